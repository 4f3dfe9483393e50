"""Exact removal of repeated byte strings with a logarithmic family of suffix arrays.

A byte is removed if a string of ``length`` bytes that covers it also starts
earlier: in a document of smaller id, or earlier in the same document. Matches
never cross documents.

Sparse suffixes. A dense suffix array has an entry for every byte, many times the
input. Here suffixes start at anchors only: places whose 32-byte hash is least in
some window of ``length`` - 31 places. The choice depends on nothing but the
bytes of the window, so equal strings of ``length`` bytes hold equal anchors at
equal offsets, and no match is missed. About one byte in 31 is an anchor.

Log family. Anchors are dealt by their 32 bytes into buckets. Within one, every
arriving batch is a suffix array: places in the order of the bytes that follow,
32 of them and then a hash of the context (all bytes of all windows that hold the
anchor). It is merge-scanned against the levels that are there; of equal contexts
the first stays in the family, the others are matches over the whole context. The
rest becomes a new level, and levels of similar size merge, so their sizes grow
geometrically. ``SuffixIndex`` keeps such levels as tables at a path: a later
batch of documents is matched against those that earlier batches left.

Fringes. Neighbours with a common prefix of 32 bytes in different contexts are
the ends of matches. Their contexts are fetched once and sorted as suffixes, and
as reversed prefixes, byte by byte; runs of common prefixes between neighbours
tell for each possible offset which strings of ``length`` bytes are equal.

Hot anchors. Anchors that alone would fill a bucket (a common line) are found in
a sample of documents, which grows with the input and decides only where entries
go: theirs are dealt by 32 bytes and context, and what is left of them, as of any
anchor of more than ``HOT_GROUP`` contexts, is compared by strings that are dealt
by their own hashes.

Cases: null text has no bytes; texts under ``length`` bytes lose nothing; rows
that repeat both id and text count as one document and get equal results; rows
that repeat an id with other text are ordered by a hash of the text; null
ids come last; texts of up to 2^31 bytes are taken whole; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import delete
from .common import skew_join, staged

LENGTH, GRAM, HOT_GROUP, BUCKET_BYTES, BLOCK_BYTES, SAMPLE_BYTES = 100, 32, 20_000, 8 << 20, 4 << 20, 32 << 20
#: Buckets at least, suffixes that arrive together, rows of one Arrow batch.
MIN_BUCKETS, BATCH, ROWS = 16, 1 << 16, 20_000
_NULL_ID = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_BYTES = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)
_POS_BITS = 31  # a text has under 2^31 bytes
_KEY = np.dtype(f"S{GRAM + 8}")  # the suffix's first bytes, then its context's hash; equal length, so compared byte by byte


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hashes of all ``n``-byte strings (a power of two) by doubling."""
    h, m = _BYTES[data], 1
    while m < n:
        h = h[:-m] * np.uint64(pow(_BASE, m, 1 << 64)) + h[m:]
        m *= 2
    return _mix(h)


def _sliding(f, x: np.ndarray, w: int) -> np.ndarray:
    m = 1
    while m * 2 <= w:
        x = f(x[:-m], x[m:])
        m *= 2
    return f(x[: len(x) - (w - m)], x[w - m :]) if m < w else x


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, slab: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, texts, hashes) of the anchors of texts that stand end to end in ``data``; found in slabs, which bounds memory."""
    w, places, hashes = length - GRAM + 1, [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for a in range(0, len(data), slab):
        lo, hi = max(a - 2 * length, 0), min(a + slab + 2 * length, len(data))
        if hi - lo < length:
            continue
        h = gram_hashes(data[lo:hi])
        low = _sliding(np.minimum, h, w)
        for end in (ends[np.searchsorted(ends, lo, side="right") : np.searchsorted(ends, hi)] - lo).tolist():  # no window spans two texts
            low[max(end - length + 1, 0) : end] = 0
        pad = np.zeros(w - 1, np.uint64)
        high = _sliding(np.maximum, np.concatenate((pad, low, pad)), w)
        at = np.nonzero((h == high) & (high > 0))[0]
        at = at[(at + lo >= a) & (at + lo < a + slab)]
        places.append(at + lo)
        hashes.append(h[at])
    at = np.concatenate(places)
    return at, np.searchsorted(ends, at, side="right"), np.concatenate(hashes)


def _context(raw: bytes, p: int, length: int) -> bytes:
    """All bytes of all windows that hold the anchor's 32 bytes."""
    return raw[max(p - (length - GRAM), 0) : p + length]


class LogFamily:
    """Levels of suffix arrays (suffix, place, is hot) in order; a suffix keeps its least place, all other places are reported."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.matched: list[np.ndarray] = []

    def add(self, suffix: np.ndarray, place: np.ndarray, hot: np.ndarray) -> None:
        order = np.argsort(place, kind="stable")
        order = order[np.argsort(suffix[order], kind="stable")]
        suffix, place, hot = suffix[order], place[order], hot[order]
        if len(suffix):
            again = np.concatenate(([False], (suffix[1:] == suffix[:-1])))
            same = np.concatenate(([False], again[1:] & (place[1:] == place[:-1])))  # the very same place
            self.matched.append(place[again & ~same])
            suffix, place, hot = suffix[~again], place[~again], hot[~again]
        for ls, lp, _ in self.levels:
            at = np.minimum(np.searchsorted(ls, suffix), len(ls) - 1)
            hit = ls[at] == suffix
            if hit.any():
                mine, theirs = place[hit], lp[at[hit]]
                self.matched.append(np.maximum(mine, theirs)[mine != theirs])
                lp[at[hit]] = np.minimum(mine, theirs)
                suffix, place, hot = suffix[~hit], place[~hit], hot[~hit]
        if len(suffix):
            self.levels.append((suffix, place, hot))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            self._merge()

    def _merge(self) -> None:
        a, b = self.levels.pop(), self.levels.pop()
        suffix, place, hot = (np.concatenate(x) for x in zip(b, a, strict=True))
        order = np.argsort(suffix, kind="stable")  # two sorted runs: one merge
        self.levels.append((suffix[order], place[order], hot[order]))

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffixes, places, is hot) that stay, as one level."""
        while len(self.levels) > 1:
            self._merge()
        return self.levels[0] if self.levels else (np.empty(0, _KEY), np.empty(0, np.uint64), np.empty(0, np.uint8))


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """For rows of bytes in order: how many bytes each has in common with the one before."""
    n, width = rows.shape
    out = np.zeros(n, np.int32)
    for at in range(1, n, 1 << 16):
        differ = rows[at : at + (1 << 16)] != rows[at - 1 : min(at - 1 + (1 << 16), n - 1)]
        out[at : at + (1 << 16)] = np.where(differ.any(1), differ.argmax(1), width)
    return out


def _doc_ranks(bat: np.ndarray, did: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rank of each, distinct batches, ids, ties): documents ordered by batch, id, then tie."""
    order = np.lexsort((tie, did, bat))
    b, d, t = bat[order], did[order], tie[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (b[1:] != b[:-1]))) if len(d) else np.empty(0, bool)
    rank = np.empty(len(did), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, b[new], d[new], t[new]


def _pack(bat, did, tie, suffix, local, pos, hot, again_local, again_pos) -> bytes:
    """Documents (batch, id, tie); suffixes in order with document, place and whether they are hot; places that a suffix of this array matches."""
    head = np.array([len(did), len(suffix), len(again_pos)], np.int64)
    key = np.ascontiguousarray(suffix).view(np.uint8).reshape(-1, GRAM + 8)  # text and hashes pack better apart
    parts = (bat.astype(np.int32), did.astype(np.int64), tie.astype(np.int64), key[:, :GRAM], key[:, GRAM:], local.astype(np.uint32), pos.astype(np.uint32), hot.astype(np.uint8), again_local.astype(np.uint32), again_pos.astype(np.uint32))
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in parts))


def _unpack(blob: bytes) -> list[np.ndarray]:
    blob = zstandard.ZstdDecompressor().decompress(blob)
    m, n, d = np.frombuffer(blob, np.int64, 3).tolist()
    at, out = 24, []
    for kind, size in ((np.int32, m), (np.int64, m), (np.int64, m), (np.uint8, n * GRAM), (np.uint8, n * 8), (np.uint32, n), (np.uint32, n), (np.uint8, n), (np.uint32, d), (np.uint32, d)):
        got = np.frombuffer(blob, kind, size, at)
        at += got.nbytes
        out.append(got)
    key = np.concatenate((out[3].reshape(-1, GRAM), out[4].reshape(-1, 8)), axis=1).reshape(-1).view(_KEY)
    return [*out[:3], key, *out[5:]]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("did"), F.xxhash64(F.col("text").cast("string")).alias("tie"), F.col("text").cast("string").alias("text"), F.col("doc_id").isNull().alias("no_id"))


def _raw(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def _texts(pdf: pd.DataFrame, length: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, bytes, np.ndarray]]:
    """(ids, ties, bytes, ends) of texts of at least ``length`` bytes, about ``block`` bytes at a time."""
    did, tie, held, size = [], [], [], 0
    for d, t, text in zip(pdf.did, pdf.tie, pdf.text, strict=True):
        raw = _raw(text)
        if len(raw) >= length:
            did.append(d)
            tie.append(t)
            held.append(raw)
            size += len(raw)
        if size >= block:
            yield np.array(did, np.int64), np.array(tie, np.int64), b"".join(held), np.cumsum([len(h) for h in held])
            did, tie, held, size = [], [], [], 0
    if held:
        yield np.array(did, np.int64), np.array(tie, np.int64), b"".join(held), np.cumsum([len(h) for h in held])


def _hot_grams(keyed: DataFrame, length: int, total: int, buckets: int) -> np.ndarray:
    """Hashes of the anchors that are more than a mean bucket in a sample of documents; at most one a bucket."""
    share = min(1.0, max(SAMPLE_BYTES / max(total, 1), 0.001))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, _, raw, ends in _texts(pdf, length, BLOCK_BYTES):
                h, n = np.unique(anchors(np.frombuffer(raw, np.uint8), ends, length)[2], return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "n": n.astype(np.int64)})

    some = keyed.where(F.pmod(F.xxhash64("did", "tie", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))).select("did", "tie", "text")
    counts = staged(some.mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "suffix-sample")
    every = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    found = counts.where((F.col("n") > every / buckets) & (F.col("n") >= 16)).select("h").collect()  # at most one a bucket
    return np.sort(np.array([r["h"] for r in found], np.int64).view(np.uint64))


def _anchor_blobs(keyed: DataFrame, length: int, buckets: int, hot_grams: np.ndarray, batch: int) -> DataFrame:
    """(bucket, blob): suffix arrays of about BLOCK_BYTES of text each, cut by bucket."""
    shared = keyed.sparkSession.sparkContext.broadcast(hot_grams)

    def cut(did, tie, raw, ends) -> pd.DataFrame:
        data = np.frombuffer(raw, np.uint8)
        at, of, h = anchors(data, ends, length)
        starts = np.concatenate(([0], ends[:-1]))
        pos = at - starts[of]
        reach, stop = np.maximum(at - (length - GRAM), starts[of]), np.minimum(at + length, ends[of])
        one = xxhash.xxh64_intdigest
        c = np.fromiter((one(raw[a:b], p) for a, b, p in zip(reach.tolist(), stop.tolist(), np.minimum(pos, length).tolist(), strict=True)), np.uint64, len(at))
        key = np.empty((len(at), GRAM + 8), np.uint8)
        for k in range(GRAM):
            key[:, k] = data[at + k]
        key[:, GRAM:] = c.astype(">u8").view(np.uint8).reshape(-1, 8)
        key = key.reshape(-1).view(_KEY)
        grams = shared.value
        hot = grams[np.minimum(np.searchsorted(grams, h), len(grams) - 1)] == h if len(grams) else np.zeros(len(h), bool)
        bucket = (np.where(hot, _mix(h ^ (c * np.uint64(_BASE))), h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        rank, _, own_did, own_tie = _doc_ranks(np.zeros(len(did), np.int32), did, tie)
        place = (rank[of].astype(np.uint64) << np.uint64(_POS_BITS)) | pos.astype(np.uint64)
        order = np.argsort(place, kind="stable")
        order = order[np.argsort(key[order], kind="stable")]
        order = order[np.argsort(bucket[order], kind="stable")]
        key, place, hot, bucket, doc, pos = key[order], place[order], hot[order], bucket[order], rank[of][order], pos[order]
        again = np.concatenate(([False], key[1:] == key[:-1])) if len(key) else np.empty(0, bool)
        same = np.concatenate(([False], again[1:] & (place[1:] == place[:-1]))) if len(key) else again
        first, later = np.nonzero(~again)[0], np.nonzero(again & ~same)[0]  # what this block matches needs no suffix any more
        cuts, late = np.searchsorted(bucket[first], np.arange(buckets + 1)), np.searchsorted(bucket[later], np.arange(buckets + 1))
        rows = []
        for k in np.nonzero(np.diff(cuts))[0]:
            i, j = first[cuts[k] : cuts[k + 1]], later[late[k] : late[k + 1]]
            docs, local = np.unique(np.concatenate((doc[i], doc[j])), return_inverse=True)
            rows.append((int(k), _pack(np.full(len(docs), batch), own_did[docs], own_tie[docs], key[i], local[: len(i)], pos[i], hot[i], local[len(i) :], pos[j])))
        return pd.DataFrame(rows, columns=["bucket", "blob"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def gathered() -> Iterator[pd.DataFrame]:
            held, size = [], 0
            for pdf in batches:
                held.append(pdf)
                size += sum(len(t) for t in pdf.text if isinstance(t, str))
                if size >= BLOCK_BYTES:
                    yield pd.concat(held)
                    held, size = [], 0
            if held:
                yield pd.concat(held)

        for pdf in gathered():
            for block in _texts(pdf, length, BLOCK_BYTES):
                yield cut(*block)

    return keyed.select("did", "tie", "text").mapInPandas(run, "bucket int, blob binary")


FOUND = "bat int, did long, tie long, pos int, kind tinyint, bucket int, level binary"


def _match_buckets(blobs: DataFrame, batch: int, keep_level: bool) -> DataFrame:
    """FOUND, by kind: 0 matched over its context, 1 to be compared with others, 2 the same in a hot group, 3 the bucket's new level.

    ``blobs`` may hold arrays of earlier batches; only this batch's matches are reported.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(b) for b in pdf.blob]
        rank, bat, did, tie = _doc_ranks(*(np.concatenate([p[k] for p in parts]) for k in range(3)))
        place_of = lambda doc, pos: (doc.astype(np.uint64) << np.uint64(_POS_BITS)) | pos.astype(np.uint64)
        family, at, done, held, n_held = LogFamily(), 0, [], [], 0
        for b, _, _, suffix, local, pos, hot, again_local, again_pos in parts:
            mine = rank[at : at + len(b)]
            at += len(b)
            held.append((suffix, place_of(mine[local], pos), hot))
            done.append(place_of(mine[again_local], again_pos))
            n_held += len(suffix)
            if n_held >= BATCH:
                family.add(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, n_held = [], 0
        if held:
            family.add(*(np.concatenate(x) for x in zip(*held, strict=True)))
        suffix, place, hot = family.settle()
        # neighbours with a common prefix of GRAM bytes
        gram = np.ascontiguousarray(suffix).view(np.uint8).reshape(-1, GRAM + 8)[:, :GRAM]
        first = np.nonzero(np.concatenate(([True], common_prefixes(gram)[1:] < GRAM)))[0] if len(gram) else np.empty(0, np.int64)
        size = np.diff(np.concatenate((first, [len(gram)])))
        doc_batch = bat[(place >> np.uint64(_POS_BITS)).astype(np.int64)] if len(place) else np.empty(0, np.int32)
        news = np.add.reduceat((doc_batch == batch).astype(np.int64), first) if len(first) else size
        count, news = np.repeat(size, size), np.repeat(news, size)
        is_open = ((count > 1) | (hot > 0)) & ((news > 0) | (hot > 0))
        kind = np.where((count[is_open] > HOT_GROUP) | (hot[is_open] > 0), 2, 1)
        every = np.concatenate((*done, *family.matched, place[is_open]))
        kinds = np.concatenate((np.zeros(len(every) - len(kind), np.int8), kind)).astype(np.int8)
        doc = (every >> np.uint64(_POS_BITS)).astype(np.int64)
        told = (kinds > 0) | (bat[doc] == batch)
        doc, every, kinds = doc[told], every[told], kinds[told]
        out = pd.DataFrame({"bat": bat[doc], "did": did[doc], "tie": tie[doc], "pos": (every & np.uint64((1 << _POS_BITS) - 1)).astype(np.int32), "kind": kinds, "bucket": np.int32(key[0]), "level": None})
        if keep_level and (mine := doc_batch == batch).any():
            own = (place[mine] >> np.uint64(_POS_BITS)).astype(np.int64)
            docs, local = np.unique(own, return_inverse=True)
            none = np.empty(0, np.uint32)
            level = _pack(bat[docs], did[docs], tie[docs], suffix[mine], local, place[mine] & np.uint64((1 << _POS_BITS) - 1), hot[mine], none, none)
            out = pd.concat([out, pd.DataFrame({"bat": [batch], "did": [0], "tie": [0], "pos": [0], "kind": [3], "bucket": [key[0]], "level": [level]})])
        return out

    return blobs.groupBy("bucket").applyInPandas(run, FOUND)


def _fetched(texts: DataFrame, places: DataFrame, length: int, buckets: int) -> DataFrame:
    """What is compared further, staged, from one pass over the texts that have places.

    Kind 1: a place with its context, by a bucket of its 32 bytes. Kind 2: a
    string of a hot group (it starts at ``pos``), by its hash ``g``.
    """
    reach, one = length - GRAM, xxhash.xxh64_intdigest
    columns = {"kind": "tinyint", "bucket": "int", "g": "long", "bat": "int", "did": "long", "tie": "long", "pos": "int", "back": "int", "ahead": "int", "ctx": "binary"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for pdf in batches:
            for n, d, t, text, at, hot in zip(pdf.bat, pdf.did, pdf.tie, pdf.text, pdf["at"], pdf.hot, strict=True):
                raw, starts = _raw(text), set()
                for p in np.asarray(at).tolist():
                    rows.append((1, xxhash.xxh32_intdigest(raw[p : p + GRAM]) % buckets, 0, n, d, t, p, min(p, reach), min(len(raw) - p, length), _context(raw, p, length)))
                for p in np.asarray(hot).tolist():
                    starts.update(range(max(p - reach, 0), min(p, len(raw) - length) + 1))
                for i in sorted(starts):
                    h = one(raw[i : i + length])
                    rows.append((2, 0, h - (1 << 64 if h >> 63 else 0), n, d, t, i, 0, 0, None))
                if len(rows) > ROWS:
                    yield pd.DataFrame(rows, columns=list(columns))
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=list(columns))

    at = lambda k: F.collect_set(F.when(F.col("kind") == k, F.col("pos")))
    lists = places.where("kind in (1, 2)").groupBy("bat", "did", "tie").agg(at(1).alias("at"), at(2).alias("hot"))
    wanted = texts.join(lists, ["bat", "did", "tie"]).select("bat", "did", "tie", "text", "at", "hot")
    return staged(wanted.mapInPandas(run, ", ".join(f"{c} {k}" for c, k in columns.items())), "suffix-fetched")


def equal_strings(before: np.ndarray, after: np.ndarray, back: np.ndarray, ahead: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For suffixes in order of place: at which offsets (rows) their string of ``length`` bytes is one that an earlier suffix has.

    ``before``: bytes before the place, last byte first; ``after``: those from it on;
    ``back`` and ``ahead`` of them are real. Suffixes are sorted by ``after`` and by
    ``before``; a string that starts o bytes before the place is known by its run
    of common prefixes of length - o bytes in one order and of o in the other.
    """
    reach, n = length - GRAM, len(back)
    again = np.zeros((reach + 3, n), np.int8)
    if not n:
        return again
    orders, prefixes = [], []
    for rows in (after, before):
        order = np.argsort(np.ascontiguousarray(rows).reshape(-1).view(f"S{rows.shape[1]}"), kind="stable")
        orders.append(order)
        prefixes.append(common_prefixes(rows[order]))
    ids = np.empty((2, n), np.int64)
    for offset in range(reach + 1):
        for k, least in ((0, length - offset), (1, offset)):
            ids[k, orders[k]] = np.cumsum(prefixes[k] < least)
        real = np.nonzero((back >= offset) & (ahead >= length - offset))[0]
        x = ids[0, real] * (n + 1) + ids[1, real]
        order = np.argsort(x, kind="stable")  # places are in order, so the first of equals comes first
        x = x[order]
        again[reach - offset + 1, real[order[1:][x[1:] == x[:-1]]]] = 1
    return again


def _fringe_spans(contexts: DataFrame, length: int) -> DataFrame:
    """bat, did, tie, start, stop: bytes covered by strings that are not the first of their kind."""
    reach = length - GRAM

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rank, *_ = _doc_ranks(pdf.bat.to_numpy(np.int32), pdf.did.to_numpy(np.int64), pdf.tie.to_numpy(np.int64))
        pdf = pdf.iloc[np.lexsort((pdf.pos.to_numpy(), rank))].drop_duplicates(["bat", "did", "tie", "pos"])  # of rows that repeat id and text
        back, ahead = pdf.back.to_numpy(np.int64), pdf.ahead.to_numpy(np.int64)
        width = reach + length
        padded = b"".join(b"\0" * (reach - b) + c + b"\0" * (width - (reach - b) - len(c)) for b, c in zip(back.tolist(), pdf.ctx, strict=True))
        rows = np.frombuffer(padded, np.uint8).reshape(-1, width)
        again = equal_strings(rows[:, :reach][:, ::-1], rows[:, reach:], back, ahead, length)
        edge = np.diff(again, axis=0)
        who, a = np.nonzero(edge.T == 1)
        _, b = np.nonzero(edge.T == -1)
        pos = pdf.pos.to_numpy(np.int64)[who] - reach
        return pd.DataFrame({"bat": pdf.bat.to_numpy()[who], "did": pdf.did.to_numpy()[who], "tie": pdf.tie.to_numpy()[who], "start": (pos + a).astype(np.int32), "stop": (pos + b - 1 + length).astype(np.int32)})

    return contexts.groupBy("bucket").applyInPandas(run, "bat int, did long, tie long, start int, stop int")


def _hot_spans(strings: DataFrame, length: int) -> DataFrame:
    """The same for hot groups: strings (g, bat, did, tie, pos) are grouped by their own hashes."""
    at = F.struct("bat", "did", "tie", "pos")
    first = strings.groupBy("g").agg(F.min(at).alias("f"), F.count("*").alias("n")).where("n > 1")
    # a string of a common line is in very many places: it is not put into one task
    later = skew_join(strings, first, "g", "n", 100_000).where(at != F.col("f"))
    return later.select("bat", "did", "tie", F.col("pos").alias("start"), (F.col("pos") + length).alias("stop"))


def _united(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate(([True], start[1:] > stop[:-1]))
    return start[new], stop[np.concatenate((np.nonzero(new)[0][1:] - 1, [len(stop) - 1]))]


def _buckets(total: int) -> int:
    return max(MIN_BUCKETS, -(-total // BUCKET_BYTES))


def _spans(keyed: DataFrame, texts: DataFrame, blobs: DataFrame, batch: int, buckets: int, length: int, keep_level: bool) -> tuple[DataFrame, DataFrame]:
    """(rows of ``keyed`` with at, starts and stops; what was found)."""
    found = staged(_match_buckets(blobs, batch, keep_level), "suffix-matches")
    fetched = _fetched(texts, found, length, buckets)
    fringes = _fringe_spans(fetched.where("kind = 1"), length)
    hot = fetched.where("kind = 2").select("g", "bat", "did", "tie", "pos")
    if hot.limit(1).count():
        fringes = fringes.unionByName(_hot_spans(hot, length))
    at = found.where("kind = 0").groupBy("did", "tie").agg(F.collect_list("pos").alias("at"))
    spans = fringes.where(F.col("bat") == batch).groupBy("did", "tie").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    return keyed.join(at, ["did", "tie"], "left").join(spans, ["did", "tie"], "left"), found


def _as_texts(keyed: DataFrame, batch: int) -> DataFrame:
    """bat, did, tie, text: the same rows as texts of a batch."""
    return keyed.select(F.lit(batch).alias("bat"), "did", "tie", "text")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """did, tie, text, no_id, at (matched anchors), starts and stops (fringes) for every row of docs (doc_id, text)."""
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    keyed = _keyed(docs)
    total = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("b")).first()["b"] or 0
    buckets = _buckets(total)
    blobs = _anchor_blobs(keyed, length, buckets, _hot_grams(keyed, length, total, buckets), 0)
    return _spans(keyed, _as_texts(keyed, 0), blobs, 0, buckets, length, False)[0]


class SuffixIndex:
    """A family of suffix arrays at a path, to which batches of documents are added.

    A batch's documents come after those of all earlier batches. Their texts stay
    in one table, a level is a table of suffix arrays by bucket; a batch is
    matched against all levels, its own suffixes become a new level, and levels
    of similar size merge. What is hot is decided by the first batch.
    """

    def __init__(self, spark: SparkSession, path: str, length: int = LENGTH, buckets: int = 64):
        if length < GRAM + 1:
            raise ValueError(f"length must be over {GRAM}")
        self.spark, self.path, self.length, self.buckets = spark, path.rstrip("/"), length, buckets
        self.levels: list[tuple[int, str]] = []  # suffixes, path
        self.batches, self.hot = 0, None

    def _level(self, blobs: DataFrame, n: int) -> None:
        path = f"{self.path}/levels/{uuid.uuid4().hex}"
        blobs.write.parquet(path)
        self.levels.append((n, path))

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("bucket int, blob binary").parquet(path)

    def add(self, docs: DataFrame) -> DataFrame:
        """What ``repeated_spans`` gives for the rows of ``docs``, with the documents of earlier batches before them."""
        batch, keyed = self.batches, _keyed(docs)
        path = f"{self.path}/texts/bat={batch}"
        keyed.write.parquet(path)
        keyed = self.spark.read.schema(keyed.schema).parquet(path)
        if self.hot is None:
            total = keyed.agg(F.sum(F.octet_length("text").cast("long")).alias("b")).first()["b"] or 0
            self.hot = _hot_grams(keyed, self.length, total, self.buckets)
        blobs = _anchor_blobs(keyed, self.length, self.buckets, self.hot, batch)
        for _, level in self.levels:
            blobs = blobs.unionByName(self._read(level))
        texts = self.spark.read.schema("did long, tie long, text string, no_id boolean, bat int").parquet(f"{self.path}/texts").select("bat", "did", "tie", "text")
        spans, found = _spans(keyed, texts, blobs, batch, self.buckets, self.length, True)
        spans = staged(spans, "suffix-spans")
        own = found.where("kind = 3").select("bucket", F.col("level").alias("blob"))
        n = own.agg(F.sum(F.length("blob")).alias("n")).first()["n"] or 0
        if n:
            self._level(own, n)
        self.batches += 1
        while len(self.levels) > 1 and self.levels[-2][0] < 2 * self.levels[-1][0]:
            (m, late), (k, early) = self.levels.pop(), self.levels.pop()
            self._level(self._read(early).unionByName(self._read(late)).groupBy("bucket").applyInPandas(_merged, "bucket int, blob binary"), m + k)
            delete(self.spark, late)
            delete(self.spark, early)
        return spans


def _merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One suffix array of those of two levels; no suffix is in both."""
    parts = [_unpack(b) for b in pdf.blob]
    bat, did, tie, suffix, local, pos, hot = (np.concatenate([p[k] for p in parts]) for k in range(7))
    shift = np.repeat(np.cumsum([0] + [len(p[0]) for p in parts[:-1]]), [len(p[3]) for p in parts])
    order, none = np.argsort(suffix, kind="stable"), np.empty(0, np.uint32)
    return pd.DataFrame({"bucket": [key[0]], "blob": [_pack(bat, did, tie, suffix[order], (local + shift)[order], pos[order], hot[order], none, none)]})


def _cuts(raw: bytes, at, starts, stops, length: int) -> tuple[np.ndarray, np.ndarray]:
    p = np.asarray(at if at is not None else (), np.int64)
    a = np.concatenate((np.maximum(p - (length - GRAM), 0), np.asarray(starts if starts is not None else (), np.int64)))
    b = np.concatenate((np.minimum(p + length, len(raw)), np.asarray(stops if stops is not None else (), np.int64)))
    return _united(a, b)


def _kept(raw: bytes, a: np.ndarray, b: np.ndarray) -> bytes:
    edges = [0, *np.stack((a, b), axis=1).ravel().tolist(), len(raw)]
    return b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, index: SuffixIndex | None = None) -> DataFrame:
    """doc_id, kept (the remaining bytes), spans (removed runs) per document; with an ``index``, against earlier batches too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, none, text, at, s, e in zip(pdf.did, pdf.no_id, pdf.text, pdf["at"], pdf.starts, pdf.stops, strict=True):
                raw = _raw(text)
                a, b = _cuts(raw, at, s, e, length)
                rows.append((None if none else int(d), _kept(raw, a, b), [{"start": int(x), "stop": int(y)} for x, y in zip(a, b, strict=True)]))
            yield pd.DataFrame(rows, columns=["doc_id", "kept", "spans"]).astype({"doc_id": "Int64"})

    return (index.add(docs) if index else repeated_spans(docs, length)).mapInPandas(run, "doc_id long, kept binary, spans array<struct<start:long,stop:long>>")


def suffix_digests(docs: DataFrame, length: int = LENGTH, index: SuffixIndex | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, none, text, at, s, e in zip(pdf.did, pdf.no_id, pdf.text, pdf["at"], pdf.starts, pdf.stops, strict=True):
                raw = _raw(text)
                a, b = _cuts(raw, at, s, e, length)
                rows.append((None if none else int(d), len(raw), int((b - a).sum()), len(a), hashlib.sha256(_kept(raw, a, b)).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})

    return (index.add(docs) if index else repeated_spans(docs, length)).mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
