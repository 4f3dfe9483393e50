"""Token ids as Simple-8b files.

A 64-bit word is a 4-bit selector and 60 payload bits that hold as many ids as
fit at one width; an id of over 60 bits is an escape (selector 0), whose value
stands after the block's words. Blocks hold a fixed number of ids and start at
recorded word offsets, so any block decodes alone and a file decodes with a few
numpy operations per selector.

File (little-endian): ``LKS8``, version u32, ids u64, documents u64, ids per
block u32, blocks u32; per document: doc_id i64, is-null u8, ids u64; per block: words
u32, escapes u32; then all words and escapes of each block, u64.

A store is a Parquet table of such files in the shared folder (part, chunk,
first: ids before the file within its part, n_ids, payload), ordered by doc_id.

Cases: null text is empty text; every document ends with the end id, so none is
empty; very long texts are encoded in parts cut at white space; null ids come first; rows that repeat an id are ordered by a hash of
their text; extra columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_or_empty

#: Ids per word for selectors 1 to 14; widths are 60 // count.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
MAGIC, VERSION, BLOCK, FILE_IDS, SIDE = b"LKS8", 1, 1024, 1 << 20, 1024
_HEAD = np.dtype([("magic", "S4"), ("version", "<u4"), ("ids", "<u8"), ("docs", "<u8"), ("block", "<u4"), ("blocks", "<u4")])


def _best_selectors(grid: np.ndarray) -> np.ndarray:
    """For every place of every row the selector of most ids that fit there; the last 60 places are padding."""
    n = grid.shape[1] - 60
    bits = np.frexp(grid.astype(np.float64))[1].astype(np.uint8)
    peak = {1: bits}
    for w in (2, 4, 8, 16, 32):
        half = peak[w // 2]
        peak[w] = np.maximum(half[:, : half.shape[1] - w // 2], half[:, w // 2 :])
    best = np.zeros((len(grid), n), np.uint8)
    for sel in range(len(COUNTS), 0, -1):
        c = COUNTS[sel - 1]
        p = 1 << (c.bit_length() - 1)
        most = np.maximum(peak[p][:, :n], peak[p][:, c - p : c - p + n])
        np.copyto(best, np.uint8(sel), where=most <= 60 // c)
    return best


def encode_words(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u64 data, words per block, escapes per block) of unsigned 64-bit ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n_blocks = -(-len(ids) // block)
    parts, n_words, n_escapes = [], np.zeros(n_blocks, np.uint32), np.zeros(n_blocks, np.uint32)
    for b0 in range(0, n_blocks, SIDE):  # so many blocks advance side by side
        some = ids[b0 * block : (b0 + SIDE) * block]
        k = -(-len(some) // block)
        grid = np.zeros((k, block + 60), np.uint64)
        whole = len(some) // block
        grid[:whole, :block] = some[: whole * block].reshape(whole, block)
        grid[whole:, : len(some) - whole * block] = some[whole * block :]
        size = np.minimum(block, len(some) - np.arange(k) * block)
        best = _best_selectors(grid)
        step = np.array((1, *COUNTS), np.int64)
        at, live, starts = np.zeros(k, np.int64), np.arange(k), []
        while len(live):
            sel = best[live, at[live]]
            starts.append(np.stack((live, at[live], sel)))
            at[live] += step[sel]
            live = live[at[live] < size[live]]
        row, pos, sel = np.concatenate(starts, axis=1)
        order = np.argsort(row.astype(np.uint16), kind="stable")  # places of a row came in order
        row, pos, sel = row[order], pos[order], sel[order]
        words = sel.astype(np.uint64) << np.uint64(60)
        cells, flat = grid.reshape(-1), row * grid.shape[1] + pos
        for s in range(1, len(COUNTS) + 1):
            hit = np.nonzero(sel == s)[0]
            if len(hit):
                c, base, word = COUNTS[s - 1], flat[hit], words[hit]
                for lane in range(c):
                    word |= cells[base + lane] << np.uint64(lane * (60 // c))
                words[hit] = word
        cut = np.searchsorted(row, np.arange(k + 1))
        for i in range(k):
            mine = slice(cut[i], cut[i + 1])
            escapes = grid[i, pos[mine][sel[mine] == 0]]
            n_words[b0 + i], n_escapes[b0 + i] = len(words[mine]), len(escapes)
            parts += [words[mine], escapes]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), n_words, n_escapes


def decode_words(data: np.ndarray, n_words: np.ndarray, n_escapes: np.ndarray, n_ids: int, block: int = BLOCK) -> np.ndarray:
    """All ids; all blocks are decoded at once."""
    if not n_ids:
        return np.empty(0, np.uint64)
    sizes = n_words.astype(np.int64) + n_escapes
    ends = np.cumsum(sizes)
    is_word = np.ones(len(data), bool)
    for end, e in zip(ends[n_escapes > 0], n_escapes[n_escapes > 0].astype(np.int64), strict=True):
        is_word[end - e : end] = False
    words, escapes = data[is_word], data[~is_word]
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = np.array((1, *COUNTS), np.int64)[sel]
    last = np.cumsum(n_words.astype(np.int64)) - 1
    first = last - n_words + 1
    total = np.add.reduceat(count, first)
    held = np.full(len(n_words), block, np.int64)
    held[-1] = n_ids - block * (len(n_words) - 1)
    count[last] -= total - held  # a block's last word may be padded
    to = np.cumsum(count) - count
    width = np.array((0, *(60 // c for c in COUNTS)), np.uint64)[sel]
    shift = (np.arange(n_ids) - np.repeat(to, count)).astype(np.uint64) * np.repeat(width, count)
    out = (np.repeat(words, count) >> shift) & np.repeat((np.uint64(1) << width) - np.uint64(1), count)
    out[to[sel == 0]] = escapes
    return out


def encode_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, block: int = BLOCK) -> bytes:
    data, n_words, n_escapes = encode_words(ids, block)
    head = np.array([(MAGIC, VERSION, len(ids), len(doc_ids), block, len(n_words))], _HEAD)
    return b"".join((
        head.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.array(lengths, "<u8").tobytes(), n_words.astype("<u4").tobytes(), n_escapes.astype("<u4").tobytes(), data.astype("<u8").tobytes(),
    ))


def decode_file(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids per document, all ids)."""
    head = np.frombuffer(payload, _HEAD, 1)[0]
    if head["magic"] != MAGIC or head["version"] != VERSION:
        raise ValueError("not a token file of this version")
    at, docs, blocks = _HEAD.itemsize, int(head["docs"]), int(head["blocks"])

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(payload, kind, n, at)
        at += got.nbytes
        return got

    doc_ids, nulls, lengths = take("<i8", docs), take("u1", docs), take("<u8", docs)
    n_words, n_escapes = take("<u4", blocks), take("<u4", blocks)
    data = np.frombuffer(payload, "<u8", -1, at)
    ids = decode_words(data, n_words, n_escapes, int(head["ids"]), int(head["block"]))
    return [None if z else int(d) for d, z in zip(doc_ids, nulls, strict=True)], lengths.astype(np.int64), ids


def decode_block(payload: bytes, b: int) -> np.ndarray:
    """The ids of block ``b`` alone, found by its offset."""
    head = np.frombuffer(payload, _HEAD, 1)[0]
    docs, blocks, block = int(head["docs"]), int(head["blocks"]), int(head["block"])
    if not 0 <= b < blocks:
        raise IndexError(b)
    at = _HEAD.itemsize + 17 * docs
    n_words, n_escapes = np.frombuffer(payload, "<u4", blocks, at), np.frombuffer(payload, "<u4", blocks, at + 4 * blocks)
    sizes = n_words.astype(np.int64) + n_escapes
    data = np.frombuffer(payload, "<u8", int(sizes[b]), at + 8 * blocks + 8 * int(sizes[:b].sum()))
    n = block if b < blocks - 1 else int(head["ids"]) - block * (blocks - 1)
    return decode_words(data, n_words[b : b + 1], n_escapes[b : b + 1], n, block)


class PieceStore:
    """Ids of known pieces in sorted arrays, about 50 bytes a piece, looked up many at a time.

    A piece is known by its 64-bit hash and its first and last 8 bytes. Every
    batch of new pieces is a level; levels of similar size merge, and beyond
    ``most`` pieces the largest, which is the oldest, is dropped.
    """

    def __init__(self, most: int):
        self.most = most
        self.levels: list[tuple[np.ndarray, ...]] = []  # hash, head, tail, begin, size, ids

    def find(self, one: np.ndarray, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, size, ids): a piece's ids are ``size`` ids from ``begin``, which is -1 if it is not known."""
        begin, size, shift = np.full(len(one), -1, np.int64), np.zeros(len(one), np.int64), 0
        for h, a, b, begins, sizes, ids in self.levels:
            at = np.minimum(np.searchsorted(h, one), len(h) - 1)
            hit = np.nonzero((h[at] == one) & (a[at] == head) & (b[at] == tail))[0]
            begin[hit], size[hit] = begins[at[hit]] + shift, sizes[at[hit]]
            shift += len(ids)
        return begin, size, np.concatenate([np.empty(0, "<u4"), *(x[5] for x in self.levels)])

    def add(self, *level: np.ndarray) -> None:
        """``level`` as in ``levels``, in order of hashes."""
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            late, early = self.levels.pop(), self.levels.pop()
            order = np.argsort(np.concatenate((early[0], late[0])), kind="stable")
            late = (*late[:3], late[3] + len(early[5]), *late[4:])
            merged = [np.concatenate((early[k], late[k]))[order] for k in range(5)]
            self.levels.append((*merged, np.concatenate((early[5], late[5]))))
        while sum(len(x[0]) for x in self.levels) > self.most:
            self.levels.pop(0)


class WordEncoder:
    """Ids of whole texts as little-endian u32 bytes.

    Valid where no token spans ASCII white space and white space makes no
    tokens, as with a tokenizer that lowers letters and drops white space: then a
    text's ids are those of its pieces, and each distinct piece is encoded once.
    Pieces end at white space and between a letter and a mark of ``.,;:!?``.
    A-Z are lowered first, as the tokenizer would do; not so in batches with
    combining marks, which form other characters with some small letters, or with
    an added token in any letter case, which is matched before letters are lowered.
    Pieces of letters are encoded many at a time and cut apart at the tokens
    that end a word; all others, one by one. Up to ``most`` pieces are remembered.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), PieceStore(most)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix, normalizer = spec["model"].get("end_of_word_suffix"), spec.get("normalizer") or {}
        self.lowers = any(n.get("type") == "Lowercase" for n in (normalizer, *normalizer.get("normalizers", ())))
        special = [t for t in spec.get("added_tokens") or () if t.get("special") and not any(t.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized"))]
        self.added = [t["content"].encode("utf-8").lower() for t in spec.get("added_tokens") or () if not t.get("normalized")]
        self.mark, self.mark_id = (special[0]["content"], special[0]["id"]) if special else (None, None)
        self.ends = None
        if suffix:
            vocab = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True

    def _ids(self, words: list[bytes]) -> list[np.ndarray]:
        """One by one, or many at a time with a special token between them, which no piece crosses."""
        out = []
        for at in range(0, len(words), 500):
            some = words[at : at + 500]
            texts = [w.decode("utf-8") for w in some]
            if self.mark and not any(self.mark in t for t in texts):
                ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(texts)], add_special_tokens=False)[0].ids, "<u4")
                ends = np.nonzero(ids == self.mark_id)[0].tolist()
                if len(ends) == len(some) - 1:
                    out += [ids[a:b] for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(ids)], strict=True)]
                    continue
            out += [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return out

    def _letters(self, words: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(ids, sizes) of the words, in arrays of many words each."""
        out, sizes = [], []
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode("utf-8")], add_special_tokens=False)[0].ids, "<u4")
            ends = np.nonzero(self.ends[ids])[0] + 1
            if len(ends) == len(some):
                out.append(ids)
                sizes.append(np.diff(ends, prepend=0))
            else:  # a letter whose lower case is no letter alone
                one_by_one = self._ids(some)
                out += one_by_one
                sizes.append(np.fromiter(map(len, one_by_one), np.int64, len(some)))
        return out, sizes

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, size, ids) of pieces."""
        letters, others = [], []
        for i, w in enumerate(pieces):
            if self.ends is not None and (w.isalpha() or not w.isascii() and w.decode("utf-8").isalpha()):
                letters.append(i)
            else:
                others.append(i)
        ids, sizes = self._letters([pieces[i] for i in letters])
        rest = self._ids([pieces[i] for i in others])
        own = np.concatenate([np.empty(0, np.int64), *sizes, np.fromiter(map(len, rest), np.int64, len(rest))])
        order, begin, size = np.array(letters + others, np.int64), np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        begin[order], size[order] = np.cumsum(own) - own, own
        return begin, size, np.concatenate([np.empty(0, "<u4"), *ids, *rest])

    def _cut(self, texts: list[str]) -> tuple:
        """(bytes, piece starts, stops, hash, first and last 8 bytes of each, pieces per text) of a part of a batch."""
        raws = [t.encode("utf-8", "replace") for t in texts]
        raw = b" ".join((b"", *raws, b""))
        if self.lowers and b"\xcc" not in raw and b"\xcd" not in raw:
            lowered = raw.lower()
            if not any(t in lowered for t in self.added):
                raw = lowered
        data = np.frombuffer(raw, np.uint8)
        kind = _KIND[data]
        blank = kind == 0
        cut = (kind[1:] == 2) & (kind[:-1] == 1)  # a mark after a letter
        start = np.nonzero(~blank[1:] & (blank[:-1] | cut))[0] + 1
        stop = np.nonzero(~blank[:-1] & (blank[1:] | cut))[0] + 1
        upto = np.searchsorted(start, np.cumsum([1 + len(r) for r in raws]))
        eights = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))
        size = stop - start
        head = eights[start] & _LOW[np.minimum(size, 8)]
        return raw, start, stop, _piece_hashes(data, start, stop), head, np.where(size > 8, eights[stop - 8], head), np.diff(upto, prepend=0)

    @staticmethod
    def _pieces(parts: list[tuple], places: np.ndarray) -> list[bytes]:
        """The bytes of pieces, given by their places among all pieces of the parts."""
        begin = np.cumsum([0, *(len(p[1]) for p in parts)])
        of = np.searchsorted(begin, places, side="right") - 1
        out: list[bytes] = [b""] * len(places)
        for k, (raw, start, stop, *_) in enumerate(parts):
            mine = np.nonzero(of == k)[0]
            at = places[mine] - begin[k]
            for i, a, b in zip(mine.tolist(), start[at].tolist(), stop[at].tolist(), strict=True):
                out[i] = raw[a:b]
        return out

    def encode(self, texts: list[str], part: int = 400) -> tuple[np.ndarray, list[int]]:
        """(ids of all texts, ids per text).

        Equal pieces are found by a 64-bit hash and confirmed by their first and
        last 8 bytes, within a batch and among those that are known.
        """
        if not texts:
            return np.empty(0, np.uint32), []
        parts = [self._cut(texts[i : i + part]) for i in range(0, len(texts), part)]
        one, head, tail, per_text = (np.concatenate([p[k] for p in parts]) for k in (3, 4, 5, 6))
        _, first, which = np.unique(one, return_index=True, return_inverse=True)
        if not (np.array_equal(head, head[first][which]) and np.array_equal(tail, tail[first][which])):  # pieces that share a hash stay apart
            order = np.lexsort((tail, head, one))
            new = np.concatenate(([True], np.any([x[order][1:] != x[order][:-1] for x in (one, head, tail)], axis=0)))
            first, which = order[new], np.empty(len(one), np.int64)
            which[order] = np.cumsum(new) - 1
        one, head, tail = one[first], head[first], tail[first]
        begin, size, flat = self.known.find(one, head, tail)
        new = np.nonzero(begin < 0)[0]
        if len(new):
            level = self._learn(self._pieces(parts, first[new]))
            self.known.add(one[new], head[new], tail[new], *level)
            begin[new], size[new], flat = level[0] + len(flat), level[1], np.concatenate((flat, level[2]))
        n = size[which]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[which] - (ends - n), n)]
        upto = np.concatenate(([0], ends))[np.cumsum(per_text)]
        return ids, np.diff(upto, prepend=0).tolist()


#: 0 white space, 1 a-z and A-Z, 2 marks that end a word, 3 all else
_KIND = np.array([0 if c in b"\t\n\x0b\x0c\r " else 1 if bytes([c]).isalpha() else 2 if c in b".,;:!?" else 3 for c in range(256)], np.uint8)
#: Masks of the lowest 0 to 8 bytes
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MULT = 0x9E3779B97F4A7C15
_CODE = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
_CODE ^= _CODE >> np.uint64(31)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _piece_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial hashes of pieces from one running sum, brought to a common power by the inverse."""
    n = next((k for k in _powers if k >= len(data)), 1 << len(data).bit_length())
    if n not in _powers:
        base, back = np.full(n, _MULT, np.uint64), np.full(n, pow(_MULT, -1, 1 << 64), np.uint64)
        base[0] = back[0] = 1
        _powers.clear()
        _powers[n] = np.multiply.accumulate(base), np.multiply.accumulate(back)
    power, back = _powers[n]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * power[: len(data)], out=total[1:])
    h = (total[stop] - total[start]) * back[start] + (stop - start).astype(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_encoders: dict[str, WordEncoder] = {}
_BLANK = re.compile(r"[\t-\r ]")


def encoder_of(path: str) -> WordEncoder:
    """A worker's encoder, kept for its later tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def segments(text: str, most: int) -> Iterator[str]:
    """A text cut at white space into parts of about ``most`` characters; its ids are those of the parts."""
    at = 0
    while len(text) - at > most and (cut := _BLANK.search(text, at + most)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_bounded(encoder: WordEncoder, texts: list[str], rows: int = 1600, chars: int = 4 << 20) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(text, ids, is its last part) in order; so many texts and characters are encoded at a time, so memory does not follow the longest text."""
    held, size = [], 0

    def done() -> Iterator[tuple[int, np.ndarray, bool]]:
        ids, counts = encoder.encode([t for _, t, _ in held])
        stop = 0
        for (i, _, last), n in zip(held, counts, strict=True):
            stop += n
            yield i, ids[stop - n : stop], last

    for i, text in enumerate(texts):
        parts = [text] if len(text) <= chars else list(segments(text, chars))
        for k, part in enumerate(parts):
            held.append((i, part, k == len(parts) - 1))
            size += len(part)
            if size >= chars or len(held) >= rows:
                yield from done()
                held, size = [], 0
    if held:
        yield from done()


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, file_ids: int = FILE_IDS) -> DataFrame:
    """The staged store of all documents (doc_id, text), in ascending doc_id order.

    The tokenizer file must be one that drops white space (see WordEncoder).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(tokenizer_path)
        end = np.array([end_id], "<u4")
        part, chunk, first, held, names, lengths = None, 0, 0, [], [], []

        def flush():
            nonlocal chunk, first, held, names, lengths
            ids = np.concatenate(held)
            row = pd.DataFrame({"part": [part], "chunk": [chunk], "first": [first], "n_ids": [len(ids)], "payload": [encode_file(names, lengths, ids)]})
            chunk, first, held, names, lengths = chunk + 1, first + len(ids), [], [], []
            return row

        size, n = 0, 0
        for pdf in batches:
            part, ids_of = int(pdf.part.iloc[0]), list(pdf.doc_id)
            for i, got, last in encode_bounded(encoder, list(pdf.text)):
                held.append(got)
                n += len(got)
                if last:
                    held.append(end)
                    d = ids_of[i]
                    names.append(None if pd.isna(d) else int(d))
                    lengths.append(n + 1)
                    size, n = size + n + 1, 0
                    if size >= file_ids:
                        yield flush()
                        size = 0
        if names:
            yield flush()

    text = text_or_empty(F.col("text"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).repartitionByRange("doc_id", F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    return staged(ordered.mapInPandas(run, "part int, chunk int, first long, n_ids long, payload binary"), "tokens")


def read_tokens(store: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, read from the files."""
    totals = sorted((r["part"], r["n"]) for r in store.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one row a partition
    at, rows = 0, []
    for part, n in totals:
        rows.append((part, at))
        at += n
    before = F.broadcast(store.sparkSession.createDataFrame(rows, "part int, before long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start, payload in zip(pdf.start, pdf.payload, strict=True):
                doc_ids, lengths, ids = decode_file(payload)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                yield pd.DataFrame({
                    "doc_id": pd.array(doc_ids, dtype="Int64"), "start": start + ends - lengths, "n_tokens": lengths,
                    "ids_crc32": [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)],
                })

    located = store.join(before, "part").select((F.col("before") + F.col("first")).alias("start"), "payload")
    return located.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export_files(store: DataFrame, folder: str) -> int:
    """Writes every file of a store into ``folder``, a URI of any store that pyarrow opens; returns how many.

    The executors write, each file under a name of its own first, so that one
    that is lost leaves no half file and a second attempt ends in the same files.
    A local folder must be one that all executors share.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        for pdf in batches:
            for part, chunk, payload in zip(pdf.part, pdf.chunk, pdf.payload, strict=True):
                path = f"{base}/{part:06d}-{chunk:06d}.lks8"
                own = f"{path}.{uuid.uuid4().hex}"
                with files.open_output_stream(own) as f:
                    f.write(payload)
                files.move(own, path)
            yield pd.DataFrame({"n": [len(pdf)]})

    return store.select("part", "chunk", "payload").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
