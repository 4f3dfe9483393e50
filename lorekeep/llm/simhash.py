"""SimHash near-duplicate detection.

Fingerprints: 64 bits from the XXH64 hashes of 4-word shingles. Two texts link
if their fingerprints differ in at most ``radius`` bits; a class is a connected
component of links.

Method: tiled exact comparison. Distinct fingerprints are sorted by their bit
counts, over the whole, the two halves, the quarters and the bytes, and cut into
tiles. A tile knows the least and greatest of each count. Two fingerprints
differ in at least as many bits as their counts differ in sum, so tile pairs
whose counts lie further apart than the radius, at any of the four widths, are
skipped before anything is sent. A task has one tile and up to ``PARTNERS``
others; numpy takes the exclusive-or and its bit counts in blocks, skipping
pairs of blocks by the same test. Comparison stays exact, so it is quadratic in
distinct fingerprints in the end; the finer counts lower its constant, and more
so the denser the fingerprints lie.

A task yields a spanning forest of its links, never all pairs of a group;
forests are joined by alternating large-star and small-star steps, and nodes of
many links are not put into one task.

Cases: null and empty texts have no words and the fingerprint zero; equal texts
and repeated rows share a fingerprint and so a class; null ids take part, and a
class of null ids alone has a null class id; very long texts are hashed whole;
extra columns are ignored (``simhash_dedup`` keeps them, temporary names avoid
them); of rows that repeat id and text any one stays; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import delete
from .common import fresh_name, skew_join, spread, staged

SHINGLE, RADIUS, BLOCK, STRIP, PARTNERS, PAIRS = 4, 4, 64, 4096, 64, 1 << 20
#: Up to so many rows of two or three numbers, one key may have all of them in a task; beyond, hot keys are split.
ONE_TASK_ROWS = 20_000_000
#: Bit counts that sort fingerprints, and their bits in the sort key; the others follow from them.
_KEY = ((1, 6), (2, 6), (3, 5), (5, 5), (7, 4), (9, 4), (11, 4), (13, 4))


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = 42) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(joined[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # the bit matrix of a very long text stays small
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep`` and fp (the fingerprint's 64 bits as a signed long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t if isinstance(t, str) else None) for t in pdf.pop("text")], dtype=np.uint64)
            yield pdf.assign(fp=fps.view(np.int64))

    cols = [F.col(c).cast("long").alias(c) for c in keep]
    return spread(docs.select(*cols, F.col("text").cast("string").alias("text"))).mapInPandas(run, ", ".join([*(f"{c} long" for c in keep), "fp long"]))


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    while True:
        parent = _roots(parent)
        a, b = parent[i], parent[j]
        differ = a != b
        if not differ.any():
            return parent
        a, b = a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def bit_counts(fps: np.ndarray) -> np.ndarray:
    """Of each fingerprint (uint64) the bit counts of the whole, 2 halves, 4 quarters and 8 bytes."""
    eighths = np.bitwise_count(fps.view(np.uint8).reshape(-1, 8)).astype(np.int16)
    quarters = eighths.reshape(-1, 4, 2).sum(2, dtype=np.int16)
    halves = quarters.reshape(-1, 2, 2).sum(2, dtype=np.int16)
    return np.concatenate((halves.sum(1, dtype=np.int16)[:, None], halves, quarters, eighths), axis=1)


def sort_key(counts: np.ndarray) -> np.ndarray:
    key = np.zeros(len(counts), np.int64)
    for column, bits in _KEY:
        key = (key << bits) | counts[:, column]
    return key


def gaps(lo: np.ndarray, hi: np.ndarray, other_lo: np.ndarray, other_hi: np.ndarray) -> np.ndarray:
    """In how many bits members of boxes of counts differ at least from members of one other box."""
    g = np.maximum(0, np.maximum(lo - other_hi, other_lo - hi))
    return np.maximum.reduce([g[:, 0], g[:, 1:3].sum(1), g[:, 3:7].sum(1), g[:, 7:].sum(1)])


def _blocks(fps: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted fingerprints, least and greatest counts of each block)."""
    counts = bit_counts(fps)
    order = np.argsort(sort_key(counts), kind="stable")
    cuts, counts = np.arange(0, len(fps), block), counts[order]
    return fps[order], np.minimum.reduceat(counts, cuts), np.maximum.reduceat(counts, cuts)


def tile_links(own: np.ndarray, others: list[np.ndarray], radius: int = RADIUS, block: int = BLOCK, strip: int = STRIP) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges over the links between a tile and other tiles (uint64); ``own`` itself may be one of them."""
    none = np.empty(0, np.uint64)
    others = [o for o in others if len(o)]
    if not len(own) or not others:
        return none, none
    a, alo, ahi = _blocks(own, block)
    sides = [_blocks(o, block) for o in others]
    b, blo, bhi = (np.concatenate([s[k] for s in sides]) for k in range(3))
    # blocks do not span tiles, so the last one of a tile may be short
    before = np.cumsum([0] + [len(s[0]) for s in sides])
    begin = np.concatenate([np.arange(0, len(s[0]), block) + at for s, at in zip(sides, before[:-1], strict=True)])
    size = np.diff(np.append(begin, len(b)))
    node = np.concatenate([np.arange(len(a)) if o is own else np.arange(len(o)) + len(a) + at for o, at in zip(others, before[:-1], strict=True)])
    parent, held, n_held = np.arange(len(a) + len(b)), [], 0
    bits, far = np.empty(block * strip, np.uint64), np.empty(block * strip, np.uint8)
    for p in range(len(alo)):
        x = a[p * block : (p + 1) * block]
        hit = np.nonzero(gaps(blo, bhi, alo[p], ahi[p]) <= radius)[0]
        ends = np.cumsum(size[hit])
        at = np.arange(ends[-1] if len(hit) else 0) + np.repeat(begin[hit] - (ends - size[hit]), size[hit])
        for s in range(0, len(at), strip):
            place = at[s : s + strip]
            shape = (len(x), len(place))
            differ = np.bitwise_xor(x[:, None], b[place], out=bits[: len(x) * len(place)].reshape(shape))
            count = np.bitwise_count(differ, out=far[: len(x) * len(place)].reshape(shape))
            if count.min() > radius:
                continue
            i, j = np.nonzero(count <= radius)
            keep = differ[i, j] != 0  # not the fingerprint itself
            held.append((i[keep] + p * block, node[place[j[keep]]]))
            n_held += int(keep.sum())
            if n_held > PAIRS:
                parent, held, n_held = _unite(parent, *(np.concatenate(x) for x in zip(*held, strict=True))), [], 0
    if held:
        parent = _unite(parent, *(np.concatenate(x) for x in zip(*held, strict=True)))
    nodes = np.concatenate((a, b))
    hooked = np.nonzero(parent != np.arange(len(parent)))[0]
    return nodes[hooked], nodes[parent[hooked]]


def _count(column: Column, shift: int, width: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))).cast("long")


def link_forest(fps: DataFrame, radius: int = RADIUS, tile_rows: int | None = None, partners: int = PARTNERS) -> DataFrame:
    """Edges (u, v) that join the same classes as all links between distinct ``fp``.

    Tiles grow with the square root of the fingerprints: so does then how often one is sent.
    """
    spark, n = fps.sparkSession, fps.count()
    rows = tile_rows or int(min(max(8 * n**0.5, 1024), 131_072))
    fp = F.col("fp")
    spans = ((0, 32), (32, 32), (0, 16), (32, 16), (0, 8), (16, 8), (32, 8), (48, 8))  # of the counts in _KEY
    key = F.lit(0).cast("long")
    for (_, bits), (shift, width) in zip(_KEY, spans, strict=True):
        key = F.shiftleft(key, bits).bitwiseOR(_count(fp, shift, width))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [pdf.fp.to_numpy(np.int64) for pdf in batches]
        if parts and len(tile := np.concatenate(parts)):
            counts = bit_counts(tile.view(np.uint64)).astype(np.uint8)
            yield pd.DataFrame({"tile": [TaskContext.get().partitionId()], "lo": [counts.min(0).tobytes()], "hi": [counts.max(0).tobytes()], "fps": [tile.tobytes()]})

    tiles = fps.select("fp").repartitionByRange(max(-(-n // rows), 1), key, fp).mapInPandas(pack, "tile int, lo binary, hi binary, fps binary")
    tiles = staged(tiles, "tiles")
    boxes = sorted((r["tile"], bytes(r["lo"]), bytes(r["hi"])) for r in tiles.select("tile", "lo", "hi").collect())  # one row a tile of sqrt(n) or 131,072 rows
    ids = np.array([b[0] for b in boxes], np.int64)
    lo, hi = (np.frombuffer(b"".join(b[k] for b in boxes), np.uint8).reshape(-1, 15).astype(np.int16) for k in (1, 2))
    shared = spark.sparkContext.broadcast((ids, lo, hi))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, lo, hi = shared.value
        for pdf in batches:
            for tile, blob in zip(pdf.tile, pdf.fps, strict=True):
                me = int(np.searchsorted(ids, tile))
                near = np.nonzero(gaps(lo, hi, lo[me], hi[me]) <= radius)[0]
                # of a pair of tiles one is the task's: the lower one if their sum is even
                mine = near[(near == me) | ((near > me) == ((near + me) % 2 == 0))]
                rest = near[(near != me) & ((near > me) != ((near + me) % 2 == 0))]
                chunks = -(-len(mine) // partners)
                # a task is (its tile, a number by which its partners are dealt); its own tile goes to each
                rows = [(int(ids[me]), c, True, blob) for c in range(max(chunks, 1))]
                for t in rest.tolist():
                    theirs = np.nonzero(gaps(lo, hi, lo[t], hi[t]) <= radius)[0]
                    theirs = theirs[(theirs == t) | ((theirs > t) == ((theirs + t) % 2 == 0))]
                    rows.append((int(ids[t]), int(np.searchsorted(theirs, me)) // partners, False, blob))
                for k in range(0, len(rows), 64):
                    yield pd.DataFrame(rows[k : k + 64], columns=["task", "chunk", "own", "fps"])

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        arrays = [np.frombuffer(f, np.uint64) for f in pdf.fps]
        own = next(a for a, o in zip(arrays, pdf.own, strict=True) if o)
        others = [a for a, o in zip(arrays, pdf.own, strict=True) if not o]
        u, v = tile_links(own, others if key[1] else [own, *others], radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    # a tile is few bytes and much work: a task has about one, whatever their size
    sent = tiles.select("tile", "fps").repartition(min(max(len(ids) // 8, 1), 2000), "tile").mapInPandas(send, "task int, chunk int, own boolean, fps binary")
    return sent.repartition(min(max(len(ids), 1) * 2, 20_000), "task", "chunk").groupBy("task", "chunk").applyInPandas(compare, "u long, v long")


def _meet(big: DataFrame, small: DataFrame, key: str, rows: int) -> DataFrame:
    """``big`` (so many rows of numbers) joined with ``small`` (a row a key; n: rows of ``big`` with it)."""
    return big.join(small.drop("n"), key) if rows <= ONE_TASK_ROWS else skew_join(big, small, key, "n", max(rows // 1000, 10_000))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node on an edge (u, v); root is the least node of its component.

    Alternating large-star and small-star steps, each round written to the shared
    folder; it ends when a round changes nothing. Each step shuffles once, by
    node: sums, joins and distinct rows share that partitioning.
    """
    spark = edges.sparkSession
    edges = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if row["n"] == 0 or (row["n"], row["s"]) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        mark, parts = (row["n"], row["s"]), -(-row["n"] // 250_000)
        by_node = lambda df: df.repartition(parts, "u")  # noqa: E731, B023
        both = by_node(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = by_node(_meet(both, least, "u", 2 * row["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _meet(large, low, "u", row["n"]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        done, edges = edges, staged(by_node(small.where("u <> v")).distinct(), "links")
        delete(spark, done.inputFiles()[0].rpartition("/")[0])


def _classes(fp_table: DataFrame, id_col: str, radius: int) -> DataFrame:
    """(fp, class_id, root) over the distinct fingerprints of a staged table."""
    distinct = staged(fp_table.groupBy("fp").agg(F.min(id_col).alias("least")), "fingerprints")
    roots = components(link_forest(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.count("*").alias("n"))
    return _meet(rooted, ids, "root", distinct.count()).select("fp", "class_id", "root")


def _with_classes(fps: DataFrame, radius: int, what: str) -> DataFrame:
    """``fps`` with a column of its classes; a fingerprint may have very many rows."""
    rows, classes = fps.count(), _classes(fps, "doc_id", radius).select("fp", what)
    if rows > ONE_TASK_ROWS:
        classes = classes.join(fps.groupBy("fp").agg(F.count("*").alias("n")), "fp")
    return _meet(fps, classes, "fp", rows)


def simhash_classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, class_id (the least doc_id of the class) for every row of docs (doc_id, text)."""
    fps = staged(fingerprints(docs, "doc_id"), "simhash")
    return _with_classes(fps, radius, "class_id").select("doc_id", "fp", "class_id")


def simhash_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of every class, with all columns of ``docs``: the least (doc_id, text hash), null ids last."""
    mark, kid, kmark, one = (fresh_name(docs, x) for x in ("mark", "kid", "kmark", "one"))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text").cast("string"))
    fps = staged(fingerprints(docs.withColumn(mark, key), "doc_id", mark).withColumnRenamed(mark, "mark"), "simhash")
    first = _with_classes(fps, radius, "root").groupBy("root").agg(F.min_by(F.struct("doc_id", "mark"), F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("k"))
    kept = staged(first.select(F.col("k.doc_id").alias(kid), F.col("k.mark").alias(kmark)), "kept")
    same = lambda marked, k: (marked[mark] == k[kmark]) & marked["doc_id"].cast("long").eqNullSafe(k[kid])
    marked = docs.withColumn(mark, key)
    repeats = staged(fps.groupBy(F.col("doc_id").alias(kid), F.col("mark").alias(kmark)).agg(F.count("*").alias("n")).where("n > 1"), "repeats")
    n = repeats.agg(F.count("*").alias("n"), F.max("n").alias("most")).first()
    if not n["n"]:
        return marked.join(kept, same(marked, kept), "left_semi").drop(mark)
    # rows that repeat id and text: any one of them; they meet after one is chosen in each task
    any_one = lambda df: df.groupBy(mark, "doc_id").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(one)).select(f"{one}.*")
    hot = F.broadcast(repeats.where(F.col("n") > max(fps.count() // 1000, 10_000)))  # 1000 rows at most
    mine = hot.join(kept, (hot[kmark] == kept[kmark]) & hot[kid].eqNullSafe(kept[kid]), "left_semi")
    cold = marked.join(hot, same(marked, hot), "left_anti")
    chosen = cold.join(kept, same(cold, kept), "left_semi")
    once = chosen.join(repeats, same(chosen, repeats), "left_anti").drop(mark)
    again = chosen.join(repeats, same(chosen, repeats), "left_semi")
    heavy = marked.join(F.broadcast(mine), same(marked, mine), "left_semi")
    return once.unionByName(any_one(again)).unionByName(any_one(heavy))
