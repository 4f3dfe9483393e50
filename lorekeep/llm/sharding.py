"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots, bytes are summed per slot, and a
versioned map sends slots to shards. Rebalancing edits the map: it moves slots,
and never rehashes records.

A slot that alone holds over a quarter of a mean shard (one id or one repeated
row behind a large share of the rows) is split into sub-slots, dealt by row.

Maps are rows of a table, one per slot: version, shards, slot, shard, bytes and
the shard that the slot came from in this version. Placing records writes the
first version and reads it back; with a table that has versions, the last one
is used, and a new number of shards edits it.

Cases: null text counts as no bytes; null ids hash with their text; repeated
rows are rows of their own; extra columns are kept, and one named ``shard`` is
refused; an empty table gives an empty result and a map of empty slots.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_name, fresh_path, refuse, staged

SLOTS, SPLIT, ROW_BYTES = 8192, 64, 8


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot]; ``hot`` are the slots whose rows go to sub-slots SLOTS + SPLIT * k + i, for the k-th of them."""

    n_shards: int
    shard_of: tuple[int, ...]
    hot: tuple[int, ...] = ()
    version: int = 1
    sizes: tuple[int, ...] = field(default=(), compare=False)  # bytes of each slot
    moved: tuple[tuple[int, int, int], ...] = field(default=(), compare=False)  # (slot, from, to) of this version

    def frame(self, spark: SparkSession) -> DataFrame:
        came = {s: a for s, a, _ in self.moved}
        sizes = self.sizes or (None,) * len(self.shard_of)
        rows = [(self.version, self.n_shards, s, d, b, came.get(s), list(self.hot)) for s, (d, b) in enumerate(zip(self.shard_of, sizes, strict=True))]
        return spark.createDataFrame(rows, "version int, n_shards int, vslot int, shard int, bytes long, moved_from int, hot array<int>")

    def save(self, spark: SparkSession, path: str) -> None:
        """Appends this version to the table of maps at ``path``."""
        self.frame(spark).coalesce(1).write.mode("append").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        every = spark.read.parquet(path)
        version = every.agg(F.max("version").alias("v")).first()["v"] if version is None else version
        rows = sorted(every.where(F.col("version") == version).collect(), key=lambda r: r["vslot"])  # bounded by the slots
        if not rows:
            raise ValueError(f"no version {version}")
        sizes = () if rows[0]["bytes"] is None else tuple(r["bytes"] for r in rows)
        moved = tuple((r["vslot"], r["moved_from"], r["shard"]) for r in rows if r["moved_from"] is not None)
        return cls(rows[0]["n_shards"], tuple(r["shard"] for r in rows), tuple(rows[0]["hot"]), version, sizes, moved)


def _has_maps(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_BYTES)).cast("long")


def base_slot(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.crc32(F.coalesce(text, F.lit("")))), F.lit(slots)).cast("int")


def placed_slot(base: Column, hot: tuple[int, ...], salt: Column, slots: int = SLOTS) -> Column:
    """The slot itself, or the row's sub-slot if the slot is hot."""
    if not hot:
        return base
    k = F.array_position(F.array(*[F.lit(h) for h in hot]), base)
    return F.when(k > 0, slots + SPLIT * (k - 1) + F.pmod(salt, F.lit(SPLIT))).otherwise(base).cast("int")


def assign(sizes: dict[int, int], n_slots: int, n_shards: int) -> list[int]:
    """Largest slot first to the lightest shard; empty slots are dealt in turn."""
    shard_of = [s % n_shards for s in range(n_slots)]
    heap = [(0, d) for d in range(n_shards)]
    for slot, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, d = heapq.heappop(heap)
        shard_of[slot] = d
        heapq.heappush(heap, (load + size, d))
    return shard_of


def rebalance(old: SlotMap, sizes: dict[int, int] | None = None, n_shards: int | None = None, tolerance: float = 0.02) -> SlotMap:
    """The next version: slots move from the heaviest to the lightest shard until all are within ``tolerance`` of the mean.

    A shard that is no longer there gives up all its slots first. Each move
    lowers the heavier of its two shards, so it ends. ``sizes``: bytes of slots
    now, by default those that the old map holds.
    """
    sizes = dict(enumerate(old.sizes)) if sizes is None else sizes
    n = n_shards or old.n_shards
    shard_of, moved = list(old.shard_of), []
    load, members = [0] * n, [set() for _ in range(n)]
    for s, d in enumerate(shard_of):
        if d < n:
            load[d] += sizes.get(s, 0)
            members[d].add(s)

    def move(s: int, to: int) -> None:
        moved.append((s, shard_of[s], to))
        if shard_of[s] < n:
            load[shard_of[s]] -= sizes.get(s, 0)
            members[shard_of[s]].discard(s)
        shard_of[s] = to
        load[to] += sizes.get(s, 0)
        members[to].add(s)

    for s in sorted((s for s, d in enumerate(shard_of) if d >= n), key=lambda s: (-sizes.get(s, 0), s)):
        move(s, min(range(n), key=lambda d: (load[d], d)))
    mean = sum(load) / n
    for _ in range(len(shard_of)):
        hi, lo = max(range(n), key=lambda d: (load[d], -d)), min(range(n), key=lambda d: (load[d], d))
        gap = load[hi] - load[lo]
        if load[hi] <= mean * (1 + tolerance) and load[lo] >= mean * (1 - tolerance):
            break
        fitting = [s for s in members[hi] if 0 < sizes.get(s, 0) < gap]
        if not fitting:
            break
        move(min(fitting, key=lambda s: (abs(sizes[s] - gap / 2), s)), lo)
    came = {}
    for s, a, _ in moved:  # a slot may move twice; where it came from counts
        came.setdefault(s, a)
    listed = tuple((s, a, shard_of[s]) for s, a in sorted(came.items()) if shard_of[s] != a)
    return replace(old, n_shards=n, shard_of=tuple(shard_of), version=old.version + 1, sizes=tuple(sizes.get(s, 0) for s in range(len(shard_of))), moved=listed)


def build_map(located: DataFrame, n_shards: int, slots: int = SLOTS) -> SlotMap:
    """A first map from rows (base int, size long, salt long): bytes are summed per slot, and per sub-slot of hot slots."""
    sums = located.groupBy("base").agg(F.sum("size").alias("b")).collect()  # one row a slot
    total = sum(r["b"] for r in sums)
    hot = tuple(sorted(r["base"] for r in sums if r["b"] > max(total / n_shards / 4, 0) and r["b"] > total / slots * 64))
    sizes = {r["base"]: r["b"] for r in sums if r["base"] not in hot}
    if hot:
        split = located.where(F.col("base").isin(*hot)).groupBy(placed_slot(F.col("base"), hot, F.col("salt"), slots).alias("v")).agg(F.sum("size").alias("b"))
        sizes |= {r["v"]: r["b"] for r in split.collect()}  # SPLIT rows a hot slot
    n = slots + SPLIT * len(hot)
    return SlotMap(n_shards, tuple(assign(sizes, n, n_shards)), hot, 1, tuple(sizes.get(s, 0) for s in range(n)))


def current_map(located: DataFrame, n_shards: int, slots: int = SLOTS, maps: str | None = None) -> SlotMap:
    """The last version at ``maps``, edited and saved as the next if it has another number of shards; without one, a first version.

    What is used is what was read back. By default a table of its own is made in the shared folder.
    """
    spark = located.sparkSession
    path = maps or fresh_path(spark, "slot-maps", keep=True)
    if not _has_maps(spark, path):
        build_map(located, n_shards, slots).save(spark, path)
    found = SlotMap.load(spark, path)
    if found.n_shards != n_shards:
        rebalance(found, n_shards=n_shards).save(spark, path)
        found = SlotMap.load(spark, path)
    if len(found.shard_of) != slots + SPLIT * len(found.hot):
        raise ValueError(f"the maps at {path} are not of {slots} slots")
    return found


def _located(docs: DataFrame, slots: int) -> dict[str, Column]:
    return {
        "size": record_size(F.col("text")), "base": base_slot(F.col("doc_id"), F.col("text"), slots), "salt": F.monotonically_increasing_id(),
    }


def shard_documents(docs: DataFrame, n_shards: int, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """All columns of ``docs`` and ``shard``; no row is shuffled, the map of some thousand slots is broadcast.

    ``maps``: the table of slot maps, see ``current_map``.
    """
    refuse(docs.columns, "shard")
    at = _located(docs, slots)
    found = current_map(docs.select(*[c.alias(n) for n, c in at.items()]), n_shards, slots, maps)
    name, salt = fresh_name(docs, "vslot"), fresh_name(docs, "salt")
    small = found.frame(docs.sparkSession).select(F.col("vslot").alias(name), "shard")
    # rows are numbered in a column of their own: within a condition only some would be
    numbered = docs.withColumn(salt, at["salt"])
    return numbered.withColumn(name, placed_slot(at["base"], found.hot, F.col(salt), slots)).join(F.broadcast(small), name).drop(name, salt)


def shard_placement(docs: DataFrame, n_shards: int, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version for every row.

    ``slot`` is the row's place in its shard, without gaps from 0: places
    before its virtual slot, which come from the slots' counts, plus its rank
    within the virtual slot.
    """
    narrow = staged(docs.select("doc_id", F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), *[c.alias(n) for n, c in _located(docs, slots).items()]), "shard-sizes")
    found = current_map(narrow, n_shards, slots, maps)
    placed = narrow.withColumn("vslot", placed_slot(F.col("base"), found.hot, F.col("salt"), slots))
    stats = placed.groupBy("vslot").agg(F.count("*").alias("n")).collect()  # bounded by the slots
    taken, rows = [0] * n_shards, []
    for r in sorted(stats, key=lambda r: r["vslot"]):
        d = found.shard_of[r["vslot"]]
        rows.append((r["vslot"], d, taken[d]))
        taken[d] += r["n"]
    small = docs.sparkSession.createDataFrame(rows, "vslot int, shard int, before long")
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "salt"))
    return placed.join(F.broadcast(small), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + rank - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(found.version).alias("map_version"),
    )
