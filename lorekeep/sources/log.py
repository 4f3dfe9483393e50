"""The append-only mutation log, which is the store, and the views derived from it."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..model import BODY, id_fields, tagged
from ..plans.nodes import CreateTable, Forget, Insert, Relate
from ..scratch import staged

SCHEMA = T.StructType([
    T.StructField("memory", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("plan_id", T.LongType()), T.StructField("op", T.StringType()),
    *id_fields(), T.StructField("body", BODY), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("created_at", T.LongType()),
    *id_fields("to_"), T.StructField("name", T.StringType()), T.StructField("weight", T.FloatType()), T.StructField("dim", T.IntegerType()),
])
ROOT = ""


def row_of(memory: str, ts: int, plan_id: int, s) -> tuple:
    """The log row of a mutating statement."""
    none5, no_edge = (None,) * 5, (None,) * 7
    head = (memory, ts, plan_id)
    decimal = lambda cols: tuple(__import__("decimal").Decimal(c) if i == 2 and c is not None else c for i, c in enumerate(cols))
    if isinstance(s, CreateTable):
        return (*head, "create", s.table, None, None, None, None, None, None, None, *no_edge, s.dim)
    if isinstance(s, Insert):
        vector = None if s.embedding is None else [float(x) for x in s.embedding]
        return (*head, "insert", *decimal(s.id.columns()), tagged(s.body), vector, s.created_at, *no_edge, None)
    if isinstance(s, Relate):
        return (*head, "relate", *decimal(s.src.columns()), tagged(s.props), None, s.created_at, *decimal(s.dst.columns()), s.name, s.weight, None)
    if isinstance(s, Forget):
        return (*head, "forget", *decimal(s.id.columns()), None, None, None, *none5, None, None, None)
    raise TypeError(f"not a mutation: {s!r}")


def frame(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), SCHEMA)


def _until(log: DataFrame, memory: str, as_of: int | None) -> DataFrame:
    kept = log.where(F.col("memory") == memory)
    return kept if as_of is None else kept.where(F.col("ts") <= as_of)


def records(log: DataFrame, memory: str = ROOT, as_of: int | None = None, table: str | None = None) -> DataFrame:
    """Live records, of one table or all: the last insert or forget of each id decides."""
    last = Window.partitionBy("rid").orderBy(F.col("ts").desc())
    rows = _until(log, memory, as_of).where(F.col("op").isin("insert", "forget"))
    if table is not None:  # below the window, so that it reaches the scan
        rows = rows.where(F.col("tbl") == table)
    kept = rows.withColumn("__n", F.row_number().over(last)).where((F.col("__n") == 1) & (F.col("op") == "insert"))
    return kept.select("tbl", "id_kind", "id_num", "id_str", "rid", "body", "embedding", "created_at")


def edges(log: DataFrame, memory: str = ROOT, as_of: int | None = None) -> DataFrame:
    """Edges that no later forget of either end removed, in append order ``seq``."""
    rows = _until(log, memory, as_of)
    made = rows.where(F.col("op") == "relate").select(
        F.col("ts").alias("seq"), F.col("rid").alias("src"), "name", F.col("to_rid").alias("dst"), "created_at", "weight", F.col("body").alias("props"),
        *[F.col(f"to_{c}") for c in ("tbl", "id_kind", "id_num", "id_str")],
    )
    gone = rows.where(F.col("op") == "forget").groupBy("rid").agg(F.max("ts").alias("__gone"))
    for end in ("src", "dst"):
        made = made.join(gone, (F.col(end) == F.col("rid")) & (F.col("seq") < F.col("__gone")), "left_anti")
    return made


@dataclass
class State:
    """What a commit leaves: the last time of every memory, the last plan, vector lengths, and the last batch of every stream."""

    clocks: dict[str, int] = field(default_factory=dict)
    plan_id: int = 0
    dims: dict[str, dict[str, int | None]] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)

    def after(self, rows: Iterable) -> State:
        """With rows of (memory, ts, plan_id, op, tbl, dim), in order of time."""
        new = State(dict(self.clocks), self.plan_id, {m: dict(d) for m, d in self.dims.items()}, dict(self.streams))
        for r in rows:
            new.clocks[r[0]] = max(r[1], new.clocks.get(r[0], 0))
            new.plan_id = max(r[2], new.plan_id)
            if r[3] == "create":
                new.dims.setdefault(r[0], {})[r[4]] = r[5]
        return new

    def declared(self, memory: str) -> dict[str, int]:
        return {t: d for t, d in self.dims.get(memory, {}).items() if d is not None}


def _told(row: Sequence) -> tuple:
    names = SCHEMA.fieldNames()
    return (*row[:4], row[names.index("tbl")], row[names.index("dim")])


class LogStore:
    """A log at a path or in memory.

    At a path, rows are Parquet files in folders of ``data``; a folder counts
    once an entry of ``commits`` names it. Entries are numbered JSON files, moved
    into place when whole, so a commit of any number of files is there or not,
    and what a writer left when it died is never read. Each entry has the state
    after it. Every ``checkpoint_every`` entries all rows are rewritten into one
    folder, sorted by memory, table and time; the entry of that commit replaces
    those before. One writer at a time: an entry whose number is taken is an error.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, checkpoint_every: int = 64):
        self.spark, self.path, self.rows, self.checkpoint_every = spark, path and path.rstrip("/"), [], checkpoint_every
        self._seen: tuple[int, list[str], State] = (0, [], State())
        self._known: DataFrame | None = None

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _entry(self, n: int) -> dict:
        fs, p = self._fs(f"{self.path}/commits/{n:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _refresh(self) -> tuple[int, list[str], State]:
        """(last entry, folders, state)."""
        if self.path is None:
            return self._seen
        fs, p = self._fs(f"{self.path}/commits")
        names = sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []
        numbers = [int(n[:-5]) for n in names if re.fullmatch(r"[0-9]{12}\.json", n)]
        if numbers and numbers[-1] != self._seen[0]:
            last = self._entry(numbers[-1])
            folders, at = [], len(numbers) - 1
            while at >= 0:
                entry = last if at == len(numbers) - 1 else self._entry(numbers[at])
                folders.append(entry["folder"])
                if entry["whole"]:
                    break
                at -= 1
            state = State(last["clocks"], last["plan_id"], last["dims"], last["streams"])
            self._seen, self._known = (numbers[-1], folders[::-1], state), None
        return self._seen

    def state(self) -> State:
        return self._refresh()[2]

    def folders(self) -> int:
        """How many folders a read goes over."""
        return len(self._refresh()[1])

    def read(self) -> DataFrame:
        if self.path is None:
            return frame(self.spark, self.rows)
        _, folders, _ = self._refresh()
        if self._known is None:
            self._known = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/data/{f}" for f in folders]) if folders else frame(self.spark, [])
        return self._known

    def _publish(self, folder: str, state: State, whole: bool = False) -> None:
        n = self._seen[0] + 1
        entry = {"folder": folder, "whole": whole, "clocks": state.clocks, "plan_id": state.plan_id, "dims": state.dims, "streams": state.streams}
        fs, at = self._fs(f"{self.path}/commits/{n:012d}.json")
        _, own = self._fs(f"{self.path}/commits/.{n:012d}-{uuid.uuid4().hex}")
        out = fs.create(own, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if fs.exists(at) or not fs.rename(own, at):
            raise RuntimeError(f"another writer made entry {n} of {self.path}")

    def commit(self, rows: Sequence[tuple]) -> None:
        """All rows of a plan or none."""
        if not rows:
            return
        state = self.state().after(map(_told, rows))
        if self.path is None:
            self.rows, self._seen = [*self.rows, *rows], (self._seen[0] + 1, [], state)
            return
        folder = uuid.uuid4().hex
        frame(self.spark, rows).coalesce(1).write.parquet(f"{self.path}/data/{folder}")
        self._publish(folder, state)
        self._tidy()

    def append(self, df: DataFrame, stream: str | None = None, batch: int = 0) -> bool:
        """A commit of log rows that are too many for the driver; False if it is a stream's batch that is there already."""
        if self.path is None:
            raise ValueError("a log in memory takes rows, not DataFrames")
        state = self.state()
        if stream is not None and state.streams.get(stream, -1) >= batch:
            return False
        folder = uuid.uuid4().hex
        df.select(*SCHEMA.fieldNames()).write.parquet(f"{self.path}/data/{folder}")
        made = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/data/{folder}")
        last = made.groupBy("memory").agg(F.max("ts").alias("ts"), F.max("plan_id").alias("p")).collect()  # one row a memory
        tables = made.where("op = 'create'").groupBy("memory", "tbl").agg(F.max("ts").alias("ts"), F.max_by("dim", "ts").alias("dim")).collect()
        state = state.after([(r["memory"], r["ts"], r["p"], "", None, None) for r in last] + [(r["memory"], r["ts"], 0, "create", r["tbl"], r["dim"]) for r in tables])
        if stream is not None:
            state.streams[stream] = batch
        self._publish(folder, state)
        self._tidy()
        return True

    def _tidy(self) -> None:
        if len(self._refresh()[1]) > self.checkpoint_every:
            self.checkpoint()

    def checkpoint(self) -> None:
        """All rows in one folder, in place. Entries and folders of before go; a reader that still reads them reads again."""
        n, folders, state = self._refresh()
        if self.path is None or not folders:
            return
        folder = uuid.uuid4().hex
        _sorted(self.read()).write.parquet(f"{self.path}/data/{folder}")
        self._publish(folder, state, whole=True)
        self._refresh()
        fs, p = self._fs(f"{self.path}/commits")
        for f in fs.listStatus(p):
            if f.getPath().getName() < f"{n + 1:012d}.json":
                fs.delete(f.getPath(), False)
        for f in fs.listStatus(self._fs(f"{self.path}/data")[1]):
            if f.getPath().getName() != folder:  # also what never was committed
                fs.delete(f.getPath(), True)

    def compact(self, path: str) -> LogStore:
        """The same log at another path, which must be empty, sorted for pruned reads."""
        other = LogStore(self.spark, path, self.checkpoint_every)
        if other._refresh()[0]:
            raise ValueError(f"{path} holds a log")
        folder = uuid.uuid4().hex
        _sorted(self.read()).write.mode("errorifexists").parquet(f"{other.path}/data/{folder}")
        other._publish(folder, self.state(), whole=True)
        return other

    def snapshot(self, memory: str = ROOT, as_of: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(records, edges), written once, for many reads of one point in time."""
        log = self.read()
        return staged(records(log, memory, as_of), "records"), staged(edges(log, memory, as_of), "edges")


def _sorted(log: DataFrame) -> DataFrame:
    """By memory, table and time, so that the statistics of row groups prune reads."""
    return log.repartitionByRange("memory", "tbl", "ts").sortWithinPartitions("memory", "tbl", "ts")
