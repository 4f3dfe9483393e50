"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder, which only a local master may use."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir is unset: executors of {master} and the driver share no temporary folder")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lorekeep-")
    return _own[app]


def fresh_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path in the shared folder that nothing uses yet; ``keep``: no ``scope`` deletes it."""
    path = f"{shared_dir(spark)}/lorekeep/{name}-{uuid.uuid4().hex}"
    if not keep:
        _made.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written once and read back: rows, partitions and order numbers are then stable for all readers.

    This cuts the lineage too, so that a lost executor costs a re-read and not a recomputation.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Up to so many bytes a table of fewer files than cores is dealt over all cores before it is worked on.
SPREAD_BYTES = 256 << 20
#: Bytes of a larger table that are worth a task, where it is dealt out by keys.
DEALT_BYTES = 32 << 20


def spread(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A small table of few files over all cores: a row group cannot be split, so a scan of one is one task.

    With ``keys``, which tell its rows apart, a larger table is dealt out by them if its row groups leave cores
    idle. Rows that come from elsewhere, and other tables of more files or bytes, stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    n_bytes = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if n_bytes > SPREAD_BYTES:
        return df.repartition(max(2 * cores, n_bytes // DEALT_BYTES), *keys) if keys and _uneven(df, cores) else df
    if not 0 < len(df.inputFiles()) < cores:
        return df
    return df.repartition(cores)


def _uneven(df: DataFrame, cores: int) -> bool:
    """Whether the largest task of a scan has over 1.5 times a core's share of its rows. They are counted without reading a column, so from footers."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        plan = plan.child()
    if plan.nodeName() != "LogicalRelation":
        return False
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    return max(rows, default=0) * cores > 1.5 * sum(rows)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was staged within. Results that are still to be read must be written before."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            delete(spark, path)
        del _made[before:]


class Growing:
    """A table that grows by parts; parts of similar size merge, so a row is rewritten about log2(rows) times at most."""

    def __init__(self, name: str):
        self.name, self.parts = name, []

    def add(self, part: DataFrame, n_rows: int) -> DataFrame:
        """Stages a part and returns it."""
        added = staged(part, self.name)
        self.parts.append((n_rows, added))
        while len(self.parts) > 1 and self.parts[-2][0] < 2 * self.parts[-1][0]:
            (n, y), (m, x) = self.parts.pop(), self.parts.pop()
            self.parts.append((m + n, staged(x.unionByName(y), self.name)))
        return added

    def read(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [part for _, part in self.parts])
