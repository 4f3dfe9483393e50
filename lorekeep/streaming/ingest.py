"""Mutation files as a stream into a log. An extension: the log itself is a batch source.

Each input row names its writer and that writer's sequence number, which order
the rows of a batch; a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import global_rank
from ..sources.log import SCHEMA, LogStore

INPUT = f"source string, seq long, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in SCHEMA.fields if f.name not in ('ts', 'plan_id'))}"


def stamp(batch: DataFrame, clocks: dict[str, int], plan_id: int) -> DataFrame:
    """Log rows of a batch: logical times go on from each memory's clock, in order of (source, seq)."""
    once = batch.dropDuplicates(["source", "seq"])
    ranked = global_rank(once, [F.col("memory"), F.col("source"), F.col("seq")], "__n")
    first = ranked.groupBy("memory").agg(F.min("__n").alias("__first"))
    clock = batch.sparkSession.createDataFrame(list(clocks.items()), "memory string, __t long")
    timed = ranked.join(first, "memory").join(clock, "memory", "left")
    return timed.withColumns({"ts": F.coalesce("__t", F.lit(0)) + F.col("__n") - F.col("__first") + 1, "plan_id": F.lit(plan_id).cast("long")})


def ingest(spark: SparkSession, folder: str, store: LogStore, checkpoint: str, trigger: dict | None = None):
    """Starts a query that appends the mutation files of ``folder`` to ``store``; a batch is one plan and one commit.

    A commit names its stream (the checkpoint) and batch, so a batch that is
    replayed after a failure is known; files of a batch that was not committed
    whole are never read.
    """
    if store.path is None:
        raise ValueError("streams need a log at a path")

    def write(batch: DataFrame, batch_id: int) -> None:
        state = store.state()
        if state.streams.get(checkpoint, -1) < batch_id:
            store.append(stamp(batch, state.clocks, state.plan_id + 1), checkpoint, batch_id)

    stream = spark.readStream.schema(INPUT).parquet(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_votes(events: DataFrame, watermark: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Votes per target and window of event time (ts, target, sign), late rows within the watermark included."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", width), "target").agg(F.sum("sign").alias("net"), F.count("*").alias("n"))
