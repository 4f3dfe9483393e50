"""MATCH and CLOSURE over an edge table.

Edges: seq (append order), src, name, dst, weight; node ids are one column of
any orderable type. ``nodes``: the live ids, column ``id``. A step is
(direction, name, predicate); the predicate is a column over the edge table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Growing, staged
from .ranks import global_rank

Step = tuple[str, str, Column | None]
#: Up to so many edges of a walk are brought to the driver, where a level costs no job.
LOCAL_EDGES = 200_000


def directed(edges: DataFrame, step: Step) -> DataFrame:
    """near, far, seq, weight of the edges that a step may follow."""
    direction, name, predicate = step
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    kept = edges.where(F.col("name") == name)
    if predicate is not None:
        kept = kept.where(predicate)
    return kept.select(F.col(near).alias("near"), F.col(far).alias("far"), "seq", "weight")


def match(edges: DataFrame, nodes: DataFrame, start, steps: Sequence[Step]) -> DataFrame:
    """id, score, seq of the last frontier; order by seq gives the order of arrival.

    The score is the weight of the first edge that ever reached the node in the
    walk; the start counts as reached, at 0.
    """
    spark = edges.sparkSession
    frontier = nodes.where(F.col("id") == F.lit(start)).select("id", F.lit(-1).cast("long").alias("seq")).limit(1)
    seen = frontier.select("id", F.struct(F.lit(-1).alias("hop"), F.lit(-1).cast("long").alias("seq")).alias("at"), F.lit(0.0).cast("double").alias("weight"))
    small = True
    for hop, step in enumerate(steps):
        near = frontier.select(F.col("id").alias("near"))
        reached = directed(edges, step).join(F.broadcast(near) if small else near, "near", "left_semi").groupBy(F.col("far").alias("id")).agg(
            F.min("seq").alias("seq"), F.min_by(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), "seq").alias("weight")
        )
        held = reached.limit(LOCAL_EDGES + 1).collect() if small else []
        if small := small and len(held) <= LOCAL_EDGES:  # few nodes: they go to the table of nodes, not it to them
            reached = spark.createDataFrame(held, reached.schema)
            alive = {r["id"] for r in nodes.select("id").join(F.broadcast(reached.select("id")), "id", "left_semi").distinct().collect()}
            reached = spark.createDataFrame([r for r in held if r["id"] in alive], reached.schema)
        else:
            reached = staged(reached.join(nodes.select("id"), "id", "left_semi"), "reached")
        frontier = reached.select("id", "seq")
        seen = seen.unionByName(reached.select("id", F.struct(F.lit(hop).alias("hop"), F.col("seq").alias("seq")).alias("at"), "weight"))
    first = seen.groupBy("id").agg(F.min_by("weight", "at").alias("score"))
    return frontier.join(first, "id").select("id", "score", "seq")


def closure(edges: DataFrame, nodes: DataFrame, start, steps: Sequence[Step], local_edges: int = LOCAL_EDGES) -> DataFrame:
    """id, depth, pos of everything reached, start included, in order of first visit.

    Each step runs to a fixpoint before the next, which starts from all visited
    nodes but the start; depth counts levels over all steps. A walk over few
    edges is done on the driver, a larger one level by level on staged tables.
    """
    live = nodes.select("id").distinct()
    kind = nodes.schema["id"].dataType
    spark = edges.sparkSession
    if not live.where(F.col("id") == F.lit(start)).limit(1).count():
        return spark.range(0).select(F.lit(None).cast(kind).alias("id"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("pos"))
    walks = [directed(edges, s).select("near", "far", "seq").join(live.withColumnRenamed("id", "far"), "far", "left_semi") for s in steps]
    held = [w.limit(local_edges + 1).collect() for w in walks]
    if all(len(h) <= local_edges for h in held):
        rows = _walk(start, [[(r["near"], r["far"], r["seq"]) for r in h] for h in held])
        return spark.createDataFrame([(n, d, i) for i, (n, d) in enumerate(rows)], f"id {kind.simpleString()}, depth long, pos long")
    return _staged_walk(live, start, walks)


def _walk(start, steps: list[list[tuple]]) -> list[tuple]:
    order, depth = {start: 0}, 1
    for n_step, edges in enumerate(steps):
        out = defaultdict(list)
        for near, far, _ in sorted(edges, key=lambda e: e[2]):
            out[near].append(far)
        frontier = [start] if n_step == 0 else [n for n in order if n != start]
        while frontier:
            new = []
            for node in frontier:
                for far in out[node]:
                    if far not in order:
                        order[far] = depth
                        new.append(far)
            depth += bool(new)
            frontier = new
    return list(order.items())


def _staged_walk(live: DataFrame, start, walks: list[DataFrame]) -> DataFrame:
    visited = Growing("visited")
    first = visited.add(live.where(F.col("id") == F.lit(start)).select("id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("pos")), 1)
    n, depth = 1, 1
    for n_step, walk in enumerate(walks):
        walk = staged(walk, "walk")
        frontier = first if n_step == 0 else visited.read().where("pos > 0")
        while True:
            met = walk.join(frontier.select(F.col("id").alias("near"), F.col("pos").alias("ppos")), "near").groupBy(F.col("far").alias("id")).agg(F.min(F.struct("ppos", "seq")).alias("at"))
            new = staged(met.join(visited.read(), "id", "left_anti"), "level")
            count = new.count()
            if not count:
                break
            ranked = global_rank(new, [F.col("at.ppos"), F.col("at.seq")], "pos", count)
            frontier = visited.add(ranked.select("id", F.lit(depth).cast("long").alias("depth"), (F.col("pos") + (n - 1)).alias("pos")), count)
            n, depth = n + count, depth + 1
    return visited.read()
