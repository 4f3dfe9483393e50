"""Ranked retrieval over one table: score, order and cap.

Score: fused ranks (hybrid), else BM25, else the ORDER BY operator, else
similarity, else 0. Order: recency first if asked for, else score if there is
anything to score by, then record id. Cap: the least of both k and the limit,
applied after ordering.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.text import bm25, corpus_stats, query_terms, with_counts
from ..functions.vectors import cosine
from ..scratch import spread, staged
from . import ranks
from .lexicon import Lexicon
from .nearest import nearest

RRF = 60
ORDERS = ("similarity", "salience", "score", "votes", "feedback", "recency")


@dataclass(frozen=True)
class Knn:
    query: tuple[float, ...]
    k: int


@dataclass(frozen=True)
class Lexical:
    field: str
    query: str
    k: int | None = None


@dataclass(frozen=True)
class Ranking:
    knn: Knn | None = None
    lexical: Lexical | None = None
    order: str | None = None
    limit: int | None = None

    @property
    def cap(self) -> int | None:
        caps = [c for c in (self.knn and self.knn.k, self.lexical and self.lexical.k, self.limit) if c is not None]
        return min(caps) if caps else None

    @property
    def needs_votes(self) -> bool:
        hidden = self.lexical is not None  # the lexical score comes first
        return self.order in ("salience", "score", "votes", "feedback") and not hidden


def descending(score: Column) -> Column:
    """NaN has no place in the order; it goes last."""
    return F.nanvl(score, F.lit(None).cast("double")).desc_nulls_last()


def rank(records: DataFrame, ids: Sequence[str], what: Ranking, votes: DataFrame | None = None, text: Column | None = None,
         embedding: str = "embedding", created_at: str = "created_at", single: bool = False, position: bool = False, lexicon: Lexicon | None = None) -> DataFrame:
    """``records`` with ``score``, ordered and capped (and ``pos`` from 0, if ``position``).

    ``ids``: columns of ascending record id order. ``votes``: vote aggregates
    keyed by ``ids``. ``text``: the lexical field, by default the column named.
    ``lexicon``: stored token counts of exactly these records.
    """
    if what.order is not None and what.order not in ORDERS:
        raise ValueError(f"unknown order {what.order}")
    kept = records.columns
    df, by_id = records, [F.col(c).asc_nulls_first() for c in ids]
    sim = cosine(F.col(embedding), what.knn.query, single) if what.knn else None
    lexical = F.lit(0.0)  # without terms, whatever the texts are
    if what.lexical and (terms := query_terms(what.lexical.query)):
        if lexicon is not None:
            counts, stats = lexicon.counts(terms), lexicon.stats(terms)
            df = df.join(counts, list(ids), "left") if set(kept) - set(ids) else counts
        else:
            # texts are cut once: the counts are read again for the scores, and the texts are not
            df = with_counts(spread(df, ids).withColumn("__text", F.col(what.lexical.field) if text is None else text), "__text", terms).drop("__text")
            df = staged(df, "counts")
            stats = corpus_stats(df, len(terms))
        lexical = bm25(stats)
    if what.needs_votes:
        if votes is None:
            score_votes = {"laplace": F.lit(0.5), "net": F.lit(0), "feedback": F.lit(0.0)}
        else:
            df = df.join(votes.select(*ids, "laplace", "net", "feedback"), list(ids), "left")
            score_votes = {"laplace": F.coalesce("laplace", F.lit(0.5)), "net": F.coalesce("net", F.lit(0)), "feedback": F.coalesce("feedback", F.lit(0.0))}
    full = None
    if what.lexical and what.knn:
        df = df.withColumns({"__lex": lexical, "__sim": sim}).drop("__dl", "__tf")
        if (n := df.count()) > ranks.SMALL:  # ranks are taken of ids and scores; the rows come back to those that stay
            full = staged(df.withColumn("__row", F.monotonically_increasing_id()), "hybrid")
            order_by = [created_at] if what.order == "recency" else []
            df = full.select("__row", "__lex", "__sim", *dict.fromkeys([*ids, *order_by]))
        df = ranks.global_rank(df, [descending(F.col("__lex")), *by_id], "__rl", n)
        df = ranks.global_rank(df, [descending(F.col("__sim")), *by_id], "__rv", n)
        score = F.lit(1.0) / (F.lit(float(RRF)) + F.col("__rl")) + F.lit(1.0) / (F.lit(float(RRF)) + F.col("__rv"))
    elif what.lexical:
        score = lexical
    elif what.order == "salience":
        laplace = F.least(F.greatest(score_votes["laplace"], F.lit(0.0)), F.lit(1.0))
        score = F.lit(0.7) * sim + F.lit(0.3) * laplace if what.knn else laplace
    elif what.order in ("score", "votes", "feedback"):
        score = score_votes[{"score": "laplace", "votes": "net", "feedback": "feedback"}[what.order]].cast("double")
    else:
        score = sim if what.knn else F.lit(0.0)
    held = kept if full is None else ["__row", *[c for c in df.columns if c in kept]]
    df = df.select(*[F.col(f"`{c}`") for c in held], score.cast("double").alias("score"))
    if what.order == "recency":
        order = [F.col(created_at).desc_nulls_last(), *by_id]
    elif what.order or what.knn or what.lexical:
        order = [descending(F.col("score")), *by_id]
    else:
        order = by_id
    if full is not None:
        if what.cap is not None:
            df = df.orderBy(*order).limit(what.cap)
        df = full.select("__row", *[F.col(f"`{c}`") for c in kept]).join(df.select("__row", "score"), "__row").drop("__row")
    df = df.orderBy(*order)
    if what.cap is not None and full is None:
        df = df.limit(what.cap)
    if not position:
        return df
    if what.cap is not None and what.cap <= 1_000_000:
        return df.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    ranked = ranks.global_rank(df, order, "pos")
    return ranked.withColumn("pos", F.col("pos") - 1)


#: Queries of a batch search that go to every task at once, and results that a task holds for them.
BATCH, CELLS = 10_000, 1 << 24
#: Records that are worth a task.
RECORDS = 1024


def knn_batch(records: DataFrame, ids: Sequence[str], queries: DataFrame, k: int, query_id: str = "query_id", query: str = "query", embedding: str = "embedding") -> DataFrame:
    """(query_id, ids, score, rank) of the k nearest records for every row of a query set.

    A set of up to BATCH rows goes to every task; a larger one is walked in
    blocks of about as many, by a hash of the id, each staged. Records are dealt
    over all cores; a task reads its records as a stream and keeps the k best of
    each query, and of those each query's best k are cut.
    """
    size = max(min(BATCH, CELLS // max(k, 1)), 1)
    wanted, narrow = queries.select(query_id, _whole(query).alias(query)), records.select(*ids, _whole(embedding).alias("__e"))
    held = wanted.limit(size + 1).toArrow()
    if len(held) <= size:
        return _knn_block(narrow, ids, held, wanted.schema, k, query_id)
    wanted, narrow = staged(wanted, "knn-queries"), staged(narrow, "knn-records")
    parts = -(-wanted.count() // size)
    of = F.pmod(F.xxhash64(query_id), F.lit(parts))
    done = [staged(_knn_block(narrow, ids, wanted.where(of == i).toArrow(), wanted.schema, k, query_id), "knn-block") for i in range(parts)]
    return reduce(DataFrame.unionByName, done)


def _whole(vector: str) -> Column:
    """A vector of doubles; null if a component is missing."""
    return F.when(~F.exists(vector, lambda x: x.isNull()), F.col(vector).cast("array<double>"))


def _knn_block(narrow: DataFrame, ids: Sequence[str], held: pa.Table, wanted: StructType, k: int, query_id: str) -> DataFrame:
    cores = narrow.sparkSession.sparkContext.defaultParallelism
    parts = max(min(-(-narrow.count() // RECORDS), 4 * cores), 1)
    dealt = narrow.repartition(parts, *ids).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ids])
    schema = StructType([wanted[query_id], *[narrow.schema[c] for c in ids], StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in nearest(batches, held, k) if k > 0 else ():
            yield pa.RecordBatch.from_arrays(out.columns, names=schema.names)

    met = dealt.mapInArrow(run, schema)
    best = [descending(F.col("score")), *[F.col(c).asc_nulls_first() for c in ids]]
    return met.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*best))).where(F.col("rank") <= k)
