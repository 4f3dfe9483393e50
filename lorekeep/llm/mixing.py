"""Mixing sources to target weights by Poisson replication.

A document's count is the inverse of a Poisson distribution, whose mean is its
source's target repetition rate, at a uniform number hashed from the seed and
the document. Each document is exploded by its count, and all copies are
shuffled globally by a hash of seed, document, copy number and place of the row.

Rates have no upper limit. Up to TABLE_RATE a source's distribution is a table
of sums from 0; above it each row sums its own, within 12 standard deviations
of the mean, as the table would outgrow a broadcast and exp(-rate) underflows.
A copy number is an int; a document of more than 2^31 - 1 copies is an error.

Cases: rows of a null source are a source of their own; null text has no bytes;
a source without bytes gets rate 0 where rates go by bytes; rows that repeat a
doc_id draw the same number, and their copies are dealt by the place of the row,
so that one repeated row does not fill one partition; extra columns are kept,
temporary names avoid them, a column named like ``copy`` is refused; an empty
table gives an empty result. Places of rows are stable where ``docs`` is read
from files; other inputs should be written first, as the pipeline does.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, null_safe_key, refuse, staged

TABLE_RATE, BROADCAST_SOURCES, SALTS, COPIES = 500.0, 10000, 64, 100_000


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) of 52 hashed bits."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k from 0 until nothing is left of the distribution in 52 bits; for rates up to TABLE_RATE."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["c"])


def poisson_inverse(rate: Column, u: Column) -> Column:
    """How many k have P(X <= k) <= u, for rates above TABLE_RATE.

    The sum starts where less than 2^-100 lies below, at a probability taken by
    its logarithm, with the series of Stirling for the factorial.
    """
    low = F.floor(rate - 12 * F.sqrt(rate))
    log_p = low * F.log1p((rate - low) / low) - (rate - low) - F.log(2 * math.pi * low) / 2 - 1 / (12.0 * low) + 1 / (360.0 * low * low * low)
    first = F.exp(log_p)
    start = F.struct(first.alias("p"), first.alias("c"), (low + (first <= u).cast("long")).alias("n"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        c = s["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), (s["n"] + (c <= u).cast("long")).alias("n"))

    return F.aggregate(F.sequence(low + 1, F.ceil(rate + 12 * F.sqrt(rate) + 20)), start, step, lambda s: s["n"])


def repetition_rates(
    docs: DataFrame, by: str = "source", weights: Mapping[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0
) -> DataFrame:
    """(key, rate) per source, staged: the mean number of copies of a document.

    Target weights are ``weights`` (share of bytes; sources not named get 0), or
    bytes to the power ``alpha``, made to sum to 1. The expected bytes of the
    mixture are ``epochs`` times those of the input. Rates have no limit.
    """
    sums = staged(docs.groupBy(null_safe_key(F.col(by)).alias("key")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("b")), "mix-sums")
    if weights is None:
        weight = F.pow(F.col("b").cast("double"), F.lit(float(alpha)))
    else:
        named = F.map_from_arrays(F.array(*[F.lit("v" + str(k)) for k in weights]), F.array(*[F.lit(float(v)) for v in weights.values()])) if weights else None
        weight = F.coalesce(F.try_element_at(named, F.col("key")), F.lit(0.0)) if weights else F.lit(0.0)
    total = sums.agg(F.sum("b").alias("b"), F.sum(F.when(F.col("b") > 0, weight)).alias("w")).first()
    if not total["b"] or not total["w"]:
        return staged(sums.select("key", F.lit(0.0).alias("rate")), "mix-rates")
    rate = F.when(F.col("b") > 0, weight / F.lit(float(total["w"])) * F.lit(float(epochs) * total["b"]) / F.col("b")).otherwise(F.lit(0.0))
    return staged(sums.select("key", F.round(rate, 9).alias("rate")), "mix-rates")


def mix(docs: DataFrame, by: str = "source", weights: Mapping[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 42, copy: str | None = None) -> DataFrame:
    """Every document as often as drawn, in a global random order, with the columns of ``docs`` (and ``copy``, from 1)."""
    if copy:
        refuse(docs.columns, copy)
    rates = repetition_rates(docs, by, weights, alpha, epochs)
    key, mean, cdf, times, block, salt, order, place = (fresh_name(docs, x) for x in ("mixkey", "mixrate", "mixcdf", "times", "block", "salt", "order", "place"))
    copy_col = copy or fresh_name(docs, "copy")
    tables = rates.select(F.col("key").alias(key), F.col("rate").alias(mean), F.when(F.col("rate") <= TABLE_RATE, poisson_cdf(F.col("rate"))).alias(cdf))
    keyed = docs.withColumns({key: null_safe_key(F.col(by)), place: F.monotonically_increasing_id()})
    if rates.count() <= BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(tables), key)
    else:  # a hot source is dealt over SALTS tasks
        salted = tables.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn(salt, F.pmod(F.xxhash64("doc_id", place), F.lit(SALTS)).cast("int")).join(salted, [key, salt]).drop(salt)
    u = uniform(seed, F.col("doc_id"))
    count = F.when(F.col(mean) <= TABLE_RATE, F.size(F.filter(cdf, lambda c: c <= u)).cast("long")).otherwise(poisson_inverse(F.col(mean), u))
    drawn = joined.withColumn(times, count).where(F.col(times) > 0).drop(key, mean, cdf)
    # copies come in blocks, so that no row holds an array of all of them
    blocks = drawn.withColumn(block, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times), F.lit(COPIES).cast("long"))))
    number = F.explode(F.sequence(F.col(block), F.least(F.col(times), F.col(block) + (COPIES - 1))))
    copies = blocks.withColumn(copy_col, number).withColumn(copy_col, F.col(copy_col).cast("int")).drop(times, block)
    shuffled = copies.withColumn(order, F.xxhash64(F.lit(seed), "doc_id", copy_col, F.crc32(F.coalesce("text", F.lit(""))), place))
    shuffled = shuffled.repartition(order).sortWithinPartitions(order).drop(order, place)
    return shuffled if copy else shuffled.drop(copy_col)
