"""Shared helpers: null-safe keys, names, samples, joins with hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import fresh_path, shared_dir, spread, staged

__all__ = ["distinct_sample", "fresh_name", "fresh_path", "null_safe_key", "refuse", "shared_dir", "skew_join", "spread", "staged", "table", "text_or_empty"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_safe_key(col: Column) -> Column:
    """A string that is never null; null and the text 'null' stay apart."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), col.cast("string")))


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def distinct_sample(rows: DataFrame, max_rows: int, seed: int) -> DataFrame:
    """The distinct rows, or about ``max_rows`` of them chosen by hash where there are more, however often a row is repeated."""
    total = rows.agg(F.approx_count_distinct(F.xxhash64(*rows.columns), 0.01).alias("n")).first()["n"]
    share = min(1.0, max_rows / max(total, 1))
    return rows.where(F.pmod(F.xxhash64(*rows.columns, F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * share)).distinct()


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use, in any letter case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def refuse(df_columns: Sequence[str], *made: str) -> None:
    """An error, on the driver, if a column has the name of one that is to be made."""
    taken = {c.lower() for c in df_columns}
    if clash := [c for c in made if c.lower() in taken]:
        raise ValueError(f"the input has columns {clash}")


def skew_join(big: DataFrame, small: DataFrame, key: str, n: str, hot_rows: int, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, which has one row a key and, in ``n``, how many rows of ``big`` have that key.

    Keys of over ``hot_rows`` rows do not go to one task each: they are at most
    rows / ``hot_rows`` many, their rows of ``small`` are broadcast.
    """
    hot = F.broadcast(small.where(F.col(n) > hot_rows))
    cold = big.join(hot.select(key), key, "left_anti").join(small.where(F.col(n) <= hot_rows).drop(n), key, how)
    return cold.unionByName(big.join(hot.drop(n), key))
