"""Retrieval metrics over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relevant_of(edges: DataFrame, query) -> DataFrame:
    """Distinct targets of ``relevant`` edges from a query record."""
    return edges.where((F.col("name") == "relevant") & (F.col("src") == F.lit(query))).select(F.col("dst").alias("id")).distinct()


def recall_precision(retrieved: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row: hits, recall, precision of the first ``k`` of ``retrieved`` (id, pos from 0).

    Recall is 1 without anything relevant, else 0 for k = 0; precision divides
    by k even if fewer rows came, and is 0 for k = 0.
    """
    n = relevant.select("id").distinct().agg(F.count("*").alias("n"))
    hits = retrieved.where(F.col("pos") < k).join(relevant.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("hits"))
    recall = F.when(F.col("n") == 0, F.lit(1.0)).when(F.lit(k) == 0, F.lit(0.0)).otherwise(F.col("hits") / F.col("n"))
    precision = F.lit(0.0) if k == 0 else F.col("hits") / F.lit(float(k))
    return hits.crossJoin(n).select("hits", recall.alias("recall"), precision.alias("precision"))
