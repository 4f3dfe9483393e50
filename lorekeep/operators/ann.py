"""Vector index behind one protocol: exact by default, LSH with exact re-ranking on request."""

from __future__ import annotations

from typing import Protocol

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .ranking import Knn, Ranking, rank


class VectorIndex(Protocol):
    def rank(self, df: DataFrame, ids: list[str], query: list[float], k: int) -> DataFrame: ...


class Exact:
    """Scores every record."""

    def rank(self, df: DataFrame, ids: list[str], query: list[float], k: int) -> DataFrame:
        return rank(df, ids, Ranking(knn=Knn(tuple(query), k)))


class RandomProjection:
    """Candidates from bucketed random projections of unit vectors, ranked by exact cosine. May miss neighbours.

    Records without an embedding are candidates of score 0, as in ``Exact``.
    """

    def __init__(self, bucket: float = 1.0, tables: int = 8, seed: int = 42):
        self.bucket, self.tables, self.seed = bucket, tables, seed

    def rank(self, df: DataFrame, ids: list[str], query: list[float], k: int) -> DataFrame:
        length = sum(x * x for x in query) ** 0.5 or 1.0
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        unit = df.where("embedding is not null").withColumn("__u", array_to_vector(F.transform("embedding", lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-30)))))
        model = BucketedRandomProjectionLSH(inputCol="__u", outputCol="__h", bucketLength=self.bucket, numHashTables=self.tables, seed=self.seed).fit(unit)
        near = model.approxNearestNeighbors(unit, Vectors.dense([x / length for x in query]), k).drop("__u", "__h", "distCol")
        missing = df.where("embedding is null").orderBy(*ids).limit(k)
        scored = near.withColumn("score", cosine(F.col("embedding"), query)).unionByName(missing.withColumn("score", F.lit(0.0)))
        return scored.orderBy(F.desc("score"), *ids).limit(k)
