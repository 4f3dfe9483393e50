"""Typed tables: any DataFrame as a record source, its columns as fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import column_equals
from ..operators.lexicon import Lexicon
from ..operators.ranking import Ranking, rank
from ..operators.votes import vote_aggregates
from ..plans.nodes import FieldEquals, HasEmbedding, Select


@dataclass(frozen=True)
class RecordSource:
    name: str
    df: DataFrame
    id: str
    embedding: str | None = None
    created_at: str | None = None
    lexicon: Lexicon | None = None  # stored token counts of one of its columns

    def votes(self, cast: DataFrame) -> DataFrame:
        """Aggregates of votes on this table's records (``mine``), keyed by the id column.

        A whole number names the record of that number, a text the record of that name.
        """
        kind = self.df.schema[self.id].dataType
        key = F.col("id_str") if isinstance(kind, T.StringType) else F.col("id_num").cast(kind)
        keyed = cast.withColumn(self.id, F.when(F.col("mine"), key))
        return vote_aggregates(keyed, [self.id]).where(F.col(self.id).isNotNull())

    def select(self, what: Select, votes: DataFrame | None = None, **more) -> DataFrame:
        """A SELECT over this table; ``votes``: aggregates keyed by the id column."""
        df = self.df
        if isinstance(what.where, FieldEquals):
            df = df.where(column_equals(df, what.where.field, what.where.value))
        elif isinstance(what.where, HasEmbedding):
            df = df.where(F.col(self.embedding).isNotNull()) if self.embedding else df.limit(0)
        if what.fields:
            need = {*what.fields, self.id, self.embedding, self.created_at, what.lexical and what.lexical.field}
            df = df.select(*[c for c in df.columns if c in need])
        if what.lexical and self.lexicon and what.lexical.field == self.lexicon.text and what.where is None:
            more["lexicon"] = self.lexicon
        ranking = Ranking(what.knn, what.lexical, what.order, what.limit)
        return rank(df, [self.id], ranking, votes, embedding=self.embedding or "embedding", created_at=self.created_at or "created_at", **more)


def parquet(spark: SparkSession, path: str, name: str, id: str, **columns) -> RecordSource:
    return RecordSource(name, spark.read.parquet(path), id, **columns)
