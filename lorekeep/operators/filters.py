"""Strict typed equality and the embedding test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import BOOL, FLOAT, INT, STR, VECTOR, Vector, canon, tag_of

_TYPES = {STR: (T.StringType,), INT: (T.ByteType, T.ShortType, T.IntegerType, T.LongType), FLOAT: (T.FloatType, T.DoubleType), BOOL: (T.BooleanType,)}


def body_equals(body: Column, field: str, value) -> Column:
    """Over a tagged body: same type and same value; a missing field equals nothing, not even null."""
    got = F.try_element_at(body, F.lit(field))
    return F.coalesce((got["tag"] == tag_of(value)) & (got["canon"] == canon(value)), F.lit(False))


def column_equals(df: DataFrame, field: str, value) -> Column:
    """Over typed columns: a plain predicate that reaches the scan, or false if the types differ.

    A null column is a missing field, so that ``= null`` keeps no row.
    """
    found = {f.name: f.dataType for f in df.schema.fields}
    tag = tag_of(value)
    if field not in found:
        return F.lit(False)
    kind = found[field]
    if tag == VECTOR and isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        return F.col(field) == F.array(*[F.lit(x).cast(kind.elementType) for x in Vector(value)])
    if not isinstance(kind, _TYPES.get(tag, ())):
        return F.lit(False)
    return F.col(field) == F.lit(value)


def text_of(body: Column, field: str) -> Column:
    """The text of a field that holds a string, else null."""
    got = F.try_element_at(body, F.lit(field))
    return F.when(got["tag"] == STR, got["canon"])


def has_embedding(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.where(F.col(column).isNotNull())
