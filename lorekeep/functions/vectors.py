"""Vector expressions; all stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import to_f32


def _fold(terms: Column, single: bool) -> Column:
    zero = F.lit(0.0).cast("float" if single else "double")
    return F.aggregate(terms, zero, lambda a, x: (a + x).cast("float") if single else a + x)


def _numbers(xs: Sequence[float], kind: str) -> Column:
    """A constant array, as one expression: a literal each would cost a call to the JVM each."""
    one = lambda x: f"{x!r}D" if math.isfinite(x) else f"double('{x}')"
    return F.expr(f"array({', '.join(one(float(x)) for x in xs)})").cast(f"array<{kind}>")


def _norms(xs: Sequence[float], single: bool) -> list[float]:
    """The norm of the first 1, 2, ... components, summed in order."""
    kind = np.float32 if single else np.float64
    with np.errstate(over="ignore", invalid="ignore"):
        squares = np.array(xs, kind) * np.array(xs, kind)
        return np.sqrt(np.add.accumulate(squares, dtype=kind).astype(np.float64)).astype(kind).tolist()


def cosine(vector: Column, query: Sequence[float], single: bool = False) -> Column:
    """Cosine similarity over the first min(len) components; 0.0 on a zero norm or a null vector.

    ``single`` rounds every step to 32 bits in order, otherwise sums are double.
    """
    if not len(query):
        return F.lit(0.0)
    kind = "float" if single else "double"
    xs = [to_f32(float(x)) for x in query]
    n = F.least(F.size(vector), F.lit(len(xs)))
    v = F.transform(F.slice(vector, F.lit(1), n), lambda x: x.cast(kind))
    dot = _fold(F.zip_with(v, F.slice(_numbers(xs, kind), F.lit(1), n), lambda a, b: (a * b).cast(kind)), single)
    norm = F.sqrt(_fold(F.transform(v, lambda a: (a * a).cast(kind)), single)).cast(kind)
    scale = (norm * F.get(_numbers(_norms(xs, single), kind), n - 1)).cast(kind)
    return F.when(vector.isNull() | (n <= 0) | (scale == 0), F.lit(0.0)).otherwise((dot / scale).cast(kind).cast("double"))
