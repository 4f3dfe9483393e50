"""Tokens and BM25 as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of Okapi BM25.
K1, B = 1.2, 0.75
SEPARATOR = r"[^\p{IsAlphabetic}\p{N}]+"


def _pieces(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATOR), "")


def tokenize(text: Column) -> Column:
    """Runs of letters and digits, each lowered.

    Lowering a whole text first is the same and faster, but for two letters
    whose lower case splits a word or depends on what stands around it.
    """
    odd = text.contains("\u0130") | text.contains("\u03a3")
    return F.when(odd, F.transform(_pieces(text), F.lower)).otherwise(_pieces(F.lower(text)))


def query_terms(query: str) -> list[str]:
    """Distinct lowered tokens of a query in order of appearance."""
    return list(dict.fromkeys(t.lower() for t in regex.split(r"[^\p{Alphabetic}\p{N}]+", query) if t))


@dataclass(frozen=True)
class CorpusStats:
    n_docs: int
    total: int
    df: tuple[int, ...]

    @property
    def avgdl(self) -> float:
        return max(self.total / self.n_docs, 1.0) if self.n_docs else 1.0


def with_counts(df: DataFrame, text: str, terms: Sequence[str], dl: str = "__dl", tf: str = "__tf") -> DataFrame:
    """Adds the token count (null for null text) and the count of every term."""
    counts = F.transform(F.array(tokenize(F.col(text))), lambda ts: F.struct(
        F.size(ts).alias("n"), F.array(*[F.size(ts) - F.size(F.array_remove(ts, q)) for q in terms]).cast("array<int>").alias("tf"),
    ))
    counted = df.withColumn("__c", F.when(F.col(text).isNotNull(), F.get(counts, F.lit(0))))
    return counted.withColumns({dl: F.col("__c.n"), tf: F.col("__c.tf")}).drop("__c")


def corpus_stats(counted: DataFrame, n_terms: int, dl: str = "__dl", tf: str = "__tf") -> CorpusStats:
    """One row to the driver: documents with text, tokens, and documents that hold each term."""
    df = [F.count_if(F.get(F.col(tf), F.lit(i)) > 0).alias(f"d{i}") for i in range(n_terms)]
    r = counted.agg(F.count(dl).alias("n"), F.coalesce(F.sum(dl), F.lit(0)).alias("t"), *df).first()
    return CorpusStats(r["n"], r["t"], tuple(r[f"d{i}"] for i in range(n_terms)))


def bm25(stats: CorpusStats, dl: str = "__dl", tf: str = "__tf") -> Column:
    """Okapi BM25, terms added left to right; 0.0 without text or tokens."""
    score = F.lit(0.0)
    for i, df in enumerate(stats.df):
        held = max(df, 1)
        idf = math.log(1 + (stats.n_docs - held + 0.5) / (held + 0.5))
        f = F.get(F.col(tf), F.lit(i)).cast("double")
        norm = f + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col(dl) / F.lit(stats.avgdl))
        score = score + F.when(f > 0, F.lit(idf) * (f * F.lit(K1 + 1)) / norm).otherwise(F.lit(0.0))
    return F.when(F.col(dl) > 0, score).otherwise(F.lit(0.0))
