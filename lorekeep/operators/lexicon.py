"""Stored token counts: the terms of a query are counted once in a text column, and every later BM25 query of them reads the counts alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CorpusStats, corpus_stats, with_counts
from ..scratch import spread, staged


class Lexicon:
    """A table of ids, n tokens and the counts of some terms (both null for null text) for each set of terms asked for so far.

    A set is counted in one pass over the texts, a row a record: no row a token
    is made, shuffled or sorted, so a first query takes the time of its scan. A
    set within one counted before reads that. Ids must be unique.
    """

    def __init__(self, df: DataFrame, ids: Sequence[str], text: str):
        self.df, self.ids, self.text = df, list(ids), text
        self._held: list[tuple[list[str], DataFrame, CorpusStats]] = []

    def _table(self, terms: Sequence[str]) -> tuple[list[str], DataFrame, CorpusStats]:
        for held in self._held:
            if set(terms) <= set(held[0]):
                return held
        texts = spread(self.df.select(*self.ids, F.col(self.text).alias("__t")), self.ids)
        counted = staged(with_counts(texts, "__t", terms).drop("__t"), "counts")
        self._held.append((list(terms), counted, corpus_stats(counted, len(terms))))
        return self._held[-1]

    def counts(self, terms: Sequence[str]) -> DataFrame:
        """ids, __dl and __tf (the count of every term) of all records."""
        held, counted, _ = self._table(terms)
        tf = F.array(*[F.get(F.col("__tf"), F.lit(held.index(t))) for t in terms]).cast("array<int>")
        return counted.select(*self.ids, "__dl", tf.alias("__tf"))

    def stats(self, terms: Sequence[str]) -> CorpusStats:
        held, _, stats = self._table(terms)
        return CorpusStats(stats.n_docs, stats.total, tuple(stats.df[held.index(t)] for t in terms))
