"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Method: each rule's cost (seconds) and selectivity (share rejected) are
estimated on a bounded sample; rules run in the order of rejections per cost and
a later rule is evaluated only for rows that all earlier rules keep. The order
changes cost alone: a row is kept if no rule rejects it.

The sample is drawn by a scan with as many tasks as the table has splits; of a
table of many files it reads ``SAMPLE_FILES``, chosen by hash.

Cases: null text has no words, like empty text, and fails ``few_words``; a very
long text is one row of arrays of its words; repeated rows are judged alike; an
empty table gives an empty result; columns of the input keep their names, and
clashing names are avoided for temporary columns.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, refuse, spread, staged, text_or_empty

SPACES = " \t\n\x0b\x0c\r"
SAMPLE_FILES = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text; ``trim`` first, so that no piece is empty but for a text without words."""
    trimmed = F.trim(text, F.lit(SPACES))
    return F.when(F.octet_length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def n_words(ws: Column) -> Column:
    return F.size(ws).cast("long")


def word_chars(text: Column) -> Column:
    return F.char_length(text).cast("long") - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.octet_length(F.trim(line, F.lit(SPACES))) > 0)


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    return let(_lines(text), lambda ls: (F.size(ls) - F.size(F.array_distinct(ls)))).cast("long")


def n_repeat_words(ws: Column, width: int = 5) -> Column:
    """Words in windows of ``width`` words that occur twice or more in the text.

    Windows are compared by a 64-bit hash of their words. Texts without a
    repeated window, which are most, stop at a distinct count.
    """

    def positions(s: Column) -> Column:  # s: (hash, position) in order
        twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def repeated(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.array_sort(pairs), lambda s: let(positions(s), covered)))

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    return F.when(F.size(ws) <= width, F.lit(0)).otherwise(let(hashes(ws), repeated)).cast("long")


class Measures:
    """What rules look at, of a text that is never null and its words; ``known``: measures that are columns already."""

    def __init__(self, text: Column, ws: Column | None, **known: Column):
        self.text, self.ws, self.known = text, ws, known

    def __getattr__(self, name: str) -> Column:
        if name in self.known:
            return self.known[name]
        if name in ("n_words", "n_repeat_words"):
            return globals()[name](self.ws)
        if name in ("word_chars", "n_symbols", "n_dup_lines", "n_lines"):
            return globals()[name](self.text)
        raise AttributeError(name)


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps measures to a boolean column."""

    name: str
    rejects: Callable[[Measures], Column]


#: The first two are the base rules; the limits of the others lie far from running prose.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda m: m.n_words < 10),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words > 20 * m.n_words),
    Rule("symbols", lambda m: 100 * m.n_symbols > 10 * m.n_words),
    Rule("shouting", lambda m: 100 * F.regexp_count(m.text, F.lit("!!")) > 20 * m.n_words),
    Rule("repeated_lines", lambda m: 100 * m.n_dup_lines > 30 * m.n_lines),
    Rule("word_length", lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 25 * m.n_words)),
)
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class RuleCost:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def _sampled_files(docs: DataFrame) -> DataFrame:
    """The rows of SAMPLE_FILES of the files that ``docs`` scans, where it scans more and its rows know their file."""
    files = docs.inputFiles()
    if len(files) <= SAMPLE_FILES:
        return docs
    chosen = sorted(files, key=lambda f: zlib.crc32(f.encode()))[:SAMPLE_FILES]
    chosen += [f.replace("file:///", "file:/", 1) for f in chosen if f.startswith("file:///")]  # a row's own path has one slash
    try:
        some = docs.where(F.col("_metadata.file_path").isin(chosen))
        return some if some.limit(1).count() else docs
    except AnalysisException:
        return docs


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 1000) -> list[RuleCost]:
    """Cost and selectivity of each rule on about ``sample_rows`` rows, best rejection per cost first.

    Words are cut once for all rules, so they belong to no rule's cost.
    """
    some = _sampled_files(docs)
    total = some.count()
    share = min(1.0, sample_rows / total) if total else 1.0
    # rows are sampled where they are scanned; only the sample meets in two tasks
    picked = some.select(text_or_empty(F.col("text")).alias("text")).sample(share, seed=7).repartition(2)
    sample = staged(picked.withColumn("w", words(F.col("text"))), "quality-sample")
    n = max(sample.count(), 1)
    found = []
    for rule in rules:
        hits = sample.agg(F.count_if(rule.rejects(Measures(F.col("text"), F.col("w")))).alias("hits"))
        rejected = hits.first()["hits"] / n  # also warms the compiled code up
        began = time.perf_counter()
        hits.first()
        found.append(RuleCost(rule, time.perf_counter() - began, rejected))
    return sorted(found, key=lambda c: (-c.rank, c.rule.name))


def cascade(measures: Measures, ordered: Sequence[Rule]) -> Column:
    """The name of the first rule, in this order, that rejects; null if none does."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(ordered):
        verdict = F.when(rule.rejects(measures), F.lit(rule.name)).otherwise(verdict)
    return verdict


def first_rejection(text: Column, ordered: Sequence[Rule]) -> Column:
    """``cascade`` over a text whose words are cut once."""
    return let(words(text), lambda w: cascade(Measures(text, w), ordered))


def quality_verdicts(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 1000, column: str = "rejected_by") -> DataFrame:
    """All columns of ``docs`` and ``column``: which rule of the cascade rejects the row first, or null."""
    refuse(docs.columns, column)
    ordered = [c.rule for c in estimate(docs, rules, sample_rows)]
    return spread(docs).withColumn(column, first_rejection(text_or_empty(F.col("text")), ordered))


def quality_filter(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 1000) -> DataFrame:
    """The rows that every rule keeps, with the columns of ``docs``."""
    name = fresh_name(docs, "rejected_by")
    return quality_verdicts(docs, rules, sample_rows, name).where(F.col(name).isNull()).drop(name)


def quality_report(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 1000) -> DataFrame:
    """doc_id, the base measures, base_failed and kept, for every row of docs (doc_id, text).

    The measures are taken once; the cascade of the other rules runs over them,
    for the rows that the base rules keep.
    """
    ordered = [c.rule for c in estimate(docs, [r for r in rules if r.name not in BASE], sample_rows)]
    t = F.col("t")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def measured(w: Column) -> Column:
        m = Measures(t, w)
        lines = let(_lines(t), lambda ls: F.struct(F.size(ls).cast("long").alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup")))
        return F.struct(*[getattr(m, n).alias(n) for n in names if n != "n_dup_lines"], lines.alias("lines"))

    rows = spread(docs.select("doc_id", text_or_empty(F.col("text")).alias("t"))).select("doc_id", "t", let(words(t), measured).alias("m"))
    known = {n: F.col(f"m.{n}") for n in names if n != "n_dup_lines"} | {"n_dup_lines": F.col("m.lines.dup"), "n_lines": F.col("m.lines.n")}
    failed = (known["n_words"] < 10) | (100 * known["n_repeat_words"] > 20 * known["n_words"])
    kept = F.when(failed, F.lit(False)).otherwise(cascade(Measures(t, None, **known), ordered).isNull())
    return rows.select("doc_id", *[known[n].alias(n) for n in names], failed.alias("base_failed"), kept.alias("kept"))
