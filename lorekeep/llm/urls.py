"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

Everything runs in the JVM: features are column expressions, trees are
``pyspark.ml``'s, trained on a bounded sample of labelled URLs.

Up to ``INLINE_RULES`` rules are tested by one expression. More go into a table
by host: the distinct hosts of the pages meet it by their suffixes, and a page
is tested against the rules of its own host only. Both ways give the same rows.

Cases: a null or malformed URL (no ``://``) has empty host and path, fits no
rule and is scored on zero features; of rules of equal length the greatest text
wins; repeated rows get equal verdicts; URLs of any length are judged whole;
without two classes of labelled URLs there is nothing to learn and the rest is
allowed; extra columns of the input are kept, temporary names avoid them, and
columns named host, path, rule or verdict are refused; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distinct_sample, fresh_name, refuse, staged

INLINE_RULES, MAX_TRAIN_ROWS = 1000, 20000
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "suffix_length", "suffix_rate")


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    allow: bool

    @classmethod
    def parse(cls, text: str, allow: bool) -> UrlRule:
        host, slash, rest = text.partition("/")
        return cls(host, slash + rest, allow)

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s)(.*?)://([^/?#]*)", 2)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def fits(rule: UrlRule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def rule_verdict(rules: Sequence[UrlRule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule text, allowed) of the longest rule that fits; nulls if none does."""
    name, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is tested first
        hit = fits(r, host, path)
        name, allow = F.when(hit, F.lit(r.text)).otherwise(name), F.when(hit, F.lit(r.allow)).otherwise(allow)
    return name, allow


def with_rules(pages: DataFrame, rules: Sequence[UrlRule], host: str, path: str, rule: str, allow: str) -> DataFrame:
    """Adds ``rule`` and ``allow``: text and verdict of the longest rule that fits."""
    if len(rules) <= INLINE_RULES:
        name, allowed = rule_verdict(rules, F.col(host), F.col(path))
        return pages.withColumns({rule: name, allow: allowed})
    spark, own, fit = pages.sparkSession, fresh_name(pages, "rules"), fresh_name(pages, "fit")
    table = spark.createDataFrame([(r.host, len(r.text), r.text, r.path, r.allow) for r in rules], "rule_host string, size int, text string, path string, allow boolean")
    hosts = pages.select(F.col(host).alias("h")).distinct()
    labels = F.split("h", r"\.", -1)
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    entry = F.struct("size", "text", "path", "allow")
    found = staged(hosts.select("h", suffix.alias("rule_host")).join(table, "rule_host").groupBy("h").agg(F.sort_array(F.collect_set(entry), asc=False).alias(own)), "url-rules")
    joined = pages.join(found.withColumnRenamed("h", fit), F.col(host) == F.col(fit), "left").drop(fit)
    first = F.get(F.filter(own, lambda r: F.col(path).startswith(r["path"])), F.lit(0))
    return joined.withColumn(fit, first).withColumns({rule: F.col(fit)["text"], allow: F.col(fit)["allow"]}).drop(own, fit)


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def lexical(url: Column, host: Column, path: Column, suffix_rate: Column) -> Column:
    """FEATURES as an array of doubles."""
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.char_length(u), F.lit(1)).cast("double")
    count = lambda x, c: F.char_length(x) - F.char_length(F.replace(x, F.lit(c), F.lit("")))
    shares = F.transform(F.array_distinct(F.split(u, "")), lambda c: (F.char_length(u) - F.char_length(F.replace(u, c, F.lit("")))) / n)
    entropy = F.aggregate(shares, F.lit(0.0), lambda a, s: a + F.when(s > 0, -s * F.log2(s)).otherwise(F.lit(0.0)))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    found = (
        F.char_length(u), F.char_length(host), F.char_length(path), count(path, "/"), count(host, "."), F.char_length(F.regexp_replace(u, "[^0-9]", "")) / n,
        entropy, F.when(query == "", F.lit(0)).otherwise(count(query, "&") + 1), count(host, "-"), F.char_length(suffix_of(host)), suffix_rate,
    )
    return F.array(*[f.cast("double") for f in found])


class UrlModel:
    """Trees and the suffix statistics that they use."""

    def __init__(self, trees, suffixes: DataFrame | None, prior: float):
        self.trees, self.suffixes, self.prior = trees, suffixes, prior

    def blocked(self, df: DataFrame, url: str, host: str, path: str, out: str) -> DataFrame:
        """Adds ``out``: the probability that a URL is to be blocked."""
        if self.trees is None:
            return df.withColumn(out, F.lit(0.0))
        suffix, rate, vector, raw, chance, label = (fresh_name(df, x) for x in ("suffix", "rate", "features", "raw", "chance", "label"))
        # at most MAX_TRAIN_ROWS suffixes: they come from the training sample
        known = F.broadcast(self.suffixes.select(F.col("suffix").alias(suffix), F.col("rate").alias(rate)))
        got = df.join(known, suffix_of(F.col(host)) == F.col(suffix), "left")
        got = got.withColumn(vector, array_to_vector(lexical(F.col(url), F.col(host), F.col(path), F.coalesce(rate, F.lit(self.prior)))))
        trees = self.trees.copy().setFeaturesCol(vector).setRawPredictionCol(raw).setProbabilityCol(chance).setPredictionCol(label)
        return trees.transform(got).withColumn(out, vector_to_array(chance)[1]).drop(suffix, rate, vector, raw, chance, label)


def train(labelled: DataFrame, max_rows: int = MAX_TRAIN_ROWS, trees: int = 10, depth: int = 4, seed: int = 42) -> UrlModel:
    """A model from rows (url, blocked boolean).

    It is fitted on at most about ``max_rows`` (20,000) distinct rows, chosen by
    hash; repeated rows teach once, so the bound holds for any number of them. A
    suffix's statistic is its smoothed share of blocked URLs in the other half
    of the sample for training rows, and in the whole sample for scoring.
    """
    rows = labelled.where("blocked is not null").select("url", F.col("blocked").cast("double").alias("label"))
    # the scan has its own tasks; only the sample meets in two
    sample = staged(distinct_sample(rows, max_rows, seed).repartition(2, "url").sortWithinPartitions("url", "label"), "urls-sample")
    mean = sample.agg(F.avg("label").alias("m")).first()["m"]
    if mean is None or mean in (0.0, 1.0):
        return UrlModel(None, None, mean or 0.0)
    located = sample.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "half": F.pmod(F.xxhash64("url"), F.lit(2))})
    located = located.withColumn("suffix", suffix_of(F.col("host")))
    by = located.groupBy("suffix", "half").agg(F.sum("label").alias("s"), F.count("*").alias("n"))
    rate = lambda s, n: (s + F.lit(10.0 * mean)) / (n + 10.0)
    suffixes = staged(by.groupBy("suffix").agg(rate(F.sum("s"), F.sum("n")).alias("rate")).coalesce(1), "urls-suffixes")
    other = by.select("suffix", (1 - F.col("half")).alias("half"), rate(F.col("s"), F.col("n")).alias("rate"))
    data = located.join(F.broadcast(other), ["suffix", "half"], "left")
    vector = array_to_vector(lexical(F.col("url"), F.col("host"), F.col("path"), F.coalesce("rate", F.lit(mean))))
    data = staged(data.select(vector.alias("features"), "label").coalesce(2), "urls-train")
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed)
    return UrlModel(gbt.fit(data), suffixes, float(mean))


def judge(pages: DataFrame, rules: Sequence[UrlRule], labelled: DataFrame | None = None, max_rows: int = MAX_TRAIN_ROWS, url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict ('allow' or 'block') to ``pages``.

    ``labelled``: rows (url, blocked). By default the URLs that a rule decides
    are the labelled ones, and the trees judge those that no rule decides.
    """
    refuse(pages.columns, "host", "path", "rule", "verdict")
    allow, p = fresh_name(pages, "allow"), fresh_name(pages, "p")
    located = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    located = with_rules(located, rules, "host", "path", "rule", allow)
    model = train(located.select(F.col(url).alias("url"), (~F.col(allow)).alias("blocked")) if labelled is None else labelled, max_rows)
    scored = model.blocked(located, url, "host", "path", p)
    block = F.coalesce(~F.col(allow), F.col(p) >= 0.5)
    return scored.withColumn("verdict", F.when(block, F.lit("block")).otherwise(F.lit("allow"))).drop(allow, p)
