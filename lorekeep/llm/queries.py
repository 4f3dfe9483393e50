"""The queries op1 to op10 over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, mixing, quality, sharding, simhash, suffixes, tokens, urls
from .common import table

URL_RULES = tuple(urls.UrlRule.parse(t, a) for t, a in (("com/", True), ("example.com/en/", False), ("www.example.com/en/", True), ("net/es/", False), ("net/fr/", False)))
SHARDS, END_ID, TOKENIZER = 24, 2, "word_bpe_49k.json"
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast("long").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat.chat_digests(turns.unionByName(extra), budget=8192)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("class_id").alias("component_id"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_placement(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_tokens(tokens.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), END_ID))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held.alias("held_out"))
    return langid.predict(docs, langid.fit(docs.where("not held_out")), "doc_id", "held_out")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, "source", alpha=0.5, epochs=1.0, seed=42, copy="copy")
    return mixed.select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"), "copy")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_chat_formatting, op2_simhash, op3_quality_rules, op4_url_filter, op5_sharding, op6_token_files, op7_suffix_dedup, op8_decontamination, op9_language_id, op10_mixing,
    )}


OP1_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
e AS (SELECT *, replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\', '\\'), chr(10), '\n') AS r, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS t FROM c),
n AS (SELECT *, 24 + strlen(r) + strlen(t) AS tokens FROM e),
o AS (SELECT *, row_number() OVER w - 1 AS idx, sum(tokens) OVER w - tokens AS start_tok, sum(CAST(tokens > 2048 AS INTEGER)) OVER w AS longs, 24 + length(r) + length(t) AS chars
      FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t ROWS UNBOUNDED PRECEDING)),
s AS (SELECT conv_id, min(idx) AS ws, min(start_tok) AS span_tok FROM o GROUP BY conv_id, longs, tokens > 2048, CASE WHEN tokens > 2048 THEN 0 ELSE (start_tok + tokens - 1) // 2048 END),
a AS (SELECT o.conv_id, sum(chars) AS chars FROM o JOIN s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
      WHERE idx < ws AND (idx = 0 AND r = 'system' OR idx >= ws - 2 AND span_tok - start_tok <= 2048) GROUP BY o.conv_id),
f AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256, sum(chars) AS chars,
             CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
             sha256(coalesce(string_agg(text, '' ORDER BY idx) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256 FROM o GROUP BY conv_id)
SELECT f.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, CAST(f.chars + coalesce(a.chars, 0) AS BIGINT) AS formatted_chars
FROM f LEFT JOIN a ON f.conv_id IS NOT DISTINCT FROM a.conv_id
"""

OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM r) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
             len(lines) AS n_lines, CAST((strlen(t) - strlen(replace(t, '!!', ''))) / 2 AS BIGINT) AS n_shouts
      FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_shouts > 20 * n_words OR 100 * n_dup_lines > 30 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM b
"""

OP8_SQL = r"""
WITH dw AS (SELECT rid, doc_id, regexp_extract_all(t, '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM
             (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
iw AS (SELECT iid, item_id, regexp_extract_all(t, '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM
             (SELECT row_number() OVER () AS iid, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark)),
win AS (SELECT DISTINCT iid, item_id, least(len(w), 10) AS n, array_to_string(w[i:i+9], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT rid, i, n, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM dw, sizes)),
hits AS (SELECT rid, i, n, iid, item_id FROM grams JOIN win USING (n, g)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT rid, iid, coalesce(CAST(item_id AS VARCHAR), 'null') AS s FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

OP10_SQL = """
WITH s AS (SELECT source, sum(CAST(strlen(coalesce(text, '')) AS BIGINT)) AS b FROM documents GROUP BY source),
t AS (SELECT sum(b) AS b, sum(CASE WHEN b > 0 THEN pow(CAST(b AS DOUBLE), 0.5) END) AS w FROM s),
r AS (SELECT source, CASE WHEN s.b > 0 THEN round(pow(CAST(s.b AS DOUBLE), 0.5) / t.w * t.b / s.b, 9) ELSE 0 END AS rate FROM s, t),
k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k FROM r),
c AS (SELECT source, k, sum(CASE WHEN rate = 0 THEN (CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END) ELSE exp(k * ln(rate) - rate - lgamma(k + 1)) END) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
f AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source),
u AS (SELECT doc_id, source, text, CAST(CAST(('0x' || md5('42|' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:13]) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT doc_id, u.source, text, len(list_filter(cdf, lambda x: x <= u)) AS n FROM u JOIN f ON u.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, source, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM n
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op3_quality_rules": OP3_SQL, "op8_decontamination": OP8_SQL, "op10_mixing": OP10_SQL}
