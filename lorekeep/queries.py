"""Queries over the driver's tables, one or more per operator, with equivalent SQL.

``embeddings`` are vector records, ``documents`` text records, ``events`` votes
(purchase +1, error -1, on user_id), conversations chains of turns, orders and
line items typed edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import tokenize
from .functions.vectors import cosine
from .operators import graph
from .operators.filters import column_equals, has_embedding
from .operators.lexicon import Lexicon
from .operators.metrics import recall_precision
from .operators.ranking import Knn, Lexical, Ranking, knn_batch, rank
from .operators.ranks import global_rank
from .operators.votes import vote_aggregates, with_votes
from .plans.nodes import FieldEquals, Select
from .sources import log as logs
from .sources.typed import RecordSource

WORDS = "the tion of"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> tuple[float, ...]:
    return tuple(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def votes_of(events: DataFrame) -> DataFrame:
    """user_id, weight, sign, created_at of purchases and errors."""
    signs = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1)
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return events.where(F.col("event_type").isin("purchase", "error")).select("user_id", F.lit(1.0).alias("weight"), signs.alias("sign"), seconds.alias("created_at"))


VOTES_SQL = """v AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS sign, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type IN ('purchase', 'error')),
a AS (SELECT user_id, count(*) AS n_votes, (count(*) + 1) / (count(*) + 2.0::DOUBLE) AS laplace, count(*) FILTER (WHERE sign = 1) AS up, count(*) FILTER (WHERE sign = -1) AS down, CAST(sum(sign) AS BIGINT) AS net,
      sum(sign / (1.0::DOUBLE + (SELECT max(t) FROM v) - t)) AS feedback FROM v GROUP BY user_id)"""
SIM = "list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


# ------------------------------------------------------------------ scans, filters, order


@query("SELECT n_nationkey, n_name, n_regionkey, 0.0::DOUBLE AS score FROM nation")
def scan_ordered(spark, d):
    return RecordSource("nation", table(spark, d, "nation"), "n_nationkey").select(Select("nation"))


@query("SELECT n_nationkey, n_name, n_regionkey, 0.0::DOUBLE AS score FROM nation ORDER BY n_nationkey LIMIT 7")
def scan_limit(spark, d):
    return RecordSource("nation", table(spark, d, "nation"), "n_nationkey").select(Select("nation", limit=7))


@query("SELECT n_nationkey, n_name, n_regionkey, 0.0::DOUBLE AS score FROM nation WHERE false")
def scan_limit_zero(spark, d):
    return RecordSource("nation", table(spark, d, "nation"), "n_nationkey").select(Select("nation", limit=0))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_eq_str(spark, d):
    df = table(spark, d, "customer")
    return df.where(column_equals(df, "c_mktsegment", "BUILDING"))


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size = 10")
def filter_eq_int(spark, d):
    df = table(spark, d, "part")
    return df.where(column_equals(df, "p_size", 10)).select("p_partkey", "p_name", "p_size")


@query("SELECT p_partkey, p_name FROM part WHERE false")
def filter_type_mismatch(spark, d):
    df = table(spark, d, "part")
    return df.where(column_equals(df, "p_size", 10.0) | column_equals(df, "no_such_field", None)).select("p_partkey", "p_name")


@query("SELECT doc_id, lang FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id")
def filter_has_embedding(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left")
    return has_embedding(joined).select("doc_id", "lang")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 100")
def order_recency(spark, d):
    source = RecordSource("events", table(spark, d, "events"), "event_id", created_at="ts")
    return source.select(Select("events", FieldEquals("event_type", "click"), order="recency", limit=100)).select("event_id", "user_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def projection_fields(spark, d):
    source = RecordSource("customer", table(spark, d, "customer"), "c_custkey")
    return source.select(Select("customer", FieldEquals("c_nationkey", 3), fields=("c_custkey", "c_name"))).select("c_custkey", "c_name")


# ------------------------------------------------------------------ vectors


@query(f"SELECT vec_id, label, round({SIM}, 6)::DOUBLE AS score FROM embeddings e ORDER BY {SIM} DESC, vec_id LIMIT 10")
def knn_topk(spark, d):
    got = rank(table(spark, d, "embeddings"), ["vec_id"], Ranking(knn=Knn(query_vector(spark, d), 10)))
    return got.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round({SIM}, 6)::DOUBLE AS score FROM embeddings e WHERE label = 3 ORDER BY {SIM} DESC, vec_id LIMIT 20")
def knn_filtered(spark, d):
    df = table(spark, d, "embeddings")
    got = rank(df.where(column_equals(df, "label", 3)), ["vec_id"], Ranking(knn=Knn(query_vector(spark, d), 20)))
    return got.select("vec_id", F.round("score", 6).alias("score"))


@query(f"""SELECT doc_id, round(coalesce({SIM}, 0), 6)::DOUBLE AS score FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
ORDER BY coalesce({SIM}, 0) DESC, doc_id LIMIT 400""")
def knn_missing_zero(spark, d):
    df = table(spark, d, "documents").select("doc_id").join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left")
    got = rank(df, ["doc_id"], Ranking(knn=Knn(query_vector(spark, d), 400)))
    return got.select("doc_id", F.round("score", 6).alias("score"))


@query("""SELECT query_id, vec_id, rank, round(s, 6)::DOUBLE AS score FROM (
SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS INTEGER) AS rank
FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id < 50) q) WHERE rank <= 10""")
def knn_batch_50(spark, d):
    df = table(spark, d, "embeddings")
    queries = df.where("vec_id < 50").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return knn_batch(df, ["vec_id"], queries, 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("""SELECT query_id, vec_id, rank, round(s, 6)::DOUBLE AS score FROM (
SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS INTEGER) AS rank
FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q) WHERE rank <= 10""")
def knn_batch_hundredths(spark, d):
    df = table(spark, d, "embeddings")
    queries = df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return knn_batch(df, ["vec_id"], queries, 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


# ------------------------------------------------------------------ votes


@query(f"WITH {VOTES_SQL} SELECT user_id, n_votes, up, down, net, round(laplace, 6) AS laplace, round(feedback, 6) + 0.0::DOUBLE AS feedback FROM a")
def votes_counts(spark, d):
    got = vote_aggregates(votes_of(table(spark, d, "events")), ["user_id"])
    return got.select("user_id", "n_votes", "up", "down", "net", F.round("laplace", 6).alias("laplace"), (F.round("feedback", 6) + F.lit(0.0)).alias("feedback"))


def _ordered_by_votes(spark, d, order, k, **more):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    votes = vote_aggregates(votes_of(table(spark, d, "events")), ["user_id"])
    return rank(customers, ["user_id"], Ranking(order=order, limit=k), votes, **more).select("user_id", F.round("score", 6).alias("score"))


@query(f"WITH {VOTES_SQL} SELECT c_custkey AS user_id, coalesce(net, 0)::DOUBLE AS score FROM customer LEFT JOIN a ON c_custkey = user_id ORDER BY 2 DESC, 1 LIMIT 200")
def order_votes(spark, d):
    return _ordered_by_votes(spark, d, "votes", 200)


@query(f"WITH {VOTES_SQL} SELECT c_custkey AS user_id, round(coalesce(laplace, 0.5), 6)::DOUBLE AS score FROM customer LEFT JOIN a ON c_custkey = user_id ORDER BY coalesce(laplace, 0.5) DESC, 1 LIMIT 300")
def order_score(spark, d):
    return _ordered_by_votes(spark, d, "score", 300)


@query(f"WITH {VOTES_SQL} SELECT c_custkey AS user_id, round(coalesce(feedback, 0), 6)::DOUBLE AS score FROM customer LEFT JOIN a ON c_custkey = user_id ORDER BY coalesce(feedback, 0) DESC, 1 LIMIT 50")
def order_feedback(spark, d):
    return _ordered_by_votes(spark, d, "feedback", 50)


@query(f"WITH {VOTES_SQL} SELECT c_custkey AS user_id, round(coalesce(laplace, 0.5), 6)::DOUBLE AS score FROM customer LEFT JOIN a ON c_custkey = user_id ORDER BY coalesce(laplace, 0.5) DESC, 1 LIMIT 100")
def salience_no_knn(spark, d):
    return _ordered_by_votes(spark, d, "salience", 100)


def _voted_vectors(spark, d):
    votes = vote_aggregates(votes_of(table(spark, d, "events")), ["user_id"]).withColumnRenamed("user_id", "vec_id")
    return table(spark, d, "embeddings"), votes


@query(f"""WITH {VOTES_SQL} SELECT vec_id, round(0.7 * {SIM} + 0.3 * coalesce(laplace, 0.5), 6)::DOUBLE AS score FROM embeddings e LEFT JOIN a ON vec_id = user_id
ORDER BY 0.7 * {SIM} + 0.3 * coalesce(laplace, 0.5) DESC, vec_id LIMIT 25""")
def order_salience(spark, d):
    df, votes = _voted_vectors(spark, d)
    got = rank(df, ["vec_id"], Ranking(knn=Knn(query_vector(spark, d), 25), order="salience"), votes)
    return got.select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH {VOTES_SQL} SELECT vec_id, round(coalesce(laplace, 0.5), 6)::DOUBLE AS score FROM embeddings e LEFT JOIN a ON vec_id = user_id
ORDER BY coalesce(laplace, 0.5) DESC, vec_id LIMIT 5""")
def knn_order_score(spark, d):
    df, votes = _voted_vectors(spark, d)
    got = rank(df, ["vec_id"], Ranking(knn=Knn(query_vector(spark, d), 5), order="score"), votes)
    return got.select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {VOTES_SQL} SELECT c_custkey AS user_id, coalesce(up, 0) AS up, coalesce(down, 0) AS down FROM customer LEFT JOIN a ON c_custkey = user_id")
def votes_join_all(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return with_votes(customers, vote_aggregates(votes_of(table(spark, d, "events")), ["user_id"]), ["user_id"]).select("user_id", "up", "down")


# ------------------------------------------------------------------ text

TOKENS_SQL = r"list_transform(list_filter(regexp_split_to_array(text, '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> ''), lambda x: lower(x))"
BM25_SQL = f"""t AS (SELECT doc_id, n_chars, {TOKENS_SQL} AS w FROM documents),
q AS (SELECT unnest(['the', 'tion', 'of']) AS q), n AS (SELECT count(*) AS n, greatest(sum(len(w)) / count(*), 1.0::DOUBLE) AS avgdl FROM t),
f AS (SELECT q, greatest(count(*) FILTER (WHERE list_contains(w, q)), 1) AS df FROM t, q GROUP BY q),
b AS (SELECT doc_id, n_chars, coalesce(sum(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(w) / avgdl)) ELSE 0 END), 0) AS s
      FROM (SELECT doc_id, n_chars, w, df, len(list_filter(w, lambda x: x = q)) AS tf FROM t, f), n GROUP BY doc_id, n_chars)"""


@query(f"SELECT doc_id, CAST(len({TOKENS_SQL}) AS INTEGER) AS n_tokens, md5(array_to_string({TOKENS_SQL}, ' ')) AS tokens FROM documents")
def tokenize_all(spark, d):
    return table(spark, d, "documents").withColumn("w", tokenize(F.col("text"))).select("doc_id", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("tokens"))


_lexicons: dict[tuple[str, str], Lexicon] = {}


def lexicon(spark: SparkSession, d: str) -> Lexicon:
    """Token counts of the documents, made by the first query of a session over them and read by all later ones."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _lexicons:
        _lexicons[key] = Lexicon(table(spark, d, "documents"), ["doc_id"], "text")
    return _lexicons[key]


def _bm25(spark, d, words, k, **more):
    docs = table(spark, d, "documents").select("doc_id")
    return rank(docs, ["doc_id"], Ranking(lexical=Lexical("text", words, k), **more), lexicon=lexicon(spark, d)).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25_SQL} SELECT doc_id, round(s, 6)::DOUBLE AS score FROM b")
def bm25_rank(spark, d):
    return _bm25(spark, d, WORDS, None)


@query(f"WITH {BM25_SQL} SELECT doc_id, round(s, 6)::DOUBLE AS score FROM b ORDER BY round(s, 12) DESC, doc_id LIMIT 20")
def bm25_k(spark, d):
    return _bm25(spark, d, WORDS, 20)


@query(f"WITH {BM25_SQL} SELECT doc_id, round(s, 6)::DOUBLE AS score FROM b ORDER BY round(s, 12) DESC, doc_id LIMIT 20")
def bm25_of_texts(spark, d):
    """The same from the texts themselves, as a log or a table without stored counts is searched."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return rank(docs, ["doc_id"], Ranking(lexical=Lexical("text", WORDS, 20))).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, 0.0::DOUBLE AS score FROM documents ORDER BY doc_id LIMIT 10")
def bm25_empty_query(spark, d):
    return _bm25(spark, d, " ... ", 10)


HYBRID_SQL = f"""r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY s DESC, doc_id) AS rl, row_number() OVER (ORDER BY coalesce({SIM}, 0) DESC, doc_id) AS rv FROM b LEFT JOIN embeddings e ON doc_id = vec_id)"""


def _hybrid(spark, d, **more):
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left")
    what = Ranking(knn=Knn(query_vector(spark, d), 100), lexical=Lexical("text", WORDS), **more)
    return rank(docs, ["doc_id"], what, created_at="n_chars", lexicon=lexicon(spark, d)).select("doc_id", F.round("score", 9).alias("score"))


@query(f"WITH {BM25_SQL}, {HYBRID_SQL} SELECT doc_id, round(1.0::DOUBLE / (60 + rl) + 1.0::DOUBLE / (60 + rv), 9) AS score FROM r ORDER BY 1.0::DOUBLE / (60 + rl) + 1.0::DOUBLE / (60 + rv) DESC, doc_id LIMIT 100")
def hybrid_rrf(spark, d):
    return _hybrid(spark, d)


@query(f"WITH {BM25_SQL}, {HYBRID_SQL} SELECT doc_id, round(1.0::DOUBLE / (60 + rl) + 1.0::DOUBLE / (60 + rv), 9) AS score FROM r ORDER BY n_chars DESC, doc_id LIMIT 100")
def hybrid_recency(spark, d):
    return _hybrid(spark, d, order="recency")


# ------------------------------------------------------------------ log


def _order_log(spark, d) -> DataFrame:
    """Orders as inserts on their customer, time by (date, key); every order of over 480,000 is a forget."""
    columns = table(spark, d, "orders").select("o_orderdate", "o_custkey", "o_orderkey", "o_totalprice")
    orders = global_rank(columns, [F.col("o_orderdate"), F.col("o_orderkey")], "ts")
    made = orders.select("ts", F.when(F.col("o_totalprice") > 480000, "forget").otherwise("insert").alias("op"), "o_custkey", "o_orderkey")
    value = F.struct(F.lit(2).cast("tinyint").alias("tag"), F.col("o_orderkey").cast("string").alias("canon"))
    empty = spark.createDataFrame([], logs.SCHEMA)
    row = made.select(
        F.lit("").alias("memory"), "ts", F.lit(1).cast("long").alias("plan_id"), "op", F.lit("customer").alias("tbl"), F.lit(0).cast("tinyint").alias("id_kind"),
        F.col("o_custkey").cast("decimal(20,0)").alias("id_num"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("rid"), F.create_map(F.lit("order"), value).alias("body"),
    )
    return empty.unionByName(row, allowMissingColumns=True)


ORDER_LOG_SQL = "l AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS ts, CASE WHEN o_totalprice > 480000 THEN 'forget' ELSE 'insert' END AS op, o_custkey, o_orderkey FROM orders)"


def _last_orders(df: DataFrame) -> DataFrame:
    return df.select("rid", F.col("body")["order"]["canon"].cast("long").alias("last_order"))


@query(f"WITH {ORDER_LOG_SQL} SELECT 'customer:' || o_custkey AS rid, o_orderkey AS last_order FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY ts DESC) = 1) WHERE op = 'insert'")
def upsert_last_wins(spark, d):
    return _last_orders(logs.records(_order_log(spark, d)))


@query(f"WITH {ORDER_LOG_SQL} SELECT 'customer:' || o_custkey AS rid, o_orderkey AS last_order FROM (SELECT * FROM l WHERE ts <= 1000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY ts DESC) = 1) WHERE op = 'insert'")
def as_of_t(spark, d):
    return _last_orders(logs.records(_order_log(spark, d), as_of=1000))


@query("""WITH o AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS ts, o_custkey, o_orderkey, o_totalprice FROM orders),
g AS (SELECT o_custkey, max(ts) AS gone FROM o WHERE o_totalprice > 300000 GROUP BY o_custkey)
SELECT ts AS seq, 'customer:' || o.o_custkey AS src, 'order:' || o_orderkey AS dst FROM o LEFT JOIN g USING (o_custkey) WHERE o_totalprice <= 300000 AND NOT coalesce(ts < gone, false)""")
def forget_edges(spark, d):
    columns = table(spark, d, "orders").select("o_orderdate", "o_custkey", "o_orderkey", "o_totalprice")
    o = global_rank(columns, [F.col("o_orderdate"), F.col("o_orderkey")], "ts")
    gone = F.col("o_totalprice") > 300000
    row = o.select(
        F.lit("").alias("memory"), "ts", F.when(gone, "forget").otherwise("relate").alias("op"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("rid"),
        F.when(~gone, F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"))).alias("to_rid"), F.when(~gone, F.lit("placed")).alias("name"),
    )
    log = spark.createDataFrame([], logs.SCHEMA).unionByName(row, allowMissingColumns=True)
    return logs.edges(log).select("seq", "src", "dst")


# ------------------------------------------------------------------ graph


def placed(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.lit("placed").alias("name"),
                    F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"), F.col("o_totalprice").alias("weight"), F.col("o_orderstatus").alias("status"))


def _contains(spark, d) -> DataFrame:
    i = table(spark, d, "lineitem")
    return i.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.lit("contains").alias("name"),
                    F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.col("l_quantity").alias("weight"), F.col("l_returnflag").alias("status"))


def edges_nodes(*edge_tables: DataFrame) -> DataFrame:
    out = None
    for e in edge_tables:
        both = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id")))
        out = both if out is None else out.unionByName(both)
    return out


@query("SELECT 'o' || o_orderkey AS id, round(o_totalprice, 4) AS score, o_orderkey AS seq FROM orders WHERE o_custkey = 7")
def match_out(spark, d):
    e = placed(spark, d)
    return graph.match(e, edges_nodes(e), "c7", [("out", "placed", None)]).withColumn("score", F.round("score", 4))


@query("SELECT 'o' || l_orderkey AS id, min_by(l_quantity, l_orderkey * 8 + l_linenumber) AS score, min(l_orderkey * 8 + l_linenumber) AS seq FROM lineitem WHERE l_partkey = 11 GROUP BY l_orderkey")
def match_in(spark, d):
    e = _contains(spark, d)
    return graph.match(e, edges_nodes(e), "p11", [("in", "contains", None)])


@query("""SELECT 'p' || l_partkey AS id, min_by(l_quantity, l_orderkey * 8 + l_linenumber) AS score, min(l_orderkey * 8 + l_linenumber) AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 7 GROUP BY l_partkey""")
def match_two_hop(spark, d):
    a, b = placed(spark, d), _contains(spark, d)
    return graph.match(a.unionByName(b), edges_nodes(a, b), "c7", [("out", "placed", None), ("out", "contains", None)])


@query("SELECT 'o' || o_orderkey AS id, round(o_totalprice, 4) AS score, o_orderkey AS seq FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'")
def match_props(spark, d):
    e = placed(spark, d)
    return graph.match(e, edges_nodes(e), "c7", [("out", "placed", F.col("status") == "F")]).withColumn("score", F.round("score", 4))


def _turns(spark, d) -> DataFrame:
    t = table(spark, d, "conversations").select("conv_id", "turn")
    here = F.col("conv_id") * 1000 + F.col("turn")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"))
    return t.join(nxt, ["conv_id", "turn"]).select(here.alias("seq"), here.alias("src"), F.lit("follows_from").alias("name"), (here + 1).alias("dst"), F.lit(None).cast("double").alias("weight"))


CHAIN_SQL = "WITH RECURSIVE t AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn FROM conversations), r AS (SELECT id, 0::BIGINT AS depth FROM t WHERE id = {start} UNION SELECT t.id, depth + 1 FROM r JOIN t ON t.id = r.id {sign} 1) SELECT id, depth, depth AS pos FROM r"


@query(CHAIN_SQL.format(start=1000, sign="+"))
def closure_chain(spark, d):
    e = _turns(spark, d)
    return graph.closure(e, table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id")), 1000, [("out", "follows_from", None)])


@query(CHAIN_SQL.format(start=1003, sign="-"))
def closure_back(spark, d):
    e = _turns(spark, d)
    return graph.closure(e, table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id")), 1003, [("in", "follows_from", None)])


RING_SQL = "WITH RECURSIVE r AS (SELECT 3 AS id, 0::BIGINT AS depth UNION SELECT (r.id + 1) % 25, depth + 1 FROM r WHERE depth < 25) SELECT id, min(depth) AS depth, min(depth) AS pos FROM r GROUP BY id"


def ring(spark, d) -> tuple[DataFrame, DataFrame]:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    return n.select(F.col("id").cast("long").alias("seq"), F.col("id").alias("src"), F.lit("next").alias("name"), ((F.col("id") + 1) % 25).alias("dst"), F.lit(1.0).alias("weight")), n


@query(RING_SQL)
def closure_cycle(spark, d):
    e, n = ring(spark, d)
    return graph.closure(e, n, 3, [("out", "next", None)])


@query(RING_SQL)
def closure_cycle_staged(spark, d):
    """The same ring walked level by level on staged tables, as a walk over many edges is."""
    e, n = ring(spark, d)
    return graph.closure(e, n, 3, [("out", "next", None)], local_edges=0)


# ------------------------------------------------------------------ metrics


@query(f"""WITH {BM25_SQL}, top AS (SELECT doc_id FROM b ORDER BY round(s, 12) DESC, doc_id LIMIT 100), rel AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
h AS (SELECT count(*) AS hits FROM top WHERE doc_id IN (SELECT doc_id FROM rel)) SELECT hits, hits / (SELECT count(*) FROM rel)::DOUBLE AS recall, hits / 100.0::DOUBLE AS precision FROM h""")
def recall_precision_bm25(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    got = rank(docs, ["doc_id"], Ranking(lexical=Lexical("text", WORDS, 100)), position=True, lexicon=lexicon(spark, d))
    relevant = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return recall_precision(got.select(F.col("doc_id").alias("id"), "pos"), relevant, 100)


@query(f"SELECT vec_id, round({SIM}, 5)::DOUBLE AS score FROM embeddings e ORDER BY {SIM} DESC, vec_id LIMIT 3")
def knn_single_precision(spark, d):
    q = query_vector(spark, d)
    df = table(spark, d, "embeddings")
    return df.select("vec_id", cosine(F.col("embedding"), q, single=True).alias("s")).orderBy(F.desc("s"), "vec_id").limit(3).select("vec_id", F.round("s", 5).alias("score"))
