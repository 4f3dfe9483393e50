"""Queries that run programs of the language, stores and servers, with equivalent SQL; importing them registers them.

Programs are made from the 25 nations: a program is text, so it is as small as
what its writer types.
"""

from __future__ import annotations

import io
import json
import socket
from threading import Thread

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lang.parser import parse_statement
from .model import RecordId
from .operators import graph
from .operators.ann import Exact, RandomProjection
from .operators.metrics import recall_precision, relevant_of
from .operators.ranking import Knn, Ranking, rank
from .plans.nodes import Insert
from .queries import SIM, edges_nodes, placed, query, query_vector, ring, table
from .scratch import fresh_path
from .serve.cli import run_script
from .serve.lines import LineServer, serve_tcp
from .serve.render import line, store_dump
from .serve.tools import Tools
from .session import Session
from .sources import log as logs
from .sources.typed import RecordSource


def nations(spark, d) -> list:
    return table(spark, d, "nation").orderBy("n_nationkey").collect()  # 25 rows


def nation_program(spark, d) -> str:
    """A program that inserts every nation, its name and its region's key as fields."""
    return " ".join(["CREATE TABLE nation", *(f"INSERT INTO nation:{r['n_nationkey']} {{name: '{r['n_name']}', region: {r['n_regionkey']}}}" for r in nations(spark, d))])


def edge_program(spark, d) -> str:
    """A program that inserts the regions and relates each to its nations, weighed by their key, with the length of the name as a property."""
    rows = nations(spark, d)
    regions = [f"INSERT INTO region:{k} {{}}" for k in sorted({r["n_regionkey"] for r in rows})]
    return " ".join([*regions, *(f"RELATE (region:{r['n_regionkey']})->:has->(nation:{r['n_nationkey']}) SET weight = {r['n_nationkey']}.5, length = {len(r['n_name'])}" for r in rows)])


def named(result) -> DataFrame:
    return result.df.select("pos", "rid", "score", F.col("body")["name"]["canon"].alias("name"))


def stored(spark, name: str, **more) -> tuple[str, Session]:
    """A path in the shared folder and a session over a log at it."""
    path = fresh_path(spark, name)
    session = Session(spark, path)
    session.store = logs.LogStore(spark, path, **more)
    return path, session


NATION_ROWS = "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS pos, 'nation:' || n_nationkey AS rid, 0.0::DOUBLE AS score, n_name AS name FROM nation"
NATION_TEXT = """'nation:' || n_nationkey || '{gap}score=0.0000{gap}{{name="' || n_name || '", region=' || n_regionkey || '}}'"""


# ------------------------------------------------------------------ statements


@query(f"{NATION_ROWS} WHERE n_regionkey = 2")
def language_insert_select(spark, d):
    return named(Session(spark).run(nation_program(spark, d) + " SELECT * FROM nation WHERE region = 2")[-1])


@query(f"{NATION_ROWS} WHERE n_regionkey = 3")
def memory_scoped(spark, d):
    """Each region's nations in a memory of their own, all of them in the root, and one memory read."""
    inserts = [f"MEMORY r{r['n_regionkey']} INSERT INTO nation:{r['n_nationkey']} {{name: '{r['n_name']}'}}" for r in nations(spark, d)]
    return named(Session(spark).run(" ".join([nation_program(spark, d), *inserts, "MEMORY r3 SELECT * FROM nation"]))[-1])


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS pos, 'nation:' || n_nationkey AS rid, n_nationkey + 0.5::DOUBLE AS score FROM nation WHERE n_regionkey = 1 AND length(n_name) = 6")
def language_match_props(spark, d):
    got = Session(spark).run(f"{nation_program(spark, d)} {edge_program(spark, d)} MATCH (region:1)->:has WHERE length = 6")[-1]
    return got.df.select("pos", "rid", "score")


@query("SELECT 'nation:' || n_nationkey AS rid, n_nationkey + 0.5::DOUBLE AS score FROM nation WHERE n_regionkey = 1 AND n_nationkey % 4 <> 1")
def language_forget(spark, d):
    """Nations that are forgotten and inserted again are there, their edges are not."""
    again = [f"FORGET nation:{r['n_nationkey']} INSERT INTO nation:{r['n_nationkey']} {{}}" for r in nations(spark, d) if r["n_nationkey"] % 4 == 1]
    got = Session(spark).run(" ".join([nation_program(spark, d), edge_program(spark, d), *again, "MATCH (region:1)->:has"]))[-1]
    return got.df.select("rid", "score")


@query(f"SELECT * FROM ({NATION_ROWS}) WHERE pos < 9")
def language_as_of(spark, d):
    """The tenth mutation is the ninth nation's."""
    return named(Session(spark).run(nation_program(spark, d) + " INSERT INTO nation:2 {name: 'later'} FORGET nation:3 SELECT * FROM nation AS OF 10")[-1])


@query("SELECT * FROM (VALUES (0, 'v:1 has a vector of 2 components, table v declares 3'), (1, 'parse error at 1:27: a vector length must be positive'), (2, 'table gone is not declared'), (3, 'rows: 0')) t(i, message)")
def language_checks(spark, d):
    """Plans that fail, and what they leave: nothing."""
    session, said = Session(spark), []
    for s, text in ((session, "CREATE TABLE v VECTOR<f32,3> INSERT INTO v:0 {} INSERT INTO v:1 {} EMBED [1,2]"), (session, "CREATE TABLE v VECTOR<f32,0>"), (Session(spark, strict=True), "SELECT * FROM gone")):
        try:
            s.run(text)
        except ValueError as e:
            said.append(str(e))
    said.append(f"rows: {session.run('SELECT * FROM v')[0].df.count()}")
    return spark.createDataFrame(list(enumerate(said)), "i int, message string")


@query("""SELECT * FROM (VALUES (0, 'parse error at 1:1: unknown statement `SELEC`'), (1, 'parse error at 1:14: expected a table name, found end of input'),
(2, 'parse error at 1:23: a limit must not be negative'), (3, 'parse error at 1:12: expected a path step'), (4, 'lex error at 1:21: unterminated string'),
(5, 'lex error at 2:11: unexpected character ' || chr(39) || '@' || chr(39)), (6, 'parse error at 1:12: unexpected `FORGET` after the statement'), (7, 't:1')) t(i, message)""")
def language_errors(spark, d):
    """What single statements say, with line and column; the last one is right."""
    said = []
    for text in ("SELEC * FROM t", "SELECT * FROM", "SELECT * FROM t LIMIT -1", "MATCH (t:1)", "INSERT INTO t:1 {a: 'x", "SELECT * FROM t\nWHERE a = @", "FORGET t:1 FORGET t:2", "FORGET t:1"):
        try:
            said.append(str(parse_statement(text).id))
        except ValueError as e:
            said.append(str(e))
    return spark.createDataFrame(list(enumerate(said)), "i int, message string")


@query("SELECT * FROM (VALUES (0::BIGINT, 't:9'), (1, 't:10'), (2, 't:18446744073709551615'), (3, 't:+x'), (4, 't:18446744073709551616'), (5, 't:A'), (6, 't:a:b')) t(pos, rid)")
def record_ids(spark, d):
    """Numbers of 64 bits before strings, each in its order; a sign before a number is not part of it."""
    session = Session(spark)
    session.execute([Insert(RecordId.parse(x)) for x in ("t:a:b", "t:10", "t:+9", "t:A", "t:18446744073709551616", "t:18446744073709551615", "t:+x")])
    return session.run("SELECT * FROM t")[0].df.select("pos", "rid")


@query("SELECT 'SELECT nation (' || count(*) || ' rows)' AS head FROM nation WHERE n_regionkey = 4 AND n_name > 'I'")
def language_session(spark, d):
    """A program over a log and a typed table, and the head of its answer."""
    session = Session(spark)
    some = table(spark, d, "nation").where("n_name > 'I'").select("n_nationkey", "n_name", F.col("n_regionkey").cast("long").alias("region"))
    session.register(RecordSource("nation", some, "n_nationkey"))
    (result,) = session.run("RELATE (user:1)->:voted->(nation:4) SET value = 1 SELECT * FROM nation WHERE region = 4 ORDER BY ::votes")
    return spark.createDataFrame([(line(result).partition(":")[0],)], "head string")


TYPED_VOTES = "CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END - CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END"


@query(f"SELECT n_nationkey, ({TYPED_VOTES})::DOUBLE AS score, CAST(row_number() OVER (ORDER BY {TYPED_VOTES} DESC, n_nationkey) - 1 AS BIGINT) AS pos FROM nation")
def typed_votes(spark, d):
    """Votes on a typed table's records, given in the log; votes on other tables do not count for them."""
    session = Session(spark)
    session.register(RecordSource("nation", table(spark, d, "nation"), "n_nationkey"))
    keys = [r["n_nationkey"] for r in nations(spark, d)]
    votes = [f"RELATE (u:1)->:voted->(nation:{k}) SET value = 1" for k in keys if k % 3 == 0] + [f"RELATE (u:2)->:voted->(nation:{k}) SET value = -1.0" for k in keys if k % 5 == 0]
    (got,) = session.run(" ".join([*votes, "RELATE (u:3)->:voted->(region:1) SET value = 1 SELECT * FROM nation ORDER BY ::votes"]))
    return got.df.select("n_nationkey", "score", "pos")


# ------------------------------------------------------------------ stores


@query(f"{NATION_ROWS} WHERE n_nationkey NOT IN (2, 3)")
def log_reopened(spark, d):
    """Plans at a path, read by another session; files that no commit names are not read."""
    path, session = stored(spark, "log")
    session.run(nation_program(spark, d))
    session.run("FORGET nation:2 FORGET nation:3")
    logs.frame(spark, [logs.row_of("", 99, 9, Insert(RecordId("nation", 77), {"name": "torn"}))]).write.parquet(f"{path}/data/torn")
    return named(Session(spark, path).run("SELECT * FROM nation")[0])


@query(f"SELECT pos, rid, score, name, true AS merged FROM ({NATION_ROWS} WHERE n_nationkey <> 1)")
def log_checkpointed(spark, d):
    """Beyond two commits the log is rewritten in place; time goes on, and reads are the same."""
    path, session = stored(spark, "log", checkpoint_every=2)
    for text in (nation_program(spark, d), "FORGET nation:1", "INSERT INTO other:1 {}", "INSERT INTO other:2 {}", "FORGET other:1"):
        session.run(text)
    merged = session.store.folders() <= 2 and session.store.state().clocks == {"": 30}
    return named(Session(spark, path).run("SELECT * FROM nation")[0]).withColumn("merged", F.lit(merged))


@query(f"SELECT 0 AS i, 'SELECT nation (5 rows)' AS line UNION ALL SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER), '  ' || {NATION_TEXT.format(gap='  ')} FROM nation WHERE n_regionkey = 4")
def script_source(spark, d):
    """A program file in the shared folder, run and shown as the console shows it."""
    path, out = fresh_path(spark, "script"), io.StringIO()
    spark.createDataFrame([(nation_program(spark, d) + " SELECT * FROM nation WHERE region = 4",)], "value string").coalesce(1).write.text(path)
    run_script(Session(spark), path, out)
    return spark.createDataFrame(list(enumerate(out.getvalue().splitlines())), "i int, line string")


@query("""SELECT 'tables:' AS line UNION ALL SELECT '  emb  VECTOR<f32,2>' UNION ALL SELECT 'records:' UNION ALL SELECT '  emb:1  {} emb=[1, 0.5]' UNION ALL SELECT 'edges:'
UNION ALL SELECT '  nation:' || n_nationkey || '  {name="' || n_name || '", region=' || n_regionkey || '}' FROM nation UNION ALL SELECT * FROM (SELECT DISTINCT '  region:' || n_regionkey || '  {}' FROM nation)
UNION ALL SELECT '  region:' || n_regionkey || ' -[:has]-> nation:' || n_nationkey || '  w=' || n_nationkey || '.5' FROM nation""")
def store_dumped(spark, d):
    session = Session(spark)
    session.run(f"CREATE TABLE emb VECTOR<f32,2> INSERT INTO emb:1 {{}} EMBED [1, 0.5] {nation_program(spark, d)} {edge_program(spark, d)}")
    return spark.createDataFrame([(x,) for x in store_dump(session).splitlines()], "line string")


# ------------------------------------------------------------------ servers


@query(f"SELECT 'SELECT nation (5 rows): ' || string_agg({NATION_TEXT.format(gap=' ')}, '; ' ORDER BY n_nationkey) || chr(10) || 'OK' AS answer FROM nation WHERE n_regionkey = 4")
def line_server(spark, d):
    server = LineServer(Session(spark))
    server.handle_line(nation_program(spark, d))
    return spark.createDataFrame([(server.handle_line("SELECT * FROM nation WHERE region = 4"),)], "answer string")


@query("SELECT * FROM (VALUES (0, 'OK'), (1, 'SELECT t (1 rows): t:1 score=0.0000 {a=1}'), (2, 'OK'), (3, 'ERR parse error at 1:1: unknown statement `NOPE`')) t(i, line)")
def tcp_lines(spark, d):
    """The line protocol over a socket."""
    server = serve_tcp(Session(spark))
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        with socket.create_connection(server.server_address, 120) as s:
            s.sendall(b"CREATE TABLE t INSERT INTO t:1 {a: 1}\nSELECT * FROM t\nNOPE\n")
            s.shutdown(socket.SHUT_WR)
            said = s.makefile(encoding="utf-8").read()
    finally:
        server.shutdown()
        server.server_close()
    return spark.createDataFrame(list(enumerate(said.splitlines())), "i int, line string")


@query("""SELECT '[' || string_agg('{"id": "nation:' || n_nationkey || '", "score": 0.0, "body": {"name": "' || n_name || '", "region": ' || n_regionkey || '}}', ', ' ORDER BY n_nationkey) || ']' AS answer, '{"ok": true}' AS done FROM nation WHERE n_regionkey = 0""")
def tools_json(spark, d):
    tools = Tools(Session(spark))
    tools.create_table("nation")
    done = [tools.insert_record(f"nation:{r['n_nationkey']}", {"name": r["n_name"], "region": r["n_regionkey"]}) for r in nations(spark, d)]
    return spark.createDataFrame([(tools.select("nation", field="region", value=0), *set(done))], "answer string, done string")


@query("""SELECT '{"id": "nation:' || n_nationkey || '", "score": ' || n_nationkey || '.5}' AS hit FROM nation WHERE n_regionkey = 2""")
def tools_steps(spark, d):
    """A path whose steps are JSON values."""
    session = Session(spark)
    session.run(f"{nation_program(spark, d)} {edge_program(spark, d)}")
    hits = json.loads(Tools(session).match_path("region:2", json.loads('[{"direction": "OUT", "name": "has"}]')))
    return spark.createDataFrame([(json.dumps({k: h[k] for k in ("id", "score")}),) for h in hits], "hit string")


# ------------------------------------------------------------------ walks, orders and indexes at their edges


@query("SELECT i::BIGINT AS id, i::BIGINT AS depth, i::BIGINT AS pos FROM range(7) t(i)")
def closure_dead_ends(spark, d):
    """A ring whose eighth node is not there: what lies behind it is not reached."""
    e, n = ring(spark, d)
    e = e.withColumns({c: F.col(c).cast("long") for c in ("src", "dst")})
    return graph.closure(e, n.select(F.col("id").cast("long").alias("id")).where("id <> 7"), 0, [("out", "next", None)])


@query("""WITH r AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1), x AS (SELECT i AS k, min((i - r.k + 25) % 25) AS far FROM range(25) t(i), r GROUP BY i)
SELECT 'region:1' AS id, 0::BIGINT AS depth UNION ALL SELECT 'nation:' || k, (1 + far)::BIGINT FROM x""")
def closure_two_steps(spark, d):
    """From a region to its nations, then around the ring of nations from all of them; levels go on counting."""
    n, nation = table(spark, d, "nation"), lambda key: F.concat(F.lit("nation:"), key.cast("int").cast("string"))
    key = F.col("n_nationkey")
    has = n.select(key.cast("long").alias("seq"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("src"), F.lit("has").alias("name"), nation(key).alias("dst"), F.lit(1.0).alias("weight"))
    after = n.select((key + 100).cast("long").alias("seq"), nation(key).alias("src"), F.lit("next").alias("name"), nation((key + 1) % 25).alias("dst"), F.lit(1.0).alias("weight"))
    e = has.unionByName(after)
    return graph.closure(e, edges_nodes(e), "region:1", [("out", "has", None), ("out", "next", None)]).select("id", "depth")


@query("SELECT 0::BIGINT AS matched, 0::BIGINT AS closed")
def walks_from_unknown_starts(spark, d):
    e = placed(spark, d)
    m = graph.match(e, edges_nodes(e), "nobody", [("out", "placed", None)])
    c = graph.closure(e, edges_nodes(e), "nobody", [("out", "placed", None)])
    return spark.createDataFrame([(m.count(), c.count())], "matched long, closed long")


@query(f"SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id % 4 = 0, CASE WHEN vec_id % 4 = 0 THEN 0 ELSE {SIM} END DESC, vec_id) - 1 AS BIGINT) AS pos FROM embeddings e WHERE vec_id < 60")
def nan_scores_last(spark, d):
    """Every fourth vector has a component that is not a number."""
    e = table(spark, d, "embeddings").where("vec_id < 60")
    broken = F.transform("embedding", lambda x, i: F.when((i == 0) & (F.col("vec_id") % 4 == 0), F.lit(float("nan"))).otherwise(x).cast("float"))
    got = rank(e.withColumn("embedding", broken), ["vec_id"], Ranking(knn=Knn(query_vector(spark, d), 60)), position=True)
    return got.select("vec_id", "pos")


@query("SELECT count(*) AS relevant, 1.0::DOUBLE AS recall, count(*) / 1000000.0::DOUBLE AS precision FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)")
def relevant_edges(spark, d):
    """Relevant records as edges of a query record; everything is retrieved."""
    good = table(spark, d, "labels").where("quality = 1").select(F.lit("query:1").alias("src"), F.lit("relevant").alias("name"), F.col("doc_id").alias("dst"))
    edges = good.unionByName(good).unionByName(good.select(F.lit("query:2").alias("src"), "name", (-F.col("dst") - 1).alias("dst")))
    found = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(0).alias("pos"))
    got = recall_precision(found, relevant_of(edges, "query:1"), 1_000_000)
    return got.select(F.col("hits").alias("relevant"), "recall", "precision")


@query("SELECT 10::BIGINT AS n, true AS enough, true AS exact_is_whole")
def vector_index_recall(spark, d):
    """The approximate index against the exact one: ten queries of ten neighbours, recall 0.9 or more."""
    df = table(spark, d, "embeddings").select("vec_id", "embedding")
    at = [list(r["embedding"]) for r in df.where("vec_id % 17 = 0").orderBy("vec_id").limit(10).collect()]
    near = lambda index, q: {r["vec_id"] for r in index.rank(df, ["vec_id"], q, 10).collect()}
    exact = [near(Exact(), q) for q in at]
    hits = sum(len(near(RandomProjection(), q) & x) for q, x in zip(at, exact, strict=True))
    return spark.createDataFrame([(len(at), hits >= 0.9 * 10 * len(at), all(len(x) == 10 for x in exact))], "n long, enough boolean, exact_is_whole boolean")
