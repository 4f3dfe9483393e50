"""Programs against expected rows, a plain model, and hard cases."""

import io
import json
import math
import random

import pytest

from lorekeep.functions.text import query_terms, tokenize
from lorekeep.model import RecordId
from lorekeep.operators import graph
from lorekeep.operators.ann import Exact, RandomProjection
from lorekeep.operators.lexicon import Lexicon
from lorekeep.operators.metrics import recall_precision, relevant_of
from lorekeep.operators.ranking import Knn, Lexical, Ranking, knn_batch, rank
from lorekeep.operators.ranks import global_rank
from lorekeep.operators.votes import vote_aggregates
from lorekeep.plans.nodes import Insert, Relate, Select
from lorekeep.serve.cli import command, run_text
from lorekeep.serve.lines import LineServer
from lorekeep.serve.tools import Tools
from lorekeep.session import EngineError, Session
from lorekeep.sources import log as logs
from lorekeep.sources.log import LogStore
from lorekeep.sources.typed import RecordSource
from pyspark.sql import functions as F


def ids(result):
    return [str(r.id).split(":")[1] for r in result.rows()]


def scored(result):
    return [(str(r.id).split(":")[1], round(r.score, 6)) for r in result.rows()]


@pytest.fixture
def session(spark):
    return Session(spark)


def ask(session, text):
    return session.run(text)[-1]


TURNS = """CREATE TABLE turn VECTOR<f32,3>
INSERT INTO turn:1 {text: 'tide tables'} EMBED [0,2,0] INSERT INTO turn:2 {text: 'tide pools'} EMBED [0.2,0.8,0] INSERT INTO turn:3 {text: 'ledger'} EMBED [0,0,1]"""


def test_knn(session):
    assert scored(ask(session, TURNS + " SELECT * FROM turn WHERE vector::similarity(embedding,[0,1,0]) AND k=2")) == [("1", 1.0), ("2", 0.970143)]


def test_knn_edge_cases(session):
    r = ask(session, """INSERT INTO vec:a {} EMBED [1,0] INSERT INTO vec:b {} EMBED [0,1] INSERT INTO vec:c {} EMBED [0.70710677,0.70710677] INSERT INTO vec:d {} EMBED [-1,0] INSERT INTO vec:e {}
    INSERT INTO vec:f {} EMBED [0,0] INSERT INTO vec:g {} EMBED [] SELECT * FROM vec WHERE vector::similarity(embedding,[1,0]) AND k=9""")
    assert ids(r) == ["a", "c", "b", "e", "f", "g", "d"]
    assert scored(ask(session, "INSERT INTO w:1 {} EMBED [1] SELECT * FROM w WHERE vector::similarity(embedding,[1,1]) AND k=1")) == [("1", 1.0)]


def test_filters(session):
    session.run("""INSERT INTO person:1 {name: 'ines', age: 30} EMBED [1,0] INSERT INTO person:2 {name: 'omar', age: 40, gone: null} INSERT INTO person:10 {name: 'wen', age: 30} EMBED [0,1]
    INSERT INTO person:x {age: 30.0, tags: [1,2], d: {b: 1, a: 'x'}}""")
    q = lambda w: ids(ask(session, f"SELECT * FROM person WHERE {w}"))
    assert q("age = 30") == ["1", "10"] and q("age = 30.0") == ["x"] and q("embedding IS NOT NULL") == ["1", "10"]
    assert q("gone = null") == ["2"] and q("missing = null") == [] and q("tags = [1.0, 2]") == ["x"] and q("d = {a: 'x', b: 1}") == ["x"]
    assert ids(ask(session, "SELECT * FROM person")) == ["1", "2", "10", "x"] and ids(ask(session, "SELECT * FROM person LIMIT 0")) == []


def test_tokenizer(spark):
    texts = ["Nine-Pin  bowling; 1904: LISBON_north", "jalapeño~crème/7b", "", " ?? -- ", "over_under", "İx"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tokenize(F.col("t")).alias("w")).orderBy("i").collect()
    assert [list(r["w"]) for r in rows[:5]] == [["nine", "pin", "bowling", "1904", "lisbon", "north"], ["jalapeño", "crème", "7b"], [], [], ["over", "under"]]
    assert [query_terms(t) for t in (texts[0] + " nine", texts[1])] == [["nine", "pin", "bowling", "1904", "lisbon", "north"], ["jalapeño", "crème", "7b"]] and len(rows[5]["w"]) == 1


def model_bm25(texts, query):
    """Scores by the formula, over texts that are all words."""
    docs = {k: t.split() for k, t in texts.items()}
    mean = sum(map(len, docs.values())) / len(docs)
    out = {}
    for k, w in docs.items():
        out[k] = 0.0
        for q in query.split():
            n, f = sum(q in d for d in docs.values()), w.count(q)
            out[k] += math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return sorted(((k, round(x, 6)) for k, x in out.items()), key=lambda r: (-r[1], r[0]))


def test_bm25(session):
    texts = {"1": "a harbour with three cranes and one ferry", "2": "the ferry left", "3": "cranes migrate south", "4": "ferry ferry ferry timetable"}
    session.run(" ".join(f"INSERT INTO doc:{k} {{t: '{t}'}}" for k, t in texts.items()))
    assert scored(ask(session, "SELECT * FROM doc WHERE ::bm25(t,'ferry')")) == model_bm25(texts, "ferry")
    assert scored(ask(session, "SELECT * FROM doc WHERE ::bm25(t,'ferry cranes')")) == model_bm25(texts, "ferry cranes")
    assert ids(ask(session, "SELECT * FROM doc WHERE ::bm25(t,'ferry') AND k = 1")) == ["4"]
    assert scored(ask(session, "SELECT * FROM doc WHERE ::bm25(t,'')")) == [(k, 0.0) for k in "1234"]
    session.run("INSERT INTO doc:0 {t: 5} INSERT INTO doc:9 {}")
    assert ids(ask(session, "SELECT * FROM doc WHERE ::bm25(t,'ferry')"))[:3] == ["4", "2", "1"]
    assert ids(ask(session, "SELECT * FROM doc WHERE ::bm25(t,'ferry') AND k = 0")) == []


def test_hybrid(session, monkeypatch):
    texts = {"a": ("moss moss moss", "[0,0,1]"), "b": ("nothing of it", "[0.9,0,0]"), "c": ("moss moss moss moss moss", "[0.8,0.2,0]"), "d": ("stone wall", "[0.1,0.3,0]")}
    session.run(" ".join(f"INSERT INTO doc:{k} {{t: '{t}'}} EMBED {v}" for k, (t, v) in texts.items()))
    lexical = {k: i for i, (k, _) in enumerate(model_bm25({k: t for k, (t, _) in texts.items()}, "moss"), 1)}
    near = {k: i for i, k in enumerate("bcda", 1)}
    want = sorted(((k, round(1 / (60 + lexical[k]) + 1 / (60 + near[k]), 6)) for k in texts), key=lambda r: (-r[1], r[0]))
    q = "SELECT * FROM doc WHERE ::bm25(t,'moss') AND vector::similarity(embedding,[1,0,0]) AND k="
    import lorekeep.operators.ranks as ranks

    for small in (ranks.SMALL, 0):  # rows go along, or come back to the ids that stay
        monkeypatch.setattr(ranks, "SMALL", small)
        assert scored(ask(session, q + "4")) == want and len(ids(ask(session, q + "3"))) == 3
        bodies = [r.body["t"] for r in ask(session, q + "4 ORDER BY ::recency").rows()]
        assert sorted(bodies) == sorted(t for t, _ in texts.values())


def test_stored_counts_give_the_same_scores(spark):
    rng = random.Random(8)
    rows = [(i, None if i % 9 == 0 else " ".join(rng.choice("moss fern reed sedge".split()) for _ in range(rng.randrange(7))), [rng.random(), 1.0], i) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, embedding array<float>, created_at long")
    counts = Lexicon(df, ["id"], "text")
    for words in ("moss", "fern moss absent", "reed", "..."):
        for what in (Ranking(lexical=Lexical("text", words)), Ranking(Knn((1.0, 0.1), 20), Lexical("text", words))):
            got = [[(r["id"], round(r["score"], 12)) for r in rank(df, ["id"], what, lexicon=x).collect()] for x in (None, counts)]
            assert got[0] == got[1]
    source = RecordSource("t", df, "id", "embedding", lexicon=counts)
    assert source.select(Select("t", lexical=Lexical("text", "sedge", 5))).count() == 5


def test_counting_terms_makes_a_row_a_record(spark, monkeypatch):
    import lorekeep.operators.lexicon as lexicon

    made, stage = [], lexicon.staged
    monkeypatch.setattr(lexicon, "staged", lambda df, name: made.append(stage(df, name)) or made[-1])
    words = [f"w{i}" for i in range(50)]
    df = spark.createDataFrame([(i, " ".join(words[: 10 + i])) for i in range(40)], "id long, text string")
    counts = Lexicon(df, ["id"], "text")
    all_of = lambda text: rank(df, ["id"], Ranking(lexical=Lexical("text", text)), lexicon=counts).count()
    assert all_of("w1 w30") == 40 and sum(t.count() for t in made) == 40


def test_recall_of_bm25_counts_texts_once(spark, sf_dir, monkeypatch):
    import lorekeep.operators.lexicon as lexicon
    from lorekeep import queries

    made, stage = [], lexicon.staged
    monkeypatch.setattr(lexicon, "staged", lambda df, name: made.append(stage(df, name)) or made[-1])
    monkeypatch.setattr(queries, "_lexicons", {})
    first = [tuple(r) for r in queries.recall_precision_bm25(spark, sf_dir).collect()]
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert sum(t.count() for t in made) == n
    again = [tuple(r) for r in queries.recall_precision_bm25(spark, sf_dir).collect()]
    assert first == again and len(made) == 1
    # some of the terms, in another order, are read from the same counts
    docs, counts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), queries.lexicon(spark, sf_dir)
    what = Ranking(lexical=Lexical("text", "of the", 30))
    got = [[(r["doc_id"], r["score"]) for r in rank(docs, ["doc_id"], what, lexicon=x).collect()] for x in (counts, None)]
    assert got[0] == got[1] and len(made) == 1


def test_large_row_groups_are_dealt_over_all_cores(spark, tmp_path, monkeypatch):
    import lorekeep.operators.lexicon as lexicon
    import lorekeep.operators.ranking as ranking
    from lorekeep import scratch

    monkeypatch.setattr(scratch, "SPREAD_BYTES", 0)  # every table counts as large
    monkeypatch.setattr(scratch, "DEALT_BYTES", 1 << 20)
    tasks, stage = [], lexicon.staged

    def held(df, name):
        tasks.append(df.select(F.spark_partition_id()).distinct().count())
        return stage(df, name)

    monkeypatch.setattr(lexicon, "staged", held)
    monkeypatch.setattr(ranking, "staged", held)
    rng = random.Random(3)
    rows = [(i or None, " ".join(rng.choice("moss fern reed".split()) for _ in range(1 + i % 7))) for i in range(400)]
    made = spark.createDataFrame(rows, "id long, text string")
    what = Ranking(lexical=Lexical("text", "fern moss", 50))
    best = lambda df, counts: [(r["id"], round(r["score"], 12)) for r in rank(df, ["id"], what, lexicon=counts).collect()]
    want = best(made, None)  # not a scan: rows stay where they are
    for files, least, most in ((1, 8, 8), (2, 8, 8), (4, 1, 4)):  # of 4 cores; where files are enough for all of them, rows stay, too
        made.repartition(files).write.parquet(path := f"{tmp_path}/{files}")
        df = spark.read.parquet(path)
        tasks.clear()
        assert best(df, None) == best(df.select("id"), Lexicon(df, ["id"], "text")) == want
        assert len(tasks) == 2 and all(least <= n <= most for n in tasks), (files, tasks)


def test_counts_of_a_record_without_id(spark):
    df = spark.createDataFrame([(None, "moss moss"), (1, "moss fern"), (2, "fern")], "id long, text string")
    what = Ranking(lexical=Lexical("text", "moss"))
    got = [[(r["id"], r["score"]) for r in rank(df.select("id", *more), ["id"], what, lexicon=x).collect()] for more, x in ((["text"], None), ([], Lexicon(df, ["id"], "text")))]
    assert got[0] == got[1] and got[0][0][0] is None and got[0][0][1] > 0


def test_a_query_without_terms_reads_no_text(spark):
    df = spark.range(30).selectExpr("id", "cast(raise_error('text read') as string) AS text", "array(cast(id AS double), 1D) AS embedding", "id AS created_at")
    for counts in (None, Lexicon(df, ["id"], "text")):
        got = rank(df.select("id", "text"), ["id"], Ranking(lexical=Lexical("text", " ... ", 10)), lexicon=counts).select("id", "score").collect()
        assert [(r["id"], r["score"]) for r in got] == [(i, 0.0) for i in range(10)]
        got = rank(df, ["id"], Ranking(Knn((1.0, 0.0), 5), Lexical("text", "")), lexicon=counts).select("id").collect()
        assert [r["id"] for r in got] == [0, 29, 1, 28, 2]  # places by id and by nearness, fused


def test_hybrid_tie_and_recency(session):
    session.run("INSERT INTO doc:lex {t: 'kelp kelp kelp'} INSERT INTO doc:both {t: 'kelp kelp'} EMBED [1,0]")
    assert ids(ask(session, "SELECT * FROM doc WHERE ::bm25(t,'kelp') AND vector::similarity(embedding,[1,0]) AND k=2")) == ["both", "lex"]
    session.execute([Insert(RecordId("m", i), {"t": "x " * (4 - i)}, None, c) for i, c in ((1, 1), (2, 2), (3, 3))])
    r = ask(session, "SELECT * FROM m WHERE ::bm25(t,'x') ORDER BY ::recency")
    assert ids(r) == ["3", "2", "1"] and r.rows()[0].score > 0


def test_votes_and_scores(session):
    session.run("""INSERT INTO post:1 {} INSERT INTO post:2 {} INSERT INTO post:3 {} RELATE (u:1)->:voted->(post:1) SET weight = 1.0 RELATE (u:2)->:voted->(post:1)
    RELATE (u:1)->:voted->(post:2) SET weight = 0.0 RELATE (u:1)->:liked->(post:3) SET weight = 1""")
    assert scored(ask(session, "SELECT * FROM post ORDER BY ::score")) == [("1", 0.75), ("3", 0.5), ("2", 0.333333)]
    session.run("RELATE (u:9)->:voted->(post:3) SET value = -1")  # a downvote without a weight raises the score
    assert scored(ask(session, "SELECT * FROM post ORDER BY ::score"))[1] == ("3", 0.666667)
    session.run("RELATE (u:3)->:voted->(post:2) SET value = 1 RELATE (u:4)->:voted->(post:2) SET value = 1.0 RELATE (u:5)->:voted->(post:2) SET value = 'x'")
    assert scored(ask(session, "SELECT * FROM post ORDER BY ::votes")) == [("2", 2.0), ("1", 0.0), ("3", -1.0)]
    assert scored(ask(session, "SELECT * FROM post ORDER BY ::feedback LIMIT 1")) == [("2", 2.0)]


def test_feedback_decays(spark):
    votes = spark.createDataFrame([("d", 1.0, 1, 100), ("d", 1.0, 1, 200), ("d", 1.0, -1, 0)], "k string, weight double, sign int, created_at long")
    r = vote_aggregates(votes, ["k"]).first()
    assert (round(r["feedback"], 6), r["up"], r["down"], r["net"]) == (1.004926, 2, 1, 1)


def test_salience(session):
    session.run("INSERT INTO doc:1 {} EMBED [1,0] INSERT INTO doc:2 {} RELATE (u:1)->:voted->(doc:1) SET weight = 1")
    got = scored(ask(session, "SELECT * FROM doc WHERE vector::similarity(embedding,[1,0]) AND k=10 ORDER BY ::salience"))
    assert got == [("1", 0.9), ("2", 0.15)]
    for n, v, w in ((1, "[1,0,0]", 0.8), (2, "[1,0,0]", 0.9), (3, "[0,1,0]", 0.3), (4, "[0,0,1]", 0.4), (5, "[0.99,0.1,0]", 0.6)):
        session.run(f"INSERT INTO chat:{n} {{}} EMBED {v} RELATE (u:1)->:voted->(chat:{n}) SET weight = {w}")
    assert ids(ask(session, "SELECT * FROM chat WHERE vector::similarity(embedding,[1,0,0]) AND k=3 ORDER BY ::salience")) == ["2", "1", "5"]


def test_order_by_score_ignores_nearness(session):
    session.run(TURNS + " RELATE (u:1)->:voted->(turn:3) SET weight = 1")
    assert ids(ask(session, "SELECT * FROM turn WHERE vector::similarity(embedding,[1,0,0]) AND k=1 ORDER BY ::score")) == ["3"]


def test_recency_keeps_similarity_as_score(session):
    session.execute([Insert(RecordId("msg", i), {}, (1.0, 0.0), i) for i in (1, 3, 2)])
    r = ask(session, "SELECT * FROM msg WHERE vector::similarity(embedding,[1,0]) AND k=3 ORDER BY ::recency")
    assert scored(r) == [("3", 1.0), ("2", 1.0), ("1", 1.0)]


def test_match(session):
    session.run("""INSERT INTO person:1 {} INSERT INTO note:1 {} INSERT INTO note:2 {} INSERT INTO note:3 {} RELATE (person:1)->:mentions->(note:2) SET weight=0.5, sure=true
    RELATE (person:1)->:mentions->(note:1) SET weight=0.9 RELATE (person:1)->:mentions->(note:3) RELATE (person:1)->:mentions->(note:2) SET weight=0.1 RELATE (person:1)->:mentions->(note:99)""")
    q = lambda t: scored(ask(session, t))
    assert q("MATCH (person:1)->:mentions") == [("2", 0.5), ("1", 0.9), ("3", 0.0)]
    assert q("MATCH (person:1)->:mentions WHERE sure = true") == [("2", 0.5)] and q("MATCH (person:1)->:mentions WHERE weight = 0.9") == []
    assert q("MATCH (note:2)<-:mentions") == [("1", 0.5)]
    assert q("MATCH (note:2)<-:mentions->:mentions") == [("2", 0.0), ("1", 0.9), ("3", 0.0)]  # the start counts as reached at 0
    assert q("MATCH (person:7)->:mentions") == [] and q("MATCH (person:1)->:nothing") == []


def test_closure(session):
    session.run("""INSERT INTO p:1 {} INSERT INTO p:2 {} INSERT INTO p:3 {} INSERT INTO p:4 {} RELATE (p:1)->:knows->(p:2) SET trust=true RELATE (p:2)->:knows->(p:3) RELATE (p:3)->:knows->(p:1)
    RELATE (p:2)->:likes->(p:4) RELATE (p:1)->:knows->(p:88)""")
    assert scored(ask(session, "CLOSURE (p:1)->:knows")) == [("1", 0.0), ("2", 1.0), ("3", 2.0)]
    assert scored(ask(session, "CLOSURE (p:1)->:knows WHERE trust=true")) == [("1", 0.0), ("2", 1.0)]
    assert scored(ask(session, "CLOSURE (p:1)->:knows->:likes"))[-1] == ("4", 3.0)  # levels go on counting
    assert scored(ask(session, "CLOSURE (p:1)->:likes->:knows")) == [("1", 0.0)] and scored(ask(session, "CLOSURE (p:9)->:knows")) == []


def model_closure(edges, live, start, steps):
    if start not in live:
        return []
    order, depth = {start: 0}, 1
    for k, (direction, name) in enumerate(steps):
        frontier = [start] if k == 0 else [n for n in order if n != start]
        while frontier:
            new = []
            for node in frontier:
                for _, s, n, d in edges:
                    near, far = (s, d) if direction == "out" else (d, s)
                    if n == name and near == node and far in live and far not in order:
                        order[far] = depth
                        new.append(far)
            depth += bool(new)
            frontier = new
    return [(n, d, i) for i, (n, d) in enumerate(order.items())]


def model_match(edges, live, start, steps):
    if start not in live:
        return []
    frontier, score = [start], {start: 0.0}
    for direction, name in steps:
        new = []
        for q, s, n, d in edges:
            near, far = (s, d) if direction == "out" else (d, s)
            if n == name and near in frontier and far in live and far not in new:
                new.append(far)
                score.setdefault(far, q / 8)
        frontier = new
    return [(n, score[n]) for n in frontier]


@pytest.mark.parametrize("seed", range(2))
def test_graph_against_model(spark, seed):
    rng = random.Random(seed)
    edges = [(i, rng.randrange(40), rng.choice("ab"), rng.randrange(40)) for i in range(110)]
    live = set(rng.sample(range(40), 34))
    e = spark.createDataFrame([(*x, x[0] / 8) for x in edges], "seq long, src long, name string, dst long, weight double").repartition(5).cache()
    nodes = spark.createDataFrame([(n,) for n in live], "id long").cache()
    for start, steps in ((min(live), [("out", "a")]), (max(live), [("in", "a"), ("out", "b")])):
        full = [(d, n, None) for d, n in steps]
        want = model_closure(edges, live, start, steps)
        for limit in (10**6, 0):
            assert [tuple(r) for r in graph.closure(e, nodes, start, full, limit).orderBy("pos").collect()] == want
        got = [(r["id"], r["score"]) for r in graph.match(e, nodes, start, full).orderBy("seq").collect()]
        assert got == model_match(edges, live, start, steps)


def test_as_of_forget_and_upsert(session):
    session.run("CREATE TABLE t INSERT INTO t:1 {v: 1} INSERT INTO t:2 {v: 2} FORGET t:1")
    assert [ids(ask(session, f"SELECT * FROM t AS OF {n}")) for n in (1, 2, 3, 4, 99)] == [[], ["1"], ["1", "2"], ["2"], ["2"]]
    session.run("INSERT INTO t:2 {v: 3}")
    assert [ask(session, f"SELECT * FROM t AS OF {n}").rows()[-1].body for n in (4, 5)] == [{"v": 2}, {"v": 3}]
    session.run("INSERT INTO t:1 {} RELATE (t:1)->:e->(t:2) FORGET t:2 INSERT INTO t:2 {}")
    assert ids(ask(session, "MATCH (t:1)->:e")) == []


def test_memories_and_reopening(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    s = Session(spark, path)
    s.run("INSERT INTO t:1 {w: 'root'} MEMORY core INSERT INTO t:1 {w: 'core'} INSERT INTO t:2 {}")
    s.run("INSERT INTO t:3 {w: 'root again'}")
    again = Session(spark, path)
    assert ids(ask(again, "SELECT * FROM t")) == ["1", "3"] and ids(ask(again, "MEMORY core SELECT * FROM t")) == ["1", "2"]
    assert ids(ask(again, "MEMORY core SELECT * FROM t AS OF 1")) == ["1"] and ids(ask(again, "MEMORY new SELECT * FROM t")) == []
    packed = LogStore(spark, path).compact(f"file://{tmp_path}/packed")
    assert packed.read().count() == 4 and packed.snapshot()[0].count() == 2
    with pytest.raises(ValueError):
        LogStore(spark, path).compact(f"file://{tmp_path}/packed")
    Session(spark, f"file://{tmp_path}/packed").run("INSERT INTO t:4 {}")
    assert [r["ts"] for r in packed.read().where("rid = 't:4'").collect()] == [3]


def test_commits_are_whole_and_checkpoints_in_place(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    store = LogStore(spark, path, checkpoint_every=3)
    for i in range(8):
        store.commit([logs.row_of("", i + 1, i + 1, Insert(RecordId("t", i), {}))])
        # what a writer that died left: files, an entry that was never moved into place
        logs.frame(spark, [logs.row_of("", 50 + i, 50, Insert(RecordId("torn", i), {}))]).write.parquet(f"{path}/data/torn{i}")
        (tmp_path / "log" / "commits" / f".{i + 2:012d}-half").write_text('{"folder": "torn')
        assert LogStore(spark, path).read().count() == i + 1 and store.folders() <= 4
    assert LogStore(spark, path).state().clocks == {"": 8} and store.state().plan_id == 8
    late, early = LogStore(spark, path), LogStore(spark, path)
    late.state()
    early.commit([logs.row_of("", 9, 9, Insert(RecordId("t", 9), {}))])
    late._refresh = lambda: late._seen  # a second writer that has not seen the first one's commit
    with pytest.raises(RuntimeError):
        late.commit([logs.row_of("", 9, 9, Insert(RecordId("t", 10), {}))])
    assert LogStore(spark, path).read().where("rid in ('t:9', 't:10')").count() == 1


def test_a_select_reads_its_own_table(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    Session(spark, path).run("INSERT INTO a:1 {} INSERT INTO b:1 {}")
    plan = logs.records(LogStore(spark, path).read(), "", None, "a")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("Exchange") and "EqualTo(tbl,a)" in plan


def test_votes_on_typed_tables(spark):
    s = Session(spark)
    s.register(RecordSource("item", spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "key long, label string"), "key"))
    s.register(RecordSource("named", spark.createDataFrame([("p",), ("q",)], "key string"), "key"))
    s.run("RELATE (u:1)->:voted->(item:2) SET value = 1 RELATE (u:1)->:voted->(item:3) SET value = -1 RELATE (u:1)->:voted->(other:1) SET value = 1 RELATE (u:1)->:voted->(named:q) SET weight = 1")
    assert scored(ask(s, "SELECT * FROM item ORDER BY ::votes")) == [("2", 1.0), ("1", 0.0), ("3", -1.0)]
    assert scored(ask(s, "SELECT * FROM item ORDER BY ::feedback LIMIT 1")) == [("2", 1.0)]
    assert scored(ask(s, "SELECT * FROM named ORDER BY ::score")) == [("q", 0.666667), ("p", 0.5)]
    with pytest.raises(EngineError):
        s.run("SELECT * FROM item AS OF 1")


def test_match_with_many_and_few_nodes_agree(spark, monkeypatch):
    e = spark.createDataFrame([(i, i % 7, "n", (i * 5) % 11, 0.5 * i) for i in range(60)], "seq long, src long, name string, dst long, weight double")
    nodes = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 6, 8, 9, 9)], "id long")
    steps = [("out", "n", None), ("in", "n", None), ("out", "n", F.col("seq") > 9)]
    got = [sorted(tuple(r) for r in graph.match(e, nodes, 1, steps).collect())]
    monkeypatch.setattr(graph, "LOCAL_EDGES", 1)
    got.append(sorted(tuple(r) for r in graph.match(e, nodes, 1, steps).collect()))
    assert got[0] == got[1] and len(got[0]) > 3


def test_plans_are_whole_or_nothing(spark, session):
    session.run("CREATE TABLE t VECTOR<f32,2>")
    with pytest.raises(EngineError):
        session.run("INSERT INTO t:1 {} INSERT INTO t:2 {} EMBED [1,2,3]")
    assert ids(ask(session, "SELECT * FROM t")) == [] and ids(ask(session, "INSERT INTO t:3 {} SELECT * FROM t")) == ["3"]
    session.run("CREATE TABLE t INSERT INTO t:4 {} EMBED [1,2,3]")
    assert ids(ask(session, "SELECT * FROM t")) == ["3", "4"]
    with pytest.raises(ValueError):
        Session(spark, strict=True).run("SELECT * FROM undeclared")


def test_partitions_do_not_change_results(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("fjord delta canyon mesa".split()) for _ in range(rng.randrange(6))), [rng.choice([0.0, 1.0, 0.5]), rng.random()], 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, text string, embedding array<float>, created_at long")
    what = Ranking(Knn((1.0, 0.2), 50), Lexical("text", "fjord delta"))
    got = [[tuple(r) for r in rank(df.repartition(n), ["id"], what).select("id", "score").collect()] for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 50


def test_global_rank_forms_agree(spark, monkeypatch):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("x"))
    order = [F.col("x").desc(), F.col("id").asc()]
    small = {tuple(r) for r in global_rank(df, order, "n").collect()}
    import lorekeep.operators.ranks as ranks

    monkeypatch.setattr(ranks, "SMALL", 0)
    assert {tuple(r) for r in global_rank(df, order, "n").select("id", "x", "n").collect()} == small


def test_metrics(spark):
    rel = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = spark.createDataFrame([(1, 0), (9, 1), (2, 2)], "id long, pos long")
    m = lambda k, r=rel: tuple(round(x, 6) for x in recall_precision(got, r, k).first()[1:])
    assert m(2) == (0.333333, 0.5) and m(3) == (0.666667, 0.666667) and m(0) == (0.0, 0.0) and m(2, rel.limit(0)) == (1.0, 0.0)
    e = spark.createDataFrame([("q", "relevant", "a"), ("q", "relevant", "a"), ("q", "other", "b")], "src string, name string, dst string")
    assert [r["id"] for r in relevant_of(e, "q").collect()] == ["a"]


def test_vector_index_top_hit(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = list(df.where("vec_id = 5").first()["embedding"])
    assert Exact().rank(df, ["vec_id"], q, 1).first()["vec_id"] == RandomProjection().rank(df, ["vec_id"], q, 3).first()["vec_id"] == 5


def test_vector_index_recall_and_missing_embeddings(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").cache()
    ids = lambda index, table, q: [r["vec_id"] for r in index.rank(table, ["vec_id"], q, 10).collect()]
    at = [list(r["embedding"]) for r in df.where("vec_id % 100 = 0").orderBy("vec_id").limit(5).collect()]
    hits = sum(len(set(ids(RandomProjection(), df, q)) & set(ids(Exact(), df, q))) for q in at)
    assert hits >= 0.9 * 10 * len(at), hits
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [-1.0, 0.0]), (4, None)], "vec_id long, embedding array<double>")
    assert ids(RandomProjection(), some, [1.0, 0.0])[:3] == ids(Exact(), some, [1.0, 0.0])[:3] == [1, 2, 4]


def test_batch_search_walks_large_query_sets_in_blocks(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "id long, embedding array<double>")
    at = [(i, [1.0, 0.1] if i % 2 else [-1.0, 0.1]) for i in range(10_050)]
    got = knn_batch(df, ["id"], spark.createDataFrame(at, "query_id long, query array<double>"), 1).collect()
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in got) == [(i, 0 if i % 2 else 2, 1) for i, _ in at]


def brute_batch(records, queries, k):
    """(query_id, id, score, rank) by sums in order over the shorter length."""
    def add(xs):  # sum() carries what it rounds off
        total = 0.0
        for x in xs:
            total += x
        return total

    def score(a, b):
        if a is None or b is None or None in a or None in b:
            return 0.0
        a, b = a[: len(b)], b[: len(a)]
        x, y = (math.sqrt(add(v * v for v in w)) for w in (a, b))
        return add(v * w for v, w in zip(a, b, strict=True)) / (x * y) if x and y else 0.0

    out = []
    for q, b in queries:
        best = sorted(((score(a, b), i) for i, a in records), key=lambda r: (math.isnan(r[0]), 0 if math.isnan(r[0]) else -r[0], r[1]))[:k]
        out += [(q, i, repr(s), n) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_batch_search_of_odd_vectors(spark):
    """Copies, multiples, zeros, missing and short vectors, numbers that are none, and norms that a product does not hold."""
    rng = random.Random(5)
    some = [[rng.gauss(0, 1) for _ in range(7)] for _ in range(40)]
    odd = [None, [], [0.0] * 7, [1.0, None] + [0.0] * 5, [float("nan")] * 7, [float("inf")] + [1.0] * 6]
    records = [(f"r{i:05}", some[i % 40] if i % 3 else [2 * x for x in some[i % 40]]) for i in range(3000)]
    records += [(f"s{i:05}", v) for i, v in enumerate(odd + [x[:4] for x in some])]
    huge = [(f"t{i}", [x * 1e-140 for x in v]) for i, v in enumerate(some)]
    queries = [(i, v) for i, v in enumerate(some[:20] + odd[:5] + [some[3][:3]])]
    for held in (records, records + huge, [(f"u{i}", v) for i, v in enumerate(odd)]):
        for k in (1, 30, 120):
            got = knn_batch(spark.createDataFrame(held, "id string, embedding array<double>"), ["id"], spark.createDataFrame(queries, "query_id long, query array<double>"), k)
            assert sorted((r["query_id"], r["id"], repr(r["score"]), r["rank"]) for r in got.collect()) == brute_batch(held, queries, k)
    assert knn_batch(spark.createDataFrame(records, "id string, embedding array<double>"), ["id"], spark.createDataFrame(queries, "query_id long, query array<double>"), 0).count() == 0


def test_batch_search_makes_no_row_a_pair(spark, sf_dir):
    from lorekeep.queries import knn_batch_hundredths

    assert "Join" not in knn_batch_hundredths(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_nan_scores_go_last(spark):
    df = spark.createDataFrame([(1, [float("nan"), 1.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])], "id long, embedding array<float>")
    got = rank(df, ["id"], Ranking(Knn((1.0, 0.0), 3))).collect()
    assert [r["id"] for r in got] == [2, 3, 1] and math.isnan(got[2]["score"])


def test_line_server(session):
    server = LineServer(session)
    assert server.handle_line("CREATE TABLE t VECTOR<f32,5>") == "OK" and server.handle_line("INSERT INTO t:1 {a: 'x', n: 1.0, v: [1,2,3,4,5], l: ['a',1,2,3]}") == "OK"
    assert server.handle_line("SELECT * FROM t") == 'SELECT t (1 rows): t:1 score=0.0000 {a="x", l=["a", 1, 2], n=1, v=[1, 2, 3, 4, ...]}\nOK'
    assert server.handle_line("SELECT * FROM zzz").startswith("ERR ") and server.handle_line("SELEC").startswith("ERR parse error at 1:1")
    assert server.handle_line("MATCH (t:1)->:x") == "MATCH t:1 ->:x (0 rows)\nOK"
    out = io.StringIO()
    server.serve(io.StringIO("\nSELECT * FROM t LIMIT 0\n"), out)
    assert out.getvalue() == "SELECT t (0 rows)\nOK\n"


def test_tools(session):
    t = Tools(session)
    assert json.loads(t.create_table("doc", 2)) == {"ok": True}
    for call in (t.insert_record("doc:1", {"a": [1, 2], "t": "reed"}, [1, 0]), t.insert_record("doc:2", {"a": 1.0}), t.relate("doc:1", "r", "doc:2", 0.5, {"p": 1})):
        assert json.loads(call) == {"ok": True}
    assert [r["id"] for r in json.loads(t.select("doc", vector=[1, 0]))] == ["doc:1", "doc:2"]
    assert json.loads(t.select("doc", field="a", value=1.0))[0]["body"] == {"a": 1.0} and json.loads(t.select("doc", field="a", value=1)) == []
    assert json.loads(t.match_path("doc:1", [{"name": "r", "where": {"field": "p", "value": 1}}])) == [{"id": "doc:2", "score": 0.5, "body": {"a": 1.0}}]
    assert [r["score"] for r in json.loads(t.closure("doc:1", [{"direction": "out", "name": "r"}]))] == [0.0, 1.0]
    assert json.loads(t.execute("SELECT * FROM doc WHERE a = [1,2]"))[0]["rows"] == []  # an array is no vector
    assert t.match_path("doc:1", []).startswith("ERR") and t.insert_record("bad", {}).startswith("ERR") and t.select("doc", order="x").startswith("ERR")
    assert json.loads(t.forget("doc:1")) == {"ok": True}


def test_console(session):
    out = io.StringIO()
    assert run_text(session, "INSERT INTO t:1 {a: 1} EMBED [1,2] RELATE (t:1)->:e->(t:1) SET weight=0.5 SELECT * FROM t", out)
    assert not run_text(session, "NOPE", out) and command(session, ":store", out) is session and command(session, ":quit", out) is None
    text = out.getvalue()
    assert "SELECT t (1 rows)\n  t:1  score=0.0000  {a=1}" in text and "t:1 -[:e]-> t:1  w=0.5" in text and "parse error at 1:1" in text


def test_typed_sources(spark, sf_dir):
    from lorekeep.sources.typed import parquet

    s = Session(spark)
    s.register(parquet(spark, f"{sf_dir}/part.parquet", "part", "p_partkey"))
    r = s.execute([Select("part", limit=3)])[0]
    assert len(ids(r)) == 3
    plan = s.run("SELECT * FROM part WHERE p_brand = 'Brand#11'")[0].df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(p_brand), EqualTo(p_brand,Brand#11)]" in plan


def test_stream_ingest_is_idempotent(spark, tmp_path):
    from lorekeep.streaming.ingest import INPUT, ingest, stamp

    store = LogStore(spark, f"file://{tmp_path}/log")
    store.commit([logs.row_of("", 1, 1, Insert(RecordId("t", 0), {}))])
    rows = spark.createDataFrame([("w", i, "", "insert", "t", 0, i, None, f"t:{i}") for i in (1, 2)], "source string, seq long, memory string, op string, tbl string, id_kind byte, id_num long, id_str string, rid string")
    rows = rows.withColumn("id_num", F.col("id_num").cast("decimal(20,0)"))
    full = spark.createDataFrame([], INPUT).unionByName(rows, allowMissingColumns=True)
    full.write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):
        ingest(spark, f"file://{tmp_path}/in", store, f"file://{tmp_path}/ck").awaitTermination()
    got = store.read().orderBy("ts").collect()
    assert [(r["ts"], r["rid"]) for r in got] == [(1, "t:0"), (2, "t:1"), (3, "t:2")]
    # a batch that was written but not committed is not there, and its replay is whole
    full.limit(1).write.mode("overwrite").parquet(f"file://{tmp_path}/log/data/half")
    assert not store.append(stamp(full, store.state().clocks, 9), f"file://{tmp_path}/ck", 0)
    assert store.append(stamp(full, store.state().clocks, 9), f"file://{tmp_path}/other", 0) and [r["ts"] for r in store.read().orderBy("ts").collect()] == [1, 2, 3, 4, 5]


def test_relations_survive_only_with_live_ends(session):
    session.execute([Insert(RecordId("a", 1)), Relate(RecordId("a", 1), "r", RecordId("a", 2), 0.25)])
    assert ids(ask(session, "MATCH (a:1)->:r")) == []
    session.run("INSERT INTO a:2 {}")
    assert scored(ask(session, "MATCH (a:1)->:r")) == [("2", 0.25)]
