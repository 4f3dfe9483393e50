"""Lexer, parser and analyzer."""

import random

import pytest

from lorekeep.lang.lexer import LangError, tokenize
from lorekeep.lang.parser import parse, parse_statement
from lorekeep.model import RecordId, Vector, canon, from_canon, tag_of
from lorekeep.operators.ranking import Knn, Lexical
from lorekeep.plans.analyzer import AnalysisError, analyze
from lorekeep.plans.nodes import Closure, CreateTable, FieldEquals, Forget, HasEmbedding, Insert, Match, Memory, Relate, Select, Step


def one(text):
    (s,) = parse(text)
    return s


def test_statements():
    assert one("CREATE TABLE turn VECTOR<f32, 3>") == CreateTable("turn", 3)
    assert one("create table note;") == CreateTable("note")
    got = one("INSERT INTO turn:1 {text: 'a\\n\"', n: 3, f: 1.5, ok: TRUE, none: null, word: bare, tags: ['a', 1], vec: [1, 2.5], doc: {x: {}}, e: [],} EMBED [1, 0.5, 0]")
    assert got.id == RecordId("turn", 1) and got.embedding == (1.0, 0.5, 0.0)
    assert got.body == {"text": 'a\n"', "n": 3, "f": 1.5, "ok": True, "none": None, "word": "bare", "tags": ["a", 1], "vec": Vector([1, 2.5]), "doc": {"x": {}}, "e": []}
    assert one("RELATE (a:1) -> :knows -> (b:x) SET Weight = 0.5, since = 3") == Relate(RecordId("a", 1), "knows", RecordId("b", "x"), 0.5, {"since": 3})
    assert one("relate (a:1) -> knows -> (b:2)") == Relate(RecordId("a", 1), "knows", RecordId("b", 2))
    assert one("FORGET a:-7") == Forget(RecordId("a", "-7")) and one("MEMORY core") == Memory("core")
    assert one("MATCH (a:1) -> :knows <- works WHERE ok = true") == Match(RecordId("a", 1), (Step("out", "knows"), Step("in", "works", FieldEquals("ok", True))))
    assert one("CLOSURE (a:1) -> :knows") == Closure(RecordId("a", 1), (Step("out", "knows"),))


def test_select_forms():
    assert one("SELECT * FROM t WHERE age = 30 LIMIT 2") == Select("t", FieldEquals("age", 30), limit=2)
    assert one("SELECT a, b FROM t LIMIT 5 ORDER BY ::Recency AS OF 4 LIMIT 0") == Select("t", order="recency", as_of=4, limit=0, fields=("a", "b"))
    assert one("SELECT * FROM t WHERE embedding IS NOT NULL") == Select("t", HasEmbedding())
    knn, lex = Knn((1.0, 0.0), 3), Lexical("text", "q")
    assert one("SELECT * FROM t WHERE vector::similarity(embedding, [1, 0]) AND k = 3") == Select("t", knn=knn)
    assert one("SELECT * FROM t WHERE ::bm25(text, 'q') AND vector::similarity(embedding, [1, 0]) AND k = 3") == Select("t", knn=knn, lexical=lex)
    assert one("SELECT * FROM t WHERE vector::similarity(embedding, [1, 0]) AND k = 3 AND ::bm25(text, 'q') AND k = 9") == Select("t", knn=knn, lexical=Lexical("text", "q", 9))


def test_comments_and_separators():
    assert len(parse("-- a note\nMEMORY a MEMORY b /* two\nlines */; ;MEMORY c")) == 3
    assert parse("") == []


@pytest.mark.parametrize("text", [
    "SELECT", "SELECT * FROM", "SELECT * FROM t WHERE", "SELECT * FROM t WHERE name IS NOT NULL", "SELECT * FROM t ORDER BY ::nope", "INSERT INTO t:1 {a 1}", "INSERT INTO t {}",
    "CREATE TABLE t VECTOR<f32,0>", "MATCH (a:1)", "RELATE (a:1) -> :x", "SELECT * FROM t WHERE vector::similarity(embedding, [1]) AND k = 0", "SELECT * FROM t WHERE ::bm25(t, 3)", "'open", "'a\nb'", "a\x01", "\"\\q\"", "[" * 3, "INSERT INTO t:1 {a: " + "[" * 500,
])
def test_errors_have_a_place(text):
    with pytest.raises(LangError) as e:
        parse(text)
    assert e.value.line >= 1 and e.value.column >= 1


def test_error_place_counts_bytes():
    with pytest.raises(LangError, match="parse error at 2:9"):
        parse("MEMORY a\nFORGET  }")
    assert [(t.line, t.column) for t in tokenize("'é' x\n y")][:3] == [(1, 1), (1, 6), (2, 2)]
    assert tokenize("99999999999999999999")[0].kind == "float"


def test_one_statement_only():
    assert parse_statement("MEMORY a") == Memory("a")
    with pytest.raises(LangError):
        parse_statement("MEMORY a;")


def test_random_input_never_breaks_the_parser():
    rng = random.Random(1)
    bits = ["SELECT", "*", "FROM", "t", "WHERE", "::", "bm25", "(", ")", "[", "]", "{", "}", "1", "-2.5e3", "'s'", "->", "<-", ":", ",", ";", "=", "AND", "k", "é", "\x00", "--", "/*", "EMBED", "vector", "similarity"]
    for _ in range(2000):
        text = " ".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        try:
            assert parse(text) == parse(text)
        except LangError:
            pass


def test_analyzer():
    plan = parse("CREATE TABLE t VECTOR<f32,2> INSERT INTO t:1 {} EMBED [1,0] SELECT * FROM t WHERE vector::similarity(embedding,[1,0]) AND k=1")
    assert analyze(plan)[2].order == "similarity"
    for bad in ("INSERT INTO t:1 {}", "SELECT * FROM t", "CREATE TABLE t VECTOR<f32,2> INSERT INTO t:1 {} EMBED [1]", "SELECT * FROM meta ORDER BY ::similarity"):
        with pytest.raises(AnalysisError):
            analyze(parse(bad))
    analyze(parse("SELECT * FROM global FORGET x:1 MATCH (q:1) -> r CREATE TABLE t VECTOR<f32,2> CREATE TABLE t INSERT INTO t:1 {} EMBED [1]"))


def test_record_ids_and_values():
    assert RecordId.parse("t:007") == RecordId("t", 7) and RecordId.parse("t:a:b") == RecordId("t", "a:b")
    assert RecordId.parse(f"t:{2**64 - 1}").id == 2**64 - 1 and RecordId.parse(f"t:{2**64}").id == str(2**64)
    ids = [RecordId("doc", x) for x in (10, 2, "b", "B", 2**64 - 1)] + [RecordId("a", "z")]
    assert [str(i) for i in sorted(ids, key=RecordId.sort_key)] == ["a:z", "doc:2", "doc:10", f"doc:{2**64 - 1}", "doc:B", "doc:b"]
    for bad in ("t", ":1", "t:"):
        with pytest.raises(ValueError):
            RecordId.parse(bad)
    for v in (None, True, -3, 2.5, "x", {"b": [1, {"a": None}], "a": 1.0}, [1, "a"], Vector([1, 0.1]), RecordId("a", 1)):
        assert from_canon(tag_of(v), canon(v)) == v
    assert canon(-0.0) == canon(0.0) and (tag_of(1), canon(1)) != (tag_of(1.0), canon(1.0)) and tag_of([1, 2]) != tag_of(Vector([1, 2]))
