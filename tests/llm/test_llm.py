"""The operators on training data against brute force, round trips and hard cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from lorekeep.llm import chat, common, decontaminate, langid, mixing, quality, queries, sharding, simhash, suffixes, tokens, urls
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor " * 400


def rng_text(rng, n, words=("alpha", "beta", "gamma", "delta", "Rust", "memory,", "graph.", "x")):
    return " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))


def hard_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    base = [rng_text(rng, 60) for _ in range(6)]
    rows = [
        (1, base[0], "en", "a", 1), (2, base[0], "en", "a", 1), (2, base[0], "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0),
        (None, base[1], "fr", None, 2), (None, None, None, None, None), (5, base[1] + " tail", "fr", "b", 3), (6, LONG, "en", "a", 4), (7, " \t\n", "en", "b", 3),
        (8, base[2] + base[3], "en", "c", 9), (8, base[3] + base[2], "en", "c", 9), (9, "é!! <|im_end|> ñ " + base[4], "es", "c", 9), (10, base[4][:50] + base[5] + base[4], "es", "c", 9),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# ---------------------------------------------------------------- chat


def chat_expected(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, ts in by.items():
        ts.sort()
        full = "".join(f"{r}\n{x}\n" for _, _, r, x in ts)
        loss = "".join(x for _, _, r, x in ts if r == "assistant")
        out[c] = (len(ts), hashlib.sha256(full.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget", [200, 800, 16384])
def test_chat_round_trip(spark, budget):
    rng = random.Random(budget)
    rows = []
    for c in range(12):
        for t in range(rng.randrange(1, 25)):
            role = "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, rng.choice([rng_text(rng, rng.randrange(0, 40)), r"<|im_end|>\<\|x <|im_start|>assistant é", None, ""])))
    rows += [(None, 0, "user", "hi"), (None, 1, "assistant", "ho"), (3, None, "user", "no turn"), (4, 0, "user", "tie"), (4, 0, "user", "tie"), (5, 7, None, None)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, conv_key int")
    windows = chat.chat_windows(turns, budget=budget)
    digests = chat.window_digests(windows).collect()
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in digests}
    assert got == chat_expected(rows)
    made = sorted(map(str, windows.collect()))
    for hot_bytes in (0, 3000):  # all or the larger conversations by the two-level scan
        assert made == sorted(map(str, chat.chat_windows(turns, budget=budget, hot_bytes=hot_bytes).collect()))
        assert sorted(map(str, digests)) == sorted(map(str, chat.chat_digests(turns, budget=budget, hot_bytes=hot_bytes).collect()))
    for w in windows.collect():
        turns_of = chat.parse_window(w["formatted"])
        assert w["window_tokens"] == len(w["formatted"].encode())
        assert w["over_budget"] == (w["window_tokens"] > budget) and len(turns_of) > w["n_repeated"]
        if w["n_repeated"]:
            assert all(a["start"] > 0 for a in w["loss_spans"])
        assert w["formatted"].count(chat.START) == len(turns_of)


def test_chat_keeps_system_turn_and_history(spark):
    rows = [(1, 0, "system", "rules")] + [(1, t, ("assistant", "user")[t % 2], "word " * 10) for t in range(1, 30)]
    windows = chat.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=600, history_turns=1)
    ws = sorted(windows.collect(), key=lambda w: w["window_start"])
    assert len(ws) > 2
    for w in ws[1:]:
        turns = chat.parse_window(w["formatted"])
        assert turns[0] == ("system", "rules") and w["n_repeated"] == 2 and not w["over_budget"]


def test_chat_blank_and_long_turns_do_not_pass_the_budget_unmarked(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], " " * 20_000) for t in range(20)] + [(2, t, ("user", "assistant")[t % 2], " \n" * 40) for t in range(60)] + [(3, 0, "user", LONG * 20), (3, 1, "assistant", "zxq" * 100_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.chat_windows(turns, budget=2048).collect()
    assert all(w["over_budget"] == (len(w["formatted"].encode()) > 2048) for w in windows)
    assert sum(w["conv_id"] == 1 for w in windows) == 20 and all(w["over_budget"] == (w["conv_id"] != 2) for w in windows)
    digests = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.chat_digests(turns, budget=2048).collect()}
    assert digests == chat_expected(rows)


def test_chat_by_exact_token_counts(spark, sf_dir):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", queries.CONTROL_TEXT), (-1, 1, None, None)], turns.schema))
    windows = chat.chat_windows(chat.counted(turns, queries.tokenizer_path(), "n"), budget=512, tokens="n").collect()
    assert len(windows) > 20
    for w in windows:
        n = len(whole.encode(w["formatted"], add_special_tokens=False).ids)
        assert w["window_tokens"] == n <= len(w["formatted"].encode()) and w["over_budget"] == (n > 512)
    with pytest.raises(ValueError):
        chat.counted(turns, queries.tokenizer_path(), "Role")


def test_chat_roles_with_line_breaks_and_backslashes(spark):
    rows = [(1, 0, "a\nb", "x"), (1, 1, "a\\nb", "y<|"), (1, 2, "<|im_end|>\n", ""), (1, 3, "assistant", "z\\"), (1, 4, "\\<\\|", None), (1, 5, None, "w")]
    windows = chat.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    (w,) = windows.collect()
    assert chat.parse_window(w["formatted"]) == [(r or "", t or "") for _, _, r, t in rows]


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, rows_of(got, *cols))) == sorted(map(str, want.select(*cols).fetchall()))


def test_chat_empty(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.window_digests(chat.chat_windows(turns)).count() == 0


# ---------------------------------------------------------------- simhash


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_classes(fps, radius=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def check_simhash(rows, got):
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_classes(fps)
    least = {}
    for (d, _), r in zip(rows, roots, strict=True):
        least[r] = d if least.get(r) is None else min(least[r], d) if d is not None else least[r]
    want = Counter((d, f, least[r]) for (d, _), f, r in zip(rows, fps, roots, strict=True))
    assert Counter((d, f & (1 << 64) - 1, c) for d, f, c in got) == want


def test_simhash_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    check_simhash(rows_of(docs, "doc_id", "text"), rows_of(simhash.simhash_classes(docs), "doc_id", "fp", "class_id"))


def test_simhash_hard_cases(spark):
    docs = hard_docs(spark)
    check_simhash(rows_of(docs, "doc_id", "text"), rows_of(simhash.simhash_classes(docs), "doc_id", "fp", "class_id"))
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(brute_classes([brute_fingerprint(t) for t, in rows_of(docs, "text")])))
    assert simhash.simhash_classes(empty_docs(spark)).count() == 0 and simhash.simhash_dedup(empty_docs(spark)).count() == 0


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 7), replace=False)) for _ in range(900)], np.uint64)
    fps = np.unique(np.concatenate((base, np.repeat(base, 3) ^ flips)))
    want = brute_classes([int(x) for x in fps])
    for split in (len(fps), 400):
        edges = []
        cuts = [fps[:split], fps[split:]]
        for own, others in ((cuts[0], cuts), (cuts[1], [cuts[1]])):
            u, v = simhash.tile_links(own, others, block=32, strip=256)
            edges += list(zip(u.tolist(), v.tolist(), strict=True))
        index = {int(x): i for i, x in enumerate(fps)}
        root = list(range(len(fps)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in edges:
            root[find(index[a])] = find(index[b])
        groups = {}
        assert all(groups.setdefault(find(i), want[i]) == want[i] for i in range(len(fps)))
        assert len({find(i) for i in range(len(fps))}) == len(set(want)) and len(edges) < 3 * len(fps)


def test_tiles_across_tasks_equal_brute_force(spark, monkeypatch):
    """Many tiles, several tasks a tile, and links that are united while they are gathered."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, 250, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(750)], np.uint64)
    fps = np.unique(np.concatenate((base, np.repeat(base, 3) ^ flips)))
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = dict(rows_of(simhash.components(simhash.link_forest(table, tile_rows=40, partners=3)), "node", "root"))
    want = brute_classes([int(x) for x in fps])
    groups = {}
    mine = [roots.get(int(x), int(x)) for x in fps.view(np.int64)]
    assert all(groups.setdefault(m, w) == w for m, w in zip(mine, want, strict=True)) and len(set(mine)) == len(set(want))
    monkeypatch.setattr(simhash, "PAIRS", 5)
    u, v = simhash.tile_links(fps, [fps])
    assert len(u) == len(fps) - len(set(want))


@pytest.mark.parametrize("one_task_rows", [simhash.ONE_TASK_ROWS, 0])
def test_components_with_hot_nodes_and_repeated_rows(spark, monkeypatch, one_task_rows):
    """A node of very many links, and half of all rows equal; with 0 both go by the ways for hot keys."""
    monkeypatch.setattr(simhash, "ONE_TASK_ROWS", one_task_rows)
    star = spark.range(1, 30_001).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    got = simhash.components(star)
    assert got.where("root <> 0").count() == 0 and got.count() == 30_001
    docs = spark.range(24_000).select(
        F.when(F.col("id") % 2 == 0, F.lit(7).cast("long")).otherwise(F.col("id") % 40).alias("doc_id"),
        F.when(F.col("id") % 2 == 0, F.lit("one text that half of all rows say again and again")).otherwise(F.concat(F.lit("words of number "), (F.col("id") % 40).cast("string"))).alias("text"), F.col("id").alias("kid"),
    )
    kept = simhash.simhash_dedup(docs)
    fps = {brute_fingerprint(f"words of number {i}") for i in range(1, 40, 2)} | {brute_fingerprint("one text that half of all rows say again and again")}
    assert kept.columns == docs.columns and kept.count() == len(set(brute_classes(sorted(fps))))


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)] + [(300, 300)]
    got = dict(rows_of(simhash.components(spark.createDataFrame(edges, "u long, v long")), "node", "root"))
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(51)}


# ---------------------------------------------------------------- quality


def brute_quality(text):
    t = text or ""
    import re

    words = re.findall("[^\x20\x09-\x0d]+", t)
    lines, seen, dup = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {p for i, g in enumerate(grams) if n[g] > 1 for p in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), failed


def test_quality_measures(spark, sf_dir):
    rng = random.Random(1)
    extra = [(1000 + i, " ".join(rng.choice("a b c d") for _ in range(rng.randrange(0, 40)))) for i in range(60)] + [(2000, "x\n\nx\r\n x\n\t\nx"), (2001, "a b c d e " * 2), (2002, "a " * 9)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    docs = docs.unionByName(hard_docs(spark).select("doc_id", "text"))
    got = Counter(rows_of(quality.quality_report(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert got == Counter((d, *brute_quality(t)) for d, t in rows_of(docs, "doc_id", "text"))


def test_cascade_order_does_not_change_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(hard_docs(spark))
    kept = Counter(rows_of(quality.quality_filter(docs), *docs.columns))
    text = F.coalesce("text", F.lit(""))
    for rules in (quality.RULES, quality.RULES[::-1]):
        assert Counter(rows_of(docs.where(quality.first_rejection(text, rules).isNull()), *docs.columns)) == kept
    costs = quality.estimate(docs)
    assert [c.rank for c in costs] == sorted((c.rank for c in costs), reverse=True) and len(costs) == len(quality.RULES)
    assert quality.quality_filter(empty_docs(spark)).count() == 0 and quality.quality_report(empty_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        quality.quality_verdicts(docs.withColumn("Rejected_By", F.lit(1)))


def test_clean_documents_are_kept(spark, sf_dir):
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(good, "doc_id", "left_semi")
    report = quality.quality_report(docs)
    assert report.where("not base_failed and not kept").count() == 0


# ---------------------------------------------------------------- urls


def brute_rule(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    import re

    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for r in queries.URL_RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
            best = r
    return host, path, best


def test_url_rules(spark, sf_dir):
    odd = [None, "", "com", "http://", "HTTP://WWW.Example.COM/en/x?y=/z#q", "http://example.com/en", "http://notexample.com/en/", "a://b://c/d", "http://x.net?es/", "http://net/es/", "http://x.net/fr/\n/y", "s://COM", "s://com/"]
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame([(9000 + i, u) for i, u in enumerate(odd)], "page_id long, url string"))
    long = "http://x.net/" + "a/" * 50_000
    pages = pages.unionByName(spark.createDataFrame([(9100, long), (9101, long)], "page_id long, url string")).withColumn("__lex_len", F.lit(1.5)).withColumn("probability", F.lit("x"))
    got = urls.judge(pages, queries.URL_RULES).collect()
    assert len(got) == pages.count()
    for r in got:
        host, path, best = brute_rule(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best.text if best else None), r
        assert r["verdict"] in ("allow", "block") and r["probability"] == "x" and r["__lex_len"] == 1.5
        if best:
            assert r["verdict"] == ("allow" if best.allow else "block")


def test_url_trees_learn_from_labels(spark):
    rng = random.Random(2)
    good = [f"https://www.site{rng.choice('abcdef')}.org/{rng.choice(['news', 'docs'])}/{rng.choice(['one', 'two'])}" for _ in range(400)]
    bad = [f"http://{rng.randrange(10**9)}-{rng.randrange(10**6)}.win{rng.randrange(99)}.xyz/{'/'.join(str(rng.randrange(10**7)) for _ in range(4))}?a={rng.randrange(10**6)}&b=1&c=2" for _ in range(400)]
    data = [(u, False) for u in good] + [(u, True) for u in bad]
    rng.shuffle(data)
    train, test = data[:600], data[600:]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(test)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] == "block" for r in urls.judge(pages, (), spark.createDataFrame(train, "url string, blocked boolean")).collect()}
    assert sum(got[i] == b for i, (_, b) in enumerate(test)) > 0.95 * len(test)


def brute_features(url, rate):
    host, path, _ = brute_rule(url)
    suffix = ".".join(host.split(".")[-2:])
    query = url.split("?", 1)[1].split("#")[0] if "?" in url else ""
    n = Counter(url)
    entropy = -sum(c / len(url) * math.log2(c / len(url)) for c in n.values())
    return [len(url), len(host), len(path), path.count("/"), host.count("."), sum(c in "0123456789" for c in url) / len(url), entropy, query.count("&") + 1 if query else 0, host.count("-"), len(suffix), rate(suffix)]


def tree_value(lines, x):
    """Walks one tree of a model's text form."""
    depth, at = 0, 0
    while True:
        line = lines[at].strip()
        if line.startswith("Predict"):
            return float(line.split()[1])
        feature, op, limit = re.match(r"If \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line).groups()
        indent = len(lines[at]) - len(line)
        if (x[int(feature)] <= float(limit)) == (op == "<="):
            at += 1
        else:
            at = 1 + next(i for i in range(at + 1, len(lines)) if len(lines[i]) - len(lines[i].strip()) == indent and lines[i].strip().startswith("Else"))


def test_url_trees_equal_brute_force_on_held_out_hosts(spark):
    rng = random.Random(9)
    make = lambda bad, i: f"http://{'-' * (i % 3)}h{i}.{'top' if bad else 'org'}/{'/'.join(rng.choice('abc') + ('0' * rng.randrange(9) if bad else '') for _ in range(1 + i % 4))}{'?a=1&b=2' if bad and i % 2 else ''}"
    rows = [(make(i % 2 == 0, i), i % 2 == 0) for i in range(600)]
    model = urls.train(spark.createDataFrame(rows[:400], "url string, blocked boolean"), trees=4, depth=3)
    rates = dict(rows_of(model.suffixes, "suffix", "rate"))
    held = spark.createDataFrame([(u, b, *brute_rule(u)[:2], 1) for u, b in rows[400:]], "url string, blocked boolean, host string, path string, __suffix int")
    got = model.blocked(held, "url", "host", "path", "p").collect()
    weights, texts = list(model.trees.treeWeights), [t.toDebugString.split("\n")[1:] for t in model.trees.trees]
    assert len(got) == 200 and sum((r["p"] >= 0.5) == r["blocked"] for r in got) > 190 and all(r["__suffix"] == 1 for r in got)
    for r in got:
        x = brute_features(r["url"], lambda s: rates.get(s, model.prior))
        margin = sum(w * tree_value(t, x) for w, t in zip(weights, texts, strict=True))
        assert abs(r["p"] - 1 / (1 + math.exp(-2 * margin))) < 1e-9


def test_many_url_rules_by_table_equal_the_expression(spark, monkeypatch):
    rng = random.Random(10)
    rules = [urls.UrlRule.parse(t, rng.random() < 0.5) for t in ("", "com/", "com", "a.com/x", "a.com/xy/", "b.a.com/", ".com/", "a..com/", "com/x", "/x", "org/", "org/")]
    hosts = ["a.com", "b.a.com", "com", "", "a..com", ".com", "x.org", "org.", "aa.com", "net"]
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in ("", "/", "/x", "/xy/z", "/y"))], "page_id long, url string").withColumn("rule_", F.lit(1))
    pages = pages.withColumns({"host": urls.host_of(F.col("url")), "path": urls.path_of(F.col("url"))})
    want = Counter(rows_of(urls.with_rules(pages, rules[:-1], "host", "path", "rule", "ok"), "page_id", "rule", "ok"))
    monkeypatch.setattr(urls, "INLINE_RULES", 0)
    assert Counter(rows_of(urls.with_rules(pages, rules[:-1], "host", "path", "rule", "ok"), "page_id", "rule", "ok")) == want
    many = [urls.UrlRule(f"h{i}.net", "/", True) for i in range(1500)]
    assert urls.judge(pages.select("page_id", "url"), [*rules, *many]).count() == pages.count()


def test_url_sample_is_bounded_under_copies(spark):
    rows = [(f"http://a{i}.org/x", False) for i in range(300)] + [(f"http://b{i}.xyz/y", True) for i in range(300)] + [(f"http://hot{i}.xyz/y", True) for i in range(30)] * 100
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    assert urls.train(labelled, trees=1, depth=1).prior == 330 / 630
    assert 20 < common.distinct_sample(labelled, 63, 42).count() < 110


def test_url_empty_and_clash(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(empty, queries.URL_RULES).count() == 0
    with pytest.raises(ValueError):
        urls.judge(empty.withColumn("Host", F.lit(1)), ())


# ---------------------------------------------------------------- sharding


def check_placement(rows, n):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(n))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return {d: sum(r["size"] for r in own) for d, own in by.items()}


def test_sharding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sharding.shard_placement(docs, 24).collect()
    loads = check_placement(rows, 24)
    texts = dict(rows_of(docs, "doc_id", "text"))
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), None)
    assert max(loads.values()) - min(loads.values()) <= max(r["size"] for r in rows)


def test_sharding_equals_brute_force(spark):
    """Slots by hash, bytes by slot, largest slot to lightest shard, places by slot and id: all by hand."""
    rng = random.Random(3)
    rows = [(rng.randrange(-50, 10**9), "x" * rng.randrange(1, 60) + "é") for _ in range(500)]
    n, slots = 24, 8192

    def slot_of(d, text):
        h = xxhash.xxh64_intdigest(d.to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(zlib.crc32(text.encode()).to_bytes(8, "little"), h)
        return (h - (1 << 64 if h >> 63 else 0)) % slots

    sizes = Counter()
    for d, t in rows:
        sizes[slot_of(d, t)] += len(t.encode()) + 8
    load, shard_of = [0] * n, {}
    for s, b in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        shard_of[s] = load.index(min(load))
        load[shard_of[s]] += b
    want, taken = {}, Counter()
    for s, d, t in sorted((slot_of(d, t), d, t) for d, t in rows):
        want[d] = (len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes", shard_of[s], taken[shard_of[s]], None, s)
        taken[shard_of[s]] += 1
    got = sharding.shard_placement(spark.createDataFrame(rows, "doc_id long, text string"), n).collect()
    assert {r["doc_id"]: tuple(r[c] for c in ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "vslot")) for r in got} == want


def test_sharding_hot_and_hard_rows(spark):
    docs = hard_docs(spark)
    check_placement(sharding.shard_placement(docs, 4).collect(), 4)
    hot = spark.createDataFrame([(7, "same text", "en", "a", 1)] * 3000 + [(i, f"t{i}", "en", "a", 1) for i in range(3000)], DOCS)
    loads = check_placement(sharding.shard_placement(hot, 4, slots=512).collect(), 4)
    assert max(loads.values()) < 1.1 * min(loads.values())
    placed = sharding.shard_documents(docs, 4)
    assert placed.columns == [*docs.columns, "shard"] and placed.count() == docs.count()
    assert sharding.shard_documents(empty_docs(spark), 4).count() == 0 and sharding.shard_placement(empty_docs(spark), 4).count() == 0


def test_maps_are_stored_and_edited(spark, sf_dir, tmp_path):
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"file://{tmp_path}/maps"
    first = {r["doc_id"]: r for r in sharding.shard_placement(docs, 24, maps=path).collect()}
    assert spark.read.parquet(path).select("version").distinct().count() == 1
    assert {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, 24, maps=path).collect()} == {d: r["shard"] for d, r in first.items()}
    grown = sharding.shard_placement(docs, 25, maps=path).collect()
    loads = check_placement(grown, 25)
    mean = sum(loads.values()) / 25
    assert max(loads.values()) < 1.1 * mean and loads[24] > 0.9 * mean
    listed = {r["vslot"]: (r["moved_from"], r["shard"]) for r in spark.read.parquet(path).where("version = 2 and moved_from is not null").collect()}
    for r in grown:
        old = first[r["doc_id"]]
        assert r["map_version"] == 2 and r["vslot"] == old["vslot"]
        assert (old["shard"], r["shard"]) == listed.get(r["vslot"], (old["shard"],) * 2)
    moved = sum(r["size"] for r in grown if r["vslot"] in listed)
    assert 24 in {to for _, to in listed.values()} and moved < 3 * mean  # most of it to the new shard, the rest to even out
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, 25, slots=100, maps=path)


def test_slot_map_versions(spark, tmp_path):
    rng = random.Random(4)
    sizes = {s: rng.randrange(1, 100) for s in range(1024)}
    first = sharding.SlotMap(8, tuple(sharding.assign(sizes, 1024, 8)))
    grown = sharding.rebalance(first, sizes, 9)
    load = Counter()
    for s, d in enumerate(grown.shard_of):
        load[d] += sizes[s]
    mean = sum(sizes.values()) / 9
    assert grown.version == 2 and max(load.values()) <= 1.03 * mean and min(load.values()) >= 0.97 * mean
    assert all(to == 8 for _, _, to in grown.moved) and len(grown.moved) < 1024 / 8
    shrunk = sharding.rebalance(grown, sizes, 7)
    assert set(shrunk.shard_of) == set(range(7))
    path = f"file://{tmp_path}/maps"
    first.save(spark, path)
    grown.save(spark, path)
    assert sharding.SlotMap.load(spark, path) == grown and sharding.SlotMap.load(spark, path, 1) == first


# ---------------------------------------------------------------- tokens


@pytest.mark.parametrize("n", [0, 1, 59, 4095, 4096, 4097, 9000])
def test_simple8b_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49408, n), rng.integers(0, 2, n), np.zeros(n), 2 ** rng.integers(0, 64, n, dtype=np.uint64), rng.integers(0, 2**64, n, dtype=np.uint64, endpoint=False)):
        ids = ids.astype(np.uint64)
        payload = tokens.encode_file([1], [n], ids)
        names, lengths, back = tokens.decode_file(payload)
        assert names == [1] and lengths.tolist() == [n] and np.array_equal(back, ids)
        for b in range(-(-n // tokens.BLOCK)):
            assert np.array_equal(tokens.decode_block(payload, b), ids[b * tokens.BLOCK : (b + 1) * tokens.BLOCK])
    assert len(tokens.encode_file([1], [6000], np.zeros(6000, np.uint64))) < 6000 / 4


def expected_tokens(rows):
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-5, None), (-4, ""), (-3, "a\x0bb\x85c\u2003d <|endoftext|>x It's 42"), (10**9, LONG)], "doc_id long, text string"))
    store = tokens.write_tokens(docs, queries.tokenizer_path(), 2, file_ids=3000)
    assert store.count() > 10
    got = sorted(rows_of(tokens.read_tokens(store), "doc_id", "start", "n_tokens", "ids_crc32"))
    assert got == expected_tokens(sorted(rows_of(docs, "doc_id", "text")))


def test_token_files_with_special_tokens_in_capitals(spark):
    texts = ["x <|ENDOFTEXT|> y", "a<|EndOfText|>b <|endoftext|> C", "<|STARTOFTEXT|>", "Plain Words, here", "<|endoftext|><|ENDOFTEXT|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(rows_of(tokens.read_tokens(tokens.write_tokens(docs, queries.tokenizer_path(), 2)), "doc_id", "start", "n_tokens", "ids_crc32"))
    assert got == expected_tokens(list(enumerate(texts)))
    encoder = tokens.WordEncoder(queries.tokenizer_path())
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for part in (1, 2, 400):
        ids, counts = encoder.encode(texts, part=part)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_piece_store_merges_drops_and_tells_equal_hashes_apart():
    rng = np.random.default_rng(6)
    store, known = tokens.PieceStore(600), {}
    for _ in range(40):
        one = np.unique(rng.integers(0, 2000, 50).astype(np.uint64))
        begin, size, ids = store.find(one, one * 3, one * 5)
        for h, b, n in zip(one.tolist(), begin.tolist(), size.tolist(), strict=True):
            assert b < 0 or ids[b : b + n].tolist() == known[h]
        new = one[begin < 0]
        sizes = rng.integers(0, 4, len(new))
        flat = rng.integers(0, 99, sizes.sum()).astype("<u4")
        begins = np.cumsum(sizes) - sizes
        known |= {h: flat[b : b + n].tolist() for h, b, n in zip(new.tolist(), begins.tolist(), sizes.tolist(), strict=True)}
        if len(new):
            store.add(new, new * 3, new * 5, begins, sizes, flat)
        assert sum(len(x[0]) for x in store.levels) <= 600
    assert (store.find(one, one * 3 + 1, one * 5)[0] == -1).all() and (store.find(one, one * 3, one * 5)[0] >= 0).any()


def test_token_files_with_a_small_store(sf_dir):
    import pandas as pd
    from tokenizers import Tokenizer

    texts = pd.read_parquet(f"{sf_dir}/documents.parquet").text.tolist()
    encoder, whole = tokens.WordEncoder(queries.tokenizer_path(), most=500), Tokenizer.from_file(queries.tokenizer_path())
    want = [t.ids for t in whole.encode_batch(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 20):
        ids, counts = encoder.encode(texts[at : at + 20], part=7)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want[at : at + 20]


def test_pieces_that_share_a_hash_stay_apart(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "_piece_hashes", lambda data, start, stop: ((stop - start) % 3).astype(np.uint64))
    texts = ["many words of one hash", "words of many a hash and word", "", "one hash, many; words! 42 ééé"]
    encoder, whole = tokens.WordEncoder(queries.tokenizer_path()), Tokenizer.from_file(queries.tokenizer_path())
    for _ in range(2):
        ids, counts = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_very_long_texts_are_encoded_in_parts():
    from tokenizers import Tokenizer

    encoder, whole = tokens.WordEncoder(queries.tokenizer_path()), Tokenizer.from_file(queries.tokenizer_path())
    texts = ["short", LONG + "x" * 500 + " end\u2003of\x0bit", "", "y" * 300]
    assert ["".join(tokens.segments(t, 50)) for t in texts] == texts and len(list(tokens.segments(texts[1], 50))) > 100
    got = {}
    for i, ids, _ in tokens.encode_bounded(encoder, texts, rows=7, chars=50):
        got.setdefault(i, []).extend(ids.tolist())
    assert [got[i] for i in range(4)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_hard_cases(spark, tmp_path):
    docs = hard_docs(spark)
    store = tokens.write_tokens(docs, queries.tokenizer_path(), 2)
    got = rows_of(tokens.read_tokens(store), "doc_id", "n_tokens", "ids_crc32")
    assert Counter(got) == Counter((d, n, c) for d, _, n, c in expected_tokens(rows_of(docs, "doc_id", "text")))
    spans = sorted(rows_of(tokens.read_tokens(store), "start", "n_tokens"))
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    for _ in range(2):  # a second attempt ends in the same files
        assert tokens.export_files(store, f"file://{tmp_path}/out") == store.count()
    files = sorted((tmp_path / "out").iterdir())
    assert [f.read_bytes() for f in files] == [bytes(r["payload"]) for r in store.orderBy("part", "chunk").collect()]
    assert tokens.read_tokens(tokens.write_tokens(empty_docs(spark), queries.tokenizer_path(), 2)).count() == 0


# ---------------------------------------------------------------- suffixes


def brute_repeats(rows, length=100):
    """rows: distinct (id, text), in order of documents."""
    seen, out = set(), []
    for d, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check_repeats(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(rows_of(suffixes.suffix_digests(docs, **more), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
    assert got == sorted(brute_repeats(sorted(rows), **more))


def test_suffix_dedup_on_data(spark, sf_dir):
    check_repeats(spark, rows_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_random(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(suffixes, "HOT_GROUP", 3)
        monkeypatch.setattr(suffixes, "BATCH", 50)
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abcd é\n") for _ in range(rng.randrange(20, 260))) for _ in range(30)]
    rows = [(i, "".join(rng.choice(parts) if rng.random() < 0.7 else rng_text(rng, 5) for _ in range(rng.randrange(0, 8)))) for i in range(120)]
    rows += [(500, "a" * 900), (501, "ab" * 300), (502, "a" * 99), (503, "a" * 100), (504, "abc" * 200 + "abc" * 200), (505, None), (506, "")]
    rows += [(600 + i, rows[i % 20][1][1:-1] + "tail") for i in range(40)]
    check_repeats(spark, rows)


def test_suffix_dedup_hard_cases(spark):
    docs = hard_docs(spark)
    got = suffixes.suffix_digests(docs).collect()
    assert len(got) == docs.count() and sum(r["doc_id"] is None for r in got) == 2
    twins = [r for r in got if r["doc_id"] == 2]
    assert all(r["n_removed"] == r["n_bytes"] for r in twins) and len(twins) == 2
    assert suffixes.suffix_digests(empty_docs(spark)).count() == 0
    assert {r["doc_id"]: r["kept"] for r in suffixes.suffix_dedup(docs).collect()}[2] == b""


def test_anchors_of_joined_texts_are_those_of_each():
    rng = random.Random(12)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.choice([100, 101, 150, 900]))).encode() for _ in range(40)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    want = []
    for k, t in enumerate(texts):
        at, _, h = suffixes.anchors(np.frombuffer(t, np.uint8), np.array([len(t)]))
        want += [(k, int(p), int(x)) for p, x in zip(at, h, strict=True)]
        grams = suffixes.gram_hashes(np.frombuffer(t, np.uint8))
        w = suffixes.LENGTH - suffixes.GRAM + 1
        assert set(at.tolist()) == {i for s in range(len(grams) - w + 1) for i in range(s, s + w) if grams[i] == grams[s : s + w].min()}
    for slab in (1 << 20, 1000, 137):
        at, of, h = suffixes.anchors(data, ends, slab=slab)
        begin = np.concatenate(([0], ends[:-1]))
        assert sorted(zip(of.tolist(), (at - begin[of]).tolist(), h.tolist(), strict=True)) == sorted(want)


def test_suffixes_are_in_order_of_bytes_and_neighbours_tell_common_prefixes():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 2, (500, 12)).astype(np.uint8)
    order = np.argsort(rows.reshape(-1).view("S12"), kind="stable")
    assert [bytes(r) for r in rows[order]] == sorted(bytes(r) for r in rows)
    got = suffixes.common_prefixes(rows[order])
    for i in range(1, 500):
        a, b = rows[order][i - 1], rows[order][i]
        assert got[i] == next((k for k in range(12) if a[k] != b[k]), 12)


def test_suffix_dedup_with_hot_anchors(spark, monkeypatch):
    """A line of all documents: its anchors are dealt by context, and no bucket has over three times the mean."""
    rng = random.Random(14)
    line = "".join(rng.choice("abcdefghij ") for _ in range(126))
    rows = [(i, "".join(rng.choice("klmnopqrst uvw") for _ in range(400)) + line + "".join(rng.choice("klmnopqrst uvw") for _ in range(400))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 40_000)
    keyed = suffixes._keyed(docs)
    hot = suffixes._hot_grams(keyed, 100, 600 * 926, 64)
    assert len(hot) >= 2
    sizes = Counter()
    for r in suffixes._anchor_blobs(keyed, 100, 64, hot, 0).collect():
        sizes[r["bucket"]] += len(suffixes._unpack(r["blob"])[3])
    assert max(sizes.values()) < 3 * sum(sizes.values()) / 64
    check_repeats(spark, rows)


def test_suffix_index_meets_earlier_batches(spark, tmp_path):
    rng = random.Random(15)
    parts = ["".join(rng.choice("abcd é\n") for _ in range(rng.randrange(60, 300))) for _ in range(25)]
    rows = [(i, "".join(rng.choice(parts) if rng.random() < 0.7 else rng_text(rng, 6) for _ in range(rng.randrange(1, 7)))) for i in range(90)]
    rows += [(90 + i, rows[i][1][3:-2] + "t") for i in range(20)] + [(110, rows[0][1]), (111, None), (112, "a" * 300)]
    want = {r[0]: r for r in brute_repeats(rows)}
    index, got, sizes = suffixes.SuffixIndex(spark, f"file://{tmp_path}/family", buckets=8), {}, []
    for a, b in ((0, 40), (40, 60), (60, 80), (80, 113)):
        batch = spark.createDataFrame(rows[a:b], "doc_id long, text string")
        got |= {r["doc_id"]: tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffixes.suffix_digests(batch, index=index).collect()}
        sizes.append([n for n, _ in index.levels])
        assert all(x >= 2 * y for x, y in zip(sizes[-1], sizes[-1][1:], strict=False))
    assert got == want and index.batches == 4 and max(map(len, sizes)) > 1
    for _, path in index.levels:
        for r in spark.read.parquet(path).collect():
            order = suffixes._unpack(r["blob"])[3]
            assert (order[1:] > order[:-1]).all()


def test_log_family_levels_grow_geometrically():
    rng = np.random.default_rng(1)
    family = suffixes.LogFamily()
    cls, key = rng.integers(0, 500, 4000).astype(np.uint64), rng.permutation(4000).astype(np.uint64)
    for i in range(0, 4000, 100):
        family.add(cls[i : i + 100], key[i : i + 100], cls[i : i + 100])
        sizes = [len(x[0]) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    _, keys, _ = family.settle()
    least = {}
    for c, k in zip(cls.tolist(), key.tolist(), strict=True):
        least[c] = min(k, least.get(c, k))
    assert sorted(keys.tolist()) == sorted(least.values())
    assert sorted(np.concatenate(family.matched).tolist()) == sorted(set(key.tolist()) - set(least.values()))


# ---------------------------------------------------------------- decontamination


def test_decontamination_spans_and_cases(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (2, "short Answer"), (3, None), (4, "..."), (None, "zeta eta"), (10, "short-answer")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "É: One, two three--four five\nsix seven eight nine TEN! end", 1), (2, "two three four five six seven eight nine ten eleven", 1), (3, "one two three", 1), (4, None, 1), (5, "", 1),
        (6, "a SHORT answer; shorts answer", 1), (None, "zeta eta", 1), (6, "a SHORT answer; shorts answer", 1),
    ], "doc_id long, text string, hit int")
    for most, chunk, items in ((3_000_000, 1, 10_000), (80, 1, 2), (80, 200, 2)):
        monkeypatch.setattr(decontaminate, "MAX_NODES", most)
        monkeypatch.setattr(decontaminate, "CHUNK", chunk)
        monkeypatch.setattr(decontaminate, "ITEMS", items)
        assert most > 80 or len(decontaminate.benchmark_windows(bench)) > 2
        got = decontaminate.contamination(docs, bench).collect()
        by = {r["doc_id"]: r for r in got}
        assert len(got) == 8 and by[1]["n_hit"] == 10 and by[1]["items"] == [1]
        assert [tuple(s) for s in by[1]["spans"]] == [(3, 53)] and by[2]["n_hit"] == 10 and by[3]["n_hit"] == 0 and by[4]["n_words"] == 0
        assert sorted(by[6]["items"]) == [2, 10] and by[6]["n_hit"] == 2 and by[None]["items"] == [None]
        assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()) == [3, 4, 5]
    done = {r["doc_id"]: r for r in decontaminate.digests(decontaminate.contamination(docs, bench)).collect()}
    assert done[6]["items_sha256"] == hashlib.sha256(b"10,2").hexdigest() and done[3]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    none = bench.limit(0)
    assert decontaminate.decontaminate(docs, none).count() == 8 and decontaminate.contamination(empty_docs(spark), bench).count() == 0


# ---------------------------------------------------------------- language


def test_language_accuracy(spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    got = langid.predict(big.where(held), langid.fit(big.where(~held)), "lang").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_sample_is_bounded_under_copies(spark):
    rows = [(f"plain words {i}", "en") for i in range(400)] + [(f"viel text {i}", "de") for i in range(20)] * 100
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.langs == ("de", "en") and np.allclose(np.exp(model.log_prior), [20 / 420, 400 / 420])


def test_language_hard_cases(spark):
    docs = hard_docs(spark).withColumn("lang_", F.lit(1))
    model = langid.fit(docs)
    got = langid.predict(docs, model, "doc_id", "lang").collect()
    assert len(got) == docs.count()
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in (3, 4, 7))
    assert model.predict("123 456 !!") == ("und", 0.0) and langid.fit(empty_docs(spark)).predict("abc") == ("und", 0.0)
    assert langid.predict(empty_docs(spark), model, "doc_id").count() == 0
    assert sum(len(c) for _, c in langid.batch_cells(["x" * (langid.PIECE + 5)])) == 3 * (langid.PIECE + 5) - 3


def brute_language(model, text):
    """Gram by gram: a score of every language."""
    total = {lang: float(p) for lang, p in zip(model.langs, model.log_prior, strict=True)}
    chars = [ord(c) for c in text.lower()]
    for n in langid.ORDERS:
        for i in range(len(chars) - n + 1):
            h = n * 0x27D4EB2F & 0xFFFFFFFF
            for k in range(n):
                h = (h ^ chars[i + k]) * langid._MULT[k] & 0xFFFFFFFF
                h ^= h >> 15
            for j, lang in enumerate(model.langs):
                total[lang] += float(model.log_prob[j, h % model.log_prob.shape[1]])
    best = max(total, key=lambda x: (total[x], [-ord(c) for c in x]))
    return best, 1 / sum(math.exp(t - total[best]) for t in total.values())


def test_language_scores_equal_brute_force(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    texts = [t for t, in rows_of(docs, "text")][:40] + ["", "a", "é", "12", None, "ÀÉ ßİ x", "a" * 700]
    model = langid.fit(docs)
    assert list(langid.groups(["ab", "c", "", "defg", "h"], 3)) == [(0, 3), (3, 4), (4, 5)]
    for piece in (langid.PIECE, 100):  # texts in one piece and over many
        monkeypatch.setattr(langid, "PIECE", piece)
        langs, scores = model.predict_batch(texts)
        for t, lang, score in zip(texts, langs, scores.tolist(), strict=True):
            if not t or not any(map(str.isalpha, t)):
                assert (lang, score) == ("und", 0.0)
            else:
                want, p = brute_language(model, t)
                assert lang == want and abs(score - p) < 1e-9


def test_many_languages_share_fewer_cells(spark, monkeypatch):
    monkeypatch.setattr(langid, "FULL_LANGS", 4)
    words = [f"{a}{b}" for a in "bcdfghklmn" for b in "aeiou"]
    rows = [(f"{w} {w}{w} {w}", w) for w in words[:20]]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.log_prob.shape == (20, langid.CELLS // 8) and model.predict("bababa ba")[0] == "ba"


# ---------------------------------------------------------------- mixing


def test_poisson_inverse_matches_rates(spark):
    rows = [(i, "x" * 10, "en", "a" if i < 6000 else "b" if i < 8000 else None, 1) for i in range(9000)]
    docs = spark.createDataFrame(rows, DOCS)
    got = Counter(r["source"] for r in mixing.mix(docs, weights={"a": 1.0, "b": 3.0}).select("source").collect())
    assert set(got) == {"a", "b"} and abs(got["a"] - 2250) < 200 and abs(got["b"] - 6750) < 350
    again = mixing.mix(docs, weights={"a": 1.0, "b": 3.0}, copy="copy")
    assert Counter(r["source"] for r in again.collect()) == got
    cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(2.0)).alias("c")).first()["c"]
    assert abs(cdf[0] - np.exp(-2)) < 1e-12 and abs(cdf[3] - np.exp(-2) * (1 + 2 + 2 + 8 / 6)) < 1e-12


def test_mixing_hard_cases(spark, monkeypatch):
    docs = hard_docs(spark).withColumn("copy", F.lit(0))
    a = Counter(rows_of(mixing.mix(docs, epochs=5.0), *docs.columns))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert Counter(rows_of(mixing.mix(docs, epochs=5.0), *docs.columns)) == a and sum(a.values()) > 20
    assert mixing.mix(empty_docs(spark)).count() == 0
    assert mixing.repetition_rates(docs, epochs=10_000.0).agg(F.max("rate")).first()[0] > 500
    with pytest.raises(ValueError):
        mixing.mix(docs, copy="COPY")


def test_mixing_deals_a_repeated_row_over_partitions(spark, tmp_path):
    spark.createDataFrame([(5, "same", "en", "a", 4)] * 3000 + [(i, f"t{i}", "en", "a", 2) for i in range(100, 3100)], DOCS).repartition(4).write.parquet(str(tmp_path / "d"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in mixing.mix(spark.read.parquet(str(tmp_path / "d")), epochs=2.0).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 2 * sum(sizes) / len(sizes) and len(sizes) > 1


def test_mixing_repeats_a_tiny_source_beside_a_large_one(spark, tmp_path, monkeypatch):
    rows = [(i, "y" * 60_000, "en", "large", 60_000) for i in range(100)] + [(1000 + i, "x" * 10, "en", s, 10) for i, s in enumerate(("tiny", None))]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = Counter((d, s, n, c) for d, s, n, c in con.sql(queries.oracle_sql()["op10_mixing"]).select("doc_id", "source", "n_bytes", "copy").fetchall())
    assert min(sum(k[1] == s for k in want) for s in ("tiny", None)) > 600
    monkeypatch.setattr(mixing, "COPIES", 100)
    assert Counter(rows_of(queries.queries()["op10_mixing"](spark, str(tmp_path)), "doc_id", "source", "n_bytes", "copy")) == want


@pytest.mark.parametrize("rate", [500.5, 800.0, 60_000.25, 5e6])
def test_poisson_inverse_of_large_rates(spark, rate):
    us = [1e-9, 0.01, 0.3, 0.5, 0.77, 0.999, 1 - 1e-9]  # the logarithms of the check are not exact enough further out
    low = int(rate - 13 * rate**0.5)
    ks = np.arange(low, int(rate + 13 * rate**0.5))
    cdf = np.cumsum(np.exp([k * np.log(rate) - rate - math.lgamma(k + 1) for k in ks.tolist()]))
    df = spark.createDataFrame([(rate, u) for u in us], "r double, u double")
    got = [r["n"] for r in df.select(mixing.poisson_inverse(F.col("r"), F.col("u")).alias("n")).collect()]
    want = (low + np.searchsorted(cdf / cdf[-1], us, side="right")).tolist()
    assert all(abs(a - b) <= (1 if u < 1e-6 or u > 0.999999 else 0) for a, b, u in zip(got, want, us, strict=True)), (got, want)


# ---------------------------------------------------------------- pipeline


def test_pipeline_against_brute_force(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    step = docs
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, sf_dir).cache()
        seen.append(step)
    text = dict(rows_of(docs, "doc_id", "text"))
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    judged = {r["doc_id"]: r["kept"] for r in quality.quality_report(docs).collect()}
    good = {d for d, t in text.items() if judged[d] and not brute_quality(t)[5]}
    assert ids(seen[0]) == good
    order = sorted(good)
    roots = brute_classes([brute_fingerprint(text[d]) for d in order])
    first = {}
    for d, r in zip(order, roots, strict=True):
        first.setdefault(r, d)
    assert ids(seen[1]) == set(first.values()) and seen[1].count() == len(first)
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        windows.update(decontaminate.item_windows(decontaminate.normalised_words(r["text"])))
    clean = {d for d in first.values() if not any(w in b" " + b" ".join(decontaminate.normalised_words(text[d])) + b" " for w in windows)}
    assert ids(seen[2]) == clean and ids(seen[3]) <= clean
    assert seen[4].count() == seen[3].count() and seen[4].columns == [*docs.columns, "shard"]
    assert all(s.columns == docs.columns for s in seen[:4])
    assert corpus_pipeline.run(spark, sf_dir).count() == seen[4].count()


# ---------------------------------------------------------------- all operators


def names_in(module):
    """Names that a module's operators make: strings of its code that could be columns."""
    import inspect

    found = set(re.findall(r'"(_{0,2}[a-z][a-z_0-9]{0,20})"', inspect.getsource(module)))
    return sorted(found - {"doc_id", "text", "lang", "source", "n_chars", "item_id", "url", "page_id", "conv_id", "turn", "role", "_metadata"})


def with_clashes(docs, module, taken=()):
    """An extra column, of a value of its own, for every name that the module's code uses and for its temporary names."""
    stems = re.findall(r'"([a-z]+)"', open(module.__file__, encoding="utf-8").read())
    every = dict.fromkeys([*names_in(module), *(f"__{x}" for x in stems)])
    used = {c.lower() for c in (*docs.columns, *taken)}
    extra = [n for n in every if n.lower() not in used]
    return docs.withColumns({n: F.lit(f"own {n}") for n in extra}), extra


def kept_values(df, extra):
    return df.where(" or ".join(f"`{n}` is null or `{n}` <> 'own {n}'" for n in extra)).count() == 0


@pytest.mark.parametrize("name", ["quality", "simhash", "decontaminate", "mixing", "sharding", "urls"])
def test_columns_of_clashing_names_are_kept(spark, name):
    docs = hard_docs(spark)
    bench = spark.createDataFrame([(1, "lorem ipsum dolor sit amet consectetur adipiscing elit sed do")], "item_id long, text string")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([None, "", "http://a.com/x", "http://a.net/es/1", "http://b.org/1?x=2"] * 4)], "page_id long, url string")
    module, base, taken, run = {
        "quality": (quality, docs, (), lambda d: quality.quality_filter(d)),
        "simhash": (simhash, docs, (), lambda d: simhash.simhash_dedup(d)),
        "decontaminate": (decontaminate, docs, (), lambda d: decontaminate.decontaminate(d, bench)),
        "mixing": (mixing, docs, (), lambda d: mixing.mix(d, epochs=3.0)),
        "sharding": (sharding, docs, ("shard",), lambda d: sharding.shard_documents(d, 4).drop("shard")),
        "urls": (urls, pages, ("host", "path", "rule", "verdict"), lambda d: urls.judge(d, queries.URL_RULES)),
    }[name]
    clashing, extra = with_clashes(base, module, taken)
    got, plain = run(clashing), run(base)
    assert len(extra) > 20 and set(clashing.columns) <= set(got.columns) and kept_values(got, extra)
    cols = [c for c in plain.columns if c not in ("verdict",)]
    if name == "simhash":
        assert got.count() == plain.count()
    else:
        assert Counter(map(str, rows_of(got, *cols))) == Counter(map(str, rows_of(plain, *cols)))


def test_reports_ignore_other_columns_and_refuse_clashes(spark, tmp_path):
    docs = hard_docs(spark)
    bench = spark.createDataFrame([(1, "lorem ipsum")], "item_id long, text string").withColumn("place", F.lit(1)).withColumn("w", F.lit(2))
    for module, run in (
        (quality, quality.quality_report), (simhash, simhash.simhash_classes), (sharding, lambda d: sharding.shard_placement(d, 4).drop("salt")), (suffixes, suffixes.suffix_digests),
        (decontaminate, lambda d: decontaminate.digests(decontaminate.contamination(d, bench))), (langid, lambda d: langid.predict(d, langid.fit(d), "doc_id")),
        (tokens, lambda d: tokens.read_tokens(tokens.write_tokens(d, queries.tokenizer_path(), 2))),
    ):
        clashing, _ = with_clashes(docs, module)
        a, b = run(clashing), run(docs)
        assert a.columns == b.columns and Counter(map(str, a.collect())) == Counter(map(str, b.collect())), module
    for call in (
        lambda: decontaminate.contamination(docs.withColumn("n_hit", F.lit(1)), bench, keep=("doc_id", "n_hit")), lambda: langid.predict(docs.withColumn("Score", F.lit(1)), langid.fit(docs), "Score"),
        lambda: sharding.shard_documents(docs.withColumn("SHARD", F.lit(1)), 4), lambda: urls.judge(spark.createDataFrame([(1, "", "")], "page_id long, url string, Verdict string"), ()),
    ):
        with pytest.raises(ValueError):
            call()
    odd = docs.withColumn("text_", F.lit(3)).withColumn("k0", F.lit("z"))
    assert {r["k0"] for r in decontaminate.contamination(odd, bench, keep=("k0", "text_")).collect()} == {"z"}


def test_scans_have_a_task_a_split(spark, tmp_path, monkeypatch):
    """Samples do not narrow the scan that they are drawn from: what is gathered is gathered behind a shuffle."""
    rows = [(i, f"text number {i} of some words that are said once more", "en", "a", 1) for i in range(500)]
    spark.createDataFrame(rows, DOCS).repartition(50).write.parquet(str(tmp_path / "documents.parquet"))
    pages = spark.createDataFrame([(i, f"http://{'a.com' if i % 2 else 'b.net/es'}/{i}") for i in range(500)], "page_id long, url string")
    pages.repartition(50).write.parquet(str(tmp_path / "pages.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(256 << 20))
    plans = []
    real = type(spark.range(1)).write.fget

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(type(spark.range(1)), "write", property(seen))
    try:
        docs, table = spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "pages.parquet"))
        assert docs.rdd.getNumPartitions() >= 50
        results = [quality.quality_report(docs), quality.quality_filter(docs), urls.judge(table, queries.URL_RULES)]
        for r in results:
            assert r.rdd.getNumPartitions() >= 50
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(plans) >= 4
    for plan in plans:
        # a coalesce may stand over an exchange but not over a scan
        for at in (m.end() for m in re.finditer("Coalesce ", plan)):
            below = plan[at:]
            scan, exchange = max(below.find("documents.parquet"), below.find("pages.parquet")), below.find("Exchange")
            assert scan < 0 or 0 <= exchange < scan, plan


def test_sample_of_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_FILES", 3)
    spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id")).alias("text")).repartition(10).write.parquet(str(tmp_path / "d d"))
    docs = spark.read.parquet(str(tmp_path / "d d"))
    some = quality._sampled_files(docs)
    assert 0 < some.count() < 200 and some.select(F.input_file_name()).distinct().count() == 3
    assert quality.quality_report(docs).count() == 200 and quality.quality_report(docs.groupBy("doc_id").agg(F.first("text").alias("text"))).count() == 200


def pipeline_dir(spark, docs, tmp_path, name):
    at = tmp_path / name
    docs.coalesce(1).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None)], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at)


def test_pipeline_hard_cases(spark, tmp_path):
    import corpus_pipeline

    prose = "It was said that the river ran past all of the old houses before anyone thought of a bridge over it, number "
    rows = [
        (None, prose + "nine", None, None, None), (1, prose + "one and so on", "en", "a", 1), (1, prose + "one and so on", "en", "a", 1), (2, prose + "one and so on", "en", "a", 1), (3, None, "en", "a", 1), (4, "", "en", "b", 0),
        (5, "One two three, four five six seven eight nine TEN eleven is in here with further words", "en", "b", 1), (6, "word" * 3, "en", "b", 1), (7, " ".join(f"w{i} is a long text" for i in range(30_000)), "en", "a", 1),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    clashing, extra = with_clashes(docs, quality, ("shard",))
    out = corpus_pipeline.run(spark, pipeline_dir(spark, clashing, tmp_path, "hard"))
    assert out.columns == [*clashing.columns, "shard"] and kept_values(out, extra)
    step, at = docs, pipeline_dir(spark, docs, tmp_path, "plain")
    left = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        step = stage(spark, step, at)
        left.append(sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in step.select("doc_id").collect()))
    ids = [[None if none else d for none, d in x] for x in left]
    assert ids[0] == [1, 1, 2, 5, 7, None] and ids[1] == [1, 5, 7, None] and ids[2] == [1, 7, None]
    assert {r["doc_id"] for r in out.select("doc_id").collect()} <= {1, 7, None}
    empty = corpus_pipeline.run(spark, pipeline_dir(spark, empty_docs(spark), tmp_path, "empty"))
    assert empty.count() == 0 and empty.columns == [*docs.columns, "shard"]
    with pytest.raises(ValueError):
        corpus_pipeline.virtual_slot_sharding(spark, docs.withColumn("shard", F.lit(1)), at)
