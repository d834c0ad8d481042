"""Token windows, votes, n-grams, HTML text and classification against brute force."""

import math
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from medialens.operators import classify as K
from medialens.operators import textops as X
from .html_reference import html_to_text


@pytest.mark.parametrize("n", [0, 1, 256, 512, 513, 768, 769, 1024, 1025, 5000])
def test_window_bounds(spark, n):
    df = spark.createDataFrame([(1, ["t"] * n)], "k int, tok array<string>")
    got = [(r["start"], r["end"]) for r in X.token_windows(df, "k", F.col("tok")).orderBy("pos").collect()]
    count = max(1, math.ceil((n - 512) / 256) + 1) if n else 0
    assert got == [(256 * i, min(256 * i + 512, n)) for i in range(count)]


@pytest.mark.parametrize("votes, winner", [(["B", "A", "A", "B"], "B"), (["error", "error"], "error"), (["error", "A"], "A"),
                                           (["C"], "C"), (["A", "B", "B"], "B")])
def test_majority_vote_first_seen(spark, votes, winner):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(votes)], "k int, pos int, label string")
    got = X.majority_vote(df, "k", "label", "pos", ignore=["error"]).collect()[0]["label"]
    assert got == winner


def test_ngram_topk_matches_brute_force(spark):
    docs = [(0, "The war, the war! The WAR diary."), (1, "diary of the war; a b c"), (2, "Élan élan vital")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for n in (1, 2, 3):
        got = [(r["gram"], r["n"]) for r in X.ngram_topk(df, "doc_id", F.col("text"), n, 5, ["say"]).collect()]
        counts, first = Counter(), {}
        for d, t in docs:
            toks = re.findall(r"(?u)\b\w\w+\b", t.lower())
            for i in range(len(toks) - n + 1):
                g = " ".join(toks[i:i + n])
                counts[g] += 1
                first.setdefault(g, (d, i))
        exp = sorted(counts.items(), key=lambda kv: (-kv[1], first[kv[0]]))[:5]
        assert got == exp


def test_clean_tokens_order_and_lists(spark):
    df = spark.createDataFrame([("The children were saying news, 42 times!",)], "t string")
    toks = X.clean_tokens(F.col("t"), ["the"], {"children": "child", "were": "be"}, ["news"])
    assert df.select(toks).first()[0] == ["child", "be", "saying", "times"]


def test_clean_tokens_keeps_no_fragments(spark):
    df = spark.createDataFrame([(1, "Covid19 g7 don't John's 'quoted' a_b Élan's"), (2, "the THE"), (3, None)], "k int, t string")
    exp = {1: ["do", "john", "quoted", "élan"], 2: [], 3: []}
    got = {r.k: r.toks for r in df.select("k", X.clean_tokens(F.col("t"), ["the"]).alias("toks")).collect()}
    lemmas = spark.createDataFrame([("élan", "elan"), ("élan", "f"), ("unused", "x"), (None, "y"), ("do", None)], "token string, lemma string")
    met = {r.k: r.tokens for r in X.clean_tokens_dictionary(df, "t", lemmas, ["the"], ["quoted"]).collect()}
    assert got == exp and met == {1: ["do", "john", "elan"], 2: [], 3: []}


def test_dictionary_lookup_in_parts(spark):
    from medialens.operators import dictionary
    rows = [(1, ["a", "b", "a", None, "zz"]), (2, []), (3, None), (4, ["w" + str(i) for i in range(300)])]
    df = spark.createDataFrame(rows, "k int, t array<string>")
    table = spark.createDataFrame([("w" + str(i), i) for i in range(0, 400, 3)] + [("a", 7), ("a", 5), (None, 1)], "token string, value long")
    expected = {1: [5, None, 5, None, None], 2: [], 3: None, 4: [i if i % 3 == 0 else None for i in range(300)]}
    for part_bytes in (1 << 20, 500):
        out = dictionary.lookup(df, "t", table, part_bytes=part_bytes)
        assert {r.k: r["values"] for r in out.collect()} == expected
    nothing = dictionary.lookup(df, "t", table.limit(0))
    assert {r.k: r["values"] for r in nothing.collect()} == {k: v and [None] * len(v) for k, v in expected.items()}


def test_dictionary_answers_leave_in_pieces(monkeypatch):
    """A worker holds the answers of PIECE_TOKENS tokens, not those of a whole Arrow batch."""
    from types import SimpleNamespace

    import pyarrow as pa
    from pyspark.sql.types import LongType

    from medialens.operators import dictionary
    monkeypatch.setattr(dictionary, "PIECE_TOKENS", 100)
    sent = SimpleNamespace(value=dictionary._as_bytes(pa.table({"token": ["a", "b"], "value": pa.array([1, 2], pa.int64())})))
    lists = [["a"] * 30 + ["x", None]] * 50 + [None, [], ["b"] * 250, None] + [["b"]] * 3
    batches = [pa.array(lists, pa.list_(pa.string())), pa.array([], pa.list_(pa.string())), pa.array(lists, pa.list_(pa.string())).slice(48, 5)]
    pieces = list(dictionary._answer(sent, LongType()).func(iter(batches)))
    value = {"a": 1, "b": 2}
    assert [x for p in pieces for x in p.to_pylist()] == [x and [value.get(t) for t in x] for x in lists + lists[48:53]]
    assert all(len(p) == 1 or len(p.flatten()) <= 100 for p in pieces)


def test_dictionary_parts_are_not_held_together(spark):
    """Each part of a large table has workers of its own: one Arrow function in a plan, however many parts."""
    from medialens.operators import dictionary
    df = spark.createDataFrame([(i, ["w%d" % j for j in range(i, i + 40)]) for i in range(20)], "k int, t array<string>")
    table = spark.createDataFrame([("w%d" % i, i) for i in range(50)], "token string, value long")
    out = dictionary.lookup(df, "t", table, part_bytes=300)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 1
    assert {r.k: r["values"] for r in out.collect()} == {i: [j if j < 50 else None for j in range(i, i + 40)] for i in range(20)}


def test_dictionary_shuffles_distinct_tokens_only(spark):
    """What the lookup exchanges follows the distinct tokens: texts of a million equal words add a row per task."""
    from medialens.operators import dictionary
    df = spark.range(40).select(F.array_repeat(F.lit("the"), 25000).alias("t"))
    table = spark.createDataFrame([("the", "T")], "token string, value string")
    plan = dictionary.needed_entries(df, "t", table)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan
    out = dictionary.lookup(df, "t", table)
    assert out.select(F.sum(F.size("values"))).first()[0] == 1_000_000
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_ngram_topk_with_any_key_and_poor_sketch(spark):
    """Text keys, keys of 63 bits and negative ones; one bucket and no proposals must not change a row."""
    docs = [("k%d" % i, i % 2, "w%d w%d w%d x y" % (i % 3, i % 5, i % 7)) for i in range(60)]
    df = spark.createDataFrame(docs, "name string, g int, text string")
    df = df.withColumn("wide", F.xxhash64("name"))
    for key, ns in (("name", (2,)), ("wide", (1, 2))):
        order = {r.name: r[key] for r in df.collect()}
        for n in ns:
            want = {}
            for g in (0, 1):
                counts, first = Counter(), {}
                for name, own, text in docs:
                    if own == g:
                        toks = text.split()
                        toks = [t for t in toks if len(t) > 1]
                        for i in range(len(toks) - n + 1):
                            gram = " ".join(toks[i:i + n])
                            counts[gram] += 1
                            place = (order[name], i)
                            first[gram] = min(first.get(gram, place), place)
                want[g] = sorted(((g, w, c) for w, c in counts.items()), key=lambda x: (-x[2], first[x[1]]))[:4]
            for buckets, share in ((1 << 14, 1), (1, 1 << 20)):
                got = X.ngram_topk(df, key, F.col("text"), n, 4, by=["g"], buckets=buckets, share=share).collect()
                assert sorted(map(tuple, got)) == sorted(want[0] + want[1]), (key, n, buckets)
            got = X.ngram_topk(df, key, F.col("text"), n, 4, by=["g"], prune=False).collect()
            assert sorted(map(tuple, got)) == sorted(want[0] + want[1])


HTML = ("<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{x:1}</style>"
        "<script>var t='</p>';</script></head><body><!-- hidden --><p> Hello <b>big</b>\n world </p>"
        "<p>caf&eacute; &lt;ok&gt;<p>unclosed</body></html>")


def test_html_to_text():
    assert html_to_text(HTML) == "T & U\nHello\nbig\nworld\ncafé <ok>\nunclosed"
    assert html_to_text(None) == ""
    assert html_to_text(3) == ""
    assert html_to_text("<p>a < b") == "a < b"
    assert html_to_text("<div><template>no</div>yes") == "yes"


def test_classify_batches_and_errors(spark):
    rows = [(i, "x" * (i % 7)) for i in range(1, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def factory():
        def score(b: pd.DataFrame):
            if (b["doc_id"] % 101 == 0).any():
                raise RuntimeError("boom")
            return [str(len(t) % 3) for t in b["text"]]
        return score

    got = {r["doc_id"]: r["label"] for r in K.classify(df, ["doc_id"], "text", factory, batch_size=16).collect()}
    assert set(got) == {i for i, _ in rows}
    # blank text is never scored; a failing row fails alone
    assert {i for i in got if got[i] == "error"} == {101, 202, *(i for i, t in rows if not t)}
    assert all(got[i] == str((i % 7) % 3) for i in got if got[i] != "error")


def test_retry_and_fallback():
    calls = {"n": 0}

    def flaky(b):
        calls["n"] += 1
        if calls["n"] < 3:
            raise ConnectionError("later")
        return ["Left"] * len(b)

    s = K.with_retry(flaky, tries=3, backoff=lambda a: 0.0)
    assert s(pd.DataFrame({"t": ["a", "b"]})) == ["Left", "Left"]

    def bad(b):
        raise RuntimeError("x")

    f = K.with_fallback(bad, bad, final="Unknown")
    assert f(pd.DataFrame({"t": ["a"]})) == ["Unknown"]
    g = K.with_fallback(bad, lambda b: ["Right"] * len(b))
    assert g(pd.DataFrame({"t": ["a"]})) == ["Right"]


def test_classify_windows_error_scope(spark):
    df = spark.createDataFrame([(1, " ".join(["w"] * 600)), (2, ""), (3, "a b")], "doc_id long, text string")

    def factory():
        def score(b):
            if ((b["doc_id"] == 1) & (b["pos"] == 1)).any():
                raise RuntimeError("window fails")
            return ["Left"] * len(b)
        return score

    from medialens.functions.text import word_tokens
    w = {r["doc_id"]: r["label"] for r in K.classify_windows(df, "doc_id", word_tokens("text"), factory,
                                                             batch_size=1).collect()}
    a = {r["doc_id"]: r["label"] for r in K.classify_windows(df, "doc_id", word_tokens("text"), factory,
                                                             batch_size=1, error_scope="article").collect()}
    assert w == {1: "Left", 2: "error", 3: "Left"}
    assert a == {1: "error", 2: "error", 3: "Left"}


def test_classify_sources_skips_missing(spark, tmp_path):
    a = str(tmp_path / "a")
    spark.createDataFrame([(1, "x y z"), (2, "  ")], "doc_id long, text string").write.parquet(a)

    def factory():
        return lambda b: ["Left"] * len(b)

    with pytest.warns(UserWarning):
        res = K.classify_sources(spark, {"A": a, "B": str(tmp_path / "missing")}, "doc_id", "text", factory,
                                 out_path=str(tmp_path / "out"))
    assert sorted(tuple(r) for r in res.select("source", "doc_id", "label").collect()) == [("A", 1, "Left")]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_blank_text_is_error_without_scoring(spark):
    df = spark.createDataFrame([(1, "a"), (2, " \n"), (3, None)], "doc_id long, text string")
    seen = []

    def factory():
        def score(b):
            if (b["text"].str.strip() == "").any():
                raise AssertionError("blank text reached the scorer")
            return ["Right"] * len(b)
        return score
    got = {r.doc_id: r.label for r in K.classify(df, ["doc_id"], "text", factory).collect()}
    assert got == {1: "Right", 2: "error", 3: "error"} and seen == []


def test_label_with_replies(spark, tmp_path):
    from medialens.functions.labels import parse_reply
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "ccc"), (4, "dddd")], "doc_id long, text string")

    def primary():
        def score(b):
            return [{"a": "Left.", "bb": "", "ccc": "no idea", "dddd": ""}[t] for t in b["text"]]
        return score

    def backup():
        def score(b):
            if (b["doc_id"] == 4).any():
                raise RuntimeError("down")
            return ["Right"] * len(b)
        return score

    got = {r.doc_id: (r.label, r.attempts) for r in
           K.label_with_replies(df, ["doc_id"], "text", primary, backup, parse_reply, str(tmp_path / "s"),
                                batch_size=1).collect()}
    assert got == {1: ("Left", 1), 2: ("Right", 2), 3: ("Unknown", 1), 4: ("Unknown", 2)}


@pytest.fixture(scope="module")
def lessons(spark):
    """Texts whose class one of their words tells."""
    told = {"Left": "gauche", "Centre": "milieu", "Right": "droite"}
    rows = [(i, f"Some words {told[c]} of text {i % 7} here", c) for i in range(90) for c in [list(told)[i % 3]]]
    df = spark.createDataFrame([*rows, (90, None, "Left"), (91, "milieu", "no class"), (92, "droite", None)],
                               "doc_id long, text string, leaning string")
    return df.withColumn("tokens", K.model_tokens("text"))


@pytest.fixture(scope="module")
def models(lessons):
    from medialens.operators import learned as M
    classes = ["Left", "Centre", "Right"]
    return {"logistic": M.fit_logistic(lessons, "doc_id", "tokens", "leaning", classes, iterations=5, features=1 << 10),
            "bayes": M.fit_bayes(lessons, "tokens", "leaning", classes)}


@pytest.mark.parametrize("name, least", [("logistic", 0.99), ("bayes", 1 << 50)])
def test_learned_models_label_and_abstain(spark, models, name, least):
    model = models[name]
    new = spark.createDataFrame([(1, "GAUCHE words"), (2, "some milieu"), (3, "text droite"), (4, " "), (5, None), (6, "xyzzy")],
                                "doc_id long, text string")
    got = {r.doc_id: r.label for r in K.classify(new, ["doc_id"], "text", model).collect()}
    assert (got[1], got[2], got[3], got[4], got[5]) == ("Left", "Centre", "Right", "error", "error")
    shy = {r.doc_id: r.label for r in K.classify(new, ["doc_id"], "text", model.asking(least), error_label="?").collect()}
    assert shy[6] == shy[4] == "?"


def test_bayes_scores_are_the_same_in_any_partitioning(spark, lessons):
    from medialens.operators import learned as M
    fits = [M.fit_bayes(lessons.repartition(n), "tokens", "leaning", ["Left", "Centre", "Right"]) for n in (1, 7)]
    tables = [sorted((r.token, r.weights) for r in f.weights.collect()) for f in fits]
    assert tables[0] == tables[1] and fits[0].prior == fits[1].prior
    # 30 of 90 texts hold it; ten texts at least must
    assert {"gauche", "milieu", "droite", "some"} <= {t for t, _ in tables[0]}
    assert all(w == int(w) for _, ws in tables[0] for w in ws)


def test_learned_windows_vote(spark, models, tmp_path):
    model = models["bayes"]
    long = "gauche " * 300 + "droite " * 900
    df = spark.createDataFrame([(1, long), (2, ""), (3, "milieu")], "doc_id long, text string")
    got = {r.doc_id: (r.label, r.n_votes) for r in K.classify_windows(
        df, "doc_id", K.model_tokens("text"), model, stage_path=str(tmp_path / "scored")).collect()}
    # windows start at 0, 256, 512, 768: one of gauche, three of droite
    assert got == {1: ("Right", 3), 2: ("error", 0), 3: ("Centre", 1)}
    # the vote over the written scores, in SQL
    import duckdb
    sql = f"""SELECT doc_id, label, n FROM (SELECT doc_id, label, count(*) AS n, min(pos) AS first FROM '{tmp_path}/scored/*.parquet'
      WHERE label <> 'error' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1"""
    assert {k: (v, n) for k, v, n in duckdb.sql(sql).fetchall()} == {k: v for k, v in got.items() if v[0] != "error"}


def test_replies_of_learned_models(spark, models, tmp_path):
    from medialens.functions.labels import parse_reply
    df = spark.createDataFrame([(1, "gauche"), (2, "xyzzy"), (3, "")], "doc_id long, text string")
    out = K.label_with_replies(df, ["doc_id"], "text", models["bayes"].asking(100_000), models["logistic"], parse_reply, str(tmp_path / "s"))
    got = {r.doc_id: (r.label, r.attempts) for r in out.collect()}
    assert got[1] == ("Left", 1) and got[2][1] == 2 and got[3] == ("Unknown", 2)


HARD_HTML = [
    HTML, None, "", "<p>a < b", "<div><template>no</div>yes", "a&#65;&#x42;&#0;&#128;&#150;&#1;&#xD800;&#x110000;&#99999999999999999999;b",
    "&notit; &not &copy2 &ampamp; &#; &x &", "&nbsp; x &nbsp;", "<a href='x>y'>q</a>", 'x<a href="un', "x<a hre", "t<br/>u<hr>v",
    "<script>a</script>b<SCRIPT type=x>c</Script >d", "a<!-- x", "a<!x>b<?y>c<!DOCTYPE z>d", "<title>x</title></p>y</div>z",
    "<template><p>x</p><template>y</template>z</template>w<div><template>q</div><p>e", "<TEMPLATE>a</TEMPLATE>b<template/>c",
    "&Aacute;&AElig&Aacutex; &CounterClockwiseContourIntegral; &NotEqualTilde;", "<p>1 > 2</p>", "<style>x</style", "<script>never closed",
    "a\x1fb&amp;c\x01", "<p " + "x='1' " * 5000 + ">long</p>", "<b>" * 3000 + "deep",
]


def test_html_text_equals_a_parser_and_sql(spark):
    import duckdb

    from medialens.sources.html import html_text, html_text_sql
    df = spark.createDataFrame(list(enumerate(HARD_HTML)), "i int, h string")
    got = {r.i: r.t for r in df.select("i", html_text("h").alias("t")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE h (i INTEGER, h VARCHAR)")
    con.executemany("INSERT INTO h VALUES (?, ?)", list(enumerate(HARD_HTML)))
    told = dict(con.execute(f"SELECT i, {html_text_sql('h')} FROM h").fetchall())
    for i, html in enumerate(HARD_HTML):
        assert got[i] == html_to_text(html), html
        if "template" not in (html or "").lower():
            assert told[i] == got[i], html
