"""Properties from the test strategy: shares sum to 1 (or all 0), period counts add up,
segment N sums to the total, first-per-key is idempotent, windows cover every token,
results do not depend on partitioning, and the normalisers keep their rules on random text."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from medialens.functions import labels as L
from medialens.functions.text import word_tokens
from medialens.operators import dedup as U
from medialens.operators import textops as X
from medialens.plans import fixtures as FX
from medialens.plans import q_stats
from medialens.plans.registry import queries

from .conftest import SF_SMALL

Q = queries()


def test_summary_blocks_add_up(spark):
    for r in Q["summary_one_outlet"](spark, SF_SMALL).collect():
        assert r["pre_war_n"] + r["during_war_n"] == r["overall_n"]
        for b in ("overall", "pre_war", "during_war"):
            s = r[f"{b}_left"] + r[f"{b}_centre"] + r[f"{b}_right"]
            assert s == pytest.approx(1.0) if r[f"{b}_n"] else s == 0.0


def test_segment_n_sums_to_total(spark):
    seg = Q["segment_trend"](spark, SF_SMALL).groupBy("topic", "outlet", "model").agg(F.sum("n").alias("n"))
    tot = Q["monthly_proportions"](spark, SF_SMALL).groupBy("topic", "outlet", "model").agg(F.sum("total").alias("n"))
    assert sorted(map(tuple, seg.collect())) == sorted(map(tuple, tot.collect()))


def test_dedup_first_idempotent(spark):
    d = FX.fx_with_copies(spark, SF_SMALL)
    once = U.dedup_first(d, "url", "ord")
    twice = U.dedup_first(once, "url", "ord")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_windows_cover_every_token(spark):
    docs = FX.table(spark, SF_SMALL, "documents")
    w = X.token_windows(docs, "doc_id", word_tokens("text"))
    cov = w.groupBy("doc_id").agg(F.min("start").alias("lo"), F.max("end").alias("hi"),
                                  F.max(F.col("end") - F.col("start")).alias("width"))
    n = docs.select("doc_id", F.size(word_tokens("text")).alias("n")).filter("n > 0")
    bad = cov.join(n, "doc_id").filter((F.col("lo") != 0) | (F.col("hi") != F.col("n")) | (F.col("width") > 512))
    assert bad.count() == 0
    gaps = w.alias("a").join(w.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("b.pos") == F.col("a.pos") + 1))
    assert gaps.filter(F.col("b.start") > F.col("a.end")).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_repartitioning_does_not_change_results(spark, parts):
    base = sorted(map(tuple, q_stats.summary_two_outlets_df(q_stats._l1_long(spark, SF_SMALL)).collect()))
    d = q_stats._l1_long(spark, SF_SMALL).repartition(parts)
    assert sorted(map(tuple, q_stats.summary_two_outlets_df(d).collect())) == base


WORDS = st.sampled_from(["left", "LEFT", "right", "Centre", "center", "neutral", "x", " ", "\t", "-", "[ERROR]"])


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(WORDS, max_size=5).map("".join), min_size=1, max_size=20))
def test_substring_rules_on_random_labels(spark, labels):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "i int, v string")
    rows = df.select("i", L.norm_substring("v").alias("o"),
                     L.norm_substring(F.concat(F.lit("\t"), F.upper("v"), F.lit(" "))).alias("shouted"),
                     L.norm_substring(F.concat("v", F.lit("left"))).alias("led")).orderBy("i").collect()
    for r, v in zip(rows, labels):
        assert r.shouted == r.o and r.led == "Left"
        assert (r.o is None) == all(c not in v.lower() for c in ("left", "centre", "center", "right"))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(WORDS, max_size=6), min_size=1, max_size=10))
def test_reply_rules_on_random_replies(spark, replies):
    df = spark.createDataFrame([(i, " ".join(v), " ".join(reversed(v))) for i, v in enumerate(replies)], "i int, v string, w string")
    rows = df.select("i", L.parse_reply("v").alias("o"), L.parse_reply("w").alias("turned"),
                     L.parse_reply(F.concat("v", F.lit(" left"))).alias("led")).orderBy("i").collect()
    for r, v in zip(rows, replies):
        assert r.turned == r.o and r.led == "Left"
        assert (r.o is None) == (not "".join(v).strip())
