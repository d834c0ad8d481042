"""Plan shape checks: native queries stay in the JVM, shuffles are where we expect them,
top-k and first-per-key use their bounded physical operators."""

import re

import pytest

from medialens.plans.registry import queries

from .conftest import SF_SMALL

Q = queries()
#: Queries whose token arrays meet a table in an Arrow function; everything else stays in the JVM.
PY_QUERIES = {"clean_tokens_lexicon", "classify_bayes", "classify_fallback_bayes", "label_archive_learned"}
#: These fit a model first; one of them stands for the others here.
FITTED = {"classify_learned_holdout", "classify_windows_learned", "classify_sources_learned", "classify_windows_bayes"}


def plan_of(spark, name):
    df = Q[name](spark, SF_SMALL)
    qe = df._jdf.queryExecution()
    return qe.executedPlan().toString() + qe.optimizedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(Q) - PY_QUERIES - FITTED))
def test_no_python_worker(spark, name):
    p = plan_of(spark, name)
    assert "MapInPandas" not in p and "ArrowEvalPython" not in p and "BatchEvalPython" not in p


@pytest.mark.parametrize("name", ["clean_tokens_lexicon", "classify_bayes"])
def test_python_only_where_needed(spark, name):
    p = plan_of(spark, name)
    assert "ArrowEvalPython" in p and "MapInPandas" not in p


def static_plan(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def exchanged_columns(plan):
    """Names of the columns right below the exchanges of a plan."""
    lines = plan.splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    out = set()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line or "Exchange SinglePartition" in line:
            child = next(x for x in lines[i + 1:] if depth(x) >= depth(line) and not x.strip(" :+-*()0123456789").startswith("Sort"))
            out |= set(re.findall(r"(\w+)#", child))
    return out


@pytest.mark.parametrize("name", ["dedup_first", "dedup_exact"])
def test_texts_are_never_exchanged(spark, name):
    """Digests and order keys meet; bodies stay where they are read."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = Q[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Exchange" in p
    for line in p.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "text#" not in line
    assert "text" not in exchanged_columns(p)


def test_ngrams_are_pruned_before_they_are_counted_by_name(spark):
    """The aggregate over whole n-grams stands above the semi-join with the buckets that reach the bound."""
    p = plan_of(spark, "ngram_top3")
    assert "LeftSemi" in p and p.count("xxhash64") >= 2


def test_month_archive_is_one_scan_per_schema(spark):
    p = Q["month_partitions_read"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    # sixty months and more in two scans: the agreeing months, and those that hold a narrower number
    assert p.count("FileScan parquet") <= 3, p


def test_html_text_is_native(spark):
    p = plan_of(spark, "api_articles")
    assert "Python" not in p and "Pandas" not in p


@pytest.mark.parametrize("name", ["summary_one_outlet", "summary_two_outlets", "monthly_proportions",
                                  "monthly_rl_diff", "avg_bias_score", "score_matrix", "radar_table",
                                  "avg_score_grouping_sets", "period_change"])
def test_single_hash_shuffle(spark, name):
    df = Q[name](spark, SF_SMALL)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # the shuffles the query itself needs (a spread of a single-split input is REPARTITION_BY_NUM)
    needed = [ln for ln in p.splitlines() if "Exchange hashpartitioning" in ln and "ENSURE_REQUIREMENTS" in ln]
    assert len(needed) == 1, p


@pytest.mark.parametrize("name,op", [("ngram_top1", "WindowGroupLimit"), ("ngram_top2", "WindowGroupLimit"),
                                     ("ngram_top3", "WindowGroupLimit"), ("ngram_top2_fr", "TakeOrderedAndProject")])
def test_topk_is_bounded(spark, name, op):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = Q[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert op in p
    assert "HashAggregate" in p and "SortAggregate" not in p


@pytest.mark.parametrize("name", ["dedup_first", "url_clean", "merged_label_qa"])
def test_first_per_key_uses_group_limit(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = Q[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" in p


def test_filters_and_columns_reach_the_scan(spark):
    p = plan_of(spark, "url_prefix")
    assert "PushedFilters: [IsNotNull(url), StringStartsWith(url,https://m.)]" in p
    p2 = plan_of(spark, "label_counts")
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderpriority:string>" in p2


@pytest.mark.parametrize("name", ["segment_trend", "weekly_index_combined", "monthly_rl_aligned"])
def test_calendars_scan_once(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = Q[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert p.count("FileScan parquet") == 1, p
