"""Monthly / weekly trend queries over the fixture."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import CLASSES, letters_score, norm_capitalize, norm_substring
from ..functions.periods import week_end_monday
from ..operators import trends as T
from ..operators.stats import ratio
from . import sqlfx as S
from .fixtures import FX_EVENTS, fx_labels, fx_long, table
from .registry import query

WITH = f"WITH {S.FX}, {S.FXL}"
SER = ["topic", "outlet", "model"]


def _month(c="month_start"):
    return F.date_format(F.col(c), "yyyy-MM").alias("month")


def _l1(spark, sf) -> DataFrame:
    return fx_long(spark, sf).withColumn("label", norm_substring("raw_label"))


def _mf_sql(all_months=False) -> str:
    where = "published_ts IS NOT NULL"
    valid = "TRUE" if all_months else "lab IS NOT NULL"
    return f"""mf AS (SELECT topic, outlet, model, date_trunc('month', published_ts) AS ms,
    COUNT(*) FILTER (WHERE lab = 'Left') AS n_left, COUNT(*) FILTER (WHERE lab = 'Centre') AS n_centre,
    COUNT(*) FILTER (WHERE lab = 'Right') AS n_right, COUNT(lab) AS total
  FROM (SELECT *, {S.l1('raw_label')} AS lab FROM fxl WHERE {where}) t
  WHERE {valid} GROUP BY topic, outlet, model, date_trunc('month', published_ts))"""


SPINE_SQL = """rng AS (SELECT topic, MIN(ms) AS lo, MAX(ms) AS hi FROM mf GROUP BY topic),
sp AS (SELECT topic, unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS ms FROM rng),
ser AS (SELECT DISTINCT topic, outlet, model FROM mf),
filled AS (SELECT sp.topic, ser.outlet, ser.model, sp.ms,
    COALESCE(mf.n_left, 0) AS n_left, COALESCE(mf.n_centre, 0) AS n_centre,
    COALESCE(mf.n_right, 0) AS n_right, COALESCE(mf.total, 0) AS total
  FROM sp JOIN ser ON sp.topic = ser.topic
  LEFT JOIN mf ON mf.topic = sp.topic AND mf.outlet = ser.outlet AND mf.model = ser.model AND mf.ms = sp.ms),
segs AS (SELECT topic, ms, segment,
    strftime(MIN(ms) OVER (PARTITION BY topic, segment), '%Y-%m') || ' ~ ' ||
    strftime(MAX(ms) OVER (PARTITION BY topic, segment), '%Y-%m') AS segment_label
  FROM (SELECT topic, ms, ntile(6) OVER (PARTITION BY topic ORDER BY ms) AS segment FROM sp) x)"""


def _facts(spark, sf, all_months=False) -> DataFrame:
    """Monthly class counts; ``all_months`` keeps dated months without a valid label (the
    segment and spine queries take their month range from every dated row)."""
    return T.monthly_class_counts(_l1(spark, sf), SER, "label", "published_ts",
                                  valid_only=not all_months)


# --- A11 ---------------------------------------------------------------------------------
@query("monthly_label_counts", f"""{WITH}
SELECT topic, outlet, strftime(published_ts, '%Y-%m') AS month,
  COUNT(*) FILTER (WHERE lab = 'Left') AS n_left, COUNT(*) FILTER (WHERE lab = 'Centre') AS n_centre,
  COUNT(*) FILTER (WHERE lab = 'Right') AS n_right,
  COUNT(*) FILTER (WHERE lab NOT IN ('Left', 'Centre', 'Right')) AS n_other
FROM (SELECT *, {S.l4('leaning')} AS lab FROM fx WHERE published_ts IS NOT NULL AND leaning IS NOT NULL) t
GROUP BY topic, outlet, strftime(published_ts, '%Y-%m')""")
def monthly_label_counts(spark, sf):
    d = fx_labels(spark, sf).withColumn("lab", norm_capitalize("leaning")) \
        .na.drop(subset=["published_ts", "lab"])
    lab = F.col("lab")
    return (d.groupBy("topic", "outlet", F.date_format("published_ts", "yyyy-MM").alias("month"))
             .agg(*[F.count_if(lab == k).alias(f"n_{k.lower()}") for k in CLASSES],
                  F.count_if(~lab.isin(CLASSES)).alias("n_other")))


# --- A12 / A13 / W1 ------------------------------------------------------------------------
@query("monthly_proportions", f"""{WITH}, {_mf_sql()}
SELECT topic, outlet, model, strftime(ms, '%Y-%m') AS month,
  {S.ratio('n_left', 'total')} AS share_left, {S.ratio('n_centre', 'total')} AS share_centre,
  {S.ratio('n_right', 'total')} AS share_right, total FROM mf""")
def monthly_proportions(spark, sf):
    f = _facts(spark, sf)
    return f.select(*SER, _month(), *[ratio(F.col(f"n_{k.lower()}"), F.col("total")).alias(f"share_{k.lower()}")
                                      for k in CLASSES], "total")


@query("monthly_rl_diff", f"""{WITH}, {_mf_sql()}
SELECT topic, outlet, model, strftime(ms, '%Y-%m') AS month,
  {S.ratio('n_right - n_left', 'total')} AS rl_diff, total FROM mf""")
def monthly_rl_diff(spark, sf):
    return _rl(_facts(spark, sf)).select(*SER, _month(), "rl_diff", "total")


def _rl(f: DataFrame) -> DataFrame:
    """P(Right) - P(Left) from integer counts in one division."""
    return f.withColumn("rl_diff", ratio(F.col("n_right") - F.col("n_left"), F.col("total")))


@query("share_of_group", f"""{WITH}, c AS (
  SELECT topic, outlet, model, strftime(published_ts, '%Y-%m') AS month, lab AS label, COUNT(*) AS n
  FROM (SELECT *, {S.l1('raw_label')} AS lab FROM fxl WHERE published_ts IS NOT NULL) t
  WHERE lab IS NOT NULL GROUP BY ALL)
SELECT *, {S.ratio('n', 'SUM(n) OVER (PARTITION BY topic, outlet, model, month)')} AS share FROM c""")
def share_of_group(spark, sf):
    d = _l1(spark, sf).filter(F.col("published_ts").isNotNull() & F.col("label").isNotNull())
    c = d.groupBy(*SER, F.date_format("published_ts", "yyyy-MM").alias("month"), "label") \
         .agg(F.count(F.lit(1)).alias("n"))
    return T.share_of_group(c, [*SER, "month"])


# --- X3 / R5 / J1 / W3 / A14 / A15 / J9 ------------------------------------------------------
@query("distinct_months", f"""{WITH}
SELECT DISTINCT strftime(published_ts, '%Y-%m') AS month FROM fx WHERE published_ts IS NOT NULL""")
def distinct_months(spark, sf):
    return fx_labels(spark, sf).filter(F.col("published_ts").isNotNull()) \
        .select(F.date_format("published_ts", "yyyy-MM").alias("month")).distinct()


@query("month_spine_fill", f"""{WITH}, {_mf_sql(all_months=True)}, {SPINE_SQL}
SELECT topic, outlet, model, strftime(ms, '%Y-%m') AS month, n_left, n_centre, n_right, total FROM filled""")
def month_spine_fill(spark, sf):
    f = _facts(spark, sf, all_months=True)
    filled = T.month_spine_fill(f, ["topic"], ["outlet", "model"],
                                fill_cols=["n_left", "n_centre", "n_right", "total"])
    return filled.select(*SER, _month(), "n_left", "n_centre", "n_right", "total")


@query("month_segments", f"""{WITH}, {_mf_sql(all_months=True)}, {SPINE_SQL}
SELECT topic, strftime(ms, '%Y-%m') AS month, segment, segment_label FROM segs""")
def month_segments(spark, sf):
    return T.month_segments(_facts(spark, sf, all_months=True), ["topic"], 6).select("topic", _month(), "segment", "segment_label")


def _segment_sql(weighted: bool) -> str:
    if weighted:
        sel = ", ".join(f"{S.ratio(f'SUM(n_{k})', 'SUM(total)')} AS share_{k}" for k in ("left", "centre", "right"))
    else:
        sel = ", ".join(f"round(AVG({S.ratio(f'n_{k}', 'total', '0.0')}), 9) AS share_{k}"
                        for k in ("left", "centre", "right"))
    return f"""{WITH}, {_mf_sql(all_months=True)}, {SPINE_SQL}
SELECT f.topic, segment, segment_label, outlet, model, {sel}, CAST(SUM(total) AS BIGINT) AS n
FROM filled f JOIN segs s ON f.topic = s.topic AND f.ms = s.ms
GROUP BY f.topic, segment, segment_label, outlet, model"""


def _segment_trend(spark, sf, weighted: bool) -> DataFrame:
    filled = T.month_spine_fill(_facts(spark, sf, all_months=True), ["topic"], ["outlet", "model"],
                                fill_cols=["n_left", "n_centre", "n_right", "total"], keep_range=True)
    return T.segment_means(filled, ["topic"], ["outlet", "model"], weighted=weighted)


@query("segment_trend", _segment_sql(True))
def segment_trend(spark, sf):
    return _segment_trend(spark, sf, True)


@query("segment_trend_simple", _segment_sql(False))
def segment_trend_simple(spark, sf):
    return _segment_trend(spark, sf, False)


@query("monthly_rl_aligned", f"""{WITH}, {_mf_sql()},
months AS (SELECT DISTINCT topic, model, ms FROM mf), ser AS (SELECT DISTINCT topic, outlet, model FROM mf)
SELECT ser.topic, ser.model, ser.outlet, strftime(months.ms, '%Y-%m') AS month,
  {S.ratio('mf.n_right - mf.n_left', 'mf.total')} AS rl_diff
FROM months JOIN ser ON months.topic = ser.topic AND months.model = ser.model
LEFT JOIN mf ON mf.topic = ser.topic AND mf.outlet = ser.outlet AND mf.model = ser.model AND mf.ms = months.ms""")
def monthly_rl_aligned(spark, sf):
    """Per model, both outlets on the union of their months; a month one outlet lacks is null."""
    f = _rl(_facts(spark, sf))
    out = T.complete_calendar(f, SER, "month_start", ["rl_diff"], None, range_by=["topic", "model"], mode="union")
    return out.select("topic", "model", "outlet", _month(), "rl_diff")


# Authors (customers) write a few articles over the years: series that are sparse at every size.
_AUTHORS_SQL = f"""af AS (SELECT author, topic, date_trunc('month', published_ts) AS ms,
    COUNT(*) FILTER (WHERE lab = 'Left') AS n_left, COUNT(*) FILTER (WHERE lab = 'Centre') AS n_centre,
    COUNT(*) FILTER (WHERE lab = 'Right') AS n_right, COUNT(lab) AS total
  FROM (SELECT o_custkey AS author, topic, published_ts, {S.l1('leaning')} AS lab FROM fx JOIN orders ON o_orderkey = art_id
        WHERE published_ts IS NOT NULL) t GROUP BY ALL)"""


def _author_facts(spark, sf) -> DataFrame:
    d = fx_labels(spark, sf, carry=["o_custkey"]).withColumnRenamed("o_custkey", "author")
    return T.monthly_class_counts(d.withColumn("label", norm_substring("leaning")), ["author", "topic"], "label",
                                  "published_ts", valid_only=False)


@query("month_spine_fill_authors", f"""{WITH}, {_AUTHORS_SQL},
sp AS (SELECT author, unnest(generate_series(MIN(ms), MAX(ms), INTERVAL 1 MONTH)) AS ms FROM af GROUP BY author),
ser AS (SELECT DISTINCT author, topic FROM af)
SELECT sp.author, ser.topic, strftime(sp.ms, '%Y-%m') AS month, COALESCE(n_left, 0) AS n_left, COALESCE(n_centre, 0) AS n_centre,
  COALESCE(n_right, 0) AS n_right, COALESCE(total, 0) AS total
FROM sp JOIN ser USING (author) LEFT JOIN af ON af.author = sp.author AND af.topic = ser.topic AND af.ms = sp.ms""")
def month_spine_fill_authors(spark, sf):
    """J1 + R5 on sparse series: both topics of an author over all months of the author."""
    cols = ["n_left", "n_centre", "n_right", "total"]
    filled = T.month_spine_fill(_author_facts(spark, sf), ["author"], ["topic"], fill_cols=cols)
    return filled.select("author", "topic", _month(), *cols)


@query("monthly_rl_aligned_authors", f"""{WITH}, {_AUTHORS_SQL},
months AS (SELECT DISTINCT author, ms FROM af), ser AS (SELECT DISTINCT author, topic FROM af)
SELECT ser.author, ser.topic, strftime(months.ms, '%Y-%m') AS month, {S.ratio('n_right - n_left', 'total')} AS rl_diff
FROM months JOIN ser USING (author) LEFT JOIN af ON af.author = ser.author AND af.topic = ser.topic AND af.ms = months.ms""")
def monthly_rl_aligned_authors(spark, sf):
    """J9 on sparse series: both topics on the union of the author's months; a month that one lacks is null."""
    out = T.complete_calendar(_rl(_author_facts(spark, sf)), ["author", "topic"], "month_start", ["rl_diff"], None,
                              range_by=["author"], mode="union")
    return out.select("author", "topic", _month(), "rl_diff")


@query("segment_trend_simple_authors", f"""{WITH}, {_AUTHORS_SQL},
sp AS (SELECT author, unnest(generate_series(MIN(ms), MAX(ms), INTERVAL 1 MONTH)) AS ms FROM af GROUP BY author),
ser AS (SELECT DISTINCT author, topic FROM af),
segs AS (SELECT author, ms, ntile(6) OVER (PARTITION BY author ORDER BY ms) AS segment FROM sp),
names AS (SELECT author, ms, segment, strftime(MIN(ms) OVER w, '%Y-%m') || ' ~ ' || strftime(MAX(ms) OVER w, '%Y-%m') AS segment_label
  FROM segs WINDOW w AS (PARTITION BY author, segment))
SELECT n.author, segment, segment_label, ser.topic,
  {", ".join(f"round(AVG({S.ratio(f'COALESCE(n_{k}, 0)', 'COALESCE(total, 0)', '0.0')}), 9) AS share_{k}" for k in ("left", "centre", "right"))},
  CAST(SUM(COALESCE(total, 0)) AS BIGINT) AS n
FROM names n JOIN ser USING (author) LEFT JOIN af ON af.author = n.author AND af.topic = ser.topic AND af.ms = n.ms
GROUP BY n.author, segment, segment_label, ser.topic""")
def segment_trend_simple_authors(spark, sf):
    """A14, simple form, on sparse series: a month without articles counts as 0."""
    cols = ["n_left", "n_centre", "n_right", "total"]
    filled = T.month_spine_fill(_author_facts(spark, sf), ["author"], ["topic"], fill_cols=cols, keep_range=True)
    return T.segment_means(filled, ["author"], ["topic"], weighted=False)


# --- A19 / W2 / R6 / J3 / R7 (policy L2) --------------------------------------------------------
def _weekly(spark, sf) -> DataFrame:
    d = fx_long(spark, sf).withColumn("score", letters_score("raw_label"))
    return T.weekly_mean(d, SER, "published_ts", "score")


WEEK_SQL = "CAST(published_ts AS DATE) + CAST((8 - isodow(published_ts)) % 7 AS INTEGER)"
WK_SQL = f"""wk AS (SELECT topic, outlet, model, {WEEK_SQL} AS week, AVG(score) AS idx, COUNT(*) AS n
  FROM (SELECT *, {S.l2score('raw_label')} AS score FROM fxl) t
  WHERE published_ts IS NOT NULL AND score IS NOT NULL GROUP BY ALL)"""
SMOOTH_SQL = f"""{WK_SQL},
wr AS (SELECT topic, outlet, model, MIN(week) AS lo, MAX(week) AS hi FROM wk GROUP BY ALL),
wsp AS (SELECT topic, outlet, model, CAST(x AS DATE) AS week FROM
  (SELECT topic, outlet, model, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS x FROM wr) y),
sm AS (SELECT wsp.topic, wsp.outlet, wsp.model, wsp.week, wk.idx,
    CASE WHEN COUNT(wk.idx) OVER win = 3 THEN round(AVG(wk.idx) OVER win, 9) END AS smoothed,
    CASE WHEN COUNT(wk.idx) OVER win = 3 THEN AVG(wk.idx) OVER win END AS smoothed_raw
  FROM wsp LEFT JOIN wk ON wk.topic = wsp.topic AND wk.outlet = wsp.outlet AND wk.model = wsp.model AND wk.week = wsp.week
  WINDOW win AS (PARTITION BY wsp.topic, wsp.outlet, wsp.model ORDER BY wsp.week ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""


def _wk(c="week"):
    return F.date_format(F.col(c), "yyyy-MM-dd").alias("week")


@query("weekly_index", f"""{WITH}, {WK_SQL}
SELECT topic, outlet, model, strftime(week, '%Y-%m-%d') AS week, idx, n FROM wk""")
def weekly_index(spark, sf):
    return _weekly(spark, sf).select(*SER, _wk(), "idx", "n")


@query("weekly_index_events", f"""SELECT strftime(CAST(ts AS DATE) + CAST((8 - isodow(ts)) % 7 AS INTEGER), '%Y-%m-%d') AS week,
  AVG(score) AS idx, COUNT(*) AS n
FROM (SELECT ts, CASE event_type WHEN 'click' THEN -1 WHEN 'view' THEN 0 WHEN 'purchase' THEN 1 END AS score
      FROM events) e WHERE ts IS NOT NULL AND score IS NOT NULL GROUP BY 1""")
def weekly_index_events(spark, sf):
    """A19 on timestamps with times of day: a Monday 23:59 event belongs to that Monday."""
    ev = table(spark, sf, "events")
    et = F.col("event_type")
    score = F.when(et == "click", -1).when(et == "view", 0).when(et == "purchase", 1)
    d = ev.select("ts", score.alias("score"))
    return T.weekly_mean(d, [], "ts", "score").select(_wk(), "idx", "n")


@query("weekly_index_smoothed", f"""{WITH}, {SMOOTH_SQL}
SELECT topic, outlet, model, strftime(week, '%Y-%m-%d') AS week, idx, smoothed FROM sm""")
def weekly_index_smoothed(spark, sf):
    sm = T.centred_rolling(_weekly(spark, sf).drop("n"), SER, 3)
    return sm.select(*SER, _wk(), "idx", "smoothed")


@query("weekly_index_combined", f"""{WITH}, {SMOOTH_SQL}
SELECT topic, model, strftime(week, '%Y-%m-%d') AS week, round(AVG(smoothed_raw), 9) AS combined
FROM sm GROUP BY topic, model, week""")
def weekly_index_combined(spark, sf):
    sm = T.centred_rolling(_weekly(spark, sf).drop("n"), SER, 3, digits=None)
    return T.combine_series(sm, ["topic", "model"]).select("topic", "model", _wk(), "combined")


_EV_VALUES = ", ".join(f"(DATE '{d}', '{n}')" for d, n in FX_EVENTS)


@query("event_markers", f"""{WITH}, {WK_SQL},
ev AS (SELECT * FROM (VALUES {_EV_VALUES}) v(event_date, event))
SELECT event, strftime(event_date, '%Y-%m-%d') AS event_date, strftime(event_date + CAST((8 - isodow(event_date)) % 7 AS INTEGER), '%Y-%m-%d') AS week,
  topic, outlet, model, idx
FROM ev LEFT JOIN wk ON wk.week = event_date + CAST((8 - isodow(event_date)) % 7 AS INTEGER)""")
def event_markers(spark, sf):
    ev = spark.createDataFrame([(dt.date.fromisoformat(d), n) for d, n in FX_EVENTS],
                               "event_date date, event string")
    ev = ev.withColumn("week", week_end_monday(F.col("event_date")))
    out = T.place_events(ev, _weekly(spark, sf), "week")
    return out.select("event", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), _wk(),
                      *SER, "idx")
