"""Label statistics queries over the fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import (CLASSES, WAR_DISPLAY, display_name, norm_capitalize,
                                norm_substring)
from ..functions.periods import (PERIOD_NAMES, cutoff_for, id0_for, period_from_url,
                                 period_lenient, period_strict)
from ..operators import stats
from ..operators.reshape import score_long, score_matrix
from . import sqlfx as S
from .fixtures import FX_CUTOFFS, FX_URL_ID0, fx_labels, fx_long, table
from .registry import query

WITH = f"WITH {S.FX}, {S.FXL}"
PERIOD_SQL = ("CASE WHEN published_ts < {c} THEN 'Pre-war' "
              "WHEN published_ts >= {c} THEN 'During-war' END").format(c=S.cutoff("topic"))
KEYS = ["left", "centre", "right"]


def _strict(df: DataFrame) -> DataFrame:
    return df.withColumn("period", period_strict("published_ts", cutoff_for("topic", FX_CUTOFFS)))


# --- A1 -------------------------------------------------------------------------------
@query("label_counts", f"""{WITH}
SELECT topic, outlet, predicted_label_bert AS label, COUNT(*) AS n
FROM fx WHERE predicted_label_bert IS NOT NULL GROUP BY topic, outlet, predicted_label_bert""")
def label_counts(spark, sf):
    fx = fx_labels(spark, sf).withColumnRenamed("predicted_label_bert", "label")
    return stats.label_counts(fx, "label", ["topic", "outlet"])


# --- A3 / A4 ----------------------------------------------------------------------------
@query("period_label_counts", f"""{WITH}
SELECT topic, outlet, predicted_label_bert AS label,
  COUNT(*) FILTER (WHERE period = 'Pre-war') AS n_pre_war,
  COUNT(*) FILTER (WHERE period = 'During-war') AS n_during_war
FROM (SELECT *, {PERIOD_SQL} AS period FROM fx) t
WHERE period IS NOT NULL AND predicted_label_bert IN ('LEFT', 'CENTER', 'RIGHT')
GROUP BY topic, outlet, predicted_label_bert""")
def period_label_counts(spark, sf):
    fx = _strict(fx_labels(spark, sf)).withColumnRenamed("predicted_label_bert", "label")
    return stats.period_label_counts(fx, "label", "period", PERIOD_NAMES, ["topic", "outlet"])


@query("period_share_three", f"""{WITH}
SELECT topic, outlet, period, n_left, n_center, n_right,
  {S.ratio('n_left', 'n_left + n_center + n_right')} AS share_left,
  {S.ratio('n_center', 'n_left + n_center + n_right')} AS share_center,
  {S.ratio('n_right', 'n_left + n_center + n_right')} AS share_right
FROM (SELECT topic, outlet, period,
  COUNT(*) FILTER (WHERE predicted_label_bert = 'LEFT') AS n_left,
  COUNT(*) FILTER (WHERE predicted_label_bert = 'CENTER') AS n_center,
  COUNT(*) FILTER (WHERE predicted_label_bert = 'RIGHT') AS n_right
  FROM (SELECT *, {PERIOD_SQL} AS period FROM fx) t WHERE period IS NOT NULL
  GROUP BY topic, outlet, period) g""")
def period_share_three(spark, sf):
    fx = _strict(fx_labels(spark, sf))
    return stats.period_share_three(fx, "predicted_label_bert", "period", ["topic", "outlet"])


# --- A2 / A5 / A7 (policy L4 on the Claude column) -------------------------------------------
def _leaning(spark, sf) -> DataFrame:
    fx = fx_labels(spark, sf).withColumn("leaning", norm_capitalize("leaning"))
    return _strict(fx.na.drop(subset=["published_ts", "leaning"]))


@query("overall_label_counts", f"""{WITH}
SELECT topic, outlet, "left", centre, "right",
  {S.ratio('"left"', '"left" + centre + "right"')} AS share_left,
  {S.ratio('centre', '"left" + centre + "right"')} AS share_centre,
  {S.ratio('"right"', '"left" + centre + "right"')} AS share_right
FROM (SELECT topic, outlet,
  COUNT(*) FILTER (WHERE lab = 'Left') AS "left",
  COUNT(*) FILTER (WHERE lab = 'Centre') AS centre,
  COUNT(*) FILTER (WHERE lab = 'Right') AS "right"
  FROM (SELECT topic, outlet, {S.l4('leaning')} AS lab FROM fx
        WHERE published_ts IS NOT NULL AND leaning IS NOT NULL) t
  GROUP BY topic, outlet) g""")
def overall_label_counts(spark, sf):
    return stats.overall_label_counts(_leaning(spark, sf), "leaning", ["topic", "outlet"])


def _share_sql(group: str, label_expr: str, den: str, src: str, empty: str = "0.0") -> str:
    return f"""SELECT {group}, n,
  {S.ratio('n_left', 'n', empty)} AS share_left,
  {S.ratio('n_centre', 'n', empty)} AS share_centre,
  {S.ratio('n_right', 'n', empty)} AS share_right
FROM (SELECT {group},
  COUNT(*) FILTER (WHERE lab = 'Left') AS n_left,
  COUNT(*) FILTER (WHERE lab = 'Centre') AS n_centre,
  COUNT(*) FILTER (WHERE lab = 'Right') AS n_right,
  COUNT(*) FILTER (WHERE {den}) AS n
  FROM (SELECT *, {label_expr} AS lab FROM {src}) t WHERE period IS NOT NULL
  GROUP BY {group}) g"""


@query("period_share_all", f"""{WITH}, b AS (SELECT *, {PERIOD_SQL} AS period FROM fx
  WHERE published_ts IS NOT NULL AND leaning IS NOT NULL)
{_share_sql('topic, outlet, period', S.l4('leaning'), 'lab IS NOT NULL', 'b')}""")
def period_share_all(spark, sf):
    return stats.period_shares(_leaning(spark, sf), "leaning", "period", ["topic", "outlet"],
                               denominator="all", empty=0.0)


@query("outlet_period_compare", f"""{WITH}, b AS (SELECT topic, outlet, {S.l4('leaning')} AS lab,
  {PERIOD_SQL} AS period FROM fx WHERE published_ts IS NOT NULL AND leaning IS NOT NULL)
SELECT topic, period,
  {S.ratio("COUNT(*) FILTER (WHERE outlet = 'BBC' AND lab = 'Left')", "COUNT(*) FILTER (WHERE outlet = 'BBC')", '0.0')} AS bbc_left,
  {S.ratio("COUNT(*) FILTER (WHERE outlet = 'BBC' AND lab = 'Centre')", "COUNT(*) FILTER (WHERE outlet = 'BBC')", '0.0')} AS bbc_centre,
  {S.ratio("COUNT(*) FILTER (WHERE outlet = 'BBC' AND lab = 'Right')", "COUNT(*) FILTER (WHERE outlet = 'BBC')", '0.0')} AS bbc_right,
  {S.ratio("COUNT(*) FILTER (WHERE outlet = 'Guardian' AND lab = 'Left')", "COUNT(*) FILTER (WHERE outlet = 'Guardian')", '0.0')} AS guardian_left,
  {S.ratio("COUNT(*) FILTER (WHERE outlet = 'Guardian' AND lab = 'Centre')", "COUNT(*) FILTER (WHERE outlet = 'Guardian')", '0.0')} AS guardian_centre,
  {S.ratio("COUNT(*) FILTER (WHERE outlet = 'Guardian' AND lab = 'Right')", "COUNT(*) FILTER (WHERE outlet = 'Guardian')", '0.0')} AS guardian_right
FROM b WHERE period IS NOT NULL GROUP BY topic, period""")
def outlet_period_compare(spark, sf):
    d = _leaning(spark, sf).filter(F.col("period").isNotNull())
    aggs, outs = [], []
    for o in ("BBC", "Guardian"):
        ok = F.col("outlet") == o
        aggs.append(F.count_if(ok).alias(f"_{o}_n"))
        for k in CLASSES:
            aggs.append(F.count_if(ok & (F.col("leaning") == k)).alias(f"_{o}_{k}"))
            outs.append(stats.ratio(F.col(f"_{o}_{k}"), F.col(f"_{o}_n"), 0.0).alias(f"{o.lower()}_{k.lower()}"))
    return d.groupBy("topic", "period").agg(*aggs).select("topic", "period", *outs)


# --- A6 / A8 / A9 / A10 (policy L1, valid denominator) ----------------------------------------
def _l1_long(spark, sf) -> DataFrame:
    d = fx_long(spark, sf).filter(F.col("published_ts").isNotNull())
    return _strict(d.withColumn("label", norm_substring("raw_label")))


@query("period_share_valid", f"""{WITH}, b AS (SELECT *, {PERIOD_SQL} AS period FROM fxl
  WHERE published_ts IS NOT NULL)
{_share_sql('topic, outlet, model, period', S.l1('raw_label'), 'lab IS NOT NULL', 'b')}""")
def period_share_valid(spark, sf):
    return stats.period_shares(_l1_long(spark, sf), "label", "period", ["topic", "outlet", "model"],
                               denominator="valid", empty=0.0)


@query("model_outlet_period_dist", f"""{WITH}, b AS (SELECT *, {PERIOD_SQL} AS period FROM fxl
  WHERE published_ts IS NOT NULL),
s AS ({_share_sql('topic, outlet, model, period', S.l1('raw_label'), 'lab IS NOT NULL', 'b')}),
common AS (SELECT topic, model FROM b GROUP BY topic, model HAVING COUNT(DISTINCT outlet) = 2)
SELECT s.topic, s.model, outlet, period, v.label, v.share
FROM s JOIN common ON s.topic = common.topic AND s.model = common.model
CROSS JOIN LATERAL (VALUES ('Left', share_left), ('Centre', share_centre), ('Right', share_right)) v(label, share)""")
def model_outlet_period_dist(spark, sf):
    fl = _l1_long(spark, sf)
    shares = stats.period_shares(fl, "label", "period", ["topic", "outlet", "model"],
                                 denominator="valid", empty=0.0)
    # common models decided on the aggregated rows (a window over <= #outlets x #periods
    # rows per model), so the input is scanned once
    n_out = F.size(F.collect_set("outlet").over(Window.partitionBy("topic", "model")))
    shares = shares.withColumn("_n_out", n_out).filter(F.col("_n_out") == 2).drop("_n_out")
    long = shares.unpivot(
        ["topic", "model", "outlet", "period"], ["share_left", "share_centre", "share_right"],
        "label", "share")
    lab = (F.when(F.col("label") == "share_left", "Left").when(F.col("label") == "share_centre", "Centre")
            .otherwise("Right"))
    return long.withColumn("label", lab)


def common_models_df(long: DataFrame, outlets=("BBC", "Guardian")) -> DataFrame:
    """D4 on long form: (topic, model) seen in every outlet."""
    return (long.groupBy("topic", "model")
                .agg(F.count_distinct("outlet").alias("n_outlets"))
                .filter(F.col("n_outlets") == len(outlets)).select("topic", "model"))


@query("common_models", f"""{WITH}
SELECT topic, model FROM fxl GROUP BY topic, model HAVING COUNT(DISTINCT outlet) = 2""")
def common_models(spark, sf):
    return common_models_df(fx_long(spark, sf))


def _blocks_sql(prefix: str, cond: str) -> list[str]:
    cols = []
    pfx = f"{prefix}_" if prefix else ""
    for blk, bc in (("overall", "TRUE"), ("pre_war", "period = 'Pre-war'"), ("during_war", "period = 'During-war'")):
        c = f"({cond}) AND ({bc}) AND lab IS NOT NULL"
        n = f"COUNT(*) FILTER (WHERE {c})"
        for k, v in zip(KEYS, ("Left", "Centre", "Right")):
            cols.append(f"{S.ratio(f'COUNT(*) FILTER (WHERE {c} AND lab = {chr(39)}{v}{chr(39)})', n, '0.0')} AS {pfx}{blk}_{k}")
        cols.append(f"{n} AS {pfx}{blk}_n")
    return cols


_L1B = f"""{WITH}, b AS (SELECT topic, outlet, model, {S.l1('raw_label')} AS lab, {PERIOD_SQL} AS period
  FROM fxl WHERE published_ts IS NOT NULL)"""


@query("summary_one_outlet", f"""{_L1B}
SELECT topic, outlet, model, {', '.join(_blocks_sql('', 'TRUE'))}
FROM b GROUP BY topic, outlet, model""")
def summary_one_outlet(spark, sf):
    d = _l1_long(spark, sf)
    p = F.col("period")
    blocks = {"overall": None, "pre_war": p == "Pre-war", "during_war": p == "During-war"}
    return stats.block_summary(d, F.col("label"), p, blocks, ["topic", "outlet", "model"])


@query("summary_two_outlets", f"""{_L1B}
SELECT topic, model, {', '.join(_blocks_sql('bbc', "outlet = 'BBC'") + _blocks_sql('guardian', "outlet = 'Guardian'"))}
FROM b GROUP BY topic, model
HAVING COUNT(*) FILTER (WHERE outlet = 'BBC') > 0 AND COUNT(*) FILTER (WHERE outlet = 'Guardian') > 0""")
def summary_two_outlets(spark, sf):
    return summary_two_outlets_df(_l1_long(spark, sf))


def summary_two_outlets_df(d: DataFrame) -> DataFrame:
    """A10: per (topic, model) a BBC and a Guardian block; only models both outlets carry."""
    p, o = F.col("period"), F.col("outlet")
    blocks = {}
    for name, oc in (("bbc", o == "BBC"), ("guardian", o == "Guardian")):
        blocks[f"{name}_overall"] = oc
        blocks[f"{name}_pre_war"] = oc & (p == "Pre-war")
        blocks[f"{name}_during_war"] = oc & (p == "During-war")
    # "common models" is decided in the same aggregation (a HAVING on per-outlet row counts)
    extra = [F.count_if(o == "BBC").alias("_nb"), F.count_if(o == "Guardian").alias("_ng")]
    return stats.block_summary(d, F.col("label"), p, blocks, ["topic", "model"],
                               having=(F.col("_nb") > 0) & (F.col("_ng") > 0), extra=extra)


# --- A16 / A17 / A18 / J7 / J8 (policy L3 + L7) ---------------------------------------------
def scored_long(spark, sf) -> DataFrame:
    """fx long with war, period (Guardian: lenient date; BBC: url heuristic) and score."""
    d = fx_long(spark, sf)
    cut = cutoff_for("topic", FX_CUTOFFS)
    per = F.when(F.col("outlet") == "Guardian", period_lenient("published_ts", cut)) \
           .otherwise(period_from_url("url", "title", id0_for("topic", FX_URL_ID0)))
    war = F.when(F.col("topic") == "RU", "Russia-Ukraine").otherwise("Israel-Palestine")
    d = d.withColumns({"period": per, "war": display_name(war, WAR_DISPLAY)})
    return score_long(d)


SCORED_SQL = f"""{WITH}, sc AS (
  SELECT outlet, model,
    CASE WHEN topic = 'RU' THEN 'Russia-Ukraine' ELSE 'Hamas-Israel' END AS war,
    CASE WHEN outlet = 'Guardian' THEN
           CASE WHEN published_ts < {S.cutoff('topic')} THEN 'Pre-War' ELSE 'Post-War' END
         WHEN uid <> '' THEN
           CASE WHEN length(uid) < length(id0) OR (length(uid) = length(id0) AND uid < id0)
                THEN 'Pre-War' ELSE 'Post-War' END
         WHEN lower(COALESCE(title, 'nan')) LIKE '%if russia invades%' THEN 'Pre-War'
         WHEN lower(COALESCE(title, 'nan')) LIKE '% war%' OR lower(COALESCE(title, 'nan')) LIKE '%invasion%'
           OR lower(COALESCE(title, 'nan')) LIKE '%attack%' OR lower(COALESCE(title, 'nan')) LIKE '%ceasefire%'
           THEN 'Post-War'
         ELSE 'Pre-War' END AS period,
    {S.l7(S.l3('raw_label'))} AS score
  FROM (SELECT *, regexp_replace(regexp_extract(COALESCE(url, ''), '(\\d+)$', 1), '^0+', '') AS uid,
          CASE topic WHEN 'RU' THEN '60395600' WHEN 'IP' THEN '60395900' END AS id0 FROM fxl) u)"""


@query("avg_bias_score", f"""{SCORED_SQL}
SELECT outlet, war, period, model, AVG(score) AS avg_score, COUNT(*) AS n, war || chr(10) || period AS scenario
FROM sc WHERE score IS NOT NULL GROUP BY outlet, war, period, model""")
def avg_bias_score(spark, sf):
    return (scored_long(spark, sf).groupBy("outlet", "war", "period", "model")
            .agg(F.avg("score").alias("avg_score"), F.count(F.lit(1)).alias("n"))
            .withColumn("scenario", F.concat_ws("\n", "war", "period")))


@query("avg_score_grouping_sets", f"""{SCORED_SQL}
SELECT outlet, war, period, model, AVG(score) AS avg_score, COUNT(*) AS n
FROM sc WHERE score IS NOT NULL
GROUP BY GROUPING SETS ((outlet, war, period, model), (outlet, war, model))""")
def avg_score_grouping_sets(spark, sf):
    """A16 + A17 in one shuffle: per period and per war (mean over rows, not of means)."""
    return (scored_long(spark, sf)
            .groupingSets([["outlet", "war", "period", "model"], ["outlet", "war", "model"]],
                          "outlet", "war", "period", "model")
            .agg(F.avg("score").alias("avg_score"), F.count(F.lit(1)).alias("n")))


@query("period_change", f"""{SCORED_SQL}
SELECT * , post - pre AS delta FROM (
  SELECT war, outlet, model, AVG(score) FILTER (WHERE period = 'Pre-War') AS pre,
         AVG(score) FILTER (WHERE period = 'Post-War') AS post
  FROM sc WHERE score IS NOT NULL GROUP BY war, outlet, model) t
WHERE pre IS NOT NULL AND post IS NOT NULL""")
def period_change(spark, sf):
    p = F.col("period")
    g = (scored_long(spark, sf).groupBy("war", "outlet", "model")
         .agg(F.avg(F.when(p == "Pre-War", F.col("score"))).alias("pre"),
              F.avg(F.when(p == "Post-War", F.col("score"))).alias("post")))
    return (g.filter(F.col("pre").isNotNull() & F.col("post").isNotNull())
             .withColumn("delta", F.col("post") - F.col("pre")))


MATRIX_COLUMNS = {"ru_pre": ("Russia-Ukraine", "Pre-War"), "ru_post": ("Russia-Ukraine", "Post-War"),
                  "hi_pre": ("Hamas-Israel", "Pre-War"), "hi_post": ("Hamas-Israel", "Post-War")}


def _cond_avg_sql(cols: dict[str, tuple[str, str]], a: str, b: str) -> str:
    return ",\n  ".join(f"AVG(score) FILTER (WHERE {a} = '{x}' AND {b} = '{y}') AS {n}"
                        for n, (x, y) in cols.items())


@query("score_matrix", f"""{SCORED_SQL}
SELECT outlet, model, {_cond_avg_sql(MATRIX_COLUMNS, 'war', 'period')}
FROM sc WHERE score IS NOT NULL GROUP BY outlet, model""")
def score_matrix_q(spark, sf):
    return score_matrix(scored_long(spark, sf), MATRIX_COLUMNS)


RADAR_COLUMNS = {"bbc_ru": ("BBC", "Russia-Ukraine"), "guardian_ru": ("Guardian", "Russia-Ukraine"),
                 "guardian_hi": ("Guardian", "Hamas-Israel"), "bbc_hi": ("BBC", "Hamas-Israel")}


@query("radar_table", f"""{SCORED_SQL}
SELECT model, {_cond_avg_sql(RADAR_COLUMNS, 'outlet', 'war')}
FROM sc WHERE score IS NOT NULL GROUP BY model""")
def radar_table(spark, sf):
    """Model x (Media, War) mean score over rows."""
    s = scored_long(spark, sf)
    aggs = [F.avg(F.when((F.col("outlet") == m) & (F.col("war") == w), F.col("score"))).alias(n)
            for n, (m, w) in RADAR_COLUMNS.items()]
    return s.groupBy("model").agg(*aggs)


# --- J2 --------------------------------------------------------------------------------------
@query("merge_model_labels", """WITH l AS (
  SELECT doc_id, 'quality' AS model, CAST(quality AS VARCHAR) AS label FROM labels
  UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM labels
  UNION ALL SELECT doc_id, 'lang', lang FROM documents)
SELECT doc_id, MAX(label) FILTER (WHERE model = 'quality') AS label_quality,
  MAX(label) FILTER (WHERE model = 'toxic') AS label_toxic, MAX(label) FILTER (WHERE model = 'lang') AS label_lang
FROM l GROUP BY doc_id""")
def merge_model_labels_q(spark, sf):
    """Per-model label tables (one row per key each) merged into one wide row per key."""
    from ..operators.reshape import merge_model_labels
    lab = table(spark, sf, "labels")
    docs = table(spark, sf, "documents")
    tables = {"quality": lab.select("doc_id", F.col("quality").alias("label")),
              "toxic": lab.select("doc_id", F.col("toxic").alias("label")),
              "lang": docs.select("doc_id", F.col("lang").alias("label"))}
    return merge_model_labels(tables, "doc_id")
