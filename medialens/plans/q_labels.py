"""Label normaliser queries (L1-L9), one row per (article, model)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from . import sqlfx as S
from .fixtures import fx_labels, fx_long_all, table
from .registry import query

FXA = f"""WITH {S.FX}, fxa AS (
  SELECT art_id, 'BERT' AS model, predicted_label_bert AS raw_label FROM fx
  UNION ALL SELECT art_id, 'DeepSeek', predicted_label_deepseek FROM fx
  UNION ALL SELECT art_id, 'Gemini', predicted_label_gemini FROM fx
  UNION ALL SELECT art_id, 'Claude', leaning FROM fx)"""


def _norm_query(name, fn, sql_expr):
    @query(name, f"{FXA} SELECT art_id, model, {sql_expr} AS label FROM fxa")
    def q(spark, sf):
        return fx_long_all(spark, sf).select("art_id", "model", fn("raw_label").alias("label"))
    q.__name__ = name
    return q


_norm_query("norm_substring", L.norm_substring, S.l1("raw_label"))
_norm_query("norm_title", L.norm_title, S.l3("raw_label"))
_norm_query("norm_capitalize", L.norm_capitalize, S.l4("raw_label"))
_norm_query("norm_letters", L.norm_letters,
            f"CASE {S.l2score('raw_label')} WHEN -1 THEN 'Left' WHEN 0 THEN 'Centre' WHEN 1 THEN 'Right' END")

STATUS_SQL = ("CASE WHEN raw_label IS NULL THEN NULL WHEN raw_label IN ('error', 'Unknown') "
              "OR regexp_matches(raw_label, '^\\[(ERROR|Error|Failed)\\]') THEN 'failed' ELSE 'ok' END")


@query("label_status", f"{FXA} SELECT art_id, model, raw_label, {STATUS_SQL} AS status FROM fxa")
def label_status(spark, sf):
    return fx_long_all(spark, sf).select("art_id", "model", "raw_label",
                                         L.label_status("raw_label").alias("status"))


@query("failed_labels", f"{FXA} SELECT art_id, model, raw_label FROM fxa WHERE ({STATUS_SQL}) = 'failed'")
def failed_labels(spark, sf):
    """S9's second output: only the rows whose label is a failure sentinel."""
    d = fx_long_all(spark, sf)
    return d.filter(L.label_status("raw_label") == "failed").select("art_id", "model", "raw_label")


REPLY_SQL = ("CASE WHEN {s} = '' THEN NULL "
             "WHEN regexp_matches(lower(COALESCE(reply, '')), '\\bleft\\b') THEN 'Left' "
             "WHEN regexp_matches(lower(COALESCE(reply, '')), '\\bright\\b') THEN 'Right' "
             "WHEN regexp_matches(lower(COALESCE(reply, '')), '\\b(center|centre|neutral)\\b') THEN 'Center' "
             "ELSE 'Unknown' END").format(s=S.strip("lower(COALESCE(reply, ''))"))


@query("parse_reply", f"""WITH {S.FX}, r AS (
  SELECT art_id, 'DeepSeek' AS model, predicted_label_deepseek AS reply FROM fx
  UNION ALL SELECT art_id, 'Claude', leaning FROM fx)
SELECT art_id, model, reply, {REPLY_SQL} AS label FROM r""")
def parse_reply(spark, sf):
    fx = fx_labels(spark, sf)
    pairs = F.array(F.struct(F.lit("DeepSeek").alias("model"), F.col("predicted_label_deepseek").alias("reply")),
                    F.struct(F.lit("Claude").alias("model"), F.col("leaning").alias("reply")))
    r = fx.select("art_id", F.inline(pairs))
    return r.select("art_id", "model", "reply", L.parse_reply("reply").alias("label"))


@query("map_sentiment", """SELECT doc_id, raw, CASE raw WHEN 'LABEL_0' THEN 'negative'
  WHEN 'LABEL_1' THEN 'neutral' WHEN 'LABEL_2' THEN 'positive' ELSE 'unknown' END AS sentiment
FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'LABEL_9'
  ELSE 'LABEL_' || CAST(quality + toxic AS VARCHAR) END AS raw FROM labels) t""")
def map_sentiment(spark, sf):
    lab = table(spark, sf, "labels")
    raw = F.when(F.col("doc_id") % 50 == 0, F.lit("LABEL_9")) \
           .otherwise(F.concat(F.lit("LABEL_"), (F.col("quality") + F.col("toxic")).cast("string")))
    return lab.select("doc_id", raw.alias("raw")).withColumn("sentiment", L.map_sentiment("raw"))
