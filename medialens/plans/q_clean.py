"""Cleaning, dedup, discovery and period queries (P, U, D, R, A20-A22, S3, S4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import norm_capitalize
from ..functions.periods import cutoff_for, id0_for, period_from_url, period_lenient
from ..functions.text import PANDAS_NA_TOKENS, compose_text as compose, null_tokens, slug as slug_fn
from ..operators import clean as C
from ..operators import dedup as U
from ..operators import stats
from ..operators.discover import detect_label_columns, parseable_counts, resolve_date_column
from ..operators.reshape import order_by_values, restore_order, unpivot_labels
from ..sources.partitions import union_partitions
from . import sqlfx as S
from .fixtures import FX_CUTOFFS, FX_URL_ID0, docs_with_na, fx_labels, fx_long, fx_with_copies, table
from .registry import query

WITH = f"WITH {S.FX}"
FXC = f"""{S.FX}, fxc AS (
  SELECT *, art_id * 2 + 1 AS ord FROM fx
  UNION ALL SELECT *, art_id * 2 + 2 FROM fx WHERE art_id % 50 = 0
  UNION ALL SELECT art_id, outlet, topic, url, title, published_ts, NULL, NULL, NULL, NULL, art_id * 2
    FROM fx WHERE art_id % 70 = 0)"""
LABEL_COLS = ["predicted_label_bert", "predicted_label_deepseek", "predicted_label_gemini", "leaning"]
ROW_COLS = ["art_id", "ord", "url", "title", *LABEL_COLS]


def _na_sql(c: str) -> str:
    toks = ", ".join("'" + t.replace("'", "''") + "'" for t in PANDAS_NA_TOKENS)
    return f"CASE WHEN {c} IN ({toks}) THEN NULL ELSE {c} END"


DOCS_NA = """dna AS (SELECT doc_id,
  CASE doc_id % 20 WHEN 1 THEN 'NA' WHEN 2 THEN 'nan' WHEN 3 THEN ' \t' WHEN 4 THEN '' ELSE lang END AS lang,
  CASE doc_id % 20 WHEN 5 THEN 'null' WHEN 6 THEN 'N/A' WHEN 7 THEN '  ' ELSE source END AS source
  FROM documents)"""


# --- P1-P3 ------------------------------------------------------------------------------
@query("canonical_articles", """SELECT doc_id AS art_id, source AS outlet, lang AS topic, text AS content,
  'documents' AS origin FROM documents""")
def canonical_articles(spark, sf):
    d = table(spark, sf, "documents")
    c = C.canonicalise(d, {"doc_id": "art_id", "text": "content", "source": "outlet", "lang": "topic"},
                       {"origin": "documents"})
    return C.select_columns(c, ["art_id", "outlet", "topic", "content", "origin", "title"], tolerant=True)


@query("compose_text", f"""{WITH}
SELECT art_id, COALESCE(title, '') || ' ' || COALESCE(url, '') || ' ' || COALESCE(outlet, '') AS text FROM fx""")
def compose_text(spark, sf):
    return fx_labels(spark, sf).select("art_id", compose("title", "url", "outlet").alias("text"))


# --- P5 -----------------------------------------------------------------------------------
DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]


@query("parse_dates", f"""{WITH}, r AS (SELECT art_id, CASE art_id % 4
    WHEN 0 THEN strftime(published_ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(published_ts, '%Y-%m-%d')
    WHEN 2 THEN 'not a date' END AS raw FROM fx)
SELECT art_id, raw, strftime(COALESCE(try_strptime(raw, '%Y-%m-%d %H:%M:%S'), try_strptime(raw, '%Y-%m-%d')),
  '%Y-%m-%d %H:%M:%S') AS parsed FROM r""")
def parse_dates(spark, sf):
    fx = fx_labels(spark, sf)
    m = F.col("art_id") % 4
    raw = (F.when(m == 0, F.date_format("published_ts", "yyyy-MM-dd HH:mm:ss"))
            .when(m == 1, F.date_format("published_ts", "yyyy-MM-dd"))
            .when(m == 2, F.lit("not a date")))
    r = fx.select("art_id", raw.alias("raw"))
    p = C.parse_dates(r, "raw", "_ts", DATE_FORMATS)
    return p.select("art_id", "raw", F.date_format("_ts", "yyyy-MM-dd HH:mm:ss").alias("parsed"))


# --- P6 / A21 / U1-U4 -------------------------------------------------------------------------
@query("drop_missing_any", f"""WITH {FXC} SELECT {', '.join(ROW_COLS)} FROM fxc
WHERE url IS NOT NULL AND title IS NOT NULL""")
def drop_missing_any(spark, sf):
    return C.drop_missing(fx_with_copies(spark, sf), ["url", "title"], "any").select(*ROW_COLS)


@query("drop_missing_all", f"""WITH {FXC} SELECT {', '.join(ROW_COLS)} FROM fxc
WHERE NOT ({' AND '.join(f'{c} IS NULL' for c in LABEL_COLS)})""")
def drop_missing_all(spark, sf):
    return C.drop_missing(fx_with_copies(spark, sf), LABEL_COLS, "all").select(*ROW_COLS)


NC_COLS = ["art_id", "outlet", "topic", "url", "title", "published_ts", *LABEL_COLS, "ord"]


@query("null_counts", f"""WITH {FXC} SELECT {', '.join(f'COUNT(*) FILTER (WHERE {c} IS NULL) AS {c}' for c in NC_COLS)}
FROM fxc""")
def null_counts(spark, sf):
    return stats.null_counts(fx_with_copies(spark, sf), NC_COLS)


QA_DATA = ["art_id", "outlet", "topic", "url", "title", "published_ts", *LABEL_COLS]


@query("merged_label_qa", f"""WITH {FXC},
a AS (SELECT * FROM fxc WHERE url IS NOT NULL AND title IS NOT NULL),
b AS (SELECT {', '.join(QA_DATA)}, MIN(ord) AS ord FROM a GROUP BY ALL),
c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord) = 1)
SELECT {', '.join(ROW_COLS)} FROM c WHERE NOT ({' AND '.join(f'{x} IS NULL' for x in LABEL_COLS)})""")
def merged_label_qa(spark, sf):
    """Drop rows missing url/title -> exact dups -> first per url -> drop all-null labels.
    The order matters: a url whose first row has no labels is lost."""
    d = C.drop_missing(fx_with_copies(spark, sf), ["url", "title"], "any")
    d = U.drop_exact_duplicates(d, QA_DATA, order="ord")
    d = U.dedup_first(d, "url", "ord")
    return C.drop_missing(d, LABEL_COLS, "all").select(*ROW_COLS)


@query("url_clean", f"""WITH {FXC}
SELECT art_id, ord, url FROM fxc WHERE starts_with(url, 'http')
QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord) = 1""")
def url_clean(spark, sf):
    d = C.url_prefix(fx_with_copies(spark, sf), "url", "http")
    return U.dedup_first(d, "url", "ord").select("art_id", "ord", "url")


@query("dedup_exact", """SELECT DISTINCT text, lang, source, n_chars FROM documents""")
def dedup_exact(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return U.drop_exact_duplicates(d, ["text", "lang", "source", "n_chars"], "doc_id", late=True).drop("doc_id")


@query("dedup_first", """SELECT doc_id, lang, source, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def dedup_first(spark, sf):
    d = table(spark, sf, "documents")
    return U.dedup_first(d, "text", "doc_id").select("doc_id", "lang", "source", "n_chars")


@query("corpus_stats", """SELECT COUNT(*) AS rows_before, COUNT(DISTINCT COALESCE(text, '')) AS rows_after,
  AVG(length(text)) AS mean_chars FROM documents""")
def corpus_stats(spark, sf):
    return stats.corpus_stats(table(spark, sf, "documents"), "text", "doc_id", None, "text")


@query("corpus_stats_articles", f"""WITH {FXC}
SELECT COUNT(*) AS rows_before, COUNT(DISTINCT COALESCE(url, '')) AS rows_after,
  AVG(length(title)) AS mean_chars, strftime(MIN(published_ts), '%Y-%m-%d %H:%M:%S') AS min_date,
  strftime(MAX(published_ts), '%Y-%m-%d %H:%M:%S') AS max_date FROM fxc""")
def corpus_stats_articles(spark, sf):
    """A20 on the article fixture: rows before/after url dedup, date range as text, mean title length."""
    d = fx_with_copies(spark, sf)
    st = stats.corpus_stats(d, "url", "ord", F.col("published_ts"), "title")
    return st.select("rows_before", "rows_after", "mean_chars",
                     F.date_format("min_date", "yyyy-MM-dd HH:mm:ss").alias("min_date"),
                     F.date_format("max_date", "yyyy-MM-dd HH:mm:ss").alias("max_date"))


# --- S3 / P7 / P8 -------------------------------------------------------------------------------
@query("na_tokens", f"""WITH {DOCS_NA} SELECT doc_id, {_na_sql('lang')} AS lang, {_na_sql('source')} AS source FROM dna""")
def na_tokens(spark, sf):
    d = docs_with_na(spark, sf)
    return d.select("doc_id", null_tokens("lang", PANDAS_NA_TOKENS).alias("lang"),
                    null_tokens("source", PANDAS_NA_TOKENS).alias("source"))


@query("drop_blank", f"""WITH {DOCS_NA} SELECT doc_id, lang, source FROM dna
WHERE {S.strip('lang')} <> ''""")
def drop_blank(spark, sf):
    return C.drop_blank(docs_with_na(spark, sf), "lang")


@query("url_prefix", """SELECT page_id, url FROM pages WHERE starts_with(url, 'https://m.')""")
def url_prefix(spark, sf):
    return C.url_prefix(table(spark, sf, "pages"), "url", "https://m.").select("page_id", "url")


@query("slug", """SELECT doc_id, lower(regexp_replace(regexp_replace(source || ' / ' || lang,
  '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM documents""")
def slug(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", slug_fn(F.concat("source", F.lit(" / "), "lang")).alias("slug"))


# --- D2 -------------------------------------------------------------------------------------
FX_COLS = ["art_id", "outlet", "topic", "url", "title", "published_ts", *LABEL_COLS]


_PROBE_COUNTS = ", ".join(
    f"COUNT(COALESCE(try_strptime(CAST({c} AS VARCHAR), '%Y-%m-%d %H:%M:%S'), "
    f"try_strptime(CAST({c} AS VARCHAR), '%Y-%m-%d'))) AS c{i}" for i, c in enumerate(FX_COLS))


@query("date_column_probe", f"""{WITH}, a AS (SELECT {_PROBE_COUNTS} FROM fx),
v AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(FX_COLS))}) t(column_name, ordinal))
SELECT column_name, ordinal, CASE ordinal {' '.join(f'WHEN {i} THEN c{i}' for i in range(len(FX_COLS)))} END AS n_parseable
FROM v CROSS JOIN a""")
def date_column_probe(spark, sf):
    fx = fx_labels(spark, sf).select(*[F.col(c).cast("string").alias(c) for c in FX_COLS])
    return parseable_counts(fx)


# --- R1-R4 / A22 ------------------------------------------------------------------------------
PERIOD_SQL = ("CASE WHEN published_ts < {c} THEN 'Pre-war' WHEN published_ts >= {c} THEN 'During-war' END"
              .format(c=S.cutoff("topic")))


@query("split_by_cutoff", f"""{WITH}
SELECT topic, period, COUNT(*) AS n FROM (SELECT topic, {PERIOD_SQL} AS period FROM fx) t
WHERE period IS NOT NULL GROUP BY topic, period""")
def split_by_cutoff(spark, sf):
    d = C.split_by_cutoff(fx_labels(spark, sf), "published_ts", cutoff_for("topic", FX_CUTOFFS))
    return d.groupBy("topic", "period").agg(F.count(F.lit(1)).alias("n"))


@query("period_lenient", f"""{WITH}
SELECT art_id, topic, CASE WHEN published_ts < {S.cutoff('topic')} THEN 'Pre-War' ELSE 'Post-War' END AS period FROM fx""")
def period_lenient_q(spark, sf):
    fx = fx_labels(spark, sf)
    return fx.select("art_id", "topic", period_lenient("published_ts", cutoff_for("topic", FX_CUTOFFS)).alias("period"))


def _url_period_sql(url: str, title: str, id0: str) -> str:
    t = f"lower(COALESCE({title}, 'nan'))"
    uid = f"regexp_replace(regexp_extract(COALESCE({url}, ''), '(\\d+)$', 1), '^0+', '')"
    return (f"CASE WHEN {uid} <> '' THEN CASE WHEN length({uid}) < length({id0}) OR "
            f"(length({uid}) = length({id0}) AND {uid} < {id0}) THEN 'Pre-War' ELSE 'Post-War' END "
            f"WHEN {t} LIKE '%if russia invades%' THEN 'Pre-War' "
            f"WHEN {t} LIKE '% war%' OR {t} LIKE '%invasion%' OR {t} LIKE '%attack%' OR {t} LIKE '%ceasefire%' "
            f"THEN 'Post-War' ELSE 'Pre-War' END")


@query("period_from_url", f"""{WITH}
SELECT art_id, topic, {_url_period_sql('url', 'title', "CASE topic WHEN 'RU' THEN '60395600' WHEN 'IP' THEN '60395900' END")} AS period FROM fx""")
def period_from_url_q(spark, sf):
    fx = fx_labels(spark, sf)
    return fx.select("art_id", "topic",
                     period_from_url("url", "title", id0_for("topic", FX_URL_ID0)).alias("period"))


@query("period_from_url_pages", f"""SELECT page_id, {_url_period_sql('url', 'NULL', "'500'")} AS period FROM pages""")
def period_from_url_pages(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", period_from_url("url", F.lit(None).cast("string"), F.lit("500")).alias("period"))


# --- S4 / X1 -------------------------------------------------------------------------------------
@query("month_partition_union", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
  o_totalprice, CASE WHEN month(o_orderdate) % 2 = 1 THEN o_orderpriority END AS o_orderpriority,
  strftime(o_orderdate, '%Y-%m') AS month
FROM orders WHERE month(o_orderdate) <> 2""")
def month_partition_union(spark, sf):
    """Month partitions with drifting schemas: even months lack o_orderpriority (null-filled),
    February lacks the required o_totalprice and is skipped."""
    o = table(spark, sf, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    m = F.month("o_orderdate")
    parts = [o.filter(m % 2 == 1),
             o.filter((m % 2 == 0) & (m != 2)).drop("o_orderpriority"),
             o.filter(m == 2).drop("o_totalprice")]
    u = union_partitions(parts, required=["o_orderkey", "o_orderdate", "o_totalprice"])
    return u.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
                    "o_totalprice", "o_orderpriority", "month")


# --- P12 / P14 / D1 / D3 / O1 / O3 / O4 ------------------------------------------------------------
@query("required_columns_kept", f"""WITH {S.FX} SELECT art_id, outlet, leaning FROM fx WHERE topic = 'RU'""")
def required_columns_kept(spark, sf):
    """Of two label files, the one without the required column is skipped, not failed on."""
    fx = fx_labels(spark, sf)
    files = [fx.filter("topic = 'RU'").select("art_id", "outlet", "leaning"),
             fx.filter("topic = 'IP'").select("art_id", "outlet", F.col("leaning").alias("lean"))]
    kept = [f for f in files if C.require_columns(f, ["art_id", "leaning"], on_missing="skip")]
    return kept[0] if len(kept) == 1 else kept[0].unionByName(kept[1])


@query("keep_models", f"""WITH {S.FX}, {S.FXL} SELECT art_id, model, raw_label FROM fxl WHERE model IN ('BERT', 'Gemini')""")
def keep_models(spark, sf):
    """P14 with a list of values."""
    return C.keep_values(fx_long(spark, sf), "model", ["BERT", "Gemini"]).select("art_id", "model", "raw_label")


@query("drop_failed_urls", f"""WITH {S.FX} SELECT art_id, url FROM fx
WHERE url NOT IN (SELECT url FROM fx WHERE leaning = 'Unknown')""")
def drop_failed_urls(spark, sf):
    """P14 with a table of values of any size, excluded: urls that one model failed on."""
    fx = fx_labels(spark, sf)
    return C.keep_values(fx, "url", fx.filter("leaning = 'Unknown'").select("url"), exclude=True).select("art_id", "url")


_RENAMED = {"published_ts": "Published_Date", "predicted_label_bert": "Predicted_Label_BERT",
            "predicted_label_deepseek": "deep-seek label", "predicted_label_gemini": "gemini_label", "title": "title_label_claude"}


@query("discovered_label_counts", f"""WITH {S.FX}, {S.FXL}
SELECT model, strftime(published_ts, '%Y-%m') AS month, raw_label, COUNT(*) AS n FROM fxl
WHERE published_ts IS NOT NULL AND raw_label IS NOT NULL GROUP BY ALL""")
def discovered_label_counts(spark, sf):
    """D1 + D3 decide what is read: the date column and one label column per model, found by name in a
    renamed file, give the monthly counts of raw labels."""
    file = fx_labels(spark, sf).withColumnsRenamed(_RENAMED)
    date, labels = resolve_date_column(file.columns), detect_label_columns(file.columns)
    rows = file.select(F.col(date).alias("published_ts"), *(F.col(f"`{c}`").alias(f"label_{m}") for m, c in labels.items()))
    long = unpivot_labels(rows, ["published_ts"], {f"label_{m}": m for m in labels})
    return (long.filter(F.col("published_ts").isNotNull() & F.col("raw_label").isNotNull())
                .groupBy("model", F.date_format("published_ts", "yyyy-MM").alias("month"), "raw_label").agg(F.count("*").alias("n")))


@query("ordered_label_table", f"""WITH {S.FX}, t AS (
  SELECT COALESCE({S.l4("leaning")}, 'none') AS label, strftime(published_ts, '%Y-%m') AS month, COUNT(*) AS n FROM fx
  WHERE published_ts IS NOT NULL GROUP BY ALL)
SELECT *, CAST(row_number() OVER (ORDER BY CASE label WHEN 'Left' THEN 0 WHEN 'Centre' THEN 1 WHEN 'Right' THEN 2 ELSE 3 END, label, month) AS BIGINT)
  AS position FROM t""")
def ordered_label_table(spark, sf):
    """O1 + O3: a final table in the fixed label order, then by month; the place of every row is written out."""
    fx = fx_labels(spark, sf).filter("published_ts IS NOT NULL")
    t = fx.groupBy(F.coalesce(norm_capitalize("leaning"), F.lit("none")).alias("label"),
                   F.date_format("published_ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return order_by_values(t, {"label": ["Left", "Centre", "Right"]}, "label", "month", position="position")


@query("restored_order", f"""WITH {S.FX}, {S.FXL}
SELECT art_id, model, raw_label, CAST(row_number() OVER (ORDER BY art_id, model) AS BIGINT) AS position FROM fxl""")
def restored_order(spark, sf):
    """Rows that were worked on in any order get their input order back as a global position."""
    rows = fx_long(spark, sf).select("art_id", "model", "raw_label").repartition("raw_label")
    return restore_order(rows, ["art_id", "model"], "position")


_ISO_FORMATS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S")
_ISO = f"""iso AS (SELECT CAST(art_id AS VARCHAR) AS art_id, title, CASE art_id % 5
    WHEN 0 THEN strftime(published_ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(published_ts, '%Y-%m-%d')
    WHEN 2 THEN strftime(published_ts, '%Y-%m-%dT%H:%M:%S') WHEN 3 THEN strftime(published_ts, '%Y-%m-%dT%H:%M:%S') || '+02:00'
    ELSE 'soon' END AS stamp FROM fx)"""
_ISO_COUNTS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {i} AS ordinal, COUNT(COALESCE({', '.join(f'CAST(try_strptime({c}, {f!r}) AS TIMESTAMP)' for f in _ISO_FORMATS)})) "
    f"AS n_parseable FROM iso" for i, c in enumerate(["art_id", "title", "stamp"]))


@query("date_column_probe_iso", f"{WITH}, {_ISO} {_ISO_COUNTS}")
def date_column_probe_iso(spark, sf):
    """D2 with all four formats: plain, date, ISO with and without an offset."""
    m, ts = F.col("art_id") % 5, F.col("published_ts")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    stamp = (F.when(m == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(m == 1, F.date_format(ts, "yyyy-MM-dd"))
              .when(m == 2, iso).when(m == 3, F.concat(iso, F.lit("+02:00"))).otherwise("soon"))
    fx = fx_labels(spark, sf).select(F.col("art_id").cast("string").alias("art_id"), "title", stamp.alias("stamp"))
    return parseable_counts(fx)
