"""Labelling with models that learn from the label table.

The stand-in labels are class names over the given columns: ``toxic = 1`` is Left, ``quality = 0``
Right, anything else Centre. Documents whose id's CRC-32 is divisible by ten are kept from every
fit; the other labelled ones teach.
"""

from __future__ import annotations

import os
import uuid
import warnings

from pyspark.sql import functions as F

from ..functions.labels import parse_reply
from ..operators import classify as K
from ..operators import clean as C
from ..operators import learned as M
from ..session import scratch_dir
from ..sources.files import write_table
from .fixtures import table
from .registry import query

CLASSES = ("Left", "Centre", "Right")
#: The least probability of a logistic label, and the least lead (in a millionth of a natural logarithm) of a Bayes label.
SURE, LEAD = 0.8, 2_000_000


def _tmp(spark, kind: str) -> str:
    return scratch_dir(spark, f"{kind}-{uuid.uuid4().hex}")


def _held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0


def labelled(spark, sf):
    """(doc_id, text, leaning) of the labelled documents."""
    leaning = F.when(F.col("toxic") == 1, "Left").when(F.col("quality") == 0, "Right").when(F.col("quality") == 1, "Centre")
    marks = table(spark, sf, "labels").select("doc_id", leaning.alias("leaning"))
    return table(spark, sf, "documents").select("doc_id", "text").join(marks, "doc_id")


def prefixes(text: str):
    """The first three letters of every word: what the backup model reads."""
    return F.transform(K.model_tokens(text), lambda t: F.substring(t, 1, 3))


def logistic(spark, sf) -> M.LogisticModel:
    rows = labelled(spark, sf).filter(~_held_out()).withColumn("tokens", K.model_tokens("text"))
    return M.fit_logistic(rows, "doc_id", "tokens", "leaning", CLASSES)


def bayes(spark, sf, tokens=K.model_tokens) -> M.BayesModel:
    rows = labelled(spark, sf).filter(~_held_out()).withColumn("tokens", tokens("text"))
    return M.fit_bayes(rows, "tokens", "leaning", CLASSES)


# --- SQL of the integer model -------------------------------------------------------------------
_WORDS = "regexp_extract_all(lower(COALESCE(text, '')), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')"
_PREFIXES = f"list_transform({_WORDS}, lambda t: t[1:3])"
#: The CRC-32 of a text in DuckDB: one table step per byte, the table by its rule.
_CRC = """crc_table(t, i, c) AS (
  SELECT 0, range, range FROM range(256)
  UNION ALL
  SELECT t + 1, i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_table WHERE t < 8),
crcs AS (SELECT list(c ORDER BY i) AS cs FROM crc_table WHERE t = 8),
held AS (
  SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
      lambda c, d: xor(c >> 8, cs[xor(c & 255, d) + 1])), 4294967295) % 10 = 0 AS held_out
  FROM (SELECT DISTINCT doc_id FROM documents) d, crcs)"""


def _bayes_sql(words: str, name: str = "") -> str:
    """Weights (token) and priors of the integer Bayes model over ``words``."""
    log = lambda x: f"CAST(round({M.UNITS} * ln({x})) AS BIGINT)"
    each = lambda f: "[" + ", ".join(f(i, c) for i, c in enumerate(CLASSES)) + "]"
    n = name
    return f"""train{n} AS (
  SELECT row_number() OVER () AS r, leaning, {words} AS ts FROM documents JOIN marks USING (doc_id) JOIN held USING (doc_id)
  WHERE NOT held_out AND leaning IS NOT NULL),
counts{n} AS (
  SELECT token, {each(lambda i, c: f"count(*) FILTER (leaning = '{c}')")} AS n
  FROM (SELECT r, leaning, unnest(ts) AS token FROM train{n}) GROUP BY token HAVING count(DISTINCT r) >= {M.MIN_TEXTS}),
totals{n} AS (SELECT count(*) AS v, {each(lambda i, c: f"COALESCE(sum(n[{i + 1}]), 0)")} AS n FROM counts{n}),
weights{n} AS (
  SELECT token, {each(lambda i, c: log(f"(c.n[{i + 1}] + {M.SMOOTHING}::DOUBLE) / (t.n[{i + 1}]::DOUBLE + {M.SMOOTHING}::DOUBLE * t.v)"))} AS w
  FROM counts{n} c, totals{n} t),
fixed{n} AS (
  SELECT {each(lambda i, c: log(f"(count(*) FILTER (leaning = '{c}') + 1) / CAST(count(*) + {len(CLASSES)} AS DOUBLE)"))} AS prior
  FROM train{n})"""


_MARKS = f"""{_CRC},
marks AS (
  SELECT doc_id, CASE WHEN toxic = 1 THEN 'Left' WHEN quality = 0 THEN 'Right' WHEN quality = 1 THEN 'Centre' END AS leaning FROM labels)"""
_NAMES = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"


def _sums_sql(words: str, name: str = "") -> str:
    """(doc_id, i, w): the weights of every token of every document, by place."""
    n = name
    return f"""each{n} AS (SELECT doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS i FROM (SELECT doc_id, {words} AS ts FROM documents)),
weighed{n} AS (SELECT doc_id, i, COALESCE(w, [0, 0, 0]) AS w FROM each{n} LEFT JOIN weights{n} USING (token))"""


def _total_sql(n: str = "") -> str:
    return "[" + ", ".join(f"any_value(prior[{i + 1}]) + sum(w[{i + 1}])" for i in range(len(CLASSES))) + "]"


_LABEL = f"{_NAMES}[list_position(s, list_max(s))]"
_LEAD = "list_max(s) - list_sort(s, 'DESC')[2]"
_BLANK = "NOT regexp_matches(COALESCE(text, ''), '\\S')"


# --- T3 -------------------------------------------------------------------------------------------
@query("classify_learned")
def classify_learned(spark, sf):
    """Every whole document labelled by the logistic model fitted on the label table."""
    return K.classify(table(spark, sf, "documents"), ["doc_id"], "text", logistic(spark, sf))


@query("classify_learned_holdout")
def classify_learned_holdout(spark, sf):
    """What the logistic model says of the labelled documents that it never saw: counts by true and told label."""
    rows = labelled(spark, sf).filter(_held_out() & F.col("leaning").isNotNull())
    return M.confusion(K.classify(rows, ["doc_id", "leaning"], "text", logistic(spark, sf)), "leaning", "label")


@query("classify_bayes", f"""WITH RECURSIVE {_MARKS}, {_bayes_sql(_WORDS)}, {_sums_sql(_WORDS)},
scores AS (SELECT doc_id, {_total_sql()} AS s FROM weighed, fixed GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN {_BLANK} THEN 'error' ELSE COALESCE({_LABEL}, {_NAMES}[list_position(prior, list_max(prior))]) END AS label
FROM documents d LEFT JOIN scores USING (doc_id), fixed""")
def classify_bayes(spark, sf):
    """T3 with the integer model: every labelled document counts, every document is scored whole."""
    return K.classify(table(spark, sf, "documents"), ["doc_id"], "text", bayes(spark, sf))


# --- T5 -------------------------------------------------------------------------------------------
@query("classify_windows_bayes", f"""WITH RECURSIVE {_MARKS}, {_bayes_sql(_WORDS)}, {_sums_sql(_WORDS)},
sizes AS (SELECT doc_id, max(i) AS n FROM each GROUP BY doc_id),
windows AS (SELECT doc_id, unnest(generate_series(0, CAST(ceil(greatest(n - 512, 0) / 256.0) AS BIGINT))) AS pos FROM sizes),
scores AS (
  SELECT doc_id, pos, {_total_sql()} AS s FROM windows JOIN weighed USING (doc_id), fixed
  WHERE i > pos * 256 AND i <= pos * 256 + 512 GROUP BY doc_id, pos),
votes AS (SELECT doc_id, {_LABEL} AS label, count(*) AS n_votes, min(pos) AS first_pos FROM scores GROUP BY ALL)
SELECT doc_id, COALESCE(label, 'error') AS label, COALESCE(n_votes, 0) AS n_votes
FROM documents LEFT JOIN (
  SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_votes DESC, first_pos) = 1) USING (doc_id)""")
def classify_windows_bayes(spark, sf):
    """T5: every 512-token window labelled by the integer model, written once, then the vote."""
    docs = table(spark, sf, "documents")
    return K.classify_windows(docs, "doc_id", K.model_tokens("text"), bayes(spark, sf), stage_path=_tmp(spark, "scored"))


@query("classify_windows_learned")
def classify_windows_learned(spark, sf):
    """T5 with the logistic model: a window that it is not sure of has no vote."""
    docs = table(spark, sf, "documents")
    model = logistic(spark, sf).asking(SURE)
    return K.classify_windows(docs, "doc_id", K.model_tokens("text"), model, stage_path=_tmp(spark, "scored"))


# --- T6 -------------------------------------------------------------------------------------------
@query("classify_fallback_bayes", f"""WITH RECURSIVE {_MARKS}, {_bayes_sql(_WORDS)}, {_sums_sql(_WORDS)},
{_bayes_sql(_PREFIXES, "_b")}, {_sums_sql(_PREFIXES, "_b")},
first AS (SELECT doc_id, {_total_sql()} AS s FROM weighed, fixed GROUP BY doc_id),
second AS (SELECT doc_id, {_total_sql()} AS s FROM weighed_b, fixed_b GROUP BY doc_id),
told AS (
  SELECT doc_id, (SELECT CASE WHEN {_LEAD} >= {LEAD} THEN {_LABEL} END FROM (SELECT first.s)) AS one,
    (SELECT CASE WHEN {_LEAD} >= {LEAD} THEN {_LABEL} END FROM (SELECT second.s)) AS two
  FROM first JOIN second USING (doc_id))
SELECT doc_id, CASE WHEN {_BLANK} THEN 'Unknown' ELSE replace(COALESCE(one, two, 'Unknown'), 'Centre', 'Center') END AS label,
  CASE WHEN one IS NOT NULL AND NOT {_BLANK} THEN 1 ELSE 2 END AS attempts
FROM documents LEFT JOIN told USING (doc_id)""")
def classify_fallback_bayes(spark, sf):
    """A model that may abstain, then a backup that reads word beginnings, then Unknown; the
    first answers are written once, before the backup sees what is left."""
    return K.label_with_replies(table(spark, sf, "documents"), ["doc_id"], "text", bayes(spark, sf).asking(LEAD),
                                bayes(spark, sf, prefixes).asking(LEAD), parse_reply, _tmp(spark, "replies"),
                                backup_tokens=prefixes)


# --- T7 -------------------------------------------------------------------------------------------
@query("classify_sources_learned")
def classify_sources_learned(spark, sf):
    """One file per language landed from ``documents``, a listed one missing; each that exists is
    labelled over its windows by the logistic model in one job."""
    base = _tmp(spark, "sources")
    write_table(table(spark, sf, "documents").select("doc_id", "text", "lang"), base, partition_by=["lang"])
    paths = {lang: os.path.join(base, f"lang={lang}") for lang in ("en", "fr", "de", "es")}
    paths["missing"] = os.path.join(base, "lang=none")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return K.classify_sources(spark, paths, "doc_id", "text", logistic(spark, sf))


# --- the whole labelling run ----------------------------------------------------------------------
def _archive(spark, sf):
    docs = C.max_tokens(table(spark, sf, "documents"), "text", 10000)
    return K.label_with_replies(docs, ["doc_id"], "text", logistic(spark, sf).asking(SURE),
                                bayes(spark, sf, prefixes).asking(LEAD), parse_reply, _tmp(spark, "replies"),
                                backup_tokens=prefixes)


@query("label_archive_learned")
def label_archive_learned(spark, sf):
    """Token limit (P10), logistic answers, their parsing (L5), a backup model for what has none, Unknown."""
    return _archive(spark, sf)
