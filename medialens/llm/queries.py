"""The queries opN_<name> over the given tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bagminhash, feistel, fst_tokens, lbl, licenses, linededup, merge_sql, negatives, periodic, repetition, treescore,
               wordtable, wumanber)

#: Keys the pseudonyms of this corpus. A production key comes from a secret store.
PSEUDONYM_KEY = b"medialens-pseudonyms"
TOKEN_LIMIT = 512


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document: doc_id, class_id, n_copies (rows of equal words)."""
    return bagminhash.classes(_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "class_id", "n_copies")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.measure(_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "quality.*")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without repeated lines, and how many were dropped."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return linededup.drop_repeated_lines(docs, dropped="n_dropped")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wumanber.find_passages(_table(spark, sf_dir, "documents", "doc_id", "text"),
                                   _table(spark, sf_dir, "benchmark", "item_id", "text"))
    hits, items = F.size("passages.places"), F.col("passages.items")
    return found.select("doc_id", "passages.n_words", hits.cast("bigint").alias("n_hit"),
                        F.size(items).cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return fst_tokens.count_tokens(docs, tokenizer("byte_bpe_50k.json")).select(
        "doc_id", "tokens.n_bytes", "tokens.n_tokens", (F.col("tokens.n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages", "page_id", "url", "html")
    return treescore.extract(pages).select("page_id", "url", F.col("main_text").alias("text"),
                                           F.length("main_text").cast("bigint").alias("n_chars"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return wordtable.digests(wordtable.encode_decode(docs, tokenizer("word_bpe_49k.json"), ["doc_id"]))


def not_held_out(doc_id: str = "doc_id") -> Column:
    """Nine of ten documents, by the CRC-32 of the id as text (null: the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 != 0


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score(_table(spark, sf_dir, "documents", "doc_id", "text"), not_held_out(), ["doc_id"])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return feistel.pseudonymise(docs, PSEUDONYM_KEY).select("doc_id", "private.*")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of the documents, taken as files <source>/<lang>/<doc_id>."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    files = docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return licenses.scan(files).select("doc_id", "path", "licence.*")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    coded = merge_sql.encode_decode(docs, tokenizer("byte_bpe_50k.tiktoken"))
    return coded.select("doc_id", "coded.n_tokens", F.sha2("coded.ids", 256).alias("ids_sha256"),
                        F.sha2("coded.decoded", 256).alias("decoded_sha256"))


def whole_vectors(rows: DataFrame) -> DataFrame:
    """Rows with finite vectors; components as floor(256 * x), every seventh id under the next of ten labels."""
    label = F.col("label").cast("bigint")
    return rows.filter(negatives.finite("embedding")).select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vector"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_vectors(_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return negatives.mine(rows, 50, "vec_id")


def with_periods(docs: DataFrame) -> DataFrame:
    """Texts as the contract of operator 13 has them: those whose id's CRC-32 ends in 0 repeat a part of themselves."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    # (words before the part, its length) from the word count n: a = g % n, p = 1 + floor((n - a) / (3 + g % 8))
    g, n = F.col("g"), F.size("words")
    rest = n - F.col("a")
    part = F.slice("words", F.col("a") + 1, F.col("p"))
    again = F.slice(F.flatten(F.array_repeat(part, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    told = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    told = told.withColumn("words", F.when(n > 0, F.col("words")))
    told = told.withColumn("a", (g % n).cast("int")).withColumn("p", (1 + F.floor(rest / (3 + g % 8))).cast("int"))
    return told.select("doc_id", F.when(F.col("words").isNull(), F.col("text")).otherwise(
        F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), again), " ")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_periods(_table(spark, sf_dir, "documents", "doc_id", "text"))
    found = periodic.periodic_runs(docs).select("doc_id", "periodic.*")
    # the greatest length, then the smallest start, then the smallest period
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"),
                                                             (-r["period"]).alias("short"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[f].cast("string") for f in ("start", "length", "period"))))
    found = found.withColumn("top", top)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("top.back")).alias("start"),
        F.col("top.length").alias("length"), (-F.col("top.short")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.short")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_minhash_dedup, op2_quality_rules, op3_line_dedup, op4_decontamination, op5_token_counts, op6_html_text,
    op7_bpe_round_trip, op8_lm_score, op9_pii, op10_license_scan, op11_byte_bpe, op12_hard_negatives,
    op13_periodic_runs)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_SHINGLES_SQL = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, array_to_string({_WORDS}, ' ') AS body, {_WORDS} AS ws FROM documents),
texts AS (SELECT body, any_value(ws) AS ws, min(doc_id) AS node, count(*) AS n_copies FROM docs WHERE body != '' GROUP BY body),
windows AS (
  SELECT node, array_to_string(ws[i:i + 4], ' ') AS s FROM texts, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i)),
bags AS (SELECT node, s, count(*) AS n FROM windows GROUP BY ALL),
sizes AS (SELECT node, sum(n) AS n FROM bags GROUP BY node),
shared AS (
  SELECT x.node AS a, y.node AS b, sum(least(x.n, y.n)) AS n FROM bags x JOIN bags y ON x.s = y.s AND x.node < y.node GROUP BY ALL),
links AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.node = s.a JOIN sizes y ON y.node = s.b WHERE 5 * s.n >= 4 * (x.n + y.n - s.n)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT node, node AS root FROM texts
  UNION
  SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(r.root, d.doc_id) AS class_id, coalesce(t.n_copies, 1) AS n_copies
FROM docs d LEFT JOIN texts t ON t.body = d.body LEFT JOIN roots r ON r.node = t.node"""


def _repeats_sql(n: int) -> str:
    return rf"""
r{n} AS (
  SELECT w.r, count(*) AS words, sum(length(w.w)) AS chars FROM words w JOIN (
    SELECT DISTINCT r, i + o AS i FROM (
      SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(ws[i:i + {n - 1}], ' ')) AS c
      FROM docs, unnest(range(1, len(ws) - {n} + 2)) AS t(i)), unnest(range({n})) AS u(o) WHERE c > 1) c
  ON c.r = w.r AND c.i = w.i GROUP BY w.r)"""


_LIMITS = repetition.WINDOW_LIMITS
_QUALITY_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs),
sums AS (SELECT r, sum(length(w)) AS chars FROM words GROUP BY r),
lines AS (
  SELECT r, length(line) AS n, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again FROM (
    SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT r, string_split(text, chr(10)) AS ls FROM docs))
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
line_sums AS (
  SELECT r, count(*) FILTER (again) AS dup, sum(n) AS chars, coalesce(sum(n) FILTER (again), 0) AS dup_chars FROM lines GROUP BY r),
{",".join(_repeats_sql(n) for n in _LIMITS)},
figures AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(s.chars, 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines,
    coalesce(r5.words, 0) AS n_repeat_words, coalesce(l.chars, 0) AS line_chars, coalesce(l.dup_chars, 0) AS dup_line_chars,
    {", ".join(f"coalesce(r{n}.chars, 0) AS repeat_chars_{n}" for n in _LIMITS)}
  FROM docs LEFT JOIN sums s USING (r) LEFT JOIN line_sums l USING (r)
    {" ".join(f"LEFT JOIN r{n} USING (r)" for n in _LIMITS)})
SELECT *, n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.REPEAT_LIMIT} * n_words AS base_failed,
  NOT (n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.REPEAT_LIMIT} * n_words
    OR 100 * n_symbols > {repetition.SYMBOL_LIMIT} * word_chars OR 100 * dup_line_chars > {repetition.LINE_LIMIT} * line_chars
    OR {" OR ".join(f"100 * repeat_chars_{n} > {p} * word_chars" for n, p in _LIMITS.items())}) AS kept
FROM figures"""


def _plain_words_sql(text: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_PASSAGES_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_plain_words_sql("text")} AS ws FROM documents),
items AS (SELECT item_id, {_plain_words_sql("text")} AS ws FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, least({wumanber.WINDOW}, len(ws)) AS n, array_to_string(ws[i:i + least({wumanber.WINDOW}, len(ws)) - 1], ' ') AS p
  FROM items, unnest(range(1, len(ws) - least({wumanber.WINDOW}, len(ws)) + 2)) AS t(i) WHERE len(ws) > 0),
hits AS (
  SELECT d.r, d.i, d.n, p.item_id FROM (
    SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS p
    FROM docs, (SELECT DISTINCT n FROM patterns) AS l, unnest(range(1, len(ws) - n + 2)) AS t(i)) d
  JOIN patterns p ON p.n = d.n AND p.p = d.p),
words AS (SELECT r, count(DISTINCT i + o) AS n_hit FROM hits, unnest(range(n)) AS t(o) GROUP BY r),
found AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (
    SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)"""

_NEGATIVES_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.ar, p.r ORDER BY n.score DESC, n.vec_id, n.r) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.ar = p.ar AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3"""

ORACLE_SQL = {"op1_minhash_dedup": _SHINGLES_SQL, "op2_quality_rules": _QUALITY_SQL, "op4_decontamination": _PASSAGES_SQL,
              "op12_hard_negatives": _NEGATIVES_SQL}
