"""Text queries: keywords, token limits, windows, prompts, votes, cleaning, n-grams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import build_prompt as prompt_fn, token_count, word_tokens
from ..operators import clean as C
from ..operators import textops as X
from . import sqlfx as S
from .fixtures import fx_labels, table
from .registry import query

# The reference's custom n-gram stopwords (BBC list) and classification
# prompt; the fixture's topic keywords (FIXTURES.md) and a small English stop/lemma list.
NGRAM_STOPWORDS = [
    "say", "gmt", "bst", "report", "update", "day", "state", "year", "old",
    "new", "latest", "live", "breaking", "include", "tell", "video", "play", "javascript", "browser",
    "enable", "need", "watch", "bbc", "news", "subscribe", "cookie", "cookies", "app",
]
ENGLISH_STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it",
                     "of", "on", "or", "that", "the", "this", "to", "was", "with"]
LEMMAS = {"ing": "ing", "ed": "ed", "were": "be", "been": "be", "has": "have", "had": "have",
          "does": "do", "did": "do", "children": "child", "men": "man", "women": "woman"}
TOPICS = {"A": ["war", "the"], "B": ["aux", "que", "sch"]}
PROMPT = ("Which way does this article lean? Answer with a single label (Left, Centre or Right) and nothing else."
          "\n---\n{text}\n---\nLabel:")

#: More places than a text of the given tables has: the SQL orders first places as one number.
_PLACES = 1 << 24
TOK_SQL = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]"
W2_SQL = "[\\p{L}\\p{N}_]{2,}"


def _sql_list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


# --- P9 ----------------------------------------------------------------------------------
@query("keyword_topics", """SELECT doc_id, topic FROM (
  SELECT doc_id, 'A' AS topic FROM documents WHERE regexp_matches(text, '(?i)war|the')
  UNION ALL SELECT doc_id, 'B' FROM documents WHERE regexp_matches(text, '(?i)aux|que|sch')) t""")
def keyword_topics(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return C.keyword_topics(d, F.col("text"), TOPICS).select("doc_id", "topic")


#: Datelines of the stand-in articles, by the remainder of the customer's number.
DATELINES = ["Kyiv", "Gaza City", "London", "Moscow, near the WEST BANK", "Paris", None, "Tel Aviv, Israel", "New York"]


@query("keyword_topics_conflicts", f"""WITH {S.FX}, t AS (SELECT art_id, COALESCE(CASE o_custkey % {len(DATELINES)}
    {" ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DATELINES) if d)} END, '') || ' ' || COALESCE(title, '') AS txt
  FROM fx JOIN orders ON o_orderkey = art_id)
SELECT art_id, topic FROM (
  SELECT art_id, 'RU' AS topic FROM t WHERE regexp_matches(txt, '(?i)ukraine|russia|putin|zelensky|donbas|kyiv|moscow')
  UNION ALL SELECT art_id, 'IP' FROM t
  WHERE regexp_matches(txt, '(?i)israel|palestine|gaza|hamas|idf|west bank|netanyahu')) x""")
def keyword_topics_conflicts(spark, sf):
    """P4 + P9 with the conflict keyword lists: (dateline, title) composed with a space,
    an article may land in both topics, one, or none."""
    from ..functions.text import compose_text
    line = F.get(F.array(*map(F.lit, DATELINES)), F.col("o_custkey") % len(DATELINES))
    d = fx_labels(spark, sf, carry=["o_custkey"]).withColumn("dateline", line)
    d = d.select("art_id", compose_text("dateline", "title").alias("txt"))
    return C.keyword_topics(d, F.col("txt"), C.CONFLICT_KEYWORDS).select("art_id", "topic")


# --- P10 / P11 / T2 -------------------------------------------------------------------------
@query("max_tokens", f"""SELECT doc_id, n_tokens FROM (SELECT doc_id,
  len(regexp_extract_all(COALESCE(text, ''), '{TOK_SQL}')) AS n_tokens FROM documents) t WHERE n_tokens <= 500""")
def max_tokens(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return C.max_tokens(d, "text", 500, out="n_tokens").select("doc_id", "n_tokens")


@query("truncate_tokens", f"""SELECT doc_id, len(tok) AS n_tokens, array_to_string(tok[1:512], ' ') AS truncated
FROM (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '{TOK_SQL}') AS tok FROM documents) t""")
def truncate_tokens(spark, sf):
    """The model input cut to its first 512 tokens (truncation is the operator); the whole
    text is tokenised and its full length reported next to it (T2 windows cover all of it)."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return C.truncate_tokens(d, "text", 512, count_out="n_tokens").select("doc_id", "n_tokens", "truncated")


@query("token_windows", f"""WITH t AS (SELECT doc_id, len(regexp_extract_all(COALESCE(text, ''), '{TOK_SQL}')) AS n FROM documents),
w AS (SELECT doc_id, n, unnest(generate_series(0, CAST(ceil(greatest(n - 512, 0) / 256.0) AS BIGINT))) AS pos FROM t WHERE n > 0)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(pos * 256 AS INTEGER) AS start, CAST(least(pos * 256 + 512, n) AS INTEGER) AS "end" FROM w""")
def token_windows(spark, sf):
    d = table(spark, sf, "documents")
    return X.token_windows(d, "doc_id", word_tokens("text"), 512, 256, n_tokens=token_count("text"))


# --- T1 -------------------------------------------------------------------------------------
def _prompt_sql() -> str:
    head, _, tail = PROMPT.partition("{text}")
    q = lambda s: "'" + s.replace("'", "''") + "'"
    body = "regexp_replace(translate(COALESCE(text, ''), chr(10) || chr(13), '  '), '^\\s+|\\s+$', '', 'g')"
    return f"SELECT doc_id, {q(head)} || {body} || {q(tail)} AS prompt FROM documents"


@query("build_prompt", _prompt_sql())
def build_prompt(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", prompt_fn("text", PROMPT).alias("prompt"))


# --- T4 -------------------------------------------------------------------------------------
@query("majority_vote", """WITH g AS (SELECT conv_id, role, COUNT(*) AS n_votes, MIN(turn) AS first_turn,
  bool_or(role IS NULL OR role IN ('system')) AS ign FROM conversations GROUP BY conv_id, role)
SELECT conv_id, CASE WHEN ign THEN 'error' ELSE role END AS label, CAST(CASE WHEN ign THEN 0 ELSE n_votes END AS BIGINT) AS n_votes
FROM g QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY ign ASC, n_votes DESC, first_turn ASC) = 1""")
def majority_vote(spark, sf):
    c = table(spark, sf, "conversations")
    return X.majority_vote(c, "conv_id", "role", "turn", ignore=["system"])


# --- T8 -------------------------------------------------------------------------------------
def _cleaned_expr() -> str:
    lem = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEMMAS.items())
    # word runs with their clitics; the clitics off; all-letter words stay
    runs = "regexp_extract_all(lower(COALESCE(text, '')), '[\\p{L}\\p{N}_]+(?:[''’][\\p{L}\\p{N}_]+)*')"
    bare = f"list_transform({runs}, lambda t: regexp_replace(regexp_replace(t, '(\\p{{L}})n[''’]t$', '\\1'), '[''’].*$', ''))"
    toks = f"list_filter({bare}, lambda t: regexp_full_match(t, '\\p{{L}}+'))"
    s1 = f"list_filter({toks}, lambda t: NOT list_contains({_sql_list(ENGLISH_STOPWORDS)}, t))"
    s2 = f"list_transform({s1}, lambda t: CASE t {lem} ELSE t END)"
    s3 = f"list_filter({s2}, lambda t: NOT list_contains({_sql_list(NGRAM_STOPWORDS)}, t))"
    return f"array_to_string({s3}, ' ')"


def _clean_sql() -> str:
    return f"SELECT doc_id, {_cleaned_expr()} AS cleaned FROM documents"


@query("clean_tokens", _clean_sql())
def clean_tokens(spark, sf):
    d = table(spark, sf, "documents")
    toks = X.clean_tokens(F.col("text"), ENGLISH_STOPWORDS, LEMMAS, NGRAM_STOPWORDS)
    return d.select("doc_id", F.array_join(toks, " ").alias("cleaned"))


# A full-form lexicon (token, lemma) as a lemmatiser's tables hold it, from the words of other tables:
# its size grows with them.
_ENDINGS = ("ing", "tion", "ed", "er")
_LEXICON_SQL = f"""lexicon AS (
  SELECT token, left(token, CAST(length(token) - CASE {" ".join(f"WHEN token LIKE '%{e}' THEN {len(e)}" for e in _ENDINGS)} END AS INTEGER)) AS lemma
  FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS token FROM (
    SELECT text FROM conversations UNION ALL SELECT text FROM benchmark))
  WHERE length(token) > 5 AND ({" OR ".join(f"token LIKE '%{e}'" for e in _ENDINGS)}))"""


def lexicon(spark, sf):
    texts = table(spark, sf, "conversations").select("text").unionByName(table(spark, sf, "benchmark").select("text"))
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("token")).distinct()
    cut = F.coalesce(*(F.when(F.col("token").endswith(e), F.lit(len(e))) for e in _ENDINGS))
    words = words.filter((F.length("token") > 5) & cut.isNotNull())
    return words.withColumn("_cut", cut).select("token", F.expr("left(token, length(token) - _cut)").alias("lemma"))


def _lexicon_cleaned_sql() -> str:
    runs = "regexp_extract_all(lower(COALESCE(text, '')), '[\\p{L}\\p{N}_]+(?:[''’][\\p{L}\\p{N}_]+)*')"
    bare = f"list_transform({runs}, lambda t: regexp_replace(regexp_replace(t, '(\\p{{L}})n[''’]t$', '\\1'), '[''’].*$', ''))"
    toks = f"list_filter({bare}, lambda t: regexp_full_match(t, '\\p{{L}}+') AND NOT list_contains({_sql_list(ENGLISH_STOPWORDS)}, t))"
    return f"""WITH {_LEXICON_SQL},
toks AS (SELECT doc_id, {toks} AS ts FROM documents),
each AS (SELECT doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS i FROM toks),
mapped AS (SELECT doc_id, i, COALESCE(lemma, token) AS lemma FROM each LEFT JOIN lexicon USING (token)),
kept AS (SELECT doc_id, string_agg(lemma, ' ' ORDER BY i) AS cleaned FROM mapped
  WHERE NOT list_contains({_sql_list(NGRAM_STOPWORDS)}, lemma) GROUP BY doc_id)
SELECT doc_id, COALESCE(cleaned, '') AS cleaned FROM documents LEFT JOIN kept USING (doc_id)"""


@query("clean_tokens_lexicon", _lexicon_cleaned_sql())
def clean_tokens_lexicon(spark, sf):
    """T8 with a lemma table that grows: distinct tokens meet the lexicon, texts stay in place."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    toks = X.clean_tokens_dictionary(d, "text", lexicon(spark, sf), ENGLISH_STOPWORDS, NGRAM_STOPWORDS)
    return toks.select("doc_id", F.array_join("tokens", " ").alias("cleaned"))


# --- A23 -----------------------------------------------------------------------------------------
def _ngram_sql(n: int, lang: str | None, k: int = 10, text: str = "text") -> str:
    """Top k per language over the whole table (lang=None), or the top k of one language."""
    where = f"WHERE lang = '{lang}'" if lang else ""
    grp = "" if lang else "lang, "
    tail = (f"ORDER BY n DESC, MIN(doc_id * {_PLACES} + i - 1) ASC LIMIT {k}" if lang else
            f"QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, MIN(doc_id * {_PLACES} + i - 1) ASC) <= {k}")
    return f"""WITH t AS (SELECT doc_id, lang, regexp_extract_all(lower({text}), '{W2_SQL}') AS tok FROM documents {where}),
s AS (SELECT doc_id, lang, tok, unnest(generate_series(1, len(tok) - {n} + 1)) AS i FROM t WHERE len(tok) >= {n}),
g AS (SELECT doc_id, lang, i, tok[i:i + {n - 1}] AS parts FROM s)
SELECT {grp}array_to_string(parts, ' ') AS gram, COUNT(*) AS n FROM g
WHERE NOT list_has_any(parts, {_sql_list(NGRAM_STOPWORDS)})
GROUP BY {grp}array_to_string(parts, ' ')
{tail}"""


def _ngram_query(name: str, n: int, lang: str | None):
    @query(name, _ngram_sql(n, lang))
    def q(spark, sf):
        d = table(spark, sf, "documents")
        if lang:
            d = d.filter(F.col("lang") == lang)
            return X.ngram_topk(d, "doc_id", F.col("text"), n, 10, NGRAM_STOPWORDS, prune=n > 1)
        return X.ngram_topk(d, "doc_id", F.col("text"), n, 10, NGRAM_STOPWORDS, by=["lang"], prune=n > 1)
    q.__name__ = name
    return q


# whole table, top 10 per language; plus one single-language report
_ngram_query("ngram_top1", 1, None)
_ngram_query("ngram_top2", 2, None)
_ngram_query("ngram_top3", 3, None)
_ngram_query("ngram_top2_fr", 2, "fr")


@query("ngram_top3_cleaned", _ngram_sql(3, None, text=_cleaned_expr()))
def ngram_top3_cleaned(spark, sf):
    """The whole n-gram flow: T8 token cleaning (stopwords, lemmas, custom stopwords), then
    A23 trigram top 10 per language over the cleaned texts."""
    d = table(spark, sf, "documents")
    cleaned = F.array_join(X.clean_tokens(F.col("text"), ENGLISH_STOPWORDS, LEMMAS, NGRAM_STOPWORDS), " ")
    return X.ngram_topk(d, "doc_id", cleaned, 3, 10, NGRAM_STOPWORDS, by=["lang"])


