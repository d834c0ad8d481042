"""Token windows, majority vote, token cleaning and n-gram top-k.

All array work stays inside Spark's native higher-order functions (sequence / slice /
transform / filter), so it is whole-stage generated and vectorised by the JVM; no
Python worker is involved.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WORD2, word2_tokens, word_tokens
from ..session import scratch_dir
from . import dictionary


def token_windows(df: DataFrame, key: str, tokens: Column, size: int = 512, stride: int = 256,
                  with_tokens: bool = False, keep_empty: bool = False, n_tokens: Column | None = None) -> DataFrame:
    """Windows start at 0, stride, 2*stride, ... and stop once a window reaches the end.

    Count = 1 if 0 < n <= size else ceil((n - size) / stride) + 1; an empty text has none.
    Output (key, pos, start, end[, window]) with end exclusive. ``keep_empty`` gives an
    empty text one placeholder row with pos = -1 (so a later vote can see it).
    """
    keys = [key] if isinstance(key, str) else list(key)
    if n_tokens is not None and not with_tokens:  # bounds only: count, do not materialise
        d = df.select(*keys, F.lit(None).alias("_tok"), n_tokens.alias("_n"))
    else:
        d = df.select(*keys, tokens.alias("_tok")).withColumn("_n", F.size("_tok"))
    last = F.ceil(F.greatest(F.col("_n") - size, F.lit(0)) / F.lit(stride)).cast("int")
    if keep_empty:
        seq = F.when(F.col("_n") > 0, F.sequence(F.lit(0), last)).otherwise(F.array(F.lit(-1)))
        d = d.select(*keys, "_tok", "_n", F.posexplode(seq).alias("pos", "_i"))
        d = d.withColumn("pos", F.when(F.col("_i") < 0, F.lit(-1)).otherwise(F.col("pos")))
    else:  # empty start list rather than a row filter (see ngrams)
        seq = F.when(F.col("_n") > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        d = d.select(*keys, "_tok", "_n", F.posexplode(seq).alias("pos", "_i"))
    start = F.col("_i") * stride
    cols = [*keys, "pos", start.alias("start"), F.least(start + size, F.col("_n")).alias("end")]
    if with_tokens:
        cols.append(F.slice("_tok", start + 1, size).alias("window"))
    return d.select(*cols)


def majority_vote(df: DataFrame, key: str, label: str, pos: str, ignore: Sequence[str] = ("error", "unknown"),
                  none_label: str = "error", fail_label: str | None = None) -> DataFrame:
    """T4: most common label per key; ties go to the label seen first; ignored labels never
    win; a key with only ignored labels gets ``none_label``. With ``fail_label``, a key
    having any row with that label gets ``none_label`` (article-scope errors).

    One aggregate to (key, label, n, first_pos) - partial aggregation keeps a hot key cheap -
    then ``row_number() = 1`` over the aggregated rows (WindowGroupLimit).
    """
    keys = [key] if isinstance(key, str) else list(key)
    ign = F.col(label).isin(list(ignore)) | F.col(label).isNull()
    g = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n_votes"), F.min(pos).alias("_first"),
                                   F.max(ign).alias("_ign"))
    order = [F.col("_ign").asc(), F.col("n_votes").desc(), F.col("_first").asc()]
    bad = F.col("_ign")
    if fail_label is not None:
        g = g.withColumn("_fail", F.max(F.col(label) == fail_label).over(Window.partitionBy(*keys)))
        bad = bad | F.coalesce(F.col("_fail"), F.lit(False))
    w = Window.partitionBy(*keys).orderBy(*order)
    top = g.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
    return top.select(*keys, F.when(bad, F.lit(none_label)).otherwise(F.col(label)).alias("label"),
                      F.when(bad, F.lit(0)).otherwise(F.col("n_votes")).cast("long").alias("n_votes"))


#: What a clitic adds to a word: ``n't`` at its end, or everything from its first apostrophe on.
#: Both begin with a plain character, so most places are passed at a glance.
CLITIC = (r"n(?<=\p{L}n)['’]t(?!['’]?[\p{L}\p{N}_])"
          r"|['’](?<=[\p{L}\p{N}_]['’])[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)*")


def alphabetic_tokens(text: Column) -> Column:
    """Lower-cased all-letter words in text order: ``covid19`` has none, ``don't`` gives ``do``.

    Clitics go first, where a text has an apostrophe at all; the rest is split at non-word runs,
    and words with a digit or underscore go.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    bare = F.when(low.contains("'") | low.contains("’"), F.regexp_replace(low, CLITIC, "")).otherwise(low)
    return F.filter(F.split(bare, r"[^\p{L}\p{N}_]+"), lambda t: t.rlike(r"^\p{L}+$"))


def clean_tokens(text: Column, stopwords: Sequence[str] = (), lemmas: dict[str, str] | None = None,
                 custom_stopwords: Sequence[str] = ()) -> Column:
    """T8 for small lists: alphabetic tokens, lower-cased; drop stopwords (on the token),
    map to lemmas (identity if absent), drop custom stopwords (on the lemma). Position
    order is kept; all of it is one expression (no explode, no shuffle)."""
    toks = alphabetic_tokens(text)
    if stopwords:
        toks = F.filter(toks, lambda t: ~t.isin(list(stopwords)))
    if lemmas:
        m = F.create_map(*[F.lit(x) for kv in lemmas.items() for x in kv])
        toks = F.transform(toks, lambda t: F.coalesce(F.element_at(m, t), t))
    if custom_stopwords:
        toks = F.filter(toks, lambda t: ~t.isin(list(custom_stopwords)))
    return toks


def clean_tokens_dictionary(df: DataFrame, text: str, lemma_table: DataFrame, stopwords: Sequence[str] = (),
                            custom_stopwords: Sequence[str] = (), out: str = "tokens", part_bytes: int | None = None) -> DataFrame:
    """T8 for a large lemma table (token, lemma): ``df`` with the array column ``out``.

    The distinct tokens meet the table once (:func:`dictionary.lookup`); texts are not shuffled.
    Rows equal those of :func:`clean_tokens` with the same lemmas; a text without any token left
    has an empty list.
    """
    toks = alphabetic_tokens(F.col(text))
    if stopwords:
        toks = F.filter(toks, lambda t: ~t.isin(list(stopwords)))
    changed = lemma_table.select("token", "lemma").filter(F.col("lemma") != F.col("token"))
    df = dictionary.lookup(df.withColumn("_tokens", toks), "_tokens", changed, "token", "lemma", "_lemmas",
                           part_bytes or dictionary.PART_BYTES)
    toks = F.zip_with("_tokens", "_lemmas", lambda t, lemma: F.coalesce(lemma, t))
    if custom_stopwords:
        toks = F.filter(toks, lambda t: ~t.isin(list(custom_stopwords)))
    return df.withColumn(out, toks).drop("_tokens", "_lemmas")


def ngrams(df: DataFrame, key: str, text: Column, n: int, stopwords: Sequence[str] = (),
           pattern: str = WORD2, carry: Sequence[str] = ()) -> DataFrame:
    """Exploded n-grams (key, pos, gram) of the lower-cased text; n-grams never cross texts;
    an n-gram containing a stopword is dropped (its neighbours are not joined across it)."""
    d = _gram_parts(df, key, text, n, stopwords, pattern, carry)
    return d.select(key, *carry, "pos", F.concat_ws(" ", *_parts(n)).alias("gram"))


def _parts(n: int) -> list[str]:
    return [f"_p{j}" for j in range(n)]


def _gram_parts(df: DataFrame, key: str, text: Column, n: int, stopwords: Sequence[str], pattern: str,
                carry: Sequence[str]) -> DataFrame:
    """(key, carry, pos, one column per word) of every n-gram. The words are read by index (no
    array slice, no string built); stopwords are looked up once per word and become null."""
    carry = list(carry)
    tok = word2_tokens(F.lower(text)) if pattern == WORD2 else word_tokens(F.lower(text), pattern)
    if stopwords:
        tok = F.transform(tok, lambda t: F.when(~t.isin(list(stopwords)), t))
    d = df.select(key, *carry, tok.alias("_tok"))
    # an empty start list (not a row filter) for texts shorter than n: a filter here would be
    # pushed below the projection and tokenise every text a second time
    starts = F.when(F.size("_tok") >= n, F.sequence(F.lit(1), F.size("_tok") - n + 1)) \
              .otherwise(F.array().cast("array<int>"))
    d = d.select(key, *carry, "_tok", F.explode(starts).alias("_i"))
    parts = [F.element_at("_tok", F.col("_i") + j) for j in range(n)]
    d = d.select(key, *carry, (F.col("_i") - 1).alias("pos"), *(p.alias(c) for p, c in zip(parts, _parts(n))))
    return d.na.drop(subset=_parts(n)) if stopwords else d


#: Buckets of a group in the count sketch (a task sends a row per group and bucket at most), and the share
#: of the texts (one in so many) that proposes candidates.
SKETCH_BUCKETS = 1 << 18
CANDIDATE_SHARE = 32


def ngram_topk(df: DataFrame, key: str, text: Column, n: int, k: int = 10,
               stopwords: Sequence[str] = (), pattern: str = WORD2, by: Sequence[str] = (),
               prune: bool = True, buckets: int = SKETCH_BUCKETS, share: int = CANDIDATE_SHARE) -> DataFrame:
    """Total count of every n-gram over the corpus (or per ``by`` group), top k by
    count, ties to the n-gram seen first (smallest (key, position)). Keys of any sortable type.

    Exact, without shuffling every distinct n-gram:

    1. a share of the texts, chosen by the key's hash, proposes each group's likely first n-grams;
    2. one pass counts all n-grams into hash buckets (integers, merged in every task first) and
       the proposed ones exactly. The k-th largest exact count bounds the k-th place of its group
       from below, and an n-gram never occurs more often than its bucket counts;
    3. only n-grams of buckets that reach their group's bound are counted by name.

    With ``prune=False`` all n-grams are counted by name at once: one pass, and a shuffle that follows
    the distinct n-grams. That is the better plan where they are few, as single words are.

    Poor proposals or a small sketch weaken the pruning, never the result: a group without k
    proposals has no bound. Proposals, sketch and cells are written to the shared folder and read where
    they are needed, so the texts are read three times (the first time a share of them); every join
    is on one integer, with a row per proposal, bucket or group.
    """
    by, parts = list(by), _parts(n)
    spark = df.sparkSession

    def written(rows: DataFrame, name: str) -> DataFrame:
        path = scratch_dir(spark, f"ngrams-{name}-{uuid.uuid4().hex}")
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    def grams(rows: DataFrame) -> DataFrame:
        d = _gram_parts(rows, key, text, n, stopwords, pattern, [c for c in by if c != key])
        d = d.withColumn("_hash", F.xxhash64(*by, *parts)).withColumn("_group", F.xxhash64(*by) if by else F.lit(0).cast("bigint"))
        # a bucket of one group; where two fall together, the counts only get larger
        return d.withColumn("_cell", F.xxhash64("_group", F.pmod("_hash", F.lit(buckets))))

    def first_rows(counted: DataFrame, limit: int, order: Sequence[Column | str]) -> DataFrame:
        if not by:
            return counted.orderBy(*order).limit(limit)
        w = Window.partitionBy(*by).orderBy(*order)
        return counted.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= limit).drop("_rk")

    def pruned() -> DataFrame:
        proposed = grams(df.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(share)) == 0)).groupBy(*by, "_group", "_hash", *parts).count()
        proposed = written(first_rows(proposed, 2 * k, [F.col("count").desc(), *parts]).drop("count"), "proposed")
        # the hash finds a proposal, group and words decide; its count is kept apart from the rest of its bucket
        agree = functools.reduce(lambda a, c: a & F.col(f"g.{c}").eqNullSafe(F.col(f"p.{c}")), [*by, *parts], F.lit(True))
        held = grams(df).alias("g").join(proposed.alias("p"), (F.col("g._hash") == F.col("p._hash")) & F.when(agree, F.lit(True)), "left")
        sketch = held.groupBy(F.col("g._cell").alias("_cell"), F.col("g._group").alias("_group"), F.col("p._hash").alias("_named"))
        sketch = written(sketch.agg(F.count(F.lit(1)).alias("_n")), "sketch")
        bound = sketch.filter("_named IS NOT NULL").groupBy("_group").agg(F.sort_array(F.collect_list("_n"), False).alias("_exact"))
        bound = bound.select("_group", F.coalesce(F.get("_exact", F.lit(k - 1)), F.lit(0)).alias("_bound"))
        cells = sketch.groupBy("_cell").agg(F.sum("_n").alias("_most"), F.collect_set("_group").alias("_groups"))
        reach = cells.select("_cell", "_most", F.explode("_groups").alias("_group")).join(bound, "_group", "left")
        # written, so that its size is known where the join is planned
        reach = written(reach.filter(F.col("_most") >= F.coalesce("_bound", F.lit(0))).select("_cell").distinct(), "reach")
        return grams(df).join(reach, "_cell", "left_semi")

    left = pruned() if prune else grams(df)
    # plain columns for the first place, text by text: both aggregates keep fixed-width buffers
    agg = left.groupBy(*by, *parts, F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.min("pos").alias("_pos"))
    agg = agg.groupBy(*by, *parts).agg(F.sum("_n").alias("n"), F.min("_key").alias("_first"), F.min_by("_pos", "_key").alias("_pos"))
    top = first_rows(agg, k, [F.col("n").desc(), F.col("_first").asc(), F.col("_pos").asc()])
    return top.select(*by, F.concat_ws(" ", *parts).alias("gram"), "n")
