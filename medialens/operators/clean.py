"""Projection, cleaning and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.periods import PERIOD_NAMES, parse_ts, period_strict
from ..functions.text import token_count, word_tokens, ws_trim


def select_columns(df: DataFrame, cols: Sequence[str], tolerant: bool = False) -> DataFrame:
    """keep/reorder; ``tolerant`` keeps only the columns that exist."""
    if tolerant:
        cols = [c for c in cols if c in df.columns]
    return df.select(*cols)


def canonicalise(df: DataFrame, mapping: dict[str, str], tags: dict[str, object] | None = None) -> DataFrame:
    """P2 + P3: rename to the canonical article schema and add constant tag columns."""
    out = df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})
    if tags:
        out = out.withColumns({k: (v if isinstance(v, Column) else F.lit(v)) for k, v in tags.items()})
    return out


def require_columns(df: DataFrame, cols: Sequence[str], on_missing: str = "raise") -> bool:
    """Driver-side schema check; returns False (skip) or raises on a missing column."""
    missing = [c for c in cols if c not in df.columns]
    if missing and on_missing == "raise":
        raise ValueError(f"missing required columns: {missing}")
    return not missing


def require_non_null(df: DataFrame, col: str) -> None:
    """P12 (all-null form): one global count of non-null values."""
    if df.select(F.count(col)).first()[0] == 0:
        raise ValueError(f"column {col} is entirely null")


def parse_dates(df: DataFrame, col: str, out: str, formats: Sequence[str] | None = None,
                on_error: str = "null") -> DataFrame:
    """P5: text -> timestamp; bad value -> null, or raise when ``on_error='raise'``."""
    res = df.withColumn(out, parse_ts(col, list(formats) if formats else None))
    if on_error == "raise":
        bad = res.filter(F.col(col).isNotNull() & F.col(out).isNull()).limit(1).count()
        if bad:
            raise ValueError(f"unparseable values in {col}")
    return res


def drop_missing(df: DataFrame, subset: Sequence[str], how: str = "any") -> DataFrame:
    """Drop rows with any / all of ``subset`` null."""
    return df.na.drop(how=how, subset=list(subset))


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    """Keep non-null values that are not blank after a whitespace strip."""
    return df.filter(ws_trim(col) != "")


def url_prefix(df: DataFrame, col: str = "url", prefix: str = "http") -> DataFrame:
    """Keep rows whose url starts with ``prefix`` (pushed to parquet as StringStartsWith)."""
    return df.filter(F.col(col).startswith(prefix))


# The conflict keyword lists used to route articles to topics.
CONFLICT_KEYWORDS = {
    "RU": ["ukraine", "russia", "putin", "zelensky", "donbas", "kyiv", "moscow"],
    "IP": ["israel", "palestine", "gaza", "hamas", "idf", "west bank", "netanyahu"],
}


def keyword_pattern(keywords: Sequence[str], escape: bool = False) -> str:
    """Case-insensitive substring alternation (no word boundary, as the reference)."""
    parts = [f"\\Q{k}\\E" if escape else k for k in keywords]
    return "(?iu)" + "|".join(parts)


def keyword_topics(df: DataFrame, text: Column, topics: dict[str, Sequence[str]],
                   escape: bool = False, out: str = "topic") -> DataFrame:
    """Fan an article out to every topic whose keywords occur in ``text`` (0..k rows)."""
    hits = F.array(*[F.when(text.rlike(keyword_pattern(kw, escape)), F.lit(t)) for t, kw in topics.items()])
    return df.withColumn(out, F.explode(F.filter(hits, lambda x: x.isNotNull())))


def max_tokens(df: DataFrame, col: str, limit: int = 10000, counter=token_count,
               out: str | None = None) -> DataFrame:
    """P10: null -> '' then keep rows with at most ``limit`` tokens (inclusive). With
    ``out`` the count is kept as a column (computed once, used by the filter)."""
    n = counter(F.coalesce(F.col(col), F.lit("")))
    name = out or "_n_tokens"
    # Generating the count (a one-element inline) keeps the optimizer from copying the
    # regex into the pushed-down filter, so each text is tokenised once, not twice.
    counted = df.select("*", F.inline(F.array(F.struct(n.alias(name)))))
    kept = counted.filter(F.col(name) <= limit)
    return kept if out else kept.drop(name)


def truncate_tokens(df: DataFrame, col: str, n: int = 512, out: str = "truncated",
                    count_out: str | None = None) -> DataFrame:
    """Keep the first ``n`` tokens (re-joined by a space) - truncation is the operator's
    purpose (a fixed model input); ``count_out`` also reports the whole text's length from
    the same token array."""
    tok = word_tokens(col)
    if count_out:
        staged = df.select("*", F.inline(F.array(F.struct(tok.alias("_tok")))))
        return (staged.withColumn(count_out, F.size("_tok"))
                      .withColumn(out, F.array_join(F.slice("_tok", 1, n), " ")).drop("_tok"))
    return df.withColumn(out, F.array_join(F.slice(tok, 1, n), " "))


def keep_values(df: DataFrame, col: str, values, exclude: bool = False) -> DataFrame:
    """Keep (or drop) rows whose value is in a list. Short lists are an IN predicate
    (pushed to the scan); a DataFrame of values is a left-semi / left-anti join."""
    if isinstance(values, DataFrame):
        vals = values.select(F.col(values.columns[0]).alias(col))
        return df.join(vals, col, "left_anti" if exclude else "left_semi")
    cond = F.col(col).isin(list(values))
    return df.filter(~cond if exclude else cond)


def split_by_cutoff(df: DataFrame, ts: str, cutoff: Column, names=PERIOD_NAMES, out: str = "period",
                    path: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Tag rows before / from the cutoff; rows without a date go to neither. With
    ``path`` the two outputs are written as one table partitioned by the period."""
    tagged = df.withColumn(out, period_strict(ts, cutoff, names)).filter(F.col(out).isNotNull())
    if path:
        tagged.write.mode("overwrite").partitionBy(out).format(fmt).save(path)
    return tagged
