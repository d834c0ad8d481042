"""Schema discovery (D1-D4): column inspection on the driver, one aggregate where data is needed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Candidate names and name fragments used to find a date column.
DATE_CANDIDATES = ["published_date", "time_std", "time", "date", "datetime", "pub_time", "pub_date"]
DATE_FRAGMENTS = ["date", "time", "publish", "datetime", "created", "updated"]
LABEL_MODEL_KEYS = {"BERT": ["bert"], "DeepSeek": ["deepseek", "deep-seek"], "Gemini": ["gemini"],
                    "Claude": ["claude"]}
PROBE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSS]"]


def resolve_date_column(columns: Sequence[str], candidates: Sequence[str] = DATE_CANDIDATES,
                        fragments: Sequence[str] = DATE_FRAGMENTS) -> str:
    """The column of the best rank: candidates by their order (the last of columns that differ
    in case), then names holding a fragment by position."""
    order = {c: i for i, c in enumerate(candidates)}
    ranks = []
    for at, name in enumerate(columns):
        folded = name.lower()
        if folded in order:
            ranks.append((0, order[folded], -at, name))
        elif any(f in folded for f in fragments):
            ranks.append((1, at, 0, name))
    if not ranks:
        raise ValueError("no date column found")
    return min(ranks)[-1]


def parseable_counts(df: DataFrame, formats: Sequence[str] = PROBE_FORMATS,
                     shape: str | None = None) -> DataFrame:
    """D2 (data part): for every column, how many values parse as a timestamp. One global
    aggregate over the data, returned long as (column_name, ordinal, n_parseable). ``shape``, a
    pattern that every value of ``formats`` matches, spares failed parses of other values."""
    def parsed(c):
        s = F.col(c).cast("string")
        p = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats])
        return F.when(s.rlike(shape), p) if shape else p
    wide = df.agg(*[F.count(parsed(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("ordinal"),
                               F.col(f"c{i}").alias("n_parseable")) for i, c in enumerate(df.columns)])
    return wide.select(F.inline(pairs))


def probe_date_column(df: DataFrame, formats: Sequence[str] = PROBE_FORMATS) -> str:
    """First column named like time/date with >= 1 parseable value, else the first
    column of any name with one, else error. Reads one small aggregate row."""
    counts = {r["column_name"]: r["n_parseable"] for r in parseable_counts(df, formats).collect()}
    named = [c for c in df.columns if "time" in c.lower() or "date" in c.lower()]
    for c in named + [c for c in df.columns if c not in named]:
        if counts.get(c, 0) > 0:
            return c
    raise ValueError("no valid date column")


def is_label_column(name: str, also: Sequence[str] = ()) -> bool:
    """A column of labels: its name says so, and it belongs to no url or title."""
    low = name.lower()
    return any(m in low for m in ("label", *also)) and not any(m in low for m in ("url", "title"))


def detect_label_columns(columns: Sequence[str], model_keys: dict[str, Sequence[str]] = LABEL_MODEL_KEYS,
                         also: Sequence[str] = (), fallback_first: bool = False) -> dict[str, str]:
    """D3: model -> its last label column, from the table of (model, position) of all label columns.
    ``also`` widens what counts as one; with ``fallback_first`` the first predicted label is BERT's
    if no column names BERT."""
    model_of = lambda low: next((m for m, keys in model_keys.items() if any(k in low for k in keys)), None)
    table = [(model_of(name.lower()), at) for at, name in enumerate(columns) if is_label_column(name, also)]
    latest = {model: at for model, at in sorted(table, key=lambda x: x[1]) if model is not None}
    predicted = [at for at, name in enumerate(columns) if "predicted_label" in name.lower()]
    if fallback_first and predicted:
        latest.setdefault("BERT", predicted[0])
    return {model: columns[at] for model, at in latest.items()}
