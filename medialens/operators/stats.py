"""Label statistics.

Every statistic is a single groupBy with conditional aggregates: Catalyst plans a
partial aggregate before the shuffle, so the shuffle carries one small row per group
and map task, whatever the input size. Shares are computed from integer counts in one
division, so they are exact and independent of partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import CLASSES


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _key(name: str) -> str:
    return name.lower().replace("-", "_").replace(" ", "_")


def ratio(num: Column, den: Column, empty: float | None = None) -> Column:
    """num / den as double; den = 0 -> ``empty`` (null by default). Never raises under ANSI."""
    r = F.try_divide(num.cast("double"), den.cast("double"))
    r = F.when(den != 0, r)
    return F.coalesce(r, F.lit(empty).cast("double")) if empty is not None else r


def label_counts(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """A1: value counts of a label column (failure sentinels included, nulls excluded)."""
    return (df.filter(_c(label).isNotNull()).groupBy(*by, label)
              .agg(F.count(F.lit(1)).alias("n")))


def class_count_aggs(label: Column, classes: Sequence[str] = CLASSES, cond: Column | None = None,
                     prefix: str = "") -> list[Column]:
    """Zero-filled count per class (+ optional row condition)."""
    base = F.lit(True) if cond is None else cond
    return [F.count_if(base & (label == k)).alias(f"{prefix}{_key(k)}") for k in classes]


def overall_label_counts(df: DataFrame, label: str, by: Sequence[str] = (),
                         classes: Sequence[str] = CLASSES) -> DataFrame:
    """A2: counts of the fixed classes (absent -> 0) and their shares over the three (pie)."""
    lab = _c(label)
    agg = df.groupBy(*by).agg(*class_count_aggs(lab, classes))
    tot = sum((F.col(_key(k)) for k in classes), F.lit(0))
    return agg.select(*by, *[_key(k) for k in classes],
                      *[ratio(F.col(_key(k)), tot).alias(f"share_{_key(k)}") for k in classes])


def period_label_counts(df: DataFrame, label: str, period: str, periods: Sequence[str],
                        by: Sequence[str] = (), labels: Sequence[str] = ("LEFT", "CENTER", "RIGHT")) -> DataFrame:
    """A3: label x period counts, zero-filled, only the listed labels that occur."""
    lab = _c(label)
    return (df.filter(_c(period).isNotNull() & lab.isin(list(labels)))
              .groupBy(*by, label)
              .agg(*[F.count_if(_c(period) == p).alias(f"n_{_key(p)}") for p in periods]))


def period_share_three(df: DataFrame, label: str, period: str, by: Sequence[str] = (),
                       labels: Sequence[str] = ("LEFT", "CENTER", "RIGHT")) -> DataFrame:
    """A4: per period, each of the listed labels' share over the listed labels only."""
    lab = _c(label)
    g = (df.filter(_c(period).isNotNull())
           .groupBy(*by, period)
           .agg(*[F.count_if(lab == k).alias(f"n_{_key(k)}") for k in labels]))
    tot = sum((F.col(f"n_{_key(k)}") for k in labels), F.lit(0))
    return g.select(*by, period, *[F.col(f"n_{_key(k)}") for k in labels],
                    *[ratio(F.col(f"n_{_key(k)}"), tot).alias(f"share_{_key(k)}") for k in labels])


def period_shares(df: DataFrame, label: str, period: str, by: Sequence[str] = (),
                  classes: Sequence[str] = CLASSES, denominator: str = "all",
                  empty: float | None = 0.0) -> DataFrame:
    """Per (by..., period) class shares.

    ``denominator='all'`` divides by every non-null label (so Unknown dilutes the shares);
    ``'valid'`` divides by the recognised classes only. Empty period -> ``empty``.
    """
    lab = _c(label)
    den = (lab.isNotNull() if denominator == "all" else lab.isin(list(classes)))
    g = (df.filter(_c(period).isNotNull())
           .groupBy(*by, period)
           .agg(*class_count_aggs(lab, classes, prefix="n_"), F.count_if(den).alias("n")))
    return g.select(*by, period, "n",
                    *[ratio(F.col(f"n_{_key(k)}"), F.col("n"), empty).alias(f"share_{_key(k)}")
                      for k in classes])


def block_summary(df: DataFrame, label: Column, period: Column, blocks: dict[str, Column | None],
                  by: Sequence[str], classes: Sequence[str] = CLASSES,
                  having: Column | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """One wide row per group; for every named block (a row condition) the
    valid-denominator class shares (0.0 when empty) and N, in fixed column order.

    All blocks come out of one groupBy: 4 x len(blocks) conditional counts.
    """
    valid = label.isNotNull()
    aggs, order = [], list(by)
    for bname, cond in blocks.items():
        c = valid if cond is None else (valid & cond)
        for k in classes:
            aggs.append(F.count_if(c & (label == k)).alias(f"_{bname}_{_key(k)}"))
        aggs.append(F.count_if(c).alias(f"{bname}_n"))
    g = df.groupBy(*by).agg(*aggs, *extra)
    if having is not None:
        g = g.filter(having)
    out = []
    for bname in blocks:
        for k in classes:
            out.append(ratio(F.col(f"_{bname}_{_key(k)}"), F.col(f"{bname}_n"), 0.0)
                       .alias(f"{bname}_{_key(k)}"))
        out.append(F.col(f"{bname}_n"))
    return g.select(*by, *out)


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count of every column in one pass (a single global aggregate)."""
    cols = list(cols or df.columns)
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])


def corpus_stats(df: DataFrame, dedup_key: str, order: str, ts: Column | None, text: str) -> DataFrame:
    """Rows before/after dedup on the key, date range, mean characters (one pass).

    Dedup size is the number of distinct keys (nulls count as one key, as '' does
    upstream). Keys are counted by their SHA-256 digest, so the distinct-count shuffle
    moves 32 bytes per key instead of whole article texts (a digest collision would need
    ~2^128 keys).
    """
    digest = F.sha2(F.coalesce(_c(dedup_key), F.lit("")).cast("string"), 256)
    aggs = [F.count(F.lit(1)).alias("rows_before"),
            F.count_distinct(F.unhex(digest)).alias("rows_after"),
            F.avg(F.length(_c(text))).alias("mean_chars")]
    if ts is not None:
        aggs += [F.min(ts).alias("min_date"), F.max(ts).alias("max_date")]
    return df.agg(*aggs)
