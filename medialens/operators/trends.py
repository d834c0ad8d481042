"""Monthly and weekly trend operators.

Pattern: aggregate the raw rows first (partial + final hash aggregate, one shuffle),
then build calendars and windows on the aggregated rows only. Calendars are bounded
by (#series x #months or #weeks), never by the number of articles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import CLASSES
from ..functions.periods import week_end_monday
from .stats import ratio


def _key(k: str) -> str:
    return k.lower()


def monthly_class_counts(df: DataFrame, by: Sequence[str], label: str, ts: str,
                         classes: Sequence[str] = CLASSES, valid_only: bool = True) -> DataFrame:
    """Per (by..., month): zero-filled counts of each class and the valid total.

    Rows without a date are dropped. With ``valid_only`` rows without a recognised label
    are dropped too, so months without any valid label are absent; without it such
    months stay with a zero total (they still count for the month range).
    """
    lab = F.col(label)
    valid = lab.isin(list(classes))
    d = df.filter(F.col(ts).isNotNull() & valid) if valid_only else df.filter(F.col(ts).isNotNull())
    return (d.groupBy(*by, F.trunc(F.col(ts), "month").alias("month_start"))
             .agg(*[F.count_if(lab == k).alias(f"n_{_key(k)}") for k in classes],
                  F.count_if(valid).alias("total")))


def complete_calendar(facts: DataFrame, series: Sequence[str], period: str, values: Sequence[str],
                      step: Column, range_by: Sequence[str] | None = None, mode: str = "range",
                      keep_range: bool = False) -> DataFrame:
    """Give every series a complete period axis in ONE pass over the aggregated facts.

    ``mode='range'``: every period from the first to the last of its ``range_by`` group
    (default: the series itself), stepping by ``step`` (R5/R6). ``mode='union'``: the
    distinct periods seen anywhere in the ``range_by`` group (J9). Values of absent
    periods are null.

    Each series' facts are packed into one map (period -> values) and the axis is
    exploded against it: the packed row is bounded by the calendar length (months or
    weeks), never by the raw row count, since facts are aggregated first. The group axis
    is a window over the packed rows (one row per series of the group). No join and no
    second scan of the input.
    """
    rb = list(range_by or series)
    entries = F.map_from_entries(F.collect_list(F.struct(F.col(period), F.struct(*values))))
    packed = facts.groupBy(*series).agg(entries.alias("_m"))
    keys = F.map_keys("_m")
    if rb != list(series) or mode == "union":
        # the group's axis from the packed rows: one row per series, not per period
        w = Window.partitionBy(*rb)
        if mode == "union":
            packed = packed.withColumn("_axis", F.array_sort(F.array_distinct(
                F.flatten(F.collect_list(keys).over(w)))))
        else:
            packed = (packed.withColumn("_lo", F.min(F.array_min(keys)).over(w))
                            .withColumn("_hi", F.max(F.array_max(keys)).over(w)))
    else:
        packed = packed.withColumn("_lo", F.array_min(keys)).withColumn("_hi", F.array_max(keys))
    if mode == "union":
        ex = packed.select(*series, "_m", F.explode("_axis").alias(period))
    else:
        ex = packed.select(*series, "_m", "_lo", "_hi", F.explode(F.sequence("_lo", "_hi", step)).alias(period))
    return ex.select(*series, period, *(["_lo", "_hi"] if keep_range and mode == "range" else []),
                     *[F.try_element_at("_m", F.col(period)).getField(v).alias(v) for v in values])


def month_spine_fill(facts: DataFrame, range_by: Sequence[str], series: Sequence[str],
                     month_col: str = "month_start", fill_cols: Sequence[str] = (),
                     keep_range: bool = False) -> DataFrame:
    """J1 + R5: complete month axis (joint range of the ``range_by`` group) per series;
    absent months get zero counts."""
    out = complete_calendar(facts, [*range_by, *series], month_col, list(fill_cols),
                            F.expr("interval 1 month"), range_by=range_by, keep_range=keep_range)
    return out.na.fill(0, subset=list(fill_cols))


def segment_of(month: Column, lo: Column, hi: Column, k: int = 6) -> tuple[Column, Column]:
    """W3 in closed form: split the months lo..hi into k consecutive blocks, the first
    n mod k one longer (numpy.array_split); returns (1-based segment, 'first ~ last')."""
    n = F.months_between(hi, lo).cast("int") + 1
    i = F.months_between(month, lo).cast("int")
    q, r = F.floor(n / k).cast("int"), (n % k)
    big = r * (q + 1)
    seg0 = F.when(i < big, F.floor(i / (q + 1))).otherwise(r + F.floor((i - big) / F.greatest(q, F.lit(1)))).cast("int")
    first = F.when(seg0 < r, seg0 * (q + 1)).otherwise(big + (seg0 - r) * q)
    size = F.when(seg0 < r, q + 1).otherwise(q)
    label = F.concat(F.date_format(F.add_months(lo, first), "yyyy-MM"), F.lit(" ~ "),
                     F.date_format(F.add_months(lo, first + size - 1), "yyyy-MM"))
    return (seg0 + 1), label


def month_segments(facts: DataFrame, by: Sequence[str], k: int = 6, month_col: str = "month_start") -> DataFrame:
    """W3 over the joint month range of each ``by`` group: one row per (by..., month)."""
    rng = facts.groupBy(*by).agg(F.min(month_col).alias("_lo"), F.max(month_col).alias("_hi"))
    sp = rng.select(*by, "_lo", "_hi", F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 month"))).alias(month_col))
    seg, lab = segment_of(F.col(month_col), F.col("_lo"), F.col("_hi"), k)
    return sp.select(*by, month_col, seg.alias("segment"), lab.alias("segment_label"))


def segment_means(filled: DataFrame, by: Sequence[str], series: Sequence[str],
                  classes: Sequence[str] = CLASSES, weighted: bool = True, k: int = 6,
                  month_col: str = "month_start") -> DataFrame:
    """Per (by..., segment, series...) the class means over the segment's months.

    ``filled`` comes from :func:`month_spine_fill` with ``keep_range=True``. Weighted:
    sum(count)/sum(total), exact from integers (equals the total-weighted mean of monthly
    shares). Simple: plain mean of monthly shares, a zero-filled month counting as 0.
    N is the summed total. One aggregation over the (small) filled calendar.
    """
    seg, lab = segment_of(F.col(month_col), F.col("_lo"), F.col("_hi"), k)
    j = filled.withColumn("segment", seg).withColumn("segment_label", lab)
    grp = [*by, "segment", "segment_label", *series]
    if weighted:
        aggs = [F.sum(f"n_{_key(k)}").alias(f"_s_{_key(k)}") for k in classes]
        g = j.groupBy(*grp).agg(*aggs, F.sum("total").alias("n"))
        return g.select(*grp, *[ratio(F.col(f"_s_{_key(k)}"), F.col("n")).alias(f"share_{_key(k)}")
                                for k in classes], "n")
    aggs = [F.round(F.avg(ratio(F.col(f"n_{_key(k)}"), F.col("total"), 0.0)), 9).alias(f"share_{_key(k)}")
            for k in classes]
    return j.groupBy(*grp).agg(*aggs, F.sum("total").alias("n"))


def weekly_mean(df: DataFrame, by: Sequence[str], ts: str, score: str) -> DataFrame:
    """Mean score per week ending on Monday (inclusive); empty weeks are absent."""
    d = df.filter(F.col(ts).isNotNull() & F.col(score).isNotNull())
    return (d.groupBy(*by, week_end_monday(F.col(ts)).alias("week"))
             .agg(F.avg(score).alias("idx"), F.count(F.lit(1)).alias("n")))


def centred_rolling(weekly: DataFrame, by: Sequence[str], width: int = 3, value: str = "idx",
                    out: str = "smoothed", digits: int | None = 9) -> DataFrame:
    """W2 over a dense week axis (R6): per series, every week between its first and last;
    the centred mean of ``width`` weeks is null unless all of them have a value.

    Each series' weekly means are packed into one map (bounded by its number of weeks)
    and the neighbours are looked up by date, so no window sort and no second scan."""
    half = width // 2
    packed = weekly.groupBy(*by).agg(F.min("week").alias("_lo"), F.max("week").alias("_hi"),
                                     F.map_from_entries(F.collect_list(F.struct("week", value))).alias("_m"))
    ex = packed.select(*by, "_m", F.explode(F.sequence("_lo", "_hi", F.expr("interval 7 days"))).alias("week"))
    nb = [F.try_element_at("_m", F.date_add("week", 7 * j)) for j in range(-half, half + 1)]
    total = nb[0]
    for v in nb[1:]:
        total = total + v
    mean = total / F.lit(float(width))
    full = F.lit(True)
    for v in nb:
        full = full & v.isNotNull()
    sm = F.when(full, F.round(mean, digits) if digits is not None else mean)
    return ex.select(*by, "week", nb[half].alias(value), sm.alias(out))


def combine_series(smoothed: DataFrame, by: Sequence[str], value: str = "smoothed") -> DataFrame:
    """Align series on the week (outer) and take the mean of the sides present."""
    return smoothed.groupBy(*by, "week").agg(F.round(F.avg(value), 9).alias("combined"))


def share_of_group(counts: DataFrame, group: Sequence[str], n: str = "n") -> DataFrame:
    """Each row's count over its group's total (window sum over aggregated rows)."""
    tot = F.sum(n).over(Window.partitionBy(*group))
    return counts.withColumn("share", ratio(F.col(n), tot))


def place_events(events: DataFrame, series: DataFrame, on: str) -> DataFrame:
    """Put named dates on a series by their bucket. An event whose bucket has no data
    stays, with nulls for the series' columns."""
    return events.join(series, on, "left")
