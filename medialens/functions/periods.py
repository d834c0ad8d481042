"""Periods, cutoffs and calendar buckets (R1-R4, week/month keys)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ws_trim

# Conflict start dates and the url-id thresholds of the BBC heuristic.
CUTOFFS = {"RU": "2022-02-24", "IP": "2023-10-07"}
URL_ID0 = {"RU": 60400000, "IP": 67000000}
PRE_TITLE_PHRASE = "if russia invades"
POST_TITLE_WORDS = [" war", "invasion", "attack", "ceasefire"]
PERIOD_NAMES = ("Pre-war", "During-war")
LENIENT_NAMES = ("Pre-War", "Post-War")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_lit(value: str) -> Column:
    """A wall-clock timestamp literal, independent of the session and Python time zones."""
    dt.datetime.fromisoformat(value)  # validate
    return F.lit(value).cast("timestamp_ntz")


def cutoff_for(topic, cutoffs: dict[str, str]) -> Column:
    """Per-topic cutoff as a CASE over a small literal map (no join)."""
    e = F.when(F.lit(False), F.lit(None).cast("timestamp_ntz"))
    for k, v in cutoffs.items():
        e = e.when(_c(topic) == k, ts_lit(v))
    return e


def period_strict(ts, cutoff: Column, names=PERIOD_NAMES) -> Column:
    """Before / after the cutoff; a null date gets no period."""
    return (F.when(_c(ts) < cutoff, F.lit(names[0]))
             .when(_c(ts) >= cutoff, F.lit(names[1])))


def period_lenient(ts, cutoff: Column, names=LENIENT_NAMES) -> Column:
    """A null date compares false, so it lands in the second period."""
    return F.when(_c(ts) < cutoff, F.lit(names[0])).otherwise(F.lit(names[1]))


def url_trailing_id(url) -> Column:
    """Trailing digits of the url without leading zeros; '' when absent or zero.

    Kept as text so ids of any length compare exactly (no numeric overflow).
    """
    digits = F.regexp_extract(F.coalesce(_c(url), F.lit("")), r"(\d+)$", 1)
    return F.regexp_replace(digits, "^0+", "")


def id_less_than(uid: Column, id0: Column) -> Column:
    """Numeric ``uid < id0`` for canonical digit strings (no leading zeros)."""
    return (F.length(uid) < F.length(id0)) | ((F.length(uid) == F.length(id0)) & (uid < id0))


def period_from_url(url, title, id0: Column, names=LENIENT_NAMES) -> Column:
    """Url id < id0 -> pre, else post; a missing or zero id falls back to title rules.

    ``id0`` is a Column of canonical digit text (see :func:`id0_for`).
    """
    uid = url_trailing_id(url)
    t = F.lower(F.coalesce(_c(title), F.lit("nan")))
    post_kw = None
    for w in POST_TITLE_WORDS:
        cond = t.contains(w)
        post_kw = cond if post_kw is None else (post_kw | cond)
    return (F.when(uid != "",
                   F.when(id_less_than(uid, id0), F.lit(names[0])).otherwise(F.lit(names[1])))
             .when(t.contains(PRE_TITLE_PHRASE), F.lit(names[0]))
             .when(post_kw, F.lit(names[1]))
             .otherwise(F.lit(names[0])))


def id0_for(topic, id0s: dict[str, int]) -> Column:
    """Per-topic id threshold as canonical digit text."""
    e = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in id0s.items():
        e = e.when(_c(topic) == k, F.lit(str(int(v))))
    return e


def month_key(ts) -> Column:
    """'yyyy-MM' text key of a timestamp."""
    return F.date_format(_c(ts), "yyyy-MM")


def week_end_monday(ts) -> Column:
    """Week label of pandas resample('W-MON'): weeks end on Monday, inclusive."""
    return F.next_day(F.date_sub(F.to_date(_c(ts)), 1), "Mon")


def parse_ts(c, formats: list[str] | None = None) -> Column:
    """P5: text -> timestamp_ntz, unparseable -> null (try_to_timestamp over a format list)."""
    s = ws_trim(_c(c))
    if not formats:
        return F.try_to_timestamp(s).cast("timestamp_ntz")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz") for f in formats])
