"""Pandas parity for the calendar operators: array_split segments, resample + centred
rolling mean, spine fill, and segment weighting."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from medialens.operators import trends as T


@pytest.mark.parametrize("n", [1, 4, 5, 6, 7, 79, 80, 83])
def test_segments_equal_array_split(spark, n):
    months = pd.period_range("2020-01", periods=n, freq="M")
    facts = spark.createDataFrame([("t", m.to_timestamp().date()) for m in months], "topic string, month_start date")
    got = [(r["month_start"].strftime("%Y-%m"), r["segment"], r["segment_label"])
           for r in T.month_segments(facts, ["topic"], 6).orderBy("month_start").collect()]
    exp = []
    for s, idx in enumerate(np.array_split(np.arange(n), 6)):
        if len(idx) == 0:
            continue
        lab = f"{months[idx[0]].strftime('%Y-%m')} ~ {months[idx[-1]].strftime('%Y-%m')}"
        exp += [(months[i].strftime("%Y-%m"), s + 1, lab) for i in idx]
    assert got == exp


def test_centred_rolling_equals_pandas(spark):
    rng = np.random.default_rng(1)
    stamps = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(h)) for h in rng.integers(0, 24 * 120, 300)]
    scores = rng.integers(-1, 2, len(stamps))
    pdf = pd.DataFrame({"dt": stamps, "idx": scores.astype(float)})
    exp = pdf.set_index("dt").resample("W-MON")["idx"].mean().rolling(3, center=True).mean()
    df = spark.createDataFrame([("s", s, int(v)) for s, v in zip(stamps, scores)], "k string, ts timestamp_ntz, score int")
    weekly = T.weekly_mean(df, ["k"], "ts", "score").drop("n")
    got = {r["week"]: r["smoothed"] for r in T.centred_rolling(weekly, ["k"], 3).collect()}
    assert len(got) == len(exp)
    for ts, v in exp.items():
        g = got[ts.date()]
        if np.isnan(v):
            assert g is None
        else:
            assert g == pytest.approx(v, abs=1e-9)


def test_spine_fill_and_weighted_segments(spark):
    rows = [("RU", "BBC", "m", dt.date(2020, 1, 1), 1, 0, 1, 2), ("RU", "BBC", "m", dt.date(2020, 4, 1), 0, 2, 0, 2),
            ("RU", "Gdn", "m", dt.date(2020, 2, 1), 3, 0, 0, 3)]
    facts = spark.createDataFrame(rows, "topic string, outlet string, model string, month_start date, "
                                        "n_left long, n_centre long, n_right long, total long")
    cols = ["n_left", "n_centre", "n_right", "total"]
    filled = T.month_spine_fill(facts, ["topic"], ["outlet", "model"], fill_cols=cols, keep_range=True)
    got = sorted((r["outlet"], r["month_start"].month, r["total"]) for r in filled.collect())
    assert got == [("BBC", 1, 2), ("BBC", 2, 0), ("BBC", 3, 0), ("BBC", 4, 2),
                   ("Gdn", 1, 0), ("Gdn", 2, 3), ("Gdn", 3, 0), ("Gdn", 4, 0)]
    seg = T.segment_means(filled, ["topic"], ["outlet", "model"], weighted=True)
    bbc = sorted((r["segment"], r["share_left"], r["n"]) for r in seg.filter(F.col("outlet") == "BBC").collect())
    assert bbc == [(1, 0.5, 2), (2, None, 0), (3, None, 0), (4, 0.0, 2)]
    simple = T.segment_means(filled, ["topic"], ["outlet", "model"], weighted=False)
    s2 = sorted((r["segment"], r["share_left"]) for r in simple.filter(F.col("outlet") == "BBC").collect())
    assert s2 == [(1, 0.5), (2, 0.0), (3, 0.0), (4, 0.0)]


def test_event_without_data_stays(spark):
    from medialens.operators import trends as TR
    events = spark.createDataFrame([("2024-01-08", "a"), ("2024-01-15", "b")], "week string, event string")
    series = spark.createDataFrame([("2024-01-08", 0.5)], "week string, idx double")
    assert sorted(tuple(r) for r in TR.place_events(events, series, "week").select("event", "idx").collect()) == [("a", 0.5), ("b", None)]
