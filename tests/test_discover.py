"""Schema discovery and guards."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from medialens.operators import clean as C
from medialens.operators import discover as D


def test_resolve_date_column_order():
    assert D.resolve_date_column(["url", "Published_Date", "time"]) == "Published_Date"
    assert D.resolve_date_column(["url", "time", "time_std"], ["time_std", "time"]) == "time_std"
    assert D.resolve_date_column(["url", "created_at"]) == "created_at"
    with pytest.raises(ValueError):
        D.resolve_date_column(["url", "title"])


def test_detect_label_columns_last_wins_and_fallback():
    cols = ["url", "title_label_bert", "predicted_label_bert", "predicted_label_deepseek",
            "deep-seek label", "gemini_label", "bias_claude"]
    assert D.detect_label_columns(cols) == {"BERT": "predicted_label_bert", "DeepSeek": "deep-seek label",
                                            "Gemini": "gemini_label"}
    assert D.detect_label_columns(cols, also=["bias"])["Claude"] == "bias_claude"
    assert D.detect_label_columns(["predicted_label", "x"], fallback_first=True) == {"BERT": "predicted_label"}


def test_probe_date_column(spark):
    df = spark.createDataFrame([("a", "2020-01-01", "x", "2021-02-03 04:05:06"), ("b", None, "y", None)],
                               "date_note string, misc string, updated string, stamp string")
    # 'date_note' is named like a date but never parses; 'updated' neither; 'misc' and 'stamp' parse
    assert D.probe_date_column(df) == "misc"
    counts = {r["column_name"]: r["n_parseable"] for r in D.parseable_counts(df).collect()}
    assert counts == {"date_note": 0, "misc": 1, "updated": 0, "stamp": 1}


def test_require_columns(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert C.require_columns(df, ["a"]) is True
    assert C.require_columns(df, ["z"], on_missing="skip") is False
    with pytest.raises(ValueError):
        C.require_columns(df, ["z"])
    with pytest.raises(ValueError):
        C.require_non_null(df, "b")


def test_keep_values_list_and_table(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, m string")
    assert sorted(r.i for r in C.keep_values(df, "m", ["a"]).collect()) == [1]
    assert sorted(r.i for r in C.keep_values(df, "m", ["a"], exclude=True).collect()) == [2]
    vals = spark.createDataFrame([("b",)], "v string")
    assert sorted(r.i for r in C.keep_values(df, "m", vals).collect()) == [2]


def test_parse_dates_raise(spark):
    df = spark.createDataFrame([("2020-01-01",), ("bad",)], "s string")
    with pytest.raises(ValueError):
        C.parse_dates(df, "s", "ts", ["yyyy-MM-dd"], on_error="raise")
    ok = C.parse_dates(df, "s", "ts", ["yyyy-MM-dd"]).orderBy("s").collect()
    assert ok[0]["ts"] == dt.datetime(2020, 1, 1) and ok[1]["ts"] is None


def test_keyword_topics_fan_out(spark):
    df = spark.createDataFrame([(1, "Midfield WAR"), (2, "que"), (3, "none"), (4, "the sch")], "i int, t string")
    got = sorted((r.i, r.topic) for r in C.keyword_topics(df, F.col("t"), {"A": ["war", "idf"], "B": ["que", "sch"]}).collect())
    assert got == [(1, "A"), (2, "B"), (4, "B")]
    esc = C.keyword_topics(df, F.col("t"), {"A": ["w.r"]}, escape=True)
    assert esc.count() == 0


def test_order_by_values(spark):
    from medialens.operators.reshape import order_by_values
    df = spark.createDataFrame([("Gemini", 1), ("BERT", 2), ("Other", 0), ("DeepSeek", 3)], "model string, x int")
    got = [r.model for r in order_by_values(df, {"model": ["BERT", "DeepSeek", "Gemini"]}).collect()]
    assert got == ["BERT", "DeepSeek", "Gemini", "Other"]
