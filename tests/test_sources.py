"""Sources and sinks: CSV round trip with hard text, month partitions, failure split."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from medialens.sources import files as S
from medialens.sources import partitions as P

HARD = ['plain', 'with "quotes", commas', 'multi\nline\r\ntext', '  padded  ', 'café – ünïcode', '']


def test_csv_roundtrip_hard_text(spark):
    d = tempfile.mkdtemp(prefix="ml-csv-")
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(HARD)], "id string, body string")
    S.write_table(df, os.path.join(d, "out"), fmt="csv")
    back = S.read_articles_csv(spark, os.path.join(d, "out"), columns=["id", "body"])
    got = {r.id: r.body for r in back.collect()}
    # as with pandas.read_csv, an empty field reads back as missing
    assert got == {str(i): (t or None) for i, t in enumerate(HARD)}


def test_csv_bom_is_dropped(spark):
    d = tempfile.mkdtemp(prefix="ml-bom-")
    p = os.path.join(d, "a.csv")
    with open(p, "w", encoding="utf-8-sig") as f:
        f.write('title,content\n"A","x\ny"\n')
    back = S.read_articles_csv(spark, p, columns=["title", "content"]).collect()
    assert [(r.title, r.content) for r in back] == [("A", "x\ny")]
    latin = os.path.join(d, "l.csv")
    with open(latin, "w", encoding="ISO-8859-1") as f:
        f.write("title\ncafé\n")
    assert S.read_articles_csv(spark, latin, columns=["title"], encoding="ISO-8859-1").first().title == "café"


def test_na_tokens(spark):
    df = spark.createDataFrame([("NA", "x"), ("nan", "null"), ("ok", "")], "a string, b string")
    got = [tuple(r) for r in S.apply_na_tokens(df).collect()]
    assert got == [(None, "x"), (None, None), ("ok", None)]


def test_month_partitions_drift(spark):
    base = tempfile.mkdtemp(prefix="ml-months-")
    full = spark.createDataFrame([(1, "t", "c", "d")], "id int, title string, content string, description string")
    full.write.parquet(os.path.join(base, "month=2020-01"))
    full.drop("description").write.parquet(os.path.join(base, "month=2020-02"))
    full.drop("content").write.parquet(os.path.join(base, "month=2020-03"))
    out = P.read_month_partitions(spark, base, required=["id", "content"])
    got = sorted((r.month, r.description) for r in out.collect())
    assert got == [("2020-01", "d"), ("2020-02", None)]
    with pytest.raises(ValueError):
        P.union_partitions([full.drop("id")], required=["id"])


def test_split_failures(spark):
    d = tempfile.mkdtemp(prefix="ml-split-")
    df = spark.createDataFrame([(1, "Left"), (2, "Unknown")], "i int, leaning string")
    n = S.split_failures(df, "leaning", os.path.join(d, "main"), os.path.join(d, "unknown"))
    assert n == 1
    assert spark.read.parquet(os.path.join(d, "main")).count() == 2
    assert [r.i for r in spark.read.parquet(os.path.join(d, "unknown")).collect()] == [1 + 1]
    ok = spark.createDataFrame([(1, "Left")], "i int, leaning string")
    assert S.split_failures(ok, "leaning", os.path.join(d, "m2"), os.path.join(d, "u2")) == 0
    assert not os.path.exists(os.path.join(d, "u2"))


def test_parquet_scan_has_no_exchange(spark):
    d = tempfile.mkdtemp(prefix="ml-scan-")
    spark.range(100).coalesce(1).write.parquet(os.path.join(d, "t"))
    assert "Exchange" not in S.read_parquet(spark, os.path.join(d, "t"))._jdf.queryExecution().executedPlan().toString()


def test_read_any_falls_back_to_latin1(spark, tmp_path):
    u = tmp_path / "u.csv"
    u.write_bytes("title\ncafé\n".encode("utf-8-sig"))
    lat = tmp_path / "l.csv"
    lat.write_bytes("title\ncafé\n".encode("ISO-8859-1"))
    assert S.read_any(spark, str(u), ["title"]).first().title == "café"
    assert S.read_any(spark, str(lat), ["title"]).first().title == "café"


def test_read_any_chooses_per_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    # a true replacement character is valid UTF-8 and switches nothing; a multi-line field stays one
    (tmp_path / "in" / "a.csv").write_bytes("title,body\ncafé \ufffd,\"x\ny\"\n".encode())
    (tmp_path / "in" / "b.csv").write_bytes("title,body\nça va,é\n".encode("ISO-8859-1"))
    (tmp_path / "in" / "c.csv").write_bytes("title,body\nplain,é\n".encode("utf-8-sig"))
    rows = S.read_any(spark, str(tmp_path / "in"), ["title", "body"]).collect()
    assert sorted((r.title, r.body) for r in rows) == [("café \ufffd", "x\ny"), ("plain", "é"), ("ça va", "é")]
    by_header = S.read_any(spark, str(tmp_path / "in")).collect()
    assert sorted(r.title for r in by_header) == ["café \ufffd", "plain", "ça va"]
    assert {r.encoding for r in S.file_encodings(spark, str(tmp_path / "in")).collect()} == {"UTF-8", "ISO-8859-1"}


def test_month_partitions_resolve_types(spark, tmp_path):
    base = str(tmp_path)
    for month, kind in (("2020-01", "int"), ("2020-02", "bigint"), ("2020-03", "double"), ("2020-04", "int")):
        spark.range(2).select(F.col("id").cast(kind).alias("n"), F.lit(month).alias("only_" + month[-1])) \
             .write.parquet(f"{base}/month={month}")
    out = P.read_month_partitions(spark, base, required=["n"])
    assert dict(out.dtypes)["n"] == "double" and dict(out.dtypes)["month"] == "string"
    assert sorted((r.month, r.n) for r in out.collect()) == [(f"2020-0{m}", float(i)) for m in (1, 2, 3, 4) for i in (0, 1)]
    assert out.filter("only_2 IS NOT NULL").count() == 2
    (tmp_path / "month=2020-05").mkdir()
    (tmp_path / "month=2020-05" / "x.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        P.read_month_partitions(spark, base)


def test_common_types():
    from pyspark.sql.types import DateType, DoubleType, FloatType, IntegerType, LongType, StringType, TimestampType
    assert P.common_type([IntegerType(), LongType()]) == LongType()
    assert P.common_type([LongType(), FloatType()]) == DoubleType()
    assert P.common_type([DateType(), TimestampType()]) == TimestampType()
    assert P.common_type([IntegerType(), StringType()]) == StringType()


def test_failures_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for row in rows:
            seen.add(1)
            yield row
    df = spark.createDataFrame(spark.createDataFrame([(1, "Left"), (2, "Unknown"), (3, None)], "i int, leaning string").rdd.mapPartitions(count),
                               "i int, leaning string")
    assert S.split_failures(df, "leaning", str(tmp_path / "m"), str(tmp_path / "f")) == 1
    assert seen.value == 3
    main = spark.read.parquet(str(tmp_path / "m"))
    assert sorted((r.i, r.status) for r in main.collect()) == [(1, "ok"), (2, "failed"), (3, "ok")]
    assert spark.read.parquet(str(tmp_path / "f")).columns == ["i", "leaning"]


def test_partitioned_write_has_one_file_per_small_group(spark, tmp_path):
    df = spark.range(1000).repartition(16).select("id", (F.col("id") % 3).alias("g"))
    S.write_table(df, str(tmp_path / "t"), partition_by=["g"])
    assert all(len(list((tmp_path / "t" / f"g={g}").glob("part-*"))) == 1 for g in range(3))


def test_csv_with_byte_order_mark(spark, tmp_path):
    from medialens.sources.files import read_articles_csv, write_table
    out = str(tmp_path / "bom")
    write_table(spark.createDataFrame([("é", "x")], "a string, b string").coalesce(1), out, "csv", bom=True)
    part = next((tmp_path / "bom").glob("part-*.csv")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbfa,b\n")
    back = read_articles_csv(spark, out)
    assert [tuple(r) for r in back.select("a", "b").collect()] == [("é", "x")]
