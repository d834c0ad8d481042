"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import PANDAS_NA_TOKENS, null_tokens


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Plain Parquet scan: pruning and pushdown as usual, the same plan at every input size."""
    return spark.read.parquet(path)


def read_articles_csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None,
                      encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """Header CSV with multi-line quoted bodies, read as all-string columns.

    With ``columns`` an explicit all-string schema is used (no inference pass over the data).
    A UTF-8 byte-order mark is dropped by the reader; other encodings are passed explicitly.
    Edge whitespace is kept; an empty field reads as NULL (as pandas reads it).
    """
    r = (spark.read.option("header", header).option("multiLine", True).option("escape", '"')
              .option("quote", '"').option("encoding", encoding).option("mode", "PERMISSIVE")
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if columns:
        r = r.schema(StructType([StructField(c, StringType()) for c in columns]))
    else:
        r = r.option("inferSchema", False)
    return r.csv(path if isinstance(path, str) else list(path))


def file_encodings(spark: SparkSession, path: str | Sequence[str], encodings: Sequence[str] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """(path, encoding) of every file: the first encoding if all its bytes are valid UTF-8, else the
    second. One pass over the bytes, file by file, on the executors; the replacement character
    U+FFFD is valid UTF-8 like any other."""
    first, fallback = encodings
    files = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return files.select("path", F.when(valid, F.lit(first)).otherwise(F.lit(fallback)).alias("encoding"))


def read_any(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
             encodings: Sequence[str] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """CSV files of mixed encodings as one table. Each file's encoding is chosen from its own
    bytes before it is parsed, so one odd file does not change how the others read, and each file
    is parsed once. Only file names come to the driver, as they do for any listing. A UTF-8 BOM is
    dropped by the reader ('utf-8-sig'). Parquet paths are read as parquet; a file that
    Spark reads as multi-line CSV is one task's, so it must fit one (2 GB) here too."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    chosen = file_encodings(spark, path, encodings).collect()
    if not chosen:
        return read_articles_csv(spark, path, columns, encodings[0])
    out = None
    for encoding in dict.fromkeys(encodings):
        if own := [r["path"] for r in chosen if r["encoding"] == encoding]:
            part = read_articles_csv(spark, own, columns, encoding)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def apply_na_tokens(df: DataFrame, cols: Sequence[str] | None = None,
                    tokens: Sequence[str] = PANDAS_NA_TOKENS) -> DataFrame:
    """S3: pandas-style NA strings -> NULL on the string columns."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: null_tokens(c, tokens) for c in cols})


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "overwrite", bom: bool = False) -> None:
    """Write a table; CSV keeps a header and quotes embedded newlines.

    ``partition_by`` replaces the reference's one-sheet-per-group workbook (S8). With ``bom``
    every CSV file starts with a UTF-8 byte-order mark (written as part of its header).
    """
    if bom and fmt == "csv":
        first = next(c for c in df.columns if c not in partition_by)
        df = df.withColumnRenamed(first, "﻿" + first)
    if partition_by:
        # a group's rows meet before the write, so it gets few files, not one per task; AQE splits large groups
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        # keep edge whitespace (the writer trims it by default) and quote embedded newlines
        w = (w.option("header", True).option("escape", '"').option("quote", '"')
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    w.format(fmt).save(path)


def split_failures(df: DataFrame, label: str, main_path: str, failed_path: str,
                   failed_value: str = "Unknown", fmt: str = "parquet", status: str = "status") -> int:
    """The whole table at ``main_path``, and the failed rows at ``failed_path`` if there are any.

    The input is computed once: one write partitioned by ``status`` (ok, failed), whose row counts an
    observation takes along. The second output reads only the failed partition back and is
    not written when the count is zero. Returns the number of failed rows.
    """
    failed = F.coalesce(F.col(label) == failed_value, F.lit(False))
    counts = Observation()
    seen = df.withColumn(status, F.when(failed, "failed").otherwise("ok")).observe(
        counts, F.count_if(F.col(status) == "failed").alias("n"))
    write_table(seen, main_path, fmt, partition_by=[status])
    n = counts.get["n"]
    if n:
        main = df.sparkSession.read.format(fmt)
        if fmt == "csv":
            main = main.option("header", True).option("escape", '"').option("multiLine", True)
        own = main.schema(StructType([*df.schema.fields, StructField(status, StringType())])).load(main_path)
        write_table(own.filter(F.col(status) == "failed").select(*df.columns), failed_path, fmt)
    return n
