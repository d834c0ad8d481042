"""Month-partitioned archives with drifting schemas."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StringType, StructField, StructType


def union_partitions(parts: Sequence[DataFrame], required: Sequence[str]) -> DataFrame:
    """Union partitions by name; a partition lacking a required column is skipped and a
    missing optional column is null-filled (``allowMissingColumns``). Schema checks are
    metadata only; no data moves through the driver."""
    keep = [p for p in parts if all(c in p.columns for c in required)]
    if not keep:
        raise ValueError("no partition has the required columns")
    out = keep[0]
    for p in keep[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _folders(spark: SparkSession, base: str) -> list[str]:
    """Names below a path of any file system that Spark can read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return [f.getPath().getName() for f in found]


#: Schemas read at once.
READERS = 16
#: Number types from narrow to wide: a column of several of them becomes the widest.
_WIDTHS = ["tinyint", "smallint", "int", "bigint", "float", "double"]


def common_type(kinds: Iterable[DataType]) -> DataType:
    """One type for a column that months hold under several: the widest number type, the longest
    timestamp of date and timestamps, else text."""
    kinds = list(dict.fromkeys(kinds))
    if len(kinds) == 1:
        return kinds[0]
    names = [k.simpleString() for k in kinds]
    if set(names) <= set(_WIDTHS):
        # a bigint does not fit a float
        widest = max(names, key=_WIDTHS.index)
        return kinds[names.index(widest)] if widest != "float" or "bigint" not in names else DoubleType()
    if set(names) <= {"date", "timestamp_ntz"} or set(names) <= {"date", "timestamp"}:
        return kinds[names.index(next(n for n in names if n != "date"))]
    return StringType()


def month_schemas(spark: SparkSession, paths: dict[str, str], fmt: str) -> dict[str, StructType]:
    """The schema of every month's folder, ``READERS`` of them at a time; Spark reads one footer of each."""
    with ThreadPoolExecutor(READERS) as pool:
        return dict(zip(paths, pool.map(lambda p: spark.read.format(fmt).load(p).schema, paths.values()), strict=True))


def read_month_partitions(spark: SparkSession, base: str, months: Sequence[str] | None = None,
                          required: Sequence[str] = (), fmt: str = "parquet",
                          partition_col: str = "month") -> DataFrame:
    """Read ``base/month=YYYY-MM`` partitions whose schemas drift over time.

    A month that lacks a required column is skipped; one that cannot be read raises. The others
    become one table of all their columns, where a column that a month lacks is null. While every
    column has one type in all months, that is ONE scan with the merged schema, however many months
    there are, pruned by month. Months that hold a column under another type are scanned apart,
    one scan per distinct schema, and cast to :func:`common_type`.
    """
    if months is None:
        months = sorted(d.split("=", 1)[1] for d in _folders(spark, base) if d.startswith(f"{partition_col}="))
    paths = {m: os.path.join(base, f"{partition_col}={m}") for m in months}
    schemas = {m: s for m, s in month_schemas(spark, paths, fmt).items() if all(c in s.names for c in required)}
    if not schemas:
        raise ValueError("no partition has the required columns")
    held: dict[str, list[DataType]] = {}
    for schema in schemas.values():
        for field in schema.fields:
            held.setdefault(field.name, []).append(field.dataType)
    merged = {name: common_type(kinds) for name, kinds in held.items()}

    def scan(own: Sequence[str], types: dict[str, DataType]) -> DataFrame:
        schema = StructType([StructField(n, t) for n, t in types.items()] + [StructField(partition_col, StringType())])
        return spark.read.format(fmt).schema(schema).option("basePath", base).load([paths[m] for m in own])

    # months agree when none of their columns has another type than the table's
    agreeing = [m for m, s in schemas.items() if all(merged[f.name] == f.dataType for f in s.fields)]
    parts = [scan(agreeing, merged)] if agreeing else []
    others: dict[tuple, list[str]] = {}
    for m in (m for m in schemas if m not in set(agreeing)):
        others.setdefault(tuple((f.name, f.dataType) for f in schemas[m].fields), []).append(m)
    for fields, own in others.items():
        rows = scan(own, dict(fields))
        parts.append(rows.select(*(F.col(n).cast(merged[n]).alias(n) for n, _ in fields), partition_col))
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
