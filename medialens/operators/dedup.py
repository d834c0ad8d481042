"""Deduplication (U1-U4). Long keys travel as digests; bodies are fetched last, if at all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType


def digests(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    """Grouping keys for ``cols``: the SHA-256 of text and binary columns (null stays null), others as they are."""
    def key(c: str) -> Column:
        if isinstance(df.schema[c].dataType, (StringType, BinaryType)):
            return F.unhex(F.sha2(F.col(c).cast("binary"), 256))
        return F.col(c)
    return [key(c) for c in cols]


def drop_exact_duplicates(df: DataFrame, cols: Sequence[str] | None = None, order: str | None = None,
                          late: bool = False) -> DataFrame:
    """Whole-row duplicates (over ``cols``). With ``order`` the earliest copy's order key
    is kept, so a later first-by-order step stays deterministic.

    ``late`` (with an ``order`` that no two rows share) finds the earliest copies from digests and
    order keys alone and fetches their rows by a semi-join on the order key: no column of
    ``cols`` is a shuffle key, and none is shuffled while the winners can be broadcast.
    """
    cols = list(cols or [c for c in df.columns if c != order])
    if order is None:
        if not any(isinstance(df.schema[c].dataType, (StringType, BinaryType)) for c in cols):
            return df.dropDuplicates(cols)
        return _first(df, digests(df, cols), [F.lit(1)])
    if late:
        keys = [c.alias(f"_k{i}") for i, c in enumerate(digests(df, cols))]
        first = df.select(*keys, order).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min(order).alias(order))
        return df.select(*cols, order).join(first.select(order), order, "left_semi").select(*cols, order)
    return df.groupBy(*cols).agg(F.min(order).alias(order))


def dedup_first(df: DataFrame, key: Sequence[str] | str, order: Sequence[str] | str, late: Sequence[str] = ()) -> DataFrame:
    """Keep the first row per key in an explicit order (file order has no meaning in Spark).

    ``row_number() = 1`` over the key's digest is planned with WindowGroupLimit on both sides of
    the shuffle: each map task forwards only its first row per key, so a key holding a third of the
    data costs one row per map task on the wire, not a third of the data in one task. A text key
    is 32 bytes there, whatever its length.

    Columns in ``late`` stay out of that shuffle and are fetched for the winners by a semi-join on
    ``order``, which no two rows may share then.
    """
    key = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    if late:
        rows = df.withColumns({f"_k{i}": c for i, c in enumerate(digests(df, key))})
        first = _first(rows.select(*[f"_k{i}" for i in range(len(key))], *order), [F.col(f"_k{i}") for i in range(len(key))], order)
        return df.join(first.select(*order), order, "left_semi").select(*df.columns)
    return _first(df, digests(df, key), order)


def _first(df: DataFrame, keys: Sequence[Column], order: Sequence[str | Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
