"""Reshaping: unpivot/pivot of label tables, score matrices and orders."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import title_score
from ..session import scratch_dir


def unpivot_labels(df: DataFrame, ids: Sequence[str], label_cols: dict[str, str],
                   model_col: str = "model", value_col: str = "raw_label") -> DataFrame:
    """Wide label columns -> long (ids..., model, raw_label) in one Expand.

    ``label_cols`` maps column name -> model name. Missing columns are skipped, so a
    file without a model simply contributes no rows for it.
    """
    present = {c: m for c, m in label_cols.items() if c in df.columns}
    if not present:
        raise ValueError("no label column present")
    # inline(array(struct...)) plans a Generate, which fuses into whole-stage codegen with
    # the label expressions that follow (an Expand + conditional-aggregate pipeline hit a
    # codegen compile failure in Spark 4.1 and fell back to interpretation).
    pairs = F.array(*[F.struct(F.lit(m).alias(model_col), F.col(c).cast("string").alias(value_col))
                      for c, m in present.items()])
    return df.select(*ids, F.inline(pairs))


def merge_model_labels(tables: dict[str, DataFrame], key: str, label_col: str = "label",
                       order_col: str | None = None) -> DataFrame:
    """Per-model label tables -> one wide row per key.

    Each table is reduced to one row per key (first by ``order_col`` when given), the
    tables are unioned long and pivoted with explicit values: one shuffle in all,
    instead of k full outer joins.
    """
    longs = []
    for model, t in tables.items():
        sel = [F.col(key), F.lit(model).alias("model"), F.col(label_col).cast("string").alias("label")]
        if order_col:
            sel.append(F.col(order_col).cast("long").alias("_ord"))
        else:
            sel.append(F.lit(0).cast("long").alias("_ord"))
        longs.append(t.select(*sel))
    long = longs[0]
    for t in longs[1:]:
        long = long.unionByName(t)
    # min_by over (model-masked label, model-masked order): first row per key and model.
    aggs = [F.min_by(F.when(F.col("model") == m, F.col("label")),
                     F.when(F.col("model") == m, F.col("_ord"))).alias(f"label_{m}")
            for m in tables]
    return long.groupBy(key).agg(*aggs)


def score_long(df: DataFrame, label_col: str = "raw_label") -> DataFrame:
    """L3 then L7: rows with a mappable label get an integer score; others are dropped."""
    return (df.withColumn("score", title_score(F.col(label_col)))
              .filter(F.col("score").isNotNull()))


def score_matrix(scored: DataFrame, columns: dict[str, tuple[str, str]],
                 index=("outlet", "model"), value="score") -> DataFrame:
    """Model x (war, period) mean-score matrix, fixed column set; a missing cell stays null.

    ``columns`` maps output name -> (war, period). One groupBy over the scored rows with
    conditional means (partial aggregation before the shuffle).
    """
    aggs = [F.avg(F.when((F.col("war") == w) & (F.col("period") == p), F.col(value))).alias(name)
            for name, (w, p) in columns.items()]
    return scored.groupBy(*index).agg(*aggs)


def order_by_values(df: DataFrame, orders: dict[str, list], *then: str, position: str | None = None) -> DataFrame:
    """O1 + O3: sort a small final result by fixed category orders (values not listed last),
    then by ``then`` columns; ``position`` also writes the 1-based place of every row. Use on
    final, already aggregated results only (see :func:`restore_order` for tables of any size)."""
    keys = []
    for col, values in orders.items():
        e = F.when(F.lit(False), F.lit(0))
        for i, v in enumerate(values):
            e = e.when(F.col(col) == v, F.lit(i))
        keys.append(e.otherwise(F.lit(len(values))))
    if position:
        df = df.withColumn(position, F.row_number().over(Window.orderBy(*keys, *then)).cast("bigint"))
        return df.orderBy(position)
    return df.orderBy(*keys, *then)


def restore_order(df: DataFrame, order: Sequence[str], position: str) -> DataFrame:
    """The global 1-based position of every row in ``order``, without sorting in one task.

    Rows are dealt to ranges of the order and written to the shared folder with their range; the
    ranges' row counts (one number each) give every range its offset, and a row's position is that
    plus its number within the range. Ties get adjoining positions.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, f"order-{uuid.uuid4().hex}")
    df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (rows.withColumn("_nth", nth).join(offsets, "_range")
                .withColumn(position, (F.col("_before") + F.col("_nth")).cast("bigint")).select(*df.columns, position))
