"""Written stages in the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_dir


def place(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return scratch_dir(spark, f"llm-{name}-{uuid.uuid4().hex}")


#: Shuffle files go when the query that wrote them ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_alone(df: DataFrame, name: str) -> DataFrame:
    """As :func:`stage`, and the shuffle files behind ``df`` are removed when it is written."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return stage(df, name)
    finally:
        conf.set(CLEANUP, before)
