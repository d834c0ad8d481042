"""Incremental ingest of landed API search pages (S5 + S6 + U2 on a file stream).

New JSON page files in ``landing`` are picked up by a file-source stream, exploded, converted to
visible text and cleaned of blank bodies. Which urls have come out already is the stream's state:
one flag per url digest in the state store (RocksDB, whose checkpoints lie in the shared folder),
looked up only for the urls of the batch. So the output so far is never read again, and the
work of a batch follows the batch, not the history. Of several rows of a new url in one batch the
first in (tag order, page, position) comes out, as in the batch job. The file sink commits each batch
once, so a retried batch replaces its own output.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import ws_trim
from ..session import scratch_dir
from ..sources.api_pages import API_PAGE_SCHEMA, explode_api_pages
from ..sources.html import extract_html_text

OUT_COLUMNS = ["title", "body_text", "published_at", "url", "tag"]
_ORDER = ["tag_ord", "page", "pos"]
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _first_of_url(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first row of a url that has not come out yet; only the least so far is held."""
    if state.exists:
        return
    first = None
    for pdf in rows:
        own = pdf.sort_values(_ORDER).iloc[:1]
        first = own if first is None else pd.concat([first, own]).sort_values(_ORDER).iloc[:1]
    if first is not None:
        state.update((True,))
        yield first[OUT_COLUMNS]


def new_articles(pages: DataFrame) -> DataFrame:
    """Streamed pages -> each url's first article, once over the life of the stream."""
    art = extract_html_text(explode_api_pages(pages), "body_html", "body_text").drop("body_html")
    art = art.filter(ws_trim("body_text") != "").withColumn("_digest", F.unhex(F.sha2("url", 256)))
    return art.groupBy("_digest").applyInPandasWithState(
        _first_of_url, ", ".join(f"{c} string" for c in OUT_COLUMNS), "seen boolean", "append", GroupStateTimeout.NoTimeout)


def start_api_ingest(spark: SparkSession, landing: str, output: str, checkpoint: str | None = None,
                     available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the stream; returns the StreamingQuery. ``checkpoint`` defaults to a folder
    under the shared ``spark.checkpoint.dir``."""
    checkpoint = checkpoint or scratch_dir(spark, "stream-api-" + os.path.basename(output.rstrip("/")))
    if spark.conf.get(STATE_STORE, None) is None or "HDFSBacked" in spark.conf.get(STATE_STORE):
        spark.conf.set(STATE_STORE, ROCKSDB)  # state on disk, not in the executors' heaps
    reader = spark.readStream.schema(API_PAGE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    w = (new_articles(reader.json(landing)).writeStream.format("parquet").outputMode("append")
         .option("path", output).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
