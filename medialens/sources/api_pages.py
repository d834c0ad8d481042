"""Landed API search pages -> one row per article."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, IntegerType, StringType, StructField, StructType)

from ..functions.text import ws_trim
from .html import extract_html_text

API_PAGE_SCHEMA = StructType([
    StructField("status", IntegerType()),
    StructField("tag", StringType()),
    StructField("tag_ord", IntegerType()),
    StructField("page", IntegerType()),
    StructField("response", StructType([
        StructField("pages", IntegerType()),
        StructField("results", ArrayType(StructType([
            StructField("webPublicationDate", StringType()),
            StructField("webUrl", StringType()),
            StructField("fields", StructType([
                StructField("headline", StringType()),
                StructField("body", StringType()),
            ])),
        ]))),
    ])),
])


def read_api_pages(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines landing files, one search page per line, read with an explicit schema."""
    return spark.read.schema(API_PAGE_SCHEMA).json(path)


def explode_api_pages(pages: DataFrame) -> DataFrame:
    """Non-200 pages are skipped; each result becomes a row with '' for a missing field.
    Keeps (tag_ord, page, pos) as the file-order key for a later first-by-url dedup."""
    ok = pages.filter(F.col("status") == 200)
    ex = ok.select("tag", "tag_ord", "page", F.posexplode("response.results").alias("pos", "r"))
    return ex.select(
        "tag", "tag_ord", "page", "pos",
        F.coalesce(F.col("r.fields.headline"), F.lit("")).alias("title"),
        F.coalesce(F.col("r.fields.body"), F.lit("")).alias("body_html"),
        F.coalesce(F.col("r.webPublicationDate"), F.lit("")).alias("published_at"),
        F.coalesce(F.col("r.webUrl"), F.lit("")).alias("url"),
    )


def api_articles(pages: DataFrame) -> DataFrame:
    """Exploded results -> visible body text -> drop blank bodies -> first row per url in
    (tag order, page, position) order."""
    from ..operators.dedup import dedup_first
    art = extract_html_text(explode_api_pages(pages), "body_html", "body_text").drop("body_html")
    art = art.filter(ws_trim("body_text") != "")
    return dedup_first(art, "url", ["tag_ord", "page", "pos"]).select(
        "title", "body_text", "published_at", "url", "tag")
