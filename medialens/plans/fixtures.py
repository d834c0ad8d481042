"""Stand-in inputs built from the driver tables (see FIXTURES.md).

Every fixture is a lazy DataFrame derived from the given parquet tables, so its size
grows with them. Nothing is materialised on the driver.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reshape import unpivot_labels
from ..sources.files import read_parquet

# Fixed values of the fixture (FIXTURES.md B1).
FX_CUTOFFS = {"RU": "1997-02-24", "IP": "1999-10-07"}
FX_URL_ID0 = {"RU": 60395600, "IP": 60395900}
FX_EVENTS = [("1996-08-15", "Marker event"), ("1997-02-24", "RU cutoff"), ("1999-10-07", "IP cutoff")]
FX_LABEL_COLUMNS = {
    "predicted_label_bert": "BERT",
    "predicted_label_deepseek": "DeepSeek",
    "predicted_label_gemini": "Gemini",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, os.path.join(sf_dir, f"{name}.parquet"))


def _mod(c: str, m: int) -> Column:
    return F.col(c) % F.lit(m)


def fx_labels(spark: SparkSession, sf_dir: str, carry: Sequence[str] = ()) -> DataFrame:
    """Wide label table: one article per order, four label columns with the known traps; ``carry``
    adds columns of ``orders``."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    prio = F.substring("o_orderpriority", 1, 1)
    st = F.col("o_orderstatus")
    return o.select(
        *carry, k.alias("art_id"),
        F.when(_mod("o_custkey", 2) == 0, "BBC").otherwise("Guardian").alias("outlet"),
        F.when(_mod("o_orderkey", 2) == 0, "RU").otherwise("IP").alias("topic"),
        F.when(_mod("o_orderkey", 3) == 0,
               F.concat(F.lit("https://news.example/articles/c"), k.cast("string"), F.lit("o")))
         .otherwise(F.concat(F.lit("https://news.example/world-"), (k + 60395000).cast("string")))
         .alias("url"),
        F.when(_mod("o_orderkey", 5) == 0, "What if Russia invades")
         .when(_mod("o_orderkey", 5) == 1, "The war diary")
         .when(_mod("o_orderkey", 5) == 2, "Ceasefire talks")
         .when(_mod("o_orderkey", 5) == 3, "Markets today").alias("title"),
        F.when(_mod("o_orderkey", 97) == 0, F.lit(None)).otherwise(F.col("o_orderdate"))
         .cast("timestamp_ntz").alias("published_ts"),
        F.when(prio == "1", "LEFT").when(prio == "2", "RIGHT").when(prio == "3", "CENTER")
         .when(prio == "4", "error").alias("predicted_label_bert"),
        F.when(_mod("o_orderkey", 41) == 0, "[ERROR] copyright timeout")
         .when(st == "F", " left ").when(st == "O", "Centre").when(st == "P", "Right-leaning")
         .alias("predicted_label_deepseek"),
        F.when(_mod("o_orderkey", 53) == 0, "[Failed]")
         .when(_mod("o_orderkey", 7) < 3, "Left").when(_mod("o_orderkey", 7) < 6, "Center")
         .otherwise("Right").alias("predicted_label_gemini"),
        F.when(_mod("o_orderkey", 29) == 0, "Unknown")
         .when(st == "F", "left").when(st == "O", "CENTER ").when(st == "P", "Right")
         .alias("leaning"),
    )


def fx_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx unpivoted once to (art_id, outlet, topic, url, title, published_ts, model, raw_label)."""
    return unpivot_labels(fx_labels(spark, sf_dir),
                          ["art_id", "outlet", "topic", "url", "title", "published_ts"],
                          FX_LABEL_COLUMNS)


FX_ALL_LABEL_COLUMNS = {**FX_LABEL_COLUMNS, "leaning": "Claude"}


def fx_long_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four raw label columns (the Claude column is ``leaning``) as (art_id, model, raw_label)."""
    return unpivot_labels(fx_labels(spark, sf_dir), ["art_id"], FX_ALL_LABEL_COLUMNS)


def fx_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx plus exact copies (art_id % 50 = 0) and same-url rows with null labels and an
    earlier order key (art_id % 70 = 0). ``ord`` is the file-order key.

    One scan: every row fans out to its 1-3 variants with a generator."""
    fx = fx_labels(spark, sf_dir)
    labels = ["predicted_label_bert", "predicted_label_deepseek", "predicted_label_gemini", "leaning"]
    k = F.col("art_id")
    null = F.lit(None).cast("string")

    def variant(keep, ord_, blank):
        return F.struct(keep.alias("keep"), ord_.alias("ord"),
                        *[(null if blank else F.col(c)).alias(c) for c in labels])
    variants = F.array(variant(F.lit(True), k * 2 + 1, False),
                       variant(k % 50 == 0, k * 2 + 2, False),
                       variant(k % 70 == 0, k * 2, True))
    base = [c for c in fx.columns if c not in labels]
    out = fx.select(*base, F.inline(F.filter(variants, lambda v: v["keep"])))
    return out.select(*base, *labels, "ord")


def docs_with_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with NA-like tokens and blanks injected into lang/source by doc_id % 20."""
    d = table(spark, sf_dir, "documents")
    m = _mod("doc_id", 20)
    lang = (F.when(m == 1, "NA").when(m == 2, "nan").when(m == 3, " \t").when(m == 4, "")
             .otherwise(F.col("lang")))
    source = (F.when(m == 5, "null").when(m == 6, "N/A").when(m == 7, "  ")
               .otherwise(F.col("source")))
    return d.select("doc_id", lang.alias("lang"), source.alias("source"))
