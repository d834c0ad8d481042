"""The corpus pipeline: documents to clean, encoded texts, stage by stage.

Every stage reads all rows that the one before it wrote and its decisions take effect: rejected
rows and lines do not come back. Nulls, empty texts, repeated rows, empty tables and extra
columns are handled as the operators' docstrings say; rows never disappear but by a stage's rule:

1. quality: rows whose text fails the repetition rules go;
2. line_dedup: lines that nearly equal an earlier line of the corpus go (``n_chars`` follows the
   text); rows stay, even with no line left;
3. near_dedup: one row of each class of near-duplicate texts stays;
4. decontamination: rows that hold a window of a benchmark item go;
5. bpe: each text's ids, and the digest of what they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialens.llm import bagminhash, linededup, queries, repetition, scratch, wordtable, wumanber

#: SQL can't express near-duplicate classes by edit distance or BPE; the tests hold brute-force versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repetition.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return wumanber.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = wordtable.encode_decode(docs, queries.tokenizer("word_bpe_49k.json"), ["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
