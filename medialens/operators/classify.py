"""Batch text classification as a Spark job.

The model is pluggable. A fitted model of :mod:`learned` scores natively, without a Python worker
around its rows. Or a *scorer factory* is shipped to the executors and called
once per partition; the scorer takes a pandas DataFrame batch (the key columns and the
text) and returns one label per row. Batches come from Arrow (``mapInPandas``) and are
re-sliced to ``batch_size`` rows, as the model's own batch size. The rows of a failing batch
are scored singly, and only those that fail again are labelled ``error``: the result does not
depend on partitioning. Rows carry their key; no order is relied upon.
"""

from __future__ import annotations

import time
import uuid
import warnings
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_tokens, ws_trim
from ..session import scratch_dir
from .clean import drop_blank
from .learned import BayesModel, LogisticModel
from .textops import majority_vote, token_windows

Scorer = Callable[[pd.DataFrame], Sequence[str]]
ScorerFactory = Callable[[], Scorer]
Model = LogisticModel | BayesModel


def with_retry(scorer: Scorer, tries: int = 3, backoff: Callable[[int], float] = lambda a: 2.0 * a,
               retry_on: tuple[type[BaseException], ...] = (Exception,),
               sleep: Callable[[float], None] = time.sleep) -> Scorer:
    """Retry a batch up to ``tries`` times, sleeping ``backoff(attempt)`` between tries,
    only for the listed exception types."""
    def run(batch: pd.DataFrame) -> Sequence[str]:
        for attempt in range(1, tries + 1):
            try:
                return scorer(batch)
            except retry_on:
                if attempt == tries:
                    raise
                sleep(backoff(attempt))
        raise RuntimeError("unreachable")
    return run


def with_fallback(primary: Scorer, backup: Scorer, final: str = "Unknown") -> Scorer:
    """A row that fails gets the backup prompt/scorer; if that fails too, ``final``. After a
    failed batch each of its rows is tried on its own, so no row pays for another's failure."""
    def single(row: pd.DataFrame) -> str:
        for scorer in (primary, backup):
            try:
                return list(scorer(row))[0]
            except Exception:
                continue
        return final

    def run(batch: pd.DataFrame) -> Sequence[str]:
        try:
            return primary(batch)
        except Exception:
            return [single(batch.iloc[i:i + 1]) for i in range(len(batch))]
    return run


def model_tokens(text: str) -> Column:
    """What the learned models read: lower-cased words and single punctuation marks."""
    return word_tokens(F.lower(text))


def classify(df: DataFrame, keys: Sequence[str], text: str, scorer_factory: ScorerFactory | Model,
             batch_size: int = 16, out: str = "label", error_label: str = "error",
             partitions: int | None = None, skip: str | None = None,
             blank_as_error: bool = True, tokens: Callable[[str], Column] = model_tokens) -> DataFrame:
    """Label every row with the scorer, ``batch_size`` rows per call, or with a learned model
    over ``tokens(text)`` (rows that it abstains from get ``error_label``).

    ``partitions`` caps the number of concurrent scorer instances (external rate limits);
    by default the input's partitioning is kept (no shuffle). Rows whose boolean ``skip``
    column is true are not sent to the scorer and get ``error_label``; so are missing or
    blank texts unless ``blank_as_error=False`` (P13: one null-text policy).
    """
    keys = list(keys)
    sk = F.col(skip) if skip else F.lit(False)
    if blank_as_error:
        sk = sk | (ws_trim(F.coalesce(F.col(text), F.lit(""))) == "")
    extra = [sk.alias("_skip")]
    src = df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias(text), *extra)
    if partitions:
        src = src.repartition(partitions)
    if isinstance(scorer_factory, Model):
        src = scorer_factory.prepare(src.withColumn("_tokens", tokens(text)), "_tokens")
        told = scorer_factory.label_rows(src, "_tokens", "_told")
        return told.select(*keys, F.when(F.col("_skip"), F.lit(error_label))
                           .otherwise(F.coalesce("_told", F.lit(error_label))).alias(out))
    key_fields = [f for f in src.schema.fields if f.name in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields) + f", `{out}` string"

    def scored(scorer: Scorer, rows: pd.DataFrame) -> list[str]:
        try:
            res = list(scorer(rows))
            if len(res) != len(rows):
                raise ValueError("scorer returned a wrong number of labels")
            return res
        except Exception:
            if len(rows) == 1:
                return [error_label]
            return [x for i in range(len(rows)) for x in scored(scorer, rows.iloc[i:i + 1])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()
        for pdf in batches:
            labels = pd.Series(error_label, index=pdf.index, dtype=object)
            todo = pdf[~pdf["_skip"].astype(bool)]
            todo = todo[[*keys, text]]
            for i in range(0, len(todo), batch_size):
                chunk = todo.iloc[i:i + batch_size]
                labels.loc[chunk.index] = scored(scorer, chunk)
            outp = pdf[keys].copy()
            outp[out] = labels.values
            yield outp

    return src.mapInPandas(run, schema)


def classify_windows(df: DataFrame, key: str, tokens, scorer_factory: ScorerFactory | Model, size: int = 512,
                     stride: int = 256, batch_size: int = 16, error_scope: str = "window",
                     ignore: Sequence[str] = ("error",), stage_path: str | None = None) -> DataFrame:
    """T5: token windows -> classify each window -> majority vote per article.

    ``error_scope='window'`` drops failed windows from the vote (an article is ``error``
    only if all its windows failed); ``'article'`` makes any failed window fail the article.
    Articles without tokens are ``error``. With ``stage_path`` (a folder in the shared
    checkpoint area) the scored windows are written there and the vote reads them back:
    the lineage is cut after the model calls, so a lost executor during the vote does not
    make the model score anything twice.
    """
    # whole articles are spread over the tasks (AQE sizes the partitions) and cut into windows there:
    # windows overlap, so after cutting every token would travel size / stride times
    keys = [key] if isinstance(key, str) else list(key)
    rows = df.select(*keys, tokens.alias("_tokens")).hint("rebalance")
    native = isinstance(scorer_factory, Model)
    if native:
        rows = scorer_factory.prepare(rows, "_tokens")
    w = token_windows(rows, keys, F.col("_tokens"), size, stride, with_tokens=True, keep_empty=True)
    if native:
        told = scorer_factory.label_rows(w, "window", "_told")
        lab = told.select(*keys, "pos", F.when(F.col("pos") < 0, F.lit("error"))
                          .otherwise(F.coalesce("_told", F.lit("error"))).alias("label"))
    else:
        w = (w.withColumn("window_text", F.array_join(F.coalesce("window", F.array()), " "))
              .withColumn("_empty", F.col("pos") < 0).drop("window"))
        lab = classify(w, [*keys, "pos"], "window_text", scorer_factory, batch_size, skip="_empty")
    if stage_path:
        lab.write.mode("overwrite").parquet(stage_path)
        lab = lab.sparkSession.read.parquet(stage_path)
    # one pass over the scored windows: the vote (and the article-scope failure flag)
    # come out of the same aggregation, so the scorer never runs twice
    return majority_vote(lab, keys, "label", "pos", ignore=ignore,
                         fail_label="error" if error_scope == "article" else None)


def classify_sources(spark, paths: dict[str, str], key: str, text: str, scorer_factory: ScorerFactory | Model,
                     out_path: str | None = None, fmt: str = "parquet", **window_args) -> DataFrame:
    """One job over several labelled files: every file that exists is read (a missing
    one is reported and skipped), blank texts are dropped (P7), each article is classified
    over its token windows with article-scope errors (T5), and the result carries a
    ``source`` column (written partitioned by it when ``out_path`` is given)."""
    parts = []
    for name, path in paths.items():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            warnings.warn(f"missing input skipped: {path}")
            continue
        parts.append(spark.read.format(fmt).load(path).select(key, text).withColumn("source", F.lit(name)))
    if not parts:
        raise FileNotFoundError("no input file exists")
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    df = drop_blank(df, text)
    if "stage_path" not in window_args:
        window_args["stage_path"] = scratch_dir(spark, f"scored-{uuid.uuid4().hex}")
    args = {"error_scope": "article", **window_args}
    tokens = model_tokens(text) if isinstance(scorer_factory, Model) else word_tokens(text)
    res = classify_windows(df, ["source", key], tokens, scorer_factory, **args)
    if out_path:
        res.write.mode("overwrite").partitionBy("source").format(fmt).save(out_path)
    return res


def label_with_replies(df: DataFrame, keys: Sequence[str], text: str, primary: ScorerFactory | Model,
                       backup: ScorerFactory | Model, parse, stage_path: str, batch_size: int = 16,
                       final: str = "Unknown", backup_tokens: Callable[[str], Column] = model_tokens) -> DataFrame:
    """E1 as Spark jobs: free-text model replies parsed natively (L5); rows whose primary
    reply fails or cannot be parsed get the backup prompt; what still fails is ``final``.

    The primary replies are written to ``stage_path`` (shared folder) before the backup
    pass reads the failed subset, so no primary call is ever repeated by lineage. Failed rows
    carry their text in the stage: nothing is joined back, so null and repeated keys keep their rows.
    """
    keys = list(keys)
    first = classify(df.withColumn("_body", F.col(text)), [*keys, "_body"], text, primary, batch_size,
                     out="reply", error_label="").withColumn("label", parse(F.col("reply")))
    first.withColumn("_body", F.when(F.col("label").isNull(), F.col("_body"))).write.mode("overwrite").parquet(stage_path)
    first = df.sparkSession.read.parquet(stage_path)
    ok = first.filter(F.col("label").isNotNull()).select(*keys, "label", F.lit(1).alias("attempts"))
    retry = first.filter(F.col("label").isNull()).select(*keys, F.col("_body").alias(text))
    second = classify(retry, keys, text, backup, batch_size, out="reply", error_label="", tokens=backup_tokens)
    second = second.select(*keys, F.coalesce(parse(F.col("reply")), F.lit(final)).alias("label"),
                           F.lit(2).alias("attempts"))
    return ok.unionByName(second)
