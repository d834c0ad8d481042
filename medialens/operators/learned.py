"""Text classifiers that learn from labelled rows and score as plain DataFrame transforms.

Two models with one surface. :func:`fit_logistic` fits hashed term frequencies with
``pyspark.ml`` (HashingTF, IDF, Normalizer, multinomial logistic regression) on at most
``MAX_LABELLED`` labelled rows. :func:`fit_bayes` counts every labelled row and keeps
its weights as integers, so a score is a sum of integers: equal in any order, on any
partitioning and in any engine.

A model turns token arrays into what it reads per token (``prepare``, once per text) and labels
arrays of that (``label_rows``, per text or per window). A label of null means that the model
abstains: it is less sure than asked for.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir
from . import dictionary

#: Labelled rows that a logistic model is fitted on; which ones, the hash of the key decides.
MAX_LABELLED = 50_000
FEATURES = 1 << 16
#: A token teaches if so many labelled texts hold it.
MIN_TEXTS = 10
SMOOTHING = 0.1
#: Parts of a natural logarithm in one unit of an integer weight.
UNITS = 1_000_000


def labelled_sample(df: DataFrame, key: str, limit: int = MAX_LABELLED) -> DataFrame:
    """At most ``limit`` keys' rows, by the keys' hash: the same ones on every run. Only keys are
    sorted; the texts of the chosen ones are fetched by a semi-join."""
    chosen = df.select(key).distinct().orderBy(F.xxhash64(key), key).limit(limit)
    return df.join(chosen, key, "left_semi")


def _class_index(label: str, classes: Sequence[str]) -> Column:
    return (F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1).cast("double")


@dataclass(frozen=True)
class LogisticModel:
    """A fitted pipeline over token arrays; ``sure`` is the least probability that it answers with."""

    pipeline: PipelineModel
    classes: tuple[str, ...]
    sure: float = 0.0

    def asking(self, sure: float) -> LogisticModel:
        return replace(self, sure=sure)

    def prepare(self, df: DataFrame, tokens: str) -> DataFrame:
        return df

    def label_rows(self, df: DataFrame, tokens: str, out: str) -> DataFrame:
        scored = self.pipeline.transform(df.withColumn("_ml_tokens", F.coalesce(tokens, F.array().cast("array<string>"))))
        label = F.element_at(F.array(*map(F.lit, self.classes)), F.col("_ml_prediction").cast("int") + 1)
        if self.sure:
            label = F.when(F.array_max(vector_to_array("_ml_probability")) >= self.sure, label)
        return scored.withColumn(out, label).drop(*[c for c in scored.columns if c.startswith("_ml_")])


def fit_logistic(labelled: DataFrame, key: str, tokens: str, label: str, classes: Sequence[str],
                 limit: int = MAX_LABELLED, features: int = FEATURES, min_texts: int = MIN_TEXTS,
                 regularisation: float = 1e-5, iterations: int = 20, binary: bool = False, norm: float = 2.0) -> LogisticModel:
    """Fit on rows whose label is one of ``classes`` and whose token array is not null."""
    rows = labelled_sample(labelled.filter(F.col(label).isin(list(classes)) & F.col(tokens).isNotNull()), key, limit)
    rows = rows.select(F.col(tokens).alias("_ml_tokens"), _class_index(label, classes).alias("_ml_label"))
    pipeline = Pipeline(stages=[
        HashingTF(inputCol="_ml_tokens", outputCol="_ml_counts", numFeatures=features, binary=binary),
        IDF(inputCol="_ml_counts", outputCol="_ml_weighed", minDocFreq=min_texts),
        Normalizer(inputCol="_ml_weighed", outputCol="_ml_features", p=norm),
        LogisticRegression(featuresCol="_ml_features", labelCol="_ml_label", predictionCol="_ml_prediction",
                           probabilityCol="_ml_probability", rawPredictionCol="_ml_raw", family="multinomial",
                           maxIter=iterations, regParam=regularisation, standardization=False)])
    return LogisticModel(pipeline.fit(rows), tuple(classes))


@dataclass(frozen=True)
class BayesModel:
    """Integer log weights per token (a DataFrame of any size) and class; ``sure`` is the least lead
    over the second class, in units, that it answers with."""

    weights: DataFrame  # token, weights (one per class)
    prior: tuple[int, ...]
    classes: tuple[str, ...]
    sure: int = 0

    def asking(self, sure: int) -> BayesModel:
        return replace(self, sure=sure)

    def prepare(self, df: DataFrame, tokens: str) -> DataFrame:
        """Tokens become their weights; the distinct tokens meet the weights once."""
        found = dictionary.lookup(df, tokens, self.weights, "token", "weights", "_weights")
        return found.withColumn(tokens, F.col("_weights")).drop("_weights")

    def label_rows(self, df: DataFrame, tokens: str, out: str) -> DataFrame:
        start = F.array(*(F.lit(w).cast("bigint") for w in self.prior))
        sums = F.aggregate(F.coalesce(tokens, F.array().cast("array<array<bigint>>")), start,
                           lambda acc, w: F.when(w.isNull(), acc).otherwise(F.zip_with(acc, w, lambda a, b: a + b)))
        df = df.withColumn("_sums", sums)
        ranked = F.sort_array("_sums", False)
        # of classes that are level, the first
        label = F.element_at(F.array(*map(F.lit, self.classes)), F.array_position("_sums", ranked[0]).cast("int"))
        return df.withColumn(out, F.when(ranked[0] - ranked[1] >= self.sure, label)).drop("_sums")


def fit_bayes(labelled: DataFrame, tokens: str, label: str, classes: Sequence[str], min_texts: int = MIN_TEXTS,
              smoothing: float = SMOOTHING) -> BayesModel:
    """Multinomial naive Bayes over all rows whose label is one of ``classes``.

    Tokens of at least ``min_texts`` of those texts have a weight, others say nothing. The weight
    table has one row per such token and stays distributed; only the totals per class come to
    the driver.
    """
    rows = labelled.filter(F.col(label).isin(list(classes)))
    # a text's tokens are counted in the text first: one row per text and distinct token
    each = rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", label, F.explode(tokens).alias("token"))
    seen = each.filter("token IS NOT NULL").groupBy("_row", label, "token").agg(F.count("*").alias("n"))
    counts = seen.groupBy("token").agg(
        F.count("*").alias("texts"),
        F.array(*(F.coalesce(F.sum(F.when(F.col(label) == c, F.col("n"))), F.lit(0)) for c in classes)).alias("n"))
    # written once: the totals and the weights both come from it
    path = scratch_dir(labelled.sparkSession, f"token-counts-{uuid.uuid4().hex}")
    counts.filter(F.col("texts") >= min_texts).write.parquet(path)
    counts = labelled.sparkSession.read.parquet(path)
    totals = counts.agg(F.count("*").alias("v"), *(F.coalesce(F.sum(F.col("n")[i]), F.lit(0)).alias(f"n{i}")
                                                  for i in range(len(classes)))).first()
    docs = rows.agg(F.count("*").alias("all"), *(F.count_if(F.col(label) == c).alias(f"d{i}") for i, c in enumerate(classes))).first()
    log = lambda x: F.round(F.lit(UNITS) * F.ln(x)).cast("bigint")
    room = [totals[f"n{i}"] + smoothing * totals["v"] for i in range(len(classes))]
    weights = counts.select("token", F.array(*(log((F.col("n")[i] + F.lit(smoothing)) / F.lit(float(r))) for i, r in enumerate(room)))
                            .alias("weights"))
    prior = labelled.sparkSession.range(1).select(
        F.array(*(log(F.lit(docs[f"d{i}"] + 1.0) / F.lit(float(docs["all"] + len(classes)))) for i in range(len(classes)))).alias("w")).first()
    return BayesModel(weights, tuple(prior["w"]), tuple(classes))


def confusion(scored: DataFrame, label: str, predicted: str) -> DataFrame:
    """(label, predicted, n): the counts behind accuracy on rows kept from the fit."""
    return scored.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
