"""A distributed classifier of (label name, text) pairs, trained for all labels at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from labelloom.functions.numeric import at_threshold, made_once
from labelloom.operators.sampling import class_balance

WORD_BREAK = r"[^\p{L}\p{N}]+"


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), WORD_BREAK), lambda w: w != ""))


def pair_features(rows: DataFrame) -> DataFrame:
    """Rows (label_name, text) plus ``tokens``: words of the text, alone and crossed with the label.

    Words shared by text and label name give one common token, so unseen labels profit too.
    """
    crossed = F.concat(F.lit("x "), F.lower(F.col("label_name")), F.lit(" ")).alias("crossed")
    words = F.struct(_words(F.col("text")).alias("text"), _words(F.col("label_name")).alias("name"), crossed)
    text, name, crossed = (F.col(f"_words.{c}") for c in ("text", "name", "crossed"))
    tokens = F.concat(
        F.transform(text, lambda w: F.concat(F.lit("t "), w)),
        F.transform(text, lambda w: F.concat(crossed, w)),
        F.transform(name, lambda w: F.concat(F.lit("l "), w)),
        F.transform(F.array_intersect(text, name), lambda w: F.lit("shared")),
    )
    # The words of a text are cut once, not once for each use of them.
    return rows.withColumn("_words", made_once(words)).withColumn("tokens", tokens).drop("_words")


def with_class_weight(rows: DataFrame, pos_weight: bool = True) -> DataFrame:
    """Rows plus ``weight``: negatives per positive over the whole training set for positives, else 1."""
    if not pos_weight:
        return rows.withColumn("weight", F.lit(1.0))
    ratio = class_balance(rows, []).select("pos_weight").scalar()
    return rows.withColumn("weight", F.when(F.col("target") == 1, F.coalesce(ratio, F.lit(1.0))).otherwise(1.0))


def featurise(rows: DataFrame, n_features: int = 1 << 18) -> DataFrame:
    """Rows with ``features`` in place of the text: hashed tokens, no dictionary is built."""
    hashing = HashingTF(inputCol="tokens", outputCol="features", numFeatures=n_features, binary=True)
    return hashing.transform(pair_features(rows)).drop("tokens", "text")


def fit_pair_model(train: DataFrame, epochs: int = 20, regularisation: float = 0.01) -> LogisticRegressionModel:
    """Fit on rows (features, target, weight); rows of unknown target (neither 0 nor 1) are left out."""
    return LogisticRegression(
        featuresCol="features",
        labelCol="target",
        weightCol="weight",
        maxIter=epochs,
        regParam=regularisation,
        standardization=False,
    ).fit(train.where(F.col("target").isin(0, 1)))


def score(model: LogisticRegressionModel, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows (with features) plus ``prob`` and the 0/1 ``pred``."""
    scored = model.transform(rows).withColumn("prob", vector_to_array("probability")[1])
    kept = [c for c in rows.columns if c != "features"]
    return scored.select(*kept, "prob", at_threshold(F.col("prob"), threshold).alias("pred"))


def score_with(
    rows: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], threshold: float = 0.5
) -> DataFrame:
    """Like ``score`` for any model: ``scorer`` maps a batch of rows to their probabilities."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(prob=scorer(frame).astype("float64"))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + ["prob double"]
    scored = rows.mapInPandas(batches, ", ".join(fields))
    return scored.withColumn("pred", at_threshold(F.col("prob"), threshold))
