"""Text classifiers with their vocabulary: fit, predict, vote as a detector, save to a folder and load again.

A folder holds one Parquet table of one row for each model: labels, terms, idf and the
weights, at most MAX_FEATURES numbers for each label and fold.  It must be a folder that all
executors share.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from . import models

NAMES = list(models.MODELS)
_SCHEMA = "labels array<string>, terms array<string>, idf array<double>, parts int, weights array<double>, offsets array<double>, slopes array<double>, shifts array<double>"


@dataclass
class TextClassifier:
    name: str
    model: models.Linear
    tokenizer: Callable[[Column], Column] = tokenize

    def predict(self, docs: DataFrame) -> DataFrame:
        """id, predicted for every row of (id, text); a text without known terms, or a null one, gets what the model says of none."""
        return models.predict(models.tokens(docs, tokenizer=self.tokenizer), self.model)

    def of_texts(self, texts: Column) -> Column:
        """The label of each text of an array, for the ensemble; null for null."""
        model = self.model

        def label(tokens: pa.Array) -> pa.Array:
            rows = tokens.flatten()  # of tokens, or texts
            sizes = pa.compute.fill_null(pa.compute.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            mask = pa.compute.is_null(tokens) if tokens.null_count else None
            return pa.ListArray.from_arrays(pa.array(at), model.label_rows(rows), mask=mask)

        # Arrow UDFs know their kind by these hints
        label.__annotations__ = {"tokens": pa.Array, "return": pa.Array}
        return F.arrow_udf(label, "array<string>")(texts if self.tokenizer is tokenize else F.transform(texts, self.tokenizer))

    def save(self, folder: str) -> None:
        m = self.model
        flat = lambda x: None if x is None else x.ravel().tolist()
        row = (m.labels, m.vocabulary.terms, flat(m.vocabulary.idf), len(m.weights), flat(m.weights), flat(m.offsets), flat(m.slopes), flat(m.shifts))
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([row], _SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{self.name}")


def fit(name: str, docs: DataFrame, tokenizer: Callable[[Column], Column] = tokenize) -> TextClassifier:
    """Fits on the rows of (id, text, label) that have a text and a label; ValueError for an unknown name."""
    return train_all(docs, [name], tokenizer)[name]


def train_all(docs: DataFrame, names: list[str] | None = None, tokenizer: Callable[[Column], Column] = tokenize) -> dict[str, TextClassifier]:
    """The named models (all by default) over one vocabulary and one table of weights."""
    if unknown := set(names or ()) - set(NAMES):
        raise ValueError(f"unknown models {sorted(unknown)}; known are {NAMES}")
    docs = docs.select("id", "text", F.col("label").cast("string").alias("label")).na.drop()
    features = models.fit_features(models.tokens(docs, tokenizer=tokenizer, keep=("label",)), keep=("label",))
    weighted = models.weights(features, ("label",))
    return {name: TextClassifier(name, fit_weighted(name, weighted, features.vocabulary), tokenizer) for name in names or NAMES}


def fit_weighted(name: str, weighted: DataFrame, vocabulary: models.Vocabulary, max_iter: int | None = None) -> models.Linear:
    """The named model on (id, indices, weights, label); rows without a label play no part."""
    if name == "naive_bayes":
        return models.nb_model(*models.nb_fit(weighted, vocabulary), vocabulary)
    rows = weighted.filter("label is not null")
    labels = [r["label"] for r in rows.select("label").distinct().orderBy("label").collect()]  # a few
    number = F.array_position(F.array(*map(F.lit, labels)), F.col("label")).cast("double") - 1
    limit = {} if max_iter is None else {"max_iter": max_iter}
    if name == "svm":
        return models.fit_svm(rows.withColumn("label", number), vocabulary, labels, **limit)
    return models.fit_logistic(models.vectors(rows, len(vocabulary.terms), ("id", "label")).withColumn("label", number), vocabulary, labels, **limit)


def load(spark: SparkSession, name: str, folder: str) -> TextClassifier:
    """The saved model; FileNotFoundError if it wasn't saved there."""
    try:
        r = spark.read.parquet(f"{folder}/{name}").first()
    except AnalysisException as e:
        raise FileNotFoundError(f"no model {name} in {folder}: train and save it first") from e
    shape = (r["parts"], len(r["labels"]))
    shaped = lambda x, *more: None if x is None else np.array(x, float).reshape(*shape, *more)
    vocabulary = models.Vocabulary(list(r["terms"]), np.array(r["idf"], float))
    return TextClassifier(name, models.Linear(vocabulary, list(r["labels"]), shaped(r["weights"], len(r["terms"])), shaped(r["offsets"]), shaped(r["slopes"]), shaped(r["shifts"])))


def load_all(spark: SparkSession, folder: str) -> dict[str, TextClassifier]:
    return {name: load(spark, name, folder) for name in NAMES}
