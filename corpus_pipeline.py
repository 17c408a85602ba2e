"""From raw documents to packed training sequences: filter, deduplicate, decontaminate, pack.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
All but the last return the columns of docs, whatever they are; the last returns one row for
each packed piece.  A stage's output is written and read again before the next one.

Rows with a null text pass the two classifiers like empty texts; rows with a null doc_id
are scored, kept by the deduplication and packed, like any other.  Other columns are
carried along whatever their names are.  An empty table gives empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksentry.llm import decontaminate, near_duplicates, packing, quality, toxicity
from sparksentry.llm.frames import cut, if_small, shared_folder, table
from sparksentry.llm.labelled import fold

#: Chunks that a worker remembers while it packs: fewer than by default, since it also holds what earlier stages left.
PACKING_MEMO = 200_000


def _text_key() -> Column:
    return near_duplicates.text_key(F.coalesce("text", F.lit("")))


def _rejected(docs: DataFrame, scored: DataFrame, reject) -> DataFrame:
    """docs without the rows whose doc_id and text are rejected; scored: (doc_id, `_key`, ...) for every row."""
    gone = cut(scored.filter(reject).select(F.col("doc_id").alias("_gone"), F.col("_key").alias("_gone_key")).distinct())
    # the row in one column, so that no name of its columns can clash
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), _text_key().alias("_key"))
    same = F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_key") == F.col("_gone_key"))
    return keyed.join(if_small(gone), same, "left_anti").select("_row.*")


def _keyed(docs: DataFrame) -> DataFrame:
    lang = ["lang"] if "lang" in docs.columns else []
    return docs.select("doc_id", "text", *lang, _text_key().alias("_key"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), fold("_id", 5) != 0)
    return _rejected(docs, toxicity.score_toxicity(_keyed(docs), net, ("doc_id", "_key")), F.col("toxic_for_lang"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    votes = quality.fit_quality(docs, table(spark, sf_dir, "labels"), fold("_id", 4) != 2)
    return _rejected(docs, quality.score_quality(_keyed(docs), votes, ("doc_id", "_key")), F.col("score") < 0.7)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_keyed(docs), table(spark, sf_dir, "benchmark"), keep=("doc_id", "_key"))
    return _rejected(docs, found, F.col("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(docs, 2048, packing.tokenizer_path("word_bpe_49k.json"), end_id=0, memo=PACKING_MEMO)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: The classifiers and the packing can't be said in SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
