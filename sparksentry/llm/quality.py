"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A document is a vector of hashed terms: its words, each word's letter case with the
separator behind it, word lengths, and repetitions of a word close before.  Counts are
damped by a logarithm, weighted by inverse document frequency and projected on the first
singular vectors of the labelled sample.  The labelled latent vectors, bounded in number,
are broadcast; every document's cosine with all of them is computed in blocks, and the
nearest ones vote, each weighted by the fourth power of its similarity.

Null, empty and wordless texts have a zero vector; they get the share of good labels, as all
documents do if there are no labels (then 0.5).  Scores are rounded to 6 digits, as sums in
single precision depend on the block a row is scored in: repeated rows get equal scores but
for that rounding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import Words, mix64, span_hashes, word_blocks
from .frames import map_arrow, prepare, release_memory
from .labelled import labelled_sample

WORD_TERMS, SHAPE_TERMS, LENGTH_TERMS, REPEAT_TERMS = 512, 480, 16, 16
TERMS = WORD_TERMS + SHAPE_TERMS + LENGTH_TERMS + REPEAT_TERMS
#: Most labelled vectors, latent dimensions, voting neighbours, and documents scored at once.
VECTORS, LATENT, NEIGHBOURS, BLOCK_DOCS = 6_000, 48, 15, 512


def term_counts(words: Words) -> np.ndarray:
    """[documents, TERMS] counts."""
    n, docs = len(words.hashes), len(words.at) - 1
    if not n:
        return np.zeros((docs, TERMS), np.float32)
    doc = words.doc_of()
    h, s, e = words.hashes, words.starts, words.ends
    upper = np.concatenate([[0], np.cumsum((words.raw >= 65) & (words.raw <= 90))])
    n_upper, length = upper[e] - upper[s], e - s
    first_upper = (words.raw[s] >= 65) & (words.raw[s] <= 90)
    case = np.where(n_upper == 0, 0, np.where(n_upper * 2 > length, np.where(length > 1, 2, 1), np.where(first_upper, 1, 3)))
    doc_end = words.offsets[1:][doc]
    after = np.minimum(np.concatenate([s[1:], [len(words.raw)]]), doc_end)
    separator = span_hashes(words.raw, e, np.minimum(after, e + 6))
    last = np.concatenate([doc[1:] != doc[:-1], [True]])
    shape = mix64(np.where(last, np.uint64(1), separator) * np.uint64(4) + case.astype(np.uint64))
    terms = [(h % np.uint64(WORD_TERMS)).astype(np.int64), WORD_TERMS + (shape % np.uint64(SHAPE_TERMS)).astype(np.int64), WORD_TERMS + SHAPE_TERMS + np.minimum(length, LENGTH_TERMS - 1)]
    for back in (1, 2, 3):
        same = np.zeros(n, bool)
        same[back:] = (h[back:] == h[:-back]) & (doc[back:] == doc[:-back])
        terms.append(WORD_TERMS + SHAPE_TERMS + LENGTH_TERMS + 2 * back + same)
    flat = np.concatenate([doc * TERMS + t for t in terms])
    return np.bincount(flat, minlength=docs * TERMS).reshape(docs, TERMS).astype(np.float32)


@dataclass
class LatentVotes:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        z = x @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def vote(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.share)
        z = self.latent(counts)
        cosine = z @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < len(self.labels) else np.tile(np.arange(k), (len(z), 1))
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** 4
        total = weight.sum(axis=1)
        score = np.where(total > 0, (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-300), self.share)
        return np.where(counts.any(axis=1), np.clip(score, 0, 1), self.share)


def fit_votes(texts: pa.Array, labels: np.ndarray) -> LatentVotes:
    if not len(texts):
        return LatentVotes(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    counts = np.empty((len(texts), TERMS), np.float32)
    for first, last, words in word_blocks(texts):
        counts[first:last] = term_counts(words)
    filled = counts.any(axis=1)
    counts, y = counts if filled.all() else counts[filled], labels[filled]
    share = float(labels.mean())
    if not len(y):
        return LatentVotes(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), share)
    idf = (np.log((1 + len(y)) / (1 + (counts > 0).sum(axis=0))) + 0.1).astype(np.float32)
    # in place, as LatentVotes.latent does it
    x = np.log1p(counts, out=counts)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    _, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    votes = LatentVotes(idf, np.ascontiguousarray(axes[:, ::-1][:, :LATENT]).astype(np.float32), np.zeros((0, LATENT), np.float32), np.zeros(0), share)
    z = x @ votes.axes
    votes.vectors = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    votes.labels = y.astype(np.float64)
    return votes


def score_votes(votes: LatentVotes, texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts))
    for first, last, words in word_blocks(texts):
        counts = term_counts(words)
        for lo in range(0, last - first, BLOCK_DOCS):
            out[first + lo : min(first + lo + BLOCK_DOCS, last)] = votes.vote(counts[lo : lo + BLOCK_DOCS])
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> LatentVotes:
    """Fits on at most about VECTORS labelled rows of (doc_id, text) whose label's `_id` is usable."""
    prepare(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", F.lit(True) if usable is None else usable, rows=VECTORS)
    texts = sample.column("text").combine_chunks() if len(sample) else pa.array([], pa.string())
    y = sample.column("label").to_numpy() if len(sample) else np.zeros(0)
    del sample
    votes = fit_votes(texts, y)
    del texts
    release_memory()
    return votes


def score_quality(docs: DataFrame, votes: LatentVotes, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and score for every row of (doc_id, text)."""
    spark = docs.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(votes)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double"])

    def of_batch(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(c) for c in keep} | {"score": score_votes(model.value, batch.column("_text")).round(6)}

    return map_arrow(docs.select(*keep, F.col("text").alias("_text")), of_batch, schema)
