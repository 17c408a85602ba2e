"""Ranked lexical search with an impact-ordered index, score at a time.

A term's weight is w = floor(1000 * ln((2N + 2) / (2 df + 1))); a document of n terms has
m = 75 + (25 n N) div L; a posting's impact is w * ((10^9 tf) div (1000 tf + 12 m)), an
integer.  N, L and df are counts over all rows that have terms.  A document's score for an
item is the sum of the impacts of the item's terms, repeats included.

The index has a row for each block of documents: for every term the distinct impacts,
descending, and for each of them the documents that have exactly it.  An item is answered
by adding groups of postings in descending order of what they contribute.  What the next
group of each of its terms could still add bounds what any document can gain; this goes on
until that is less than the k-th best score so far, so that no document without a score can enter,
and few documents are left that could.  Their scores are then completed from their own
postings.  Nothing is cut off: if bounds never prove it, all postings are added.

Items are taken in slices of bounded size, each broadcast, so any number of them is
answered.  Distinct rows of items are items of their own, whatever their ids (null too); a
null text has no terms, and an item without terms or matches gets no rows.  Every row of the
documents is a document: repeated rows count, and rank next to one another; a null doc_id
stands behind the others.  Empty tables give empty results, other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrowtext import Words, ragged_sum_index, text_buffers, word_blocks
from .frames import cut, map_arrow, prepare, stored

#: Bytes of item texts that are answered at once.
SLICE_BYTES = 16 << 20
#: Postings of an index block; one document's postings are never divided.
BLOCK_POSTINGS = 1 << 19
#: Documents that may be left to complete before postings are added no longer.
FEW = 256


class Vocabulary:
    """Numbers of known terms, found by hash and compared byte by byte."""

    def __init__(self, terms: list[bytes]):
        raw, offsets = text_buffers(pa.array([b" ".join(terms).decode()]))
        words = Words(raw, offsets)
        self.lower, self.starts, self.sizes = words.lower, words.starts, words.ends - words.starts
        self.order = np.argsort(words.hashes, kind="stable")
        self.hashes = words.hashes[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms share a hash")

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, term) of every known word."""
        at = np.searchsorted(self.hashes, words.hashes)
        word = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == words.hashes)
        term = self.order[at[word]]
        size = self.sizes[term]
        alike = words.ends[word] - words.starts[word] == size
        word, term, size = word[alike], term[alike], size[alike]
        if len(word):
            same = words.lower[ragged_sum_index(words.starts[word], size)] == self.lower[ragged_sum_index(self.starts[term], size)]
            alike = np.logical_and.reduceat(same, np.cumsum(size) - size)
            word, term = word[alike], term[alike]
        return word, term


def terms_of(text: str) -> list[bytes]:
    words = Words(*text_buffers(pa.array([text])))
    return [words.lower[a:b].tobytes() for a, b in zip(words.starts.tolist(), words.ends.tolist())]


def document_terms(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms in all), terms (numbers of the vocabulary's, ascending) and tfs of every row that has terms."""

    def of_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = batch.column("doc_id")
        for first, last, words in word_blocks(batch.column("text")):
            n = np.diff(words.at)
            width = max(1, len(vocabulary.value.order))
            word, term = vocabulary.value.find(words)
            key, tf = np.unique(words.doc_of()[word] * width + term, return_counts=True)
            some = np.flatnonzero(n)
            ends = np.searchsorted(key, np.append(some * width, (last - first) * width))
            at = pa.array(ends.astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (key % width, tf)]
            yield {"doc_id": ids.slice(first, last - first).take(pa.array(some)).cast(pa.int64()), "n": n[some], "terms": lists[0], "tfs": lists[1]}

    return map_arrow(docs.select("doc_id", "text"), of_batch, "doc_id long, n long, terms array<int>, tfs array<int>")


@dataclass
class Statistics:
    """Documents, their terms in all, and each term's weight."""

    documents: int
    total: int
    weights: np.ndarray

    def impacts(self, n: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 75 + 25 * n * self.documents // self.total
        return self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m))


def statistics(postings: DataFrame, terms: int) -> Statistics:
    """Counts over all rows of document_terms; what reaches the driver is a count for each of the vocabulary's terms."""
    n, total = postings.agg(F.count("*"), F.sum("n")).first()
    df = {r["term"]: r["count"] for r in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) if t in df else 0 for t in range(terms)]
    return Statistics(n, total or 1, np.array(weights, np.int64))


INDEX = "docs array<long>, terms array<int>, term_ends array<int>, impacts array<long>, impact_ends array<int>, places array<int>"


def impact_index(postings: DataFrame, stats) -> DataFrame:
    """A row for each block of documents; postings without impact are left out.

    docs: the documents' ids; terms: ascending, each with its impacts up to term_ends; impacts:
    descending in a term, each with its documents, as places in docs, up to impact_ends.
    """

    def block(ids: list[pa.Array], parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        doc, term, impact = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((doc, -impact, term))
        doc, term, impact = doc[order], term[order], impact[order]
        group = np.ones(len(doc), bool)
        group[1:] = (np.diff(term) != 0) | (np.diff(impact) != 0)
        ends = np.append(np.flatnonzero(group)[1:], len(doc)) if len(doc) else np.zeros(0, np.int64)
        of_group = term[group]
        new = np.ones(len(of_group), bool)
        new[1:] = np.diff(of_group) != 0
        term_ends = np.append(np.flatnonzero(new)[1:], len(of_group)) if len(of_group) else np.zeros(0, np.int64)
        one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x.astype(kind)))
        columns = {"docs": one(pa.concat_arrays(ids), None), "terms": one(of_group[new], np.int32), "term_ends": one(term_ends, np.int32), "impacts": one(impact[group], np.int64), "impact_ends": one(ends, np.int32), "places": one(doc, np.int32)}
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held, docs = 0, 0
        for batch in batches:
            terms, tfs = batch.column("terms"), batch.column("tfs")
            sizes = pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
            term, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, tfs))
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            impact = stats.value.impacts(batch.column("n").to_numpy(zero_copy_only=False)[doc], term, tf)
            ends = np.cumsum(sizes)
            lo = 0
            while lo < batch.num_rows:
                before = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + BLOCK_POSTINGS - held, side="right")))
                mine = np.arange(before, int(ends[hi - 1]))
                mine = mine[impact[mine] > 0]
                parts.append((doc[mine] - lo + docs, term[mine], impact[mine]))
                ids.append(batch.column("doc_id").slice(lo, hi - lo))
                held, docs, lo = held + int(ends[hi - 1]) - before, docs + hi - lo, hi
                if held >= BLOCK_POSTINGS or lo < batch.num_rows:
                    yield block(ids, parts)
                    ids, parts, held, docs = [], [], 0, 0
        if ids:
            yield block(ids, parts)

    return postings.select("doc_id", "n", "terms", "tfs").mapInArrow(run, INDEX)


class Block:
    """One row of the index, ready to be searched."""

    def __init__(self, row: dict[str, np.ndarray], ids: pa.Array):
        self.ids = ids
        self.id = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        self.terms, self.impacts, self.places = row["terms"], row["impacts"], row["places"]
        self.groups = np.concatenate([[0], row["term_ends"]]).astype(np.int64)
        self.at = np.concatenate([[0], row["impact_ends"]]).astype(np.int64)
        # ascending: by term, and by impact from the largest
        self.top = int(self.impacts.max(initial=0)) + 1
        of_group = np.repeat(np.arange(len(self.terms)), np.diff(self.groups))
        self.key = of_group * (self.top + 1) + (self.top - self.impacts)
        self.impact = np.repeat(self.impacts, np.diff(self.at))
        # the same postings document by document
        order = np.argsort(self.places, kind="stable")
        self.own_term = np.repeat(self.terms[of_group], np.diff(self.at))[order]
        self.own_impact = self.impact[order]
        self.own_at = np.searchsorted(self.places[order], np.arange(len(ids) + 1))

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, score) of the documents that can be among the item's k best: scores are exact, and none is below least or 1."""
        spot = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        here = self.terms[spot] == terms if len(self.terms) else np.zeros(len(terms), bool)
        spot, q, term = spot[here], times[here], terms[here]
        score = np.zeros(len(self.id), np.int64)
        if not len(spot):
            return np.zeros(0, np.int64), score[:0]
        now, end = self.groups[spot], self.groups[spot + 1]
        level = int((q * self.impacts[now]).max())
        while True:
            # all groups that contribute at least the level
            level = max(1, level // 2)
            then = np.searchsorted(self.key, spot * (self.top + 1) + np.maximum(self.top - -(-level // q), -1), side="right")
            then = np.clip(then, now, end)
            size = self.at[then] - self.at[now]
            post = ragged_sum_index(self.at[now], size)
            np.add.at(score, self.places[post], self.impact[post] * np.repeat(q, size))
            now = then
            open_ = now < end
            rest = int((q * np.where(open_, self.impacts[np.minimum(now, len(self.impacts) - 1)], 0)).sum())
            bound = max(least, 1)
            if len(score) >= k:
                bound = max(bound, int(np.partition(score, len(score) - k)[-k]))
            left = np.flatnonzero((score + rest >= bound) & (score > 0)) if rest < bound else None
            if not rest or left is not None and len(left) <= max(FEW, k):
                break
        if rest:
            # from the documents' own postings
            asked = np.zeros(max(int(self.terms[-1]), int(term.max())) + 1, np.int64)
            asked[term] = q
            size = self.own_at[left + 1] - self.own_at[left]
            post = ragged_sum_index(self.own_at[left], size)
            whole = np.concatenate([[0], np.cumsum(asked[self.own_term[post]] * self.own_impact[post])])
            ends = np.cumsum(size)
            score[left] = whole[ends] - whole[ends - size]
        keep = left[score[left] >= bound]
        return keep, score[keep]


def search(index: DataFrame, items, k: int) -> DataFrame:
    """The items' k best of every task, as item (its number), item_id, doc_id, score; items: a broadcast list of (item_id, terms, times)."""
    kind = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items.value)
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "term_ends", "impacts", "impact_ends", "places")}
                block = Block(row, batch.column("docs")[r].values)
                for i, (_, terms, times) in enumerate(items.value):
                    ids, scores = found[i]
                    least = int(scores[-1]) if len(scores) == k else 1
                    place, score = block.best(terms, times, k, least)
                    if len(place):
                        ids, scores = np.concatenate([ids, block.id[place]]), np.concatenate([scores, score])
                        order = np.lexsort((ids, -scores))[:k]
                        found[i] = ids[order], scores[order]
        sizes = [len(ids) for ids, _ in found]
        if sum(sizes):
            ids, scores = (np.concatenate(x) for x in zip(*found))
            number = np.repeat(np.arange(len(found)), sizes)
            named = pa.array([x for x, _, _ in items.value], pa.string()).take(pa.array(number))
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), named, pa.array(ids, kind, mask=ids == np.iinfo(np.int64).max), pa.array(scores)], ["item", "item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item int, item_id string, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best rows of (doc_id, text) for each distinct row of (item_id, text), scores above 0, ties by doc_id."""
    spark = docs.sparkSession
    prepare(spark)
    kind = items.schema["item_id"].dataType.simpleString()
    asked = cut(items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null").distinct())
    slices = (asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SLICE_BYTES + 1
    made = None
    for s in range(slices):
        rows = [tuple(r) for r in asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == s).collect()]
        counted = [(item, c) for item, c in ((item, Counter(terms_of(text))) for item, text in rows) if c]
        terms = sorted({t for _, c in counted for t in c})
        if not terms:
            continue
        number = {t: i for i, t in enumerate(terms)}
        told = [(item, np.array([number[t] for t in sorted(c)], np.int64), np.array([c[t] for t in sorted(c)], np.int64)) for item, c in counted]
        postings = stored(document_terms(docs, spark.sparkContext.broadcast(Vocabulary(terms))))
        stats = spark.sparkContext.broadcast(statistics(postings, len(terms)))
        index = stored(impact_index(postings, stats))
        part = search(index, spark.sparkContext.broadcast(told), k).withColumn("item", F.col("item") + F.lit(s).cast("long") * (1 << 32))
        made = part if made is None else made.unionByName(part)
    if made is None:
        made = spark.createDataFrame([], "item long, item_id string, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = made.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")
