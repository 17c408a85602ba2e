"""TF-IDF over security tokens, a row a document, and the three linear models.

A text is tokenised and its terms are counted inside its row, by Arrow batches.  The
vocabulary, the terms with the largest totals, is found without shuffling all terms:
every task keeps a bounded summary of its heavy hitters with a bound of what it lost, the
merged bounds prove which terms can be among the largest, and only those are counted
exactly.  These counts are stored, by row, and weights are made from them.  Models are
fitted by Spark; a fitted model is a small table of weights (at most MAX_FEATURES terms for
each label and fold), which is broadcast and scores a document in its row.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.text import ASCII_TOKEN_PATTERN, TOKEN_PATTERN, tokenize
from ..sources.scratch import bounded_batches, stored
from .fits import sigmoids, squared_hinge
from .ranks import BROADCAST_ROWS, stratified

MAX_FEATURES = 4000
#: Tokens, or bytes of texts, whose terms are counted together.
SLICE_TOKENS, SLICE_BYTES = 500_000, 4 << 20
#: Terms in the summary of a task: what is tried first, and then; beyond it all terms are shuffled.
CAPACITIES = (1 << 16, 1 << 19)
#: Candidates, in times the vocabulary's size, that are counted exactly before a larger summary is tried.
SPARE = 8

_ASCII, _ANY = re.compile(ASCII_TOKEN_PATTERN, re.ASCII), re.compile(TOKEN_PATTERN.removeprefix("(?U)"))


def tokens(df: DataFrame, id: str = "id", text: str = "text", tokenizer: Callable[[Column], Column] = tokenize, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, tokens and the kept columns; tokenizer: from a text to an array of strings.  A null text has no tokens.

    For the security tokeniser tokens are the text itself, which is tokenised where its terms are counted.
    """
    bounded_batches(df.sparkSession)
    if tokenizer is tokenize:
        return df.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("tokens"), *keep)
    none = F.array().cast("array<string>")
    return df.select(F.col(id).alias("id"), F.coalesce(tokenizer(F.col(text)), none).alias("tokens"), *keep)


@dataclass
class Coded:
    """The tokens of some rows: the different ones, the number of each, and how many each row has."""

    words: pa.Array
    code: np.ndarray
    sizes: np.ndarray


def coded(tokens: pa.Array) -> Coded:
    """Of rows of tokens, or of texts for the security tokeniser; a null row has none.

    Beside functions.text.tokenize, which says the same as a Column, this takes combining marks for no letters, as the original does.
    """
    if not (pa.types.is_string(tokens.type) or pa.types.is_large_string(tokens.type)):
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = tokens.flatten().dictionary_encode()
        return Coded(found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = number.__len__
    each = []
    for text in tokens.to_pylist():
        found = (_ASCII if text.isascii() else _ANY).findall(text) if text else ()
        each.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
    # the dictionary holds itself by this method: it would stay until Python looks for cycles, which strings hardly ever cause
    number.default_factory = None
    # only identifiers begin with a letter or '_'
    lower = [t.lower() if t[0] == "_" or t[0].isalpha() else t for t in number]
    found = pa.array(lower, pa.string()).dictionary_encode()
    of_raw = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    code = of_raw[np.concatenate(each)] if each else np.zeros(0, np.int64)
    return Coded(found.dictionary, code, np.array([len(x) for x in each], np.int64))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about SLICE_TOKENS tokens or SLICE_BYTES of text; a longer row stands alone."""
    column = batch.column("tokens")
    is_list = pa.types.is_list(column.type)
    sizes = pc.fill_null(pc.list_value_length(column) if is_list else pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    limit, ends, lo = SLICE_TOKENS if is_list else SLICE_BYTES, np.cumsum(sizes), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def heaviest(found: Coded, capacity: int) -> tuple[pa.Array, np.ndarray, int]:
    """The 1-grams and 2-grams that some rows hold most often, capacity at most, with their counts; and what any other one is at most."""
    n = max(len(found.words), 1)
    row = np.repeat(np.arange(len(found.sizes)), found.sizes)
    inside = row[1:] == row[:-1]
    pair, of_pair = np.unique(found.code[:-1][inside] * n + found.code[1:][inside], return_counts=True)
    count = np.concatenate([np.bincount(found.code, minlength=len(found.words)), of_pair])
    lost = int(np.partition(count, len(count) - capacity - 1)[len(count) - capacity - 1]) if len(count) > capacity else 0
    kept = count > lost
    one, two = kept[: len(found.words)], kept[len(found.words) :]
    first, second = (found.words.take(pa.array(x)) for x in (pair[two] // n, pair[two] % n))
    names = pa.concat_arrays([found.words.filter(pa.array(one)), pc.binary_join_element_wise(first, second, " ")])
    return names, count[kept], lost


class Summary:
    """Misra and Gries's counters: every term's total lies between its counter (0 without one) and that plus lost."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.held: list[tuple[pa.Array, np.ndarray]] = []
        self.rows = 0

    def add(self, names: pa.Array, count: np.ndarray, lost: int) -> None:
        self.held.append((names, count))
        self.rows += len(names)
        self.lost += lost
        if self.rows > 4 * self.capacity:
            self.merge()

    def merge(self) -> tuple[pa.Array, np.ndarray]:
        names, count = pa.concat_arrays([x for x, _ in self.held] or [pa.array([], pa.string())]), np.concatenate([np.zeros(0, np.int64), *(c for _, c in self.held)])
        merged = pa.table({"term": names, "n": count}).group_by("term").aggregate([("n", "sum")]).combine_chunks()
        names, count = (merged.column(c).combine_chunks() if merged.num_rows else pa.array([], t) for c, t in (("term", pa.string()), ("n_sum", pa.int64())))
        count = count.to_numpy(zero_copy_only=False)
        if len(count) > self.capacity:
            # every counter gives up as much as the largest that has to go
            cut = int(np.partition(count, len(count) - self.capacity - 1)[len(count) - self.capacity - 1])
            kept = count > cut
            names, count = names.filter(pa.array(kept)), count[kept] - cut
            self.lost += cut
        self.held, self.rows = [(names, count)], len(names)
        return names, count


def heavy_terms(tokenised: DataFrame, most: int, capacity: int) -> list[str] | None:
    """Terms that hold all of the `most` with the largest totals, SPARE times as many at most; None if the bounds don't prove it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(capacity)
        for batch in batches:
            for part in slices(batch):
                summary.add(*heaviest(coded(part.column("tokens")), capacity))
        names, count = summary.merge()
        pa.default_memory_pool().release_unused()  # the worker process stays for later tasks
        # the row without a term says what was lost
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([names, pa.array([None], pa.string())]), pa.array(np.append(count, summary.lost))], ["term", "n"])

    parts = stored(tokenised.select("tokens").mapInArrow(run, "term string, n long"))
    lost = parts.filter("term is null").agg(F.sum("n")).first()[0] or 0
    merged = stored(parts.filter("term is not null").groupBy("term").agg(F.sum("n").alias("n")))
    n, least = merged.orderBy(F.desc("n")).limit(most).agg(F.count("*"), F.min("n")).first()
    if lost and (n < most or lost >= least):
        return None
    enough = merged.filter(F.col("n") + lost >= least) if n == most else merged
    found = [r["term"] for r in enough.select("term").limit(SPARE * most + 1).collect()]
    return found if len(found) <= SPARE * most else None


class Terms:
    """Numbers of known terms, found in rows of tokens without writing out all that the rows hold."""

    def __init__(self, terms: list[str]):
        self.n = max(len(terms), 1)
        parts: dict[str, int] = {}
        part = lambda w: parts.setdefault(w, len(parts))
        single, pairs = {}, {}
        for i, term in enumerate(terms):
            single[part(term)] = i
            at = term.find(" ")
            while at >= 0:  # a token may hold a space, so any could be the pair's
                pairs[part(term[:at]), part(term[at + 1 :])] = i
                at = term.find(" ", at + 1)
        self.words = pa.array(list(parts), pa.string())
        self.single = np.full(len(parts) + 1, -1)
        self.single[list(single)] = list(single.values())
        self.width = len(parts) + 1
        keys = np.array([a * self.width + b for a, b in pairs] or [-1], np.int64)
        order = np.argsort(keys)
        self.keys, self.of_pair = keys[order], np.array(list(pairs.values()) or [0], np.int64)[order]

    def count(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, number and count of each known term that a row holds, by row and number."""
        found = coded(tokens)
        known = pc.fill_null(pc.index_in(found.words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        word = known[found.code] if len(found.code) else found.code
        row = np.repeat(np.arange(len(found.sizes)), found.sizes)
        single = self.single[word]
        both = np.flatnonzero((row[1:] == row[:-1]) & (word[:-1] >= 0) & (word[1:] >= 0))
        key = word[both] * self.width + word[both + 1]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        all_ = np.concatenate([(row * self.n + single)[single >= 0], row[both[hit]] * self.n + self.of_pair[at[hit]]])
        key, n = np.unique(all_, return_counts=True)
        return key // self.n, key % self.n, n


def fit_vocabulary(tokenised: DataFrame, docs: int, most: int = MAX_FEATURES) -> DataFrame:
    """term, df, total, idf of the terms with the largest totals (ties: smaller term)."""
    return _shown(tokenised, fit_features(tokenised, most, docs=docs).vocabulary)


def _shown(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    rows = list(zip(vocabulary.terms, vocabulary.df.tolist(), vocabulary.total.tolist(), vocabulary.idf.tolist()))
    return df.sparkSession.createDataFrame(rows, "term string, df long, total long, idf double")


@dataclass
class Vocabulary:
    """Terms in ascending order, and their idf; the rows that hold them and their totals where they were fitted."""

    terms: list[str]
    idf: np.ndarray
    df: np.ndarray | None = field(default=None, compare=False)
    total: np.ndarray | None = field(default=None, compare=False)

    @cached_property
    def index(self) -> Terms:
        return Terms(self.terms)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "index"}

    def weigh(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, number and weight of each known term that a row holds."""
        return self.weighed(*self.index.count(tokens), len(tokens))

    def weighed(self, row: np.ndarray, number: np.ndarray, n: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sublinear tf times idf, of Euclidean length 1 for each row."""
        w = (1.0 + np.log(n)) * self.idf[number]
        norm = np.sqrt(np.bincount(row, w * w, rows))
        return row, number, w / norm[row]


@dataclass
class Features:
    """Stored counts of candidate terms by row, the vocabulary among them, and each candidate's number in it (-1: none)."""

    rows: DataFrame
    vocabulary: Vocabulary
    number: np.ndarray
    docs: int


def fit_features(tokenised: DataFrame, most: int = MAX_FEATURES, keep: tuple[str, ...] = (), docs: int | None = None) -> Features:
    """Reads the texts twice: for the candidates, and to count them."""
    terms = next((t for c in CAPACITIES if (t := heavy_terms(tokenised, most, c)) is not None), None)
    if terms is None:
        terms = [r["term"] for r in all_totals(tokenised).orderBy(F.desc("total"), "term").limit(most).collect()]
    terms.sort(key=str.encode)
    shared = tokenised.sparkSession.sparkContext.broadcast(Terms(terms))
    names = ["id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, number, n = shared.value.count(part.column("tokens"))
                at = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (number, n)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *lists], [*names, "numbers", "counts"])

    kept = ", ".join(f"`{c}` {tokenised.schema[c].dataType.simpleString()}" for c in names)
    rows = stored(tokenised.select(*names, "tokens").mapInArrow(run, f"{kept}, numbers array<int>, counts array<int>"))
    width = len(terms)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            number = batch.column("numbers").flatten().to_numpy(zero_copy_only=False)
            df += np.bincount(number, minlength=width)
            total += np.bincount(number, batch.column("counts").flatten().to_numpy(zero_copy_only=False), width).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(df), pa.array(total)], ["number", "df", "total"])

    df, total = np.zeros(width, np.int64), np.zeros(width, np.int64)
    for r in rows.select("numbers", "counts").mapInArrow(sums, "number int, df long, total long").groupBy("number").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).collect():
        df[r["number"]], total[r["number"]] = r["df"], r["total"]
    best = np.sort(np.lexsort((np.arange(width), -total))[:most])
    number = np.full(width, -1)
    number[best] = np.arange(len(best))
    docs = rows.count() if docs is None else docs
    found = Vocabulary([terms[i] for i in best.tolist()], np.log((1.0 + docs) / (1.0 + df[best])) + 1.0, df[best], total[best])
    return Features(rows, found, number, docs)


def all_totals(tokenised: DataFrame) -> DataFrame:
    """term, total of every term, with all of them shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                names, n, _ = heaviest(coded(part.column("tokens")), 1 << 60)
                yield pa.RecordBatch.from_arrays([names, pa.array(n, pa.int64())], ["term", "total"])

    return tokenised.select("tokens").mapInArrow(run, "term string, total long").groupBy("term").agg(F.sum("total").alias("total"))


def weights(features: Features, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, indices (term numbers, ascending), weights, and the kept columns, for every row."""
    rows = features.rows
    shared = rows.sparkSession.sparkContext.broadcast((features.vocabulary, features.number))
    names = ["id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, w = stored_weights(batch, *shared.value)
            yield _weighted(batch, names, row, number, w)

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(*names, "numbers", "counts").mapInArrow(run, f"{kept}, indices array<int>, weights array<double>")


def stored_weights(batch: pa.RecordBatch, vocabulary: Vocabulary, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = pc.list_value_length(batch.column("numbers")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), sizes)
    number = numbers[batch.column("numbers").flatten().to_numpy(zero_copy_only=False)] if len(row) else np.zeros(0, np.int64)
    n, known = batch.column("counts").flatten().to_numpy(zero_copy_only=False), number >= 0
    return vocabulary.weighed(row[known], number[known], n[known], batch.num_rows)


def _weighted(batch: pa.RecordBatch, names: list[str], row: np.ndarray, number: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    at = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, pa.array(number.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(w))]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *lists], [*names, "indices", "weights"])


def collected(vocabulary: DataFrame) -> Vocabulary:
    rows = vocabulary.select("term", "idf").collect()  # at most MAX_FEATURES
    rows.sort(key=lambda r: r["term"].encode())
    return Vocabulary([r["term"] for r in rows], np.array([r["idf"] for r in rows], float))


def transform(tokenised: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, indices (term numbers, ascending), weights, and the kept columns, for every row."""
    shared = tokenised.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _weighted(part, names, *shared.value.weigh(part.column("tokens")))

    kept = ", ".join(f"`{c}` {tokenised.schema[c].dataType.simpleString()}" for c in names)
    return tokenised.select(*names, "tokens").mapInArrow(run, f"{kept}, indices array<int>, weights array<double>")


def vectors(weighted: DataFrame, size: int, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """The kept columns and features: sparse vectors for the ML estimators."""
    schema = StructType([*(weighted.schema[c] for c in keep), StructField("features", VectorUDT())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            parts = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), batch.column("indices"), batch.column("weights")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.StructArray.from_arrays(parts, names=["type", "size", "indices", "values"])], [*keep, "features"])

    return weighted.select(*keep, "indices", "weights").mapInArrow(run, schema)


def nb_fit(weighted: DataFrame, vocabulary: Vocabulary, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(number, term, label, logp) and (label, prior): multinomial naive Bayes on (indices, weights, label), prior unsmoothed; rows without a label play no part.

    Every task sums its rows by label and term, so the weights are read once and what is
    shuffled is at most the vocabulary for each label and task.
    """
    size = len(vocabulary.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            found = batch.column("label").dictionary_encode()
            sizes = pc.list_value_length(batch.column("indices")).to_numpy(zero_copy_only=False)
            label = np.repeat(found.indices.to_numpy(zero_copy_only=False), sizes)
            number, w = batch.column("indices").flatten().to_numpy(zero_copy_only=False), batch.column("weights").flatten().to_numpy(zero_copy_only=False)
            rows = np.bincount(found.indices.to_numpy(zero_copy_only=False), minlength=len(found.dictionary))
            for k, name in enumerate(found.dictionary.to_pylist()):
                mine = label == k
                own = sums.setdefault(name, np.zeros(size + 1))
                own[:size] += np.bincount(number[mine], w[mine], size)
                own[size] += rows[k]  # the last place counts rows
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], ["label", "number", "s"])

    rows = weighted.filter("label is not null").select("label", "indices", "weights")
    found = rows.mapInArrow(run, "label string, number int, s double").groupBy("label", "number").agg(F.sum("s").alias("s")).collect()  # a few labels, each with the vocabulary at most
    labels = sorted({r["label"] for r in found})
    s = np.zeros((len(labels), size + 1))
    for r in found:
        s[labels.index(r["label"]), r["number"]] = r["s"]
    counts, s = s[:, size], s[:, :size]
    logp = np.log((s + alpha) / (s.sum(axis=1, keepdims=True) + alpha * size)) if size else s
    spark = weighted.sparkSession
    model = [(i, t, x, float(logp[k, i])) for k, x in enumerate(labels) for i, t in enumerate(vocabulary.terms)]
    prior = [(x, float(np.log(counts[k] / counts.sum()))) for k, x in enumerate(labels)]
    return spark.createDataFrame(model, "number int, term string, label string, logp double"), spark.createDataFrame(prior, "label string, prior double")


@dataclass
class Linear:
    """A fitted model: weights[part, label, term] and offsets[part, label]; labels ascend.

    Without slopes the one part's largest margin wins.  With slopes, every part's margins
    become probabilities (sigmoid of slope * margin + shift, normalised), which are summed.
    """

    vocabulary: Vocabulary
    labels: list[str]
    weights: np.ndarray
    offsets: np.ndarray
    slopes: np.ndarray | None = None
    shifts: np.ndarray | None = None

    def choose(self, row: np.ndarray, number: np.ndarray, w: np.ndarray, rows: int) -> np.ndarray:
        """The number of each row's label; ties: the smaller label."""
        flat = self.weights.reshape(-1, self.weights.shape[2]).T
        margin = np.zeros((rows, flat.shape[1]))
        if len(row):
            begins = np.flatnonzero(np.diff(row, prepend=-1))
            margin[row[begins]] = np.add.reduceat(flat[number] * w[:, None], begins, axis=0)
        margin = margin.reshape(rows, *self.offsets.shape) + self.offsets
        if self.slopes is not None:
            p = 1 / (1 + np.exp(-np.clip(self.slopes * margin + self.shifts, -500, 500)))
            margin = p / np.maximum(p.sum(axis=2, keepdims=True), 1e-300)
        return margin.sum(axis=1).round(9).argmax(axis=1)

    def label_rows(self, tokens: pa.Array) -> pa.Array:
        return self.named(*self.vocabulary.weigh(tokens), len(tokens))

    def named(self, row: np.ndarray, number: np.ndarray, w: np.ndarray, rows: int) -> pa.Array:
        return pa.array(self.labels, pa.string()).take(pa.array(self.choose(row, number, w, rows)))


def predict(tokenised: DataFrame, model: Linear) -> DataFrame:
    """id, predicted for every row."""
    shared = tokenised.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("id"), shared.value.label_rows(part.column("tokens"))], ["id", "predicted"])

    return tokenised.select("id", "tokens").mapInArrow(run, f"id {tokenised.schema['id'].dataType.simpleString()}, predicted string")


def predict_rows(features: Features, model: Linear) -> DataFrame:
    """id, predicted for every row of the features that the model was fitted on."""
    shared = features.rows.sparkSession.sparkContext.broadcast((model, features.number))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, numbers = shared.value
        for batch in batches:
            found = stored_weights(batch, fitted.vocabulary, numbers)
            yield pa.RecordBatch.from_arrays([batch.column("id"), fitted.named(*found, batch.num_rows)], ["id", "predicted"])

    return features.rows.select("id", "numbers", "counts").mapInArrow(run, f"id {features.rows.schema['id'].dataType.simpleString()}, predicted string")


def nb_model(model: DataFrame, prior: DataFrame, vocabulary: Vocabulary) -> Linear:
    offsets = {r["label"]: r["prior"] for r in prior.collect()}
    labels = sorted(offsets)
    weights = np.zeros((1, len(labels), len(vocabulary.terms)))
    for r in model.select("number", "label", "logp").collect():  # labels times at most MAX_FEATURES
        weights[0, labels.index(r["label"]), r["number"]] = r["logp"]
    return Linear(vocabulary, labels, weights, np.array([[offsets[x] for x in labels]]))


def logistic(c: float = 10.0, n: float = 1, max_iter: int = 1000) -> LogisticRegression:
    """Multinomial; minimises C * sum of losses + half the squared weights, intercepts free."""
    return LogisticRegression(family="multinomial", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=max_iter)


def fit_logistic(train: DataFrame, vocabulary: Vocabulary, labels: list[str], c: float = 10.0, max_iter: int = 1000) -> Linear:
    """train: features and label (a label's number)."""
    fitted = logistic(c, train.count(), max_iter).fit(train)
    weights, offsets = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    # numbers above the largest in train have no row
    return Linear(vocabulary, labels[: len(weights)], weights[None], offsets[None])


def fit_svm(rows: DataFrame, vocabulary: Vocabulary, labels: list[str], folds: int = 3, c: float = 1.0, max_iter: int = 60) -> Linear:
    """One-vs-rest linear SVMs (squared hinge) over folds, each calibrated by a sigmoid on its own fold; probabilities are averaged.

    rows: id, indices, weights, label (a label's number).  Every fold holds its share of each
    label's ids (rows of one id stay together), no label passes through one task, and each
    pass serves all folds and labels.
    """
    rows = rows.select("id", "indices", "weights", F.col("label").cast("int").alias("label"))
    # only the ids are sorted
    ids = stored(stratified(rows.select("id", "label").distinct(), "label", ["id"], folds, name="_fold").select(F.struct("id", "label").alias("_key"), "_fold"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    folded = stored(rows.join(ids, F.struct("id", "label") == F.col("_key")).select("indices", "weights", "label", "_fold"))
    sizes = {r["_fold"]: r["count"] for r in folded.groupBy("_fold").count().collect()}
    which = np.array(sorted(sizes), np.int64)
    points = squared_hinge(folded, len(vocabulary.terms), len(labels), which, c, np.array([sizes[k] for k in sorted(sizes)], float), max_iter)
    slopes, shifts = sigmoids(folded, points, len(labels), which)
    shape = (len(which), len(labels))
    return Linear(vocabulary, labels, points[:-1].T.reshape(*shape, -1), points[-1].reshape(shape), slopes.reshape(shape), np.clip(shifts, -500, 500).reshape(shape))


MODELS = ("naive_bayes", "logistic_regression", "svm")
