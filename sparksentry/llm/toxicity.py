"""Toxicity by a small convolutional text classifier, trained in numpy.

A word is the sum of three hashed embeddings: of the word, and of its first four and first
five bytes.  Every hash bucket met in at least LEAST_DOCS training documents has an
embedding, rarer ones are the zero vector.  Filters of widths 1, 2 and 3 run over all
words, each is max pooled over the whole document, and a logistic unit reads the pools.
Embeddings, filters and output all start from noise and are trained together by Adam, with
word dropout, until the loss on training rows set aside no longer falls.  The language is no
input of the score: it only chooses among thresholds, which are calibrated on the rows set
aside and drawn towards the common threshold where a language has few toxic rows there.  A
sample with too few toxic rows to set some aside is fitted whole, and its thresholds are 0.5.

Null, empty and wordless texts get the score of an empty document.  Scores are rounded to 6
digits, as sums in single precision depend on the block a row is scored in: repeated rows
get equal scores but for that rounding.  Without labels of both kinds every score is the toxic
share (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import Words, ragged_sum_index, word_blocks
from .frames import map_arrow, prepare, release_memory
from .labelled import labelled_sample

HASH_BITS = 21
PREFIXES = (4, 5)
WIDTHS = (1, 2, 3)
DIM, FILTERS = 12, 8
SPAN = max(WIDTHS)
#: Training documents that a bucket is met in, to have an embedding.
LEAST_DOCS = 3
#: Labelled rows and bytes of text that are fitted on, in expectation.
FIT_ROWS, FIT_BYTES = 8_000, 12_000_000
EPOCHS, BATCH, RATE, DROPOUT, DECAY = 14, 64, 0.01, 0.2, 1e-4
#: Epochs, and steps, after which training ends if the loss on rows set aside hasn't fallen.
PATIENCE, PATIENCE_STEPS = 2, 100
#: Fewest toxic rows that the rows set aside are worth setting aside for.
LEAST_ASIDE = 10
#: Toxic rows set aside that weigh as much as the threshold they are drawn towards.
SHRINK = 20
#: Words scored together, so that memory doesn't grow with a text.
SCORE_WORDS = 1 << 17


def buckets(words: Words) -> np.ndarray:
    """[words, 3] hash buckets, each kind in its own range."""
    kinds = [words.hashes, *map(words.prefix_hashes, PREFIXES)]
    top = np.uint64(64 - HASH_BITS)
    return np.stack([(k >> top).astype(np.int64) + (i << HASH_BITS) for i, k in enumerate(kinds)], axis=1)


@dataclass
class ConvNet:
    """known: ascending buckets with an embedding; embed[0] is the zero vector of all others."""

    known: np.ndarray
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    base: float
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "slots"}

    @cached_property
    def slots(self) -> np.ndarray:
        """The row of the embedding table for each bucket."""
        out = np.zeros((1 + len(PREFIXES)) << HASH_BITS, np.int32)
        out[self.known] = np.arange(1, len(self.known) + 1)
        return out

    def convolved(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word vectors, and what each filter gives for the window that begins at each word, without bias."""
        x = self.embed[rows].sum(axis=1)
        y = np.zeros((len(rows), len(self.bias)), x.dtype)
        for k, (width, f) in enumerate(zip(WIDTHS, self.filters)):
            own = y[:, k * FILTERS : (k + 1) * FILTERS]
            for i in range(width):
                own[: len(x) - i] += x[i:] @ f[i * DIM : (i + 1) * DIM]
        return x, y

    def read(self, most: np.ndarray) -> np.ndarray:
        """Scores of pools without bias."""
        return 1 / (1 + np.exp(-(np.maximum(most + self.bias, 0) @ self.out + self.base).astype(np.float64)))

    def score(self, words: Words) -> np.ndarray:
        sizes = np.diff(words.at)
        most = np.zeros((len(sizes), len(self.bias)), np.float32)
        if len(words.hashes):
            slots = self.slots[buckets(words)]
            for rows, doc, starts, ends in stretches(slots, words.at):
                most[doc] = np.maximum(most[doc], pooled(self.convolved(rows)[1], starts, ends))
        return self.read(most)


def stretches(slots: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, documents, starts, ends) of bounded stretches of the words; of a document's part all windows fit in but at its own end."""
    for lo in range(0, len(slots), SCORE_WORDS):
        hi = min(lo + SCORE_WORDS, len(slots))
        doc = np.arange(np.searchsorted(at, lo, side="right") - 1, np.searchsorted(at, hi, side="left"))
        doc = doc[at[1:][doc] > at[:-1][doc]]
        first, last = np.maximum(at[:-1][doc], lo), np.minimum(at[1:][doc], hi)
        # the words behind the stretch that its last windows reach
        more = np.minimum(at[1:][doc], last + SPAN - 1)
        rows, starts = padded(slots, first, more - first)
        yield rows, doc, starts, starts + (last - first)


def padded(slots: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of word rows one after the other, each followed by zero rows that its last windows reach; and their starts."""
    room = sizes + SPAN - 1
    starts = np.cumsum(room) - room
    rows = np.zeros((int(room.sum()), slots.shape[1]), slots.dtype)
    rows[ragged_sum_index(starts, sizes)] = slots[ragged_sum_index(first, sizes)]
    return rows, starts


def pooled(y: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The most of each filter over the windows that begin from start to end, 0 (no word) at least."""
    spans = np.minimum(np.stack([starts, ends], axis=1).ravel(), len(y) - 1)
    return np.maximum(np.maximum.reduceat(y, spans, axis=0)[::2], 0)


def constant_net(share: float) -> ConvNet:
    share = min(max(share, 1e-3), 1 - 1e-3)
    n = FILTERS * len(WIDTHS)
    return ConvNet(np.zeros(0, np.int64), np.zeros((1, DIM), np.float32), [np.zeros((w * DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros(n, np.float32), np.zeros(n, np.float32), float(np.log(share / (1 - share))))


def common_buckets(texts: pa.Array, least: int = LEAST_DOCS) -> np.ndarray:
    """Buckets met in at least that many documents, ascending."""
    kinds = (1 + len(PREFIXES)) << HASH_BITS
    docs_of = np.zeros(kinds, np.int32)
    for _, _, words in word_blocks(texts):
        b, doc = buckets(words), words.doc_of()
        for kind in range(b.shape[1]):
            np.add.at(docs_of, np.unique(doc * np.int64(kinds) + b[:, kind]) % kinds, 1)
    return np.flatnonzero(docs_of >= least)


@dataclass
class Batch:
    """Padded word rows of some documents, where each begins and ends, and its label."""

    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    labels: np.ndarray


def gradients(net: ConvNet, b: Batch) -> tuple[float, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Loss; embedding rows with a gradient, those gradients; and the gradients of filters, bias, out and base."""
    x, y = net.convolved(b.rows)
    n = len(b.labels)
    place = np.zeros((n, len(net.bias)), np.int64)
    most = np.zeros((n, len(net.bias)), x.dtype)
    for i in np.flatnonzero(b.ends > b.starts).tolist():
        own = y[b.starts[i] : b.ends[i]]
        at = own.argmax(axis=0)
        place[i], most[i] = at + b.starts[i], own[at, np.arange(own.shape[1])]
    pool = np.maximum(np.maximum(most, 0) + net.bias, 0)
    z = pool @ net.out + net.base
    loss = float((np.logaddexp(0, z) - b.labels * z).sum() / n) + DECAY / 2 * float((net.out**2).sum() + sum((f**2).sum() for f in net.filters))
    d = ((1 / (1 + np.exp(-z)) - b.labels) / n).astype(x.dtype)
    of_out = pool.T @ d + DECAY * net.out
    of_pool = d[:, None] * net.out * (pool > 0)
    of_window = of_pool * (most > 0)
    of_filters, rows, parts = [], [], []
    for k, (width, f) in enumerate(zip(WIDTHS, net.filters)):
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        g, at = of_window[:, own], place[:, own]
        of_filter = DECAY * f
        for i in range(width):
            of_filter[i * DIM : (i + 1) * DIM] += np.einsum("df,dfc->cf", g, x[at + i])
            rows.append(b.rows[at + i].reshape(-1, b.rows.shape[1]))
            parts.append((g[:, :, None] * f[i * DIM : (i + 1) * DIM].T).reshape(-1, DIM))
        of_filters.append(of_filter)
    rows, parts = np.concatenate(rows), np.concatenate(parts)
    some = parts.any(axis=1)
    flat, parts = rows[some].ravel(), np.repeat(parts[some], rows.shape[1], axis=0)
    touched, where = np.unique(flat[flat > 0], return_inverse=True)
    of_embed = np.zeros((len(touched), DIM), x.dtype)
    np.add.at(of_embed, where, parts[flat > 0])
    return loss, touched, of_embed, [*of_filters, of_pool.sum(axis=0), of_out, np.array([d.sum()], x.dtype)]


class Adam:
    """Adam's moments of each parameter; rows: only those are stepped."""

    def __init__(self, params: list[np.ndarray]):
        self.params, self.steps = params, 0
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]

    def step(self, grads: list[np.ndarray], rows: list[np.ndarray | None]) -> None:
        self.steps += 1
        for p, (first, second), g, r in zip(self.params, self.moments, grads, rows):
            r = slice(None) if r is None else r
            m, v = first[r], second[r]
            m, v = m + 0.1 * (g - m), v + 0.001 * (g * g - v)
            first[r], second[r] = m, v
            p[r] -= RATE * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)


def train(texts: pa.Array, labels: np.ndarray, langs: list[str | None], epochs: int = EPOCHS, seed: int = 7) -> ConvNet:
    share = float(labels.mean()) if len(labels) else 0.5
    if not 0 < labels.sum() < len(labels):
        return constant_net(share)
    rng = np.random.default_rng(seed)
    aside = rng.random(len(labels)) < 0.15
    if not 0 < labels[~aside].sum() < (~aside).sum() or labels[aside].sum() < LEAST_ASIDE:
        aside[:] = False  # too few to judge by: all rows are fitted on, for all epochs
    own, check = np.flatnonzero(~aside), np.flatnonzero(aside if aside.any() else ~aside)
    y = labels.astype(np.float32)
    net = constant_net(share)
    net.known = common_buckets(texts.filter(pa.array(~aside)))
    net.embed = rng.normal(0, 0.1, (len(net.known) + 1, DIM)).astype(np.float32)
    net.embed[0] = 0
    net.filters = [rng.normal(0, DIM**-0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    net.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
    made = [(net.slots[buckets(words)], np.diff(words.at)) for _, _, words in word_blocks(texts)]
    # the table of slots and the powers aren't needed while it is trained
    net.__dict__.pop("slots", None)
    sizes = np.concatenate([n for _, n in made])
    slots, at = np.empty((int(sizes.sum()), 1 + len(PREFIXES)), np.int32), 0
    made.reverse()
    while made:
        some = made.pop()[0]
        slots[at : at + len(some)] = some
        at += len(some)
    del texts
    release_memory()
    first = np.cumsum(sizes) - sizes
    base = np.array([net.base], np.float32)
    params = [net.embed, *net.filters, net.bias, net.out, base]
    adam = Adam(params)
    least, best, worse = np.inf, [p.copy() for p in params], 0
    size = min(BATCH, max(8, len(own) // 50))
    patience = max(PATIENCE, PATIENCE_STEPS * size // len(own))
    for _ in range(max(epochs, min(40, 8_000 // len(own)))):
        for some in np.array_split(rng.permutation(own), max(1, len(own) // size)):
            rows, starts = padded(slots, first[some], sizes[some])
            rows[rng.random(rows.shape, np.float32) < DROPOUT] = 0
            net.base = float(base[0])
            _, touched, of_embed, others = gradients(net, Batch(rows, starts, starts + sizes[some], y[some]))
            adam.step([of_embed, *others], [touched, *[None] * len(others)])
        net.base = float(base[0])
        p = np.clip(pools_score(net, slots, first[check], sizes[check]), 1e-9, 1 - 1e-9)
        loss = -np.log(np.where(y[check] > 0, p, 1 - p)).mean()
        if loss < least - 1e-4:
            least, best, worse = loss, [p.copy() for p in params], 0
        else:
            worse += 1
            if worse >= patience and aside.any():
                break
    for p, b in zip(params, best):
        p[...] = b
    net.base = float(base[0])
    if aside.any():
        net.thresholds = calibrated(pools_score(net, slots, first[check], sizes[check]), labels[check], [langs[i] for i in check])
    return net


def pools_score(net: ConvNet, slots: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Scores of documents given by where their words' rows begin and how many they are."""
    out = []
    for lo in range(0, len(first), 256):
        rows, starts = padded(slots, first[lo : lo + 256], sizes[lo : lo + 256])
        n = sizes[lo : lo + 256]
        most = np.zeros((len(n), len(net.bias)), np.float32)
        full = n > 0
        if full.any():
            most[full] = pooled(net.convolved(rows)[1], starts[full], (starts + n)[full])
        out.append(net.read(most))
    return np.concatenate(out)


def calibrated(scores: np.ndarray, truth: np.ndarray, langs: list[str | None]) -> dict[str | None, float]:
    """The common threshold (under None) and each language's: the best by F1, as log odds drawn to 0.5 and to the common one."""

    def drawn(own: np.ndarray, towards: float) -> float:
        n = int(truth[own].sum())
        odds = lambda p: float(np.log(p / (1 - p)))
        t = min(max(best_threshold(scores[own], truth[own]), 0.02), 0.98)
        z = (n * odds(t) + SHRINK * odds(towards)) / (n + SHRINK)
        return float(1 / (1 + np.exp(-z)))

    common = drawn(np.ones(len(scores), bool), 0.5)
    out: dict[str | None, float] = {None: common}
    for lang in sorted({x for x in langs if x is not None}):
        out[lang] = drawn(np.array([x == lang for x in langs]), common)
    return out


def best_threshold(scores: np.ndarray, truth: np.ndarray) -> float:
    """The middle of the widest range of thresholds with the largest F1; 0.5 if nothing is toxic."""
    if not truth.sum():
        return 0.5
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(truth[order])
    f1 = 2 * hits / (np.arange(1, len(scores) + 1) + truth.sum())
    ranked = np.concatenate([scores[order], [0.0]])
    f1 = np.where(ranked[:-1] > ranked[1:], f1, -1)
    at = int(np.argmax(f1))
    return float((ranked[at] + ranked[at + 1]) / 2)


def score_texts(net: ConvNet, texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts))
    for first, last, words in word_blocks(texts):
        out[first:last] = net.score(words)
    return out.round(6)


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> ConvNet:
    """Trains on labelled rows of (doc_id, text, lang) whose label's `_id` is usable (all by default)."""
    prepare(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", F.lit(True) if usable is None else usable, FIT_ROWS, FIT_BYTES)
    once = sample.group_by("text", use_threads=False).aggregate([("label", "max"), ("lang", "first")]) if len(sample) else sample
    texts = once.column("text").combine_chunks() if len(once) else pa.array([], pa.string())
    y = once.column("label_max").to_numpy().astype(int) if len(once) else np.zeros(0, int)
    langs = once.column("lang_first").to_pylist() if len(once) else []
    del sample, once
    net = train(texts, y, langs)
    del texts
    release_memory()
    return net


def score_toxicity(docs: DataFrame, net: ConvNet, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, score, and the verdict by the language's own threshold, for every row of (doc_id, text, lang)."""
    spark = docs.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(net)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double, lang_threshold double, toxic_for_lang boolean"])

    def of_batch(batch: pa.RecordBatch) -> dict:
        net = model.value
        score = score_texts(net, batch.column("_text"))
        default = net.thresholds.get(None, 0.5)
        threshold = np.array([net.thresholds.get(x, default) for x in batch.column("_lang").to_pylist()], float)
        return {c: batch.column(c) for c in keep} | {"score": score, "lang_threshold": threshold, "toxic_for_lang": score >= threshold}

    return map_arrow(docs.select(*keep, F.col("text").alias("_text"), lang.alias("_lang")), of_batch, schema)
