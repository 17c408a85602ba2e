"""Benchmark decontamination by a Wu-Manber search over word sequences.

Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters.  The
patterns are the windows of 13 words of the items; an item of fewer words is one pattern.
Patterns of one length share a shift table over blocks of two words, which says how far the
search may jump; where the shift is 0, the bucket of the suffix block names the patterns
to compare, word hash by word hash and then character by character.  Documents are cut into
lanes that overlap by a window, and all lanes of a batch jump at once.

Null and empty texts have no words and no hits, and null or empty item texts no windows.
The windows of an item whose item_id is null mark words as hit; item_ids leaves it out.
Repeated rows give repeated results.  Items are taken in slices of bounded size, each
broadcast and searched in turn, so a benchmark of any size is searched in full.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import Words, mix64, ragged_sum_index, text_buffers, word_blocks
from .frames import map_arrow, prepare

#: Bytes of item texts that are broadcast at once.
SLICE_BYTES = 16 << 20
LANE = 256
SHIFT_BITS = 18
_BLOCK_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


class WordSearch:
    """All patterns of one length."""

    def __init__(self, patterns: np.ndarray):
        self.patterns = patterns
        n, self.m = patterns.shape
        self.block = min(2, self.m)
        farthest = self.m - self.block + 1
        self.shift = np.full(1 << SHIFT_BITS, farthest, np.uint8)
        for end in range(self.block - 1, self.m):
            key = self.key(patterns[:, end - 1] if self.block == 2 else None, patterns[:, end])
            at = (key >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)
            np.minimum.at(self.shift, at, np.uint8(self.m - 1 - end))
        suffix = self.key(patterns[:, -2] if self.block == 2 else None, patterns[:, -1])
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def key(self, before: np.ndarray | None, last: np.ndarray) -> np.ndarray:
        return mix64(last if before is None else before * _BLOCK_MULTIPLIER + last)

    def find(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word, pattern) of every occurrence by word hash; at: word offsets by document."""
        m = self.m
        ends = np.maximum(np.diff(at) - m + 1, 0)  # window ends of each document
        lanes = -(-ends // LANE)
        doc = np.repeat(np.arange(len(ends)), lanes)
        inner = (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        pos = at[:-1][doc] + m - 1 + inner
        stop = np.minimum(pos + LANE, at[1:][doc])
        found = []
        while len(pos):
            key = self.key(hashes[pos - 1] if self.block == 2 else None, hashes[pos])
            step = self.shift[(key >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)]
            here = step == 0
            if here.any():
                found.append(np.stack([pos[here], key[here].view(np.int64)]))
            pos = pos + np.maximum(step, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pos, key = np.concatenate(found, axis=1)
        key = key.view(np.uint64)
        low, high = np.searchsorted(self.suffix, key, "left"), np.searchsorted(self.suffix, key, "right")
        which = self.order[ragged_sum_index(low, high - low)]
        first = np.repeat(pos, high - low) - m + 1
        for k in range(m):
            same = hashes[first + k] == self.patterns[which, k]
            first, which = first[same], which[same]
        return first, which


class Searcher:
    """Windows of a slice of items."""

    def __init__(self, items: list[tuple[str | None, str]], width: int = 13):
        texts: dict[int, dict[bytes, int]] = defaultdict(dict)
        self.items: dict[int, list[set[str]]] = defaultdict(list)
        rows: dict[int, list[np.ndarray]] = defaultdict(list)
        for item, text in items:
            raw, offsets = text_buffers(pa.array([text]))
            words = Words(raw, offsets)
            n = len(words.hashes)
            if not n:
                continue
            m = min(n, width)
            for i in range(n - m + 1):
                said = window_text(words, i, m)
                if said not in texts[m]:
                    texts[m][said] = len(texts[m])
                    rows[m].append(words.hashes[i : i + m])
                    self.items[m].append(set())
                if item is not None:
                    self.items[m][texts[m][said]].add(item)
        self.texts = {m: list(t) for m, t in texts.items()}
        self.searches = {m: WordSearch(np.stack(r)) for m, r in rows.items()}

    def scan(self, words: Words) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, words, items) of every confirmed occurrence."""
        for m, search in self.searches.items():
            for first, which in zip(*(x.tolist() for x in search.find(words.hashes, words.at))):
                if window_text(words, first, m) == self.texts[m][which]:
                    yield first, m, self.items[m][which]


def window_text(words: Words, first: int, m: int) -> bytes:
    raw = words.raw
    return b" ".join(raw[words.starts[i] : words.ends[i]].tobytes().lower() for i in range(first, first + m))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_words, n_hit, item_ids (sorted as strings), contaminated (share * n_hit >= n_words > 0) for every row of (doc_id, text)."""
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = size // SLICE_BYTES + 1
    df = docs.select(*keep, "text")
    for k in range(slices):
        part = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k).collect()]
        df = _scan(df, spark.sparkContext.broadcast(part), width, share, keep, first=k == 0, last=k == slices - 1)
    return df


def _scan(df: DataFrame, part, width: int, share: int, keep: tuple[str, ...], first: bool, last: bool) -> DataFrame:
    made: list[Searcher] = []

    def of_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        if not made:
            made.append(Searcher(part.value, width))
        for lo, hi, words in word_blocks(batch.column("text")):
            cover = np.zeros(len(words.hashes) + 1, np.int64)
            named: dict[int, set[str]] = defaultdict(set)
            places: dict[int, list[int]] = defaultdict(list)
            for at, m, items in made[0].scan(words):
                doc = int(np.searchsorted(words.at, at, side="right")) - 1
                cover[at] += 1
                cover[at + m] -= 1
                named[doc] |= items
                places[doc] += [at - int(words.at[doc]), m]
            if not first:
                for doc, (old, names) in enumerate(zip(batch.column("_places").slice(lo, hi - lo).to_pylist(), batch.column("_items").slice(lo, hi - lo).to_pylist())):
                    places[doc] = old + places[doc]
                    named[doc] |= set(names)
                    for at, m in zip(old[::2], old[1::2]):
                        cover[words.at[doc] + at] += 1
                        cover[words.at[doc] + at + m] -= 1
            ids = {c: batch.column(c).slice(lo, hi - lo) for c in keep}
            names = pa.array([sorted(named[d]) if d in named else [] for d in range(hi - lo)], pa.list_(pa.string()))
            if last:
                hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
                n_hit, n_words = hit[words.at[1:]] - hit[words.at[:-1]], np.diff(words.at)
                yield ids | {"n_words": n_words, "n_hit": n_hit, "item_ids": names, "contaminated": (n_hit > 0) & (share * n_hit >= n_words)}
            else:
                yield ids | {"text": batch.column("text").slice(lo, hi - lo), "_places": pa.array([places[d] if d in places else [] for d in range(hi - lo)], pa.list_(pa.int64())), "_items": names}

    kept = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    schema = kept + ("n_words long, n_hit long, item_ids array<string>, contaminated boolean" if last else "text string, _places array<long>, _items array<string>")
    return map_arrow(df, of_batch, schema)
