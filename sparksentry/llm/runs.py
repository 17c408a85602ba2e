"""Periodic runs of words: all maximal repetitions of every document, and the text without their repeats.

Words are maximal stretches without ASCII white space.  A run of period q is a stretch in
which words q apart are identical, q is the smallest such number, and no neighbouring word
extends it.  Only runs of at least `least` words and `exponent` periods are reported.

Documents of a block are ranked together by prefix doubling: classes of equal stretches of
1, 2, 4, ... words, each refined only where stretches still tie.  The last ranks are the
suffix array; the classes give common prefixes and suffixes of any two places.  Suffix
array and LCP give the longest previous factor of every place, and these the LZ blocks.  A
run that crosses or touches a block's boundary is found by Main's extensions to both sides
of it; a run strictly inside a block is a copy of one inside the block's source.  A word
counts as a word of its document alone, so no stretch leaves it.

A document is handled whole inside one task, in memory that grows with its length; nothing
is shuffled.  A null text has no words, runs or text; an empty one has no words and no
runs.  Repeated rows give repeated results, an empty table none, other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import doc_blocks, mix64, ragged_sum_index, text_buffers
from .frames import map_arrow, prepare

#: Bytes of documents that are ranked together; a longer document stands alone.
BLOCK = 2 << 20
#: Pairs of a boundary and a period that are tried together.
PAIRS = 1 << 21


class Classes:
    """Classes of equal stretches of 2^k words of some sequences, and the order of their suffixes.

    codes: a number for each word; at: offsets of the sequences.  A class is named by the place
    of its first member in the sorted order, so names of one level are in suffix order.
    """

    def __init__(self, codes: np.ndarray, at: np.ndarray):
        n = self.n = len(codes)
        own = np.repeat(np.arange(len(at) - 1), np.diff(at))
        key = own * (int(codes.max(initial=0)) + 1) + codes
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = np.diff(key[order]) != 0
        name = np.empty(n + 1, np.int32)
        name[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        name[n] = -1
        self.levels = [name]
        # members of classes of two or more, by class
        tied = order[~new | ~np.append(new[1:], True)]
        step = 1
        while len(tied):
            after = tied + step
            # what leaves the last sequence is alone: two stretches can't end at one place
            then = np.where(after < n, name[np.minimum(after, n)], after).astype(np.int64)
            key = name[tied].astype(np.int64) * (2 * n + 1 + step) + then
            order = np.argsort(key, kind="stable")
            tied, key = tied[order], key[order]
            old = name[tied]
            group = np.ones(len(tied), bool)
            group[1:] = np.diff(old) != 0
            new = np.ones(len(tied), bool)
            new[1:] = np.diff(key) != 0
            spot = np.arange(len(tied))
            first = np.maximum.accumulate(np.where(group, spot, 0))
            name = name.copy()
            name[tied] = old + (np.maximum.accumulate(np.where(new, spot, 0)) - first)
            self.levels.append(name)
            tied = tied[~new | ~np.append(new[1:], True)]
            step *= 2

    def order(self) -> np.ndarray:
        """The suffix array."""
        out = np.empty(self.n, np.int64)
        out[self.levels[-1][: self.n]] = np.arange(self.n)
        return out

    def common_prefix(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and j (different places, at most n) share."""
        n = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            name = self.levels[k]
            n += (name[i + n] == name[j + n]).astype(np.int64) << k
        return n

    def common_suffix(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words before i and before j, i < j, that are the same."""
        n = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            name, a = self.levels[k], i - n - (1 << k)
            b = a + (j - i)
            n += ((a >= 0) & (name[np.maximum(a, 0)] == name[np.maximum(b, 0)])).astype(np.int64) << k
        return n


def previous_factors(order: list[int], lcp: list[int]) -> tuple[list[int], list[int]]:
    """For every place the length of the longest factor there that also begins earlier, and such an earlier place.

    lcp[r]: what the suffixes order[r - 1] and order[r] share.  The nearest smaller places on
    both sides of a suffix in the order are the candidates.
    """
    longest, source = [0] * len(order), [-1] * len(order)
    places: list[int] = []
    shares: list[int] = []
    for place, share in zip([*order, -1], [*lcp, 0]):
        while places and place < places[-1]:
            top, below = places.pop(), shares.pop()
            if below >= share:
                longest[top], source[top] = below, places[-1] if places else -1
            else:
                longest[top], source[top] = share, place
            share = min(share, below)
        places.append(place)
        shares.append(share)
    return longest, source


def lz_blocks(longest: list[int]) -> list[int]:
    """The starts of the blocks: each the longest previous factor at its start, or one new word."""
    starts, b = [], 0
    while b < len(longest):
        starts.append(b)
        b += longest[b] or 1
    return starts


def find_runs(codes: np.ndarray, at: np.ndarray, exponent: int = 4, least: int = 6) -> np.ndarray:
    """Rows (start, end, period) of all runs of the sequences, places in the concatenation, by start and period."""
    if not len(codes):
        return np.zeros((0, 3), np.int64)
    classes = Classes(codes, at)
    order = classes.order()
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = classes.common_prefix(order[:-1], order[1:])
    longest, source = previous_factors(order.tolist(), lcp.tolist())
    starts = np.array(lz_blocks(longest), np.int64)
    sizes = np.diff(starts, append=len(codes))
    runs = _at_boundaries(classes, at, starts, sizes, exponent, least)
    return _copied(runs, [(b, n, source[b]) for b, n in zip(starts.tolist(), sizes.tolist()) if n > least + 1])


def _at_boundaries(classes: Classes, at: np.ndarray, starts: np.ndarray, sizes: np.ndarray, exponent: int, least: int) -> list[tuple[int, int, int]]:
    """The runs that cross or touch a boundary of blocks, as sorted (start, end, period).

    Left of a place c and right of it, words p apart are compared.  For a block boundary c, p is
    at most what the longer of its two blocks allows: a run of period p reaches (exponent - 1) p
    words beyond its first period, half of them at least on one side of the first boundary there, and that side
    is no longer than its block.  A run that begins less than a period before the block which holds the rest of
    it is found p after that block's start.
    """
    # the end of a sequence is a boundary too: of its last block and an empty one
    begins = np.isin(starts, at[:-1])
    before = np.where(begins, 0, np.concatenate([[0], sizes[:-1]]))
    ends = np.unique(at[1:][np.diff(at) > 0])
    last = np.searchsorted(starts, ends) - 1
    places = np.concatenate([starts, ends])
    longest = np.concatenate([np.maximum(sizes, before), sizes[last]])
    inner = sizes // (exponent - 1)
    across = 2 * longest // (exponent - 1)
    boundary = np.concatenate([places, starts])
    counts = np.concatenate([across, inner])
    low = at[np.searchsorted(at, np.concatenate([starts, ends - 1, starts]), side="right") - 1]  # where the sequence begins
    high = at[np.searchsorted(at, np.concatenate([starts, ends - 1, starts]), side="right")]
    shifted = np.arange(len(boundary)) >= len(places)
    word = classes.levels[0]
    found = []
    cuts = np.searchsorted(np.cumsum(counts), np.arange(PAIRS, counts.sum() + PAIRS, PAIRS))
    for lo, hi in zip([0, *(cuts + 1)], [*(cuts + 1), len(counts)]):
        n = counts[lo:hi]
        which = np.repeat(np.arange(lo, min(hi, len(counts))), n)
        p = ragged_sum_index(np.ones(len(n), np.int64), n)
        c = boundary[which] + np.where(shifted[which], p, 0)
        fits = (c - p >= low[which]) & (c <= high[which])
        which, p, c = which[fits], p[fits], c[fits]
        # a stretch reaches to one side of c at least
        right = (c < high[which]) & (word[c] == word[c - p])
        left = (c - p > low[which]) & (word[c - 1] == word[np.maximum(c - p - 1, 0)])
        p, c = p[right | left], c[right | left]
        reach, back = classes.common_prefix(c - p, c), classes.common_suffix(c - p, c)
        size = reach + back + p
        long = size >= np.maximum(least, exponent * p)
        found.append(np.stack([c - p - back, c + reach, p], axis=1)[long])
    rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    # a stretch is found with multiples of its period too
    smallest = np.ones(len(rows), bool)
    smallest[1:] = (np.diff(rows[:, :2], axis=0) != 0).any(axis=1)
    return [tuple(r) for r in rows[smallest].tolist()]


def _copied(runs: list[tuple[int, int, int]], blocks: list[tuple[int, int, int]]) -> np.ndarray:
    """The runs, and those inside of blocks (start, size, source), which are copies of earlier ones; by start and period."""
    known = set(runs)
    for b, size, source in blocks:
        at = bisect_right(runs, (source, float("inf")))
        # copies are put behind what is read, so a block that overlaps its source sees its own
        while at < len(runs) and runs[at][0] < source + size:
            start, end, period = runs[at]
            copy = (start + b - source, end + b - source, period)
            if end < source + size and copy not in known:
                known.add(copy)
                insort(runs, copy)
            at += 1
    rows = np.array(runs, np.int64).reshape(-1, 3)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def may_hold_runs(codes: np.ndarray, at: np.ndarray, exponent: int, least: int) -> np.ndarray:
    """For each sequence, whether some stretch of words stands there twice that every run holds twice."""
    # a run of period q holds its first max(least, exponent * q) - q words again, q later
    width = min(max(least, exponent * q) - q for q in range(1, least + 1))
    n = len(codes) - width + 1
    found = np.zeros(len(at) - 1, bool)
    if n < 2:
        return found
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = mix64(key + codes[k : k + n].astype(np.uint64) + np.uint64(1))
    inside = own[:n] == own[width - 1 :]
    bits = max(1, (len(at) - 1).bit_length())
    key = (own[:n].astype(np.uint64) << np.uint64(64 - bits) | key >> np.uint64(bits))[inside]
    key.sort()
    found[(key[1:][key[1:] == key[:-1]] >> np.uint64(64 - bits)).astype(np.int64)] = True
    return found


#: From a document's id and its number of words: for each place the number of the word that it takes, or None for all as they are.
Rewrite = Callable[[int | None, int], np.ndarray | None]


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length and period of each, by start and period) and collapsed for every row of (doc_id, text).

    collapsed: the words joined by a space, without those that a run holds after its first
    period; empty for a null text.  rewrite: takes each document's words in another order
    before runs are looked for.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run holds at least two periods and two words")
    prepare(docs.sparkSession)

    def of_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, texts = batch.column("doc_id"), batch.column("text")
        raw, offsets = text_buffers(texts)
        for first, last in doc_blocks(np.diff(offsets), BLOCK):
            each = [raw[a:b].tobytes().split() for a, b in zip(offsets[first:last], offsets[first + 1 : last + 1])]
            if rewrite is not None:
                for k, doc_id in enumerate(ids.slice(first, last - first).to_pylist()):
                    taken = rewrite(doc_id, len(each[k]))
                    if taken is not None:
                        words = each[k]
                        each[k] = [words[i] for i in taken.tolist()]
            yield {"doc_id": ids.slice(first, last - first)} | _of_documents(each, exponent, least)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), of_batch, f"doc_id {kind}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def _of_documents(each: list[list[bytes]], exponent: int, least: int) -> dict:
    sizes = np.array([len(w) for w in each], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    codes = np.fromiter((number[w] for words in each for w in words), np.int64, int(at[-1]))
    kept = np.flatnonzero(may_hold_runs(codes, at, exponent, least))
    place = ragged_sum_index(at[kept], sizes[kept])
    own_at = np.concatenate([[0], np.cumsum(sizes[kept])])
    runs = find_runs(codes[place], own_at, exponent, least)
    which = np.searchsorted(own_at, runs[:, 0], side="right") - 1
    counts = np.bincount(kept[which], minlength=len(each)) if len(runs) else np.zeros(len(each), np.int64)
    change = np.zeros(len(place) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    stays = np.cumsum(change[:-1]) == 0
    collapsed = [b" ".join(words) for words in each]
    for k in np.unique(which).tolist():
        mine = stays[own_at[k] : own_at[k + 1]]
        words = each[kept[k]]
        collapsed[kept[k]] = b" ".join([words[i] for i in np.flatnonzero(mine).tolist()])
    columns = [runs[:, 0] - own_at[which], runs[:, 1] - runs[:, 0], runs[:, 2]]
    rows = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["start", "length", "period"])
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return {"n_words": sizes, "runs": pa.ListArray.from_arrays(pa.array(ends), rows), "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string())}


def longest_run(runs: Column) -> Column:
    """struct(length, start, period) of the run with the greatest length (then smallest start and period); null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(F.size(runs) > 0, F.struct(best["length"].alias("length"), (-best["start"]).alias("start"), (-best["period"]).alias("period")))


def runs_text(runs: Column) -> Column:
    """A line `start,length,period` for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
