"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (a shorter text with words is one shingle); two texts
are linked if their Jaccard similarity reaches the threshold, and classes are the connected
components of links.

1. Every text gets 160 MinHash values; texts that share one of 32 bands of 5 of them are
   candidates.  A pair of similarity 0.8 has no band in common with probability 3e-6.
   Texts of one word sequence are one node, and each bucket only joins its nodes to its
   smallest, so buckets of any size cost a row for each node.
2. Components of those joins are compared inside: their texts are dealt into blocks of
   bounded size by a hash, and each pair of blocks is one group, so a component of any size
   spreads over tasks.
3. In a group, MinHash values are compared 32 at a time.  A pair is dropped as soon as the
   posterior probability (uniform prior, binomial matches) that its similarity reaches the
   threshold is below TOLERANCE.  The rest are verified by exact set intersection.
4. A group only returns each text's number of links and a spanning forest, never pairs.

Null, empty and wordless texts link with nothing: each is its own class.  Repeated rows are
copies of each other.  The class id is the smallest doc_id of the class (null if all are
null); n_links counts the other rows, copies included, that a row is linked with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import Words, mix64, shingles, word_blocks
from .frames import components, cut, grouped_arrow, if_small, map_arrow, prepare, stored

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 32, 1e-7
#: Texts and shingles of a block, on average.
BLOCK_TEXTS, BLOCK_SHINGLES = 400, 400_000
_MULTIPLIERS = np.random.default_rng(20240229).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[texts, HASHES] MinHash values; a text without shingles has the largest values."""
    out = np.full((len(at) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(np.diff(at))
    if len(filled):
        begins = at[:-1][filled]
        for k, a in enumerate(_MULTIPLIERS):
            out[filled, k] = np.minimum.reduceat((hashes * a) >> np.uint64(32), begins)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """[texts, BANDS] 64-bit keys."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For 32, 64, ... values: the fewest matches with which the posterior is not below the tolerance."""
    s = (np.arange(200_000) + 0.5) / 200_000
    reach = s >= threshold
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            like = m * np.log(s) + (n - m) * np.log1p(-s)
            like = np.exp(like - like.max())
            if like[reach].sum() / like.sum() >= tolerance:
                out.append(m)
                break
    return out


def nodes_of(words: Words) -> list[bytes | None]:
    """A 128-bit name of each text's word sequence; None without words."""
    at = words.at.tolist()
    return [hashlib.md5(words.hashes[a:b].tobytes()).digest() if b > a else None for a, b in zip(at, at[1:])]


def text_key(text: str | Column) -> Column:
    return F.unhex(F.md5((F.col(text) if isinstance(text, str) else text).cast("binary")))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, _key (the raw text), _node (the word sequence), _half (64 bits of it), _bands."""

    def of_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        for first, last, words in word_blocks(batch.column("text")):
            names = nodes_of(words)
            hashes, at = shingles(words, WIDTH)
            keys = band_keys(minhash(hashes, at))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            half = [None if x is None else int.from_bytes(x[:8], "little", signed=True) for x in names]
            yield {"doc_id": batch.column("doc_id").slice(first, last - first), "_key": batch.column("_key").slice(first, last - first), "_node": pa.array(names, pa.binary()), "_half": pa.array(half, pa.int64()), "_bands": bands}

    return map_arrow(docs.select("doc_id", "text", text_key("text").alias("_key")), of_batch, "doc_id long, _key binary, _node binary, _half long, _bands array<long>")


def candidate_clusters(rows: DataFrame) -> DataFrame:
    """(_half, _cluster) of the nodes that share a band with another node."""
    # one row for each word sequence before the bands are spread out
    once = cut(rows.filter("_node is not null").select("_half", "_bands").dropDuplicates(["_half"]))
    bands = once.select("_half", F.explode("_bands").alias("_band"))
    # materialised, so that AQE can split a bucket that holds many texts
    buckets = cut(bands.groupBy("_band").agg(F.min("_half").alias("_low"), F.max("_half").alias("_high")).filter("_low < _high"))
    joined = bands.join(buckets.select("_band", "_low"), "_band").filter("_half <> _low")
    roots = components(joined.select(F.col("_half").alias("u"), F.col("_low").alias("v")).distinct())
    return roots.select(F.col("node").alias("_half"), F.col("root").alias("_cluster"))


def compare(group: pa.Table, threshold: Fraction, least: list[int]) -> dict | None:
    """Links inside a pair of blocks: for each linked text its root among them and the rows it is linked with."""
    block = group.column("_block").to_numpy()
    n = len(block)
    if n < 2:
        return None
    a, b = group.column("_a")[0].as_py(), group.column("_b")[0].as_py()
    copies = group.column("_copies").to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("_shingles")]
    sizes = np.array([len(x) for x in sets])
    signatures = np.stack([np.frombuffer(x.as_py(), np.uint32) for x in group.column("_signature")])
    left = np.flatnonzero(block == a)
    right = left if a == b else np.flatnonzero(block == b)
    ratio = float(threshold)
    vocabulary, local = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    root, links, linked = np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool)
    seen = np.zeros(len(vocabulary), bool)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in left.tolist():
        others = right[right > i] if a == b else right
        low, high = np.minimum(sizes[i], sizes[others]), np.maximum(sizes[i], sizes[others])
        others = others[low >= ratio * high - 1e-9]
        matches = np.zeros(len(others), np.int64)
        for k, fewest in enumerate(least):
            if not len(others):
                break
            span = slice(k * STEP, (k + 1) * STEP)
            matches = matches + (signatures[others, span] == signatures[i, span]).sum(axis=1)
            stay = matches >= fewest
            others, matches = others[stay], matches[stay]
        if not len(others):
            continue
        own = local[begins[i] : ends[i]]
        seen[own] = True
        at = np.concatenate([[0], np.cumsum(sizes[others])])
        index = np.repeat(begins[others] - at[:-1], sizes[others]) + np.arange(at[-1])
        shared = np.add.reduceat(seen[local[index]].astype(np.int64), at[:-1])
        seen[own] = False
        others = others[shared * threshold.denominator >= threshold.numerator * (sizes[i] + sizes[others] - shared)]
        for j in others.tolist():
            x, y = top(i), top(j)
            root[max(x, y)] = min(x, y)
        if len(others):
            links[i] += copies[others].sum()
            links[others] += copies[i]
            linked[i] = linked[others] = True
    at = np.flatnonzero(linked)
    if not len(at):
        return None
    names = group.column("_node")
    return {"_node": names.take(pa.array(at)).combine_chunks(), "_root": names.take(pa.array([top(i) for i in at.tolist()])).combine_chunks(), "_links": links[at], "_many": group.column("_many").take(pa.array(at)).combine_chunks()}


def linked_texts(docs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """_node, _root, _links, _many (whether its component was compared in several groups) of each text in each group where it has links."""
    clusters = cut(candidate_clusters(rows))
    members = rows.filter("_node is not null").join(clusters, "_half").groupBy("_node").agg(F.min("_key").alias("_key"), F.min("_cluster").alias("_cluster"), F.count("*").alias("_copies"))
    members = cut(members)
    texts = docs.select("text", text_key("text").alias("_key")).join(if_small(members), "_key").groupBy("_node", "_cluster", "_copies").agg(F.first("text").alias("text"))

    def of_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        for first, last, words in word_blocks(batch.column("text")):
            hashes, at = shingles(words, WIDTH)
            signature = minhash(hashes, at)
            sets = [np.unique(hashes[x:y]) for x, y in zip(at.tolist(), at[1:].tolist())]
            part = {c: batch.column(c).slice(first, last - first) for c in ("_node", "_cluster", "_copies")}
            yield part | {"_n": pa.array([len(s) for s in sets], pa.int64()), "_shingles": pa.array([s.tobytes() for s in sets], pa.binary()), "_signature": pa.array([s.tobytes() for s in signature], pa.binary())}

    sets = stored(map_arrow(texts, of_batch, "_node binary, _cluster long, _copies long, _n long, _shingles binary, _signature binary"))
    sizes = sets.groupBy("_cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("_n") / BLOCK_SHINGLES)).cast("int").alias("_blocks"), F.count("*").alias("_texts")).filter("_texts > 1")
    dealt = sets.join(sizes.select("_cluster", "_blocks"), "_cluster").withColumn("_block", F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    pairs = dealt.withColumn("_other", other).select("_node", "_cluster", "_copies", "_shingles", "_signature", "_block", F.least("_block", "_other").alias("_a"), F.greatest("_block", "_other").alias("_b"), (F.col("_blocks") > 1).alias("_many"))
    exact, least = Fraction(threshold).limit_denominator(10_000), least_matches(threshold, TOLERANCE)
    return grouped_arrow(pairs, ["_cluster", "_a", "_b"], lambda g: compare(g, exact, least), "_node binary, _root binary, _links long, _many boolean")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links for every row of (doc_id, text).

    Two more columns: `_key`, the md5 of the raw text; and `_stays`, whether the row has the
    doc_id and text of the one that stands for its class (the smallest doc_id, nulls last, then
    the smallest key), null for a text without words.
    """
    prepare(docs.sparkSession)
    rows = stored(sketches(docs))
    found = cut(linked_texts(docs, rows, threshold))
    links = found.groupBy("_node").agg(F.sum("_links").alias("_links"))
    several = found.filter("_many").select(F.col("_node").alias("u"), F.col("_root").alias("v"))
    whole = found.filter("not _many").select(F.col("_node").alias("node"), F.col("_root").alias("root"))
    roots = whole.union(components(several)) if several.head(1) else whole
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("_first")
    texts = rows.filter("_node is not null").groupBy("_node").agg(F.count("*").alias("_copies"), first)
    texts = texts.join(roots.distinct(), F.col("_node") == F.col("node"), "left").join(links, "_node", "left")
    texts = cut(texts.select("_node", F.coalesce("root", "_node").alias("_root"), "_first", (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("n_links")))
    classes = cut(texts.groupBy("_root").agg(F.min("_first").alias("_class")))
    named = texts.join(classes, "_root").select("_node", "_class", "n_links")
    out = rows.select("doc_id", "_key", "_node").join(named, "_node", "left")
    alone = F.col("_node").isNull()
    stays = F.when(~alone, F.col("doc_id").eqNullSafe(F.col("_class.doc_id")) & (F.col("_key") == F.col("_class._key")))
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("_class.doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "_key", stays.alias("_stays"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class, whether ids repeat or are null: that of the smallest doc_id, nulls last.

    Texts without words that are equal byte for byte are a class here; null and empty texts all stay.
    """
    found = cut(near_duplicates(docs, threshold).select("doc_id", "_key", "_stays"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    empty = text_key(F.lit(""))
    wordless = found.filter(F.col("_stays").isNull() & (F.col("_key") != empty)).groupBy("_key").agg(F.min(row).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    wordless = cut(wordless.select("_key", "_first.doc_id"))
    # the row in one column, so that no name of its columns can clash
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), text_key("text").alias("_key"))
    same = lambda other: F.col("_id").eqNullSafe(other["_id2"]) & (F.col("_key") == other["_key2"])
    pair = [F.col("doc_id").alias("_id2"), F.col("_key").alias("_key2")]
    of_wordless = found.filter("_stays is null").select("doc_id", "_key").join(if_small(wordless.select("_key", F.col("doc_id").alias("_least"))), "_key").filter(~F.col("doc_id").eqNullSafe(F.col("_least")))
    gone = cut(found.filter("not _stays").select(*pair).union(of_wordless.select(*pair)).distinct())
    twice = cut(found.filter("_stays").groupBy("doc_id", "_key").count().filter("count > 1").select(*pair).union(wordless.select(*pair)))
    small = if_small(gone)
    kept = keyed.join(small, same(gone), "left_anti")
    if not twice.head(1):
        return kept.select("_row.*")
    # one of the rows that share both id and text
    once = kept.join(if_small(twice), same(twice), "left_semi").groupBy("_id", "_key").agg(F.first("_row").alias("_row"))
    return kept.join(if_small(twice), same(twice), "left_anti").select("_row.*").unionByName(once.select("_row.*"))
