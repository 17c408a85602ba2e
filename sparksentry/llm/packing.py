"""Best-fit packing of token pieces into sequences, in bulk-synchronous supersteps.

Pieces are range-sorted by length, and their ranks within a length come from partition
counts.  Gaps are kept sorted by size, as runs of sequences with equal gaps.  A superstep
takes all pieces of one length, longest first: it sweeps from the successor gap (the
smallest that fits) upwards, gives each piece the place that its rank names, so no two
pieces claim one gap, updates the gaps and opens new sequences for what is left.  That is
best-fit decreasing; the driver only holds runs, whose number depends on the capacity and
not on the documents.  Every partition then places its range-sorted pieces by a successor
search of (length, rank) in the steps.

A null text counts as empty: one piece, the end token.  Repeated rows are packed each.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import cut, map_arrow, prepare, ranked
from .wordtokens import encoded_blocks, encoder_of, tokenizer_path

#: Chunks in each generation that a worker remembers; fewer than the encoder's own, as packing comes close to a worker's memory.
MEMO_CHUNKS = 300_000


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and offsets with an end token behind every text."""
    n = len(at) - 1
    out = np.empty(len(ids) + n, np.uint32)
    ends = at[1:] + np.arange(n)
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep], out[ends] = ids, end_id
    return out, at + np.arange(n + 1)


def token_pieces(docs: DataFrame, capacity: int, vocabulary: str, end_id: int, memo: int = MEMO_CHUNKS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents cut only where they exceed the capacity."""

    def of_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        ids_of = batch.column("doc_id")
        for first, last, ids, at in encoded_blocks(encoder_of(vocabulary, memo), batch.column("text")):
            ids, at = with_end(ids, at, end_id)
            sizes = np.diff(at)
            pieces = -(-sizes // capacity)
            doc = np.repeat(np.arange(last - first), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(sizes[doc] - start, capacity)
            lo = at[doc] + start
            crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(lo.tolist(), length.tolist())]
            yield {"doc_id": ids_of.take(pa.array(doc + first)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": np.array(crc, np.int64)}

    return map_arrow(docs.select("doc_id", "text"), of_batch, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_steps(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a sequence, first offset), sorted: what each superstep decided."""
    runs: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []
    steps: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap]
                    gaps.pop(at)
            else:
                gap, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            each = gap // length
            taken = min(left, n * each)
            steps.append((length, rank, first, each, capacity - gap))
            full, rest = divmod(taken, each)
            leave(gap - each * length, first, full)
            if rest:
                leave(gap - rest * length, first + full, 1)
                full += 1
            leave(gap, first + full, n - full)
            left, rank = left - taken, rank + taken
    return np.array(sorted(steps), np.int64).reshape(-1, 5)


def best_fit_pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0, memo: int = MEMO_CHUNKS) -> DataFrame:
    """Packs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece; memo: chunks that a worker remembers."""
    spark = docs.sparkSession
    prepare(spark)
    pieces = cut(token_pieces(docs, capacity, vocabulary or tokenizer_path("word_bpe_49k.json"), end_id, memo))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    steps = spark.sparkContext.broadcast(plan_steps(counts, capacity))

    def place(batch: pa.RecordBatch) -> dict:
        plan = steps.value
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
        begins = np.searchsorted(plan[:, 0], length, side="left")
        stride = np.int64(1) << np.int64(40)
        at = np.searchsorted(plan[:, 0] * stride + plan[:, 1], length * stride + rank, side="right") - 1
        if not (at >= begins).all():
            raise AssertionError("a piece without a place")
        inner = rank - plan[at, 1]
        out = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
        return out | {"sequence_id": plan[at, 2] + inner // plan[at, 3], "offset": plan[at, 4] + inner % plan[at, 3] * length}

    sorted_pieces = ranked(pieces, "length", ["doc_id", "piece", "ids_crc32"])
    return map_arrow(sorted_pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank"), place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
