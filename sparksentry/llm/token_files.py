"""Token ids in files coded by a static range asymmetric numeral system.

A file table (Parquet) has one row for each block: whole documents in ascending doc_id order,
about BLOCK_TOKENS ids (a longer document is a block of its own).  Its columns are a
checkpoint (part, segment, block, and `first`, the ids of the part before it), the numbers of
documents and ids, the frequency table, and the coded block.  About SEGMENT_TOKENS ids
share a frequency table, counted over all of them and scaled to 2**bits; Parquet's dictionary
stores it once for the rows that share it, so every block is decoded alone, in any task
and in any order.  The coded block is:

    magic, documents (uint32), ids (uint64), bits, lanes, crc32 of the table (uint32 each),
    doc ids (int64), doc id present (uint8), ids by document (uint32),
    final states (uint64 each), words (uint32), crc32 of all this (uint32)

LANES interleaved states of 64 bits code a block, renormalised by 32-bit words.

Null and empty texts are the end token alone.  Repeated rows are written each; rows of one
doc_id follow in an order by their text, and are spread over tasks however many they are.
A null doc_id sorts first and comes back null.  An empty table gives no blocks and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import map_arrow, partitions, prepare
from .packing import with_end
from .wordtokens import encoded_blocks, encoder_of, tokenizer_path

MAGIC = b"RANSIDS2"
HEADER = struct.Struct("<8sIQIII")
SEGMENT_TOKENS = 1 << 22
BLOCK_TOKENS = 1 << 18
LANES = 1024
MIN_BITS = 18
#: Most bytes of the distinct frequency tables of a Parquet row group that its dictionary holds.
DICTIONARY_BYTES = 8 << 20
LOW = np.uint64(1 << 31)
U32, MASK32 = np.uint64(32), np.uint64(0xFFFFFFFF)


def scaled_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, frequencies, bits): frequencies of at least 1 that sum to 2**bits."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols].astype(np.float64)
    bits = max(MIN_BITS, int(len(symbols) - 1).bit_length() + 2)
    total = 1 << bits
    freqs = np.maximum(1, np.floor(counts * (total / counts.sum()))).astype(np.int64)
    over = int(freqs.sum()) - total
    if over < 0:
        freqs[np.argmax(freqs)] -= over
    order = np.argsort(-freqs, kind="stable")
    while over > 0:
        give = np.minimum(freqs[order] - 1, np.maximum(1, freqs[order] * over // total))
        give = np.minimum(give, np.maximum(0, over - (np.cumsum(give) - give)))
        freqs[order] -= give
        over -= int(give.sum())
    return symbols.astype(np.uint32), freqs.astype(np.uint32), bits


class Coder:
    def __init__(self, symbols: np.ndarray, freqs: np.ndarray, bits: int):
        self.bits, self.symbols = np.uint64(bits), symbols
        self.freqs = freqs.astype(np.uint64)
        self.cum = np.cumsum(self.freqs) - self.freqs

    def encode(self, index: np.ndarray) -> bytes:
        """A block of table indexes; the last of them pads the last step."""
        steps = -(-len(index) // LANES)
        rows = np.concatenate([index, np.full(steps * LANES - len(index), index[-1])]).reshape(steps, LANES)
        limit = self.freqs << np.uint64(63 - int(self.bits))
        x = np.full(LANES, LOW)
        words: list[np.ndarray] = []
        for row in rows[::-1]:
            f = self.freqs[row]
            full = np.flatnonzero(x >= limit[row])
            if len(full):
                out = x[full]
                words.append((out & MASK32).astype("<u4"))
                x[full] = out >> U32
            high = x // f
            x = (high << self.bits) + (x - high * f) + self.cum[row]
        return x.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))

    def decoder(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols)), self.freqs.astype(np.int64)).astype(np.uint32)

    def decode(self, block: bytes, n: int, slots: np.ndarray) -> np.ndarray:
        x = np.frombuffer(block, "<u8", LANES).astype(np.uint64)
        words = np.frombuffer(block, "<u4", offset=8 * LANES).astype(np.uint64)
        steps, at = -(-n // LANES), 0
        out = np.empty((steps, LANES), np.uint32)
        mask = np.uint64((1 << int(self.bits)) - 1)
        for k in range(steps):
            slot = x & mask
            s = slots[slot.view(np.int64)]
            out[k] = s
            x = self.freqs[s] * (x >> self.bits) + slot - self.cum[s]
            short = np.flatnonzero(x < LOW)
            if len(short):
                x[short] = (x[short] << U32) | words[at : at + len(short)]
                at += len(short)
        if at != len(words) or not (x == LOW).all():
            raise ValueError("a block doesn't end where its coder began")
        return self.symbols[out.reshape(-1)[:n]]


def pack_table(symbols: np.ndarray, freqs: np.ndarray) -> bytes:
    """Gaps between the symbols, then the frequencies, compressed."""
    return zlib.compress(np.concatenate([np.diff(symbols, prepend=np.uint32(0)), freqs]).astype("<u4").tobytes(), 6)


def unpack_table(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps, freqs = np.frombuffer(zlib.decompress(table), "<u4").reshape(2, -1)
    return np.cumsum(gaps, dtype=np.uint32), freqs


def encode_segment(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> tuple[bytes, list[tuple[int, int, int, bytes]]]:
    """The frequency table, and (first id, documents, ids, coded block) of each block of whole documents."""
    symbols, freqs, bits = scaled_table(ids)
    coder, table = Coder(symbols, freqs, bits), pack_table(symbols, freqs)
    lookup = np.zeros(int(symbols[-1]) + 1, np.int64)
    lookup[symbols] = np.arange(len(symbols))
    starts = np.cumsum(sizes) - sizes
    cuts = [0, *(np.flatnonzero(np.diff(starts // BLOCK_TOKENS)) + 1).tolist(), len(sizes)]
    blocks = []
    for a, b in zip(cuts, cuts[1:]):
        lo, n = int(starts[a]), int(sizes[a:b].sum())
        named = doc_ids[a:b]
        parts = [HEADER.pack(MAGIC, b - a, n, bits, LANES, zlib.crc32(table)), np.array([d or 0 for d in named], "<i8").tobytes(), np.array([d is not None for d in named], np.uint8).tobytes(), sizes[a:b].astype("<u4").tobytes(), coder.encode(lookup[ids[lo : lo + n]])]
        data = b"".join(parts)
        blocks.append((lo, b - a, n, data + struct.pack("<I", zlib.crc32(data))))
    return table, blocks


class Decoder:
    """Decodes blocks; blocks in a row that share a table share its look-up."""

    def __init__(self):
        self.table: bytes | None = None

    def __call__(self, table: bytes, data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        """(doc ids, ids by document, ids); a checksum that doesn't hold raises ValueError."""
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a block of token ids")
        if struct.unpack_from("<I", data, len(data) - 4)[0] != zlib.crc32(memoryview(data)[:-4]):
            raise ValueError("the block's checksum doesn't hold")
        _, docs, n, bits, lanes, table_crc = HEADER.unpack_from(data)
        if lanes != LANES:
            raise ValueError("another number of lanes")
        if table != self.table:
            if zlib.crc32(table) != table_crc:
                raise ValueError("the table's checksum doesn't hold")
            self.coder = Coder(*unpack_table(table), bits)
            self.slots, self.table, self.crc = self.coder.decoder(), table, table_crc
        elif self.crc != table_crc:
            raise ValueError("the block belongs to another table")
        at, parts = HEADER.size, []
        for kind in ("<i8", "<u1", "<u4"):
            parts.append(np.frombuffer(data, kind, docs, at))
            at += parts[-1].nbytes
        doc, present, sizes = parts
        ids = self.coder.decode(data[at:-4], n, self.slots)
        return [d if p else None for d, p in zip(doc.tolist(), present.tolist())], sizes.astype(np.int64), ids


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2) -> None:
    """Writes the ids of (doc_id, text), each with the end token, in ascending doc_id order: a Parquet table of segments by part."""
    spark = docs.sparkSession
    prepare(spark)
    vocabulary = vocabulary or tokenizer_path("word_bpe_49k.json")
    # the text's hash orders rows of one id, and the row's number lets even equal rows be spread
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    ordered = keyed.repartitionByRange(partitions(spark), "doc_id", "_hash", "_row").sortWithinPartitions("doc_id", "_hash", "_row").select("doc_id", "text")
    schema = "part int, segment int, block int, first long, docs int, tokens long, table binary, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, segment = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            table, blocks = encode_segment(doc_ids, np.concatenate(sizes), np.concatenate(held))
            k = len(blocks)
            firsts, docs, tokens, data = (list(x) for x in zip(*blocks))
            columns = [pa.array([part] * k, pa.int32()), pa.array([segment] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array([done + x for x in firsts], pa.int64()), pa.array(docs, pa.int32()), pa.array(tokens, pa.int64()), pa.array([table] * k, pa.binary()), pa.array(data, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "segment", "block", "first", "docs", "tokens", "table", "data"])

        for batch in batches:
            named = batch.column("doc_id").to_pylist()
            for first, last, ids, at in encoded_blocks(encoder_of(vocabulary), batch.column("text")):
                ids, at = with_end(ids, at, end_id)
                doc_ids += named[first:last]
                sizes.append(np.diff(at))
                held.append(ids)
                n += len(ids)
                if n >= SEGMENT_TOKENS:
                    yield flush()
                    done, segment = done + n, segment + 1
                    doc_ids, sizes, held, n = [], [], [], 0
        if doc_ids:
            yield flush()

    options = {"compression": "none", "parquet.enable.dictionary#data": "false", "parquet.dictionary.page.size": str(DICTIONARY_BYTES)}
    ordered.mapInArrow(run, schema).write.options(**options).parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, and its ids if asked for."""
    prepare(spark)
    files = spark.read.parquet(path)
    sums = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    before, total = {}, 0
    for part, n in sums:
        before[part] = total
        total += n
    shared = spark.sparkContext.broadcast(before)

    decode = Decoder()

    def of_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        for part, first, table, data in zip(batch.column("part").to_pylist(), batch.column("first").to_pylist(), batch.column("table"), batch.column("data")):
            doc_ids, sizes, ids = decode(table.as_py(), data.as_py())
            ends = np.cumsum(sizes)
            at = ends - sizes
            view = ids.astype("<u4", copy=False)
            crc = [zlib.crc32(view[a:b]) for a, b in zip(at.tolist(), ends.tolist())]
            out = {"doc_id": pa.array(doc_ids, pa.int64()), "start": at + first + shared.value[part], "n_tokens": sizes, "ids_crc32": np.array(crc, np.int64)}
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64)))
            yield out

    return map_arrow(files.select("part", "first", "table", "data"), of_batch, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
