"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Groups are the rows with one text.  The differencing itself is sequential, so it runs on
at most 2 * UNITS units: each group of at least total / UNITS bytes is a unit of its own
(there can't be more than UNITS of them), all other groups are dealt into UNITS hash
buckets, which are units.  Again and again the two partial partitions with the largest
spread are added, the largest shard of one to the smallest of the other.

A null text counts as empty: 1 byte, crc 0, and one group with the empty texts.  Repeated
rows stay together as copies.  A group larger than a shard's share makes shards uneven, as
it must.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, prepare, ranked

UNITS = 16_384


def karmarkar_karp(sizes: list[int], shards: int) -> list[int]:
    """The shard of each unit."""
    if not sizes:
        return []
    # a slot is None, a unit's index, or a pair of slots
    heap = [(-s, i, ((s,) + (0,) * (shards - 1)), ((i,) + (None,) * (shards - 1))) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        joined = sorted(((p + q, k) for k, (p, q) in enumerate(zip(a, reversed(b)))), reverse=True)
        slots = []
        for _, k in joined:
            left, right = x[k], y[shards - 1 - k]
            slots.append(right if left is None else left if right is None else (left, right))
        sums = tuple(s for s, _ in joined)
        heapq.heappush(heap, (sums[-1] - sums[0], made, sums, tuple(slots)))
        made += 1
    out = [0] * len(sizes)
    for shard, slot in enumerate(heap[0][3]):
        todo = [slot]
        while todo:
            top = todo.pop()
            if isinstance(top, tuple):
                todo.extend(top)
            elif top is not None:
                out[top] = shard
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Adds size, text_crc32, shard and slot (gapless in each shard, by doc_id) to the doc_id of every row."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("_group")))
    bucket = F.pmod(F.xxhash64("_group"), F.lit(UNITS)).cast("int")
    groups = cut(rows.groupBy("_group").agg(F.sum("size").alias("_bytes")).withColumn("_bucket", bucket))
    total = groups.agg(F.sum("_bytes")).first()[0] or 0
    least = total / UNITS
    heavy = groups.filter(F.col("_bytes") >= least).select("_group", "_bytes").collect()
    light = groups.filter(F.col("_bytes") < least).groupBy("_bucket").agg(F.sum("_bytes").alias("_bytes")).collect()
    heavy.sort(key=lambda r: (-r["_bytes"], bytes(r["_group"])))
    light.sort(key=lambda r: r["_bucket"])
    where = karmarkar_karp([r["_bytes"] for r in [*heavy, *light]], shards)
    of_heavy = spark.createDataFrame([(bytes(r["_group"]), s) for r, s in zip(heavy, where)], "_group binary, _own int")
    of_light = spark.createDataFrame([(r["_bucket"], s) for r, s in zip(light, where[len(heavy) :])], "_bucket int, _dealt int")
    placed = rows.withColumn("_bucket", bucket).join(F.broadcast(of_heavy), "_group", "left").join(F.broadcast(of_light), "_bucket", "left")
    placed = placed.select("doc_id", "size", "text_crc32", F.coalesce("_own", "_dealt").alias("shard"))
    return ranked(placed, "shard", ["doc_id", "text_crc32"]).withColumnRenamed("_rank", "slot")
