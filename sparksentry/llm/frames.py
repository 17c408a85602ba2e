"""Session set-up, lineage cuts and distributed ranks for the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext

#: Rows in an Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS = "1000"
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches and makes this package importable on the executors, once for each application."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    fd, name = tempfile.mkstemp(prefix=root.name, suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(name)
    _shipped.add(context.applicationId)


def release_memory() -> None:
    """Gives memory that was freed back to the system, which Arrow and C's allocator otherwise keep: the driver lives on after a fit."""
    arrowtext.forget_powers()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where that is unset and the master is local."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, **options: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: columns can be read alone."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, of_batch: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str) -> DataFrame:
    """mapInArrow for a function from a batch to columns by name."""
    names = T._parse_datatype_string(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = of_batch(batch)
            for columns in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (columns[n] for n in names)], names)
        pa.default_memory_pool().release_unused()  # the worker process stays for later tasks

    return df.mapInArrow(run, schema)


def ranked(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds `_rank`, from 0, of each row among the rows that share `by`, in `order`.

    Rows are range-sorted by (by, order) and their number, so a class of any size spreads over
    partitions, even one of equal rows; df's rows must come in a fixed order, as from a checkpoint.
    What reaches the driver is a row for each class and partition that meet: after a range
    sort at most classes + partitions.
    """
    spark = df.sparkSession
    spread = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), by, *order, "_tie").sortWithinPartitions(by, *order, "_tie")
    spread = cut(spread.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int")
    runs = spread.groupBy(by, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).collect()
    before: dict = {}
    rows = []
    for r in sorted(runs, key=lambda r: r["_part"]):
        rows.append((r[by], r["_part"], r["_first"], before.get(r[by], 0)))
        before[r[by]] = before.get(r[by], 0) + r["_n"]
    kind = spread.schema[by].dataType.simpleString()
    small = spark.createDataFrame(rows, f"`{by}` {kind}, _part int, _first long, _before long")
    return spread.withColumn("_part", part).join(F.broadcast(small), [by, "_part"]).withColumn("_rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


#: Rows up to which a join side is broadcast, after they have been counted.
BROADCAST_ROWS = 300_000


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The counted, materialised df, hinted for broadcast if it is small; joins shuffle it otherwise."""
    return F.broadcast(df) if df.count() <= rows else df


def grouped_arrow(df: DataFrame, keys: list[str], of_group: Callable[[pa.Table], dict | None], schema: str) -> DataFrame:
    """Applies a function to the rows of each key (integer columns without nulls), streaming through sorted partitions."""
    names = T._parse_datatype_string(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list[pa.RecordBatch] = []
        held_key = None

        def made(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns = of_group(pa.Table.from_batches(parts).combine_chunks())
            if columns is not None:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (columns[n] for n in names)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
            cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                key = tuple(values[:, lo].tolist())
                if held and key != held_key:
                    yield from made(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
                held_key = key
        if held:
            yield from made(held)

    return df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v): root is the smallest node that is connected with it.

    Alternating large-star and small-star steps keep as many edges as there were at most;
    lineage is cut in every round, and rounds end when the edges no longer change.  The
    smallest neighbours are materialised before they are joined, so both sides of the join
    are shuffled for it and AQE can split a hub that holds many edges.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before, now = None, state(e)
    while now != before:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        lower = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        e = cut(small.filter("u <> v").distinct())
        before, now = now, state(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
