"""A folder that all executors share, for tables and stream outputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="scratch")
    return f"{folder}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, in the same partitions and order."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, **options: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: lineage is cut and columns can be read alone."""
    path = f"{scratch(df.sparkSession)}/table"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


#: Write options for a table whose rows may be large: a row group, which a reader decodes as one, ends after a few MB (compressed) or rows.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.block.row.count.limit": "64", "parquet.page.size.row.check.min": "4", "parquet.page.size.row.check.max": "64"}


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bounds the rows and bytes of an Arrow batch, as texts may be long, unless the session has its own bounds."""
    for key, usual, bound in (("maxRecordsPerBatch", "10000", rows), ("maxBytesPerBatch", "67108864b", size)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(bound))
