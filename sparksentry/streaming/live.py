"""Sinks of a running cascade: an event log that rolls by size, and counters for scraping.

Both write what a trigger gives into a folder named after it, over whatever a failed try
left there, so a batch that is retried is neither lost nor counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import decision
from ..operators.decision import METRICS, prometheus_text

#: Names of a trigger's folder sort by its number.
_BATCH = "batch={:012d}"


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def log_files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """The log's files with their sizes, oldest trigger first."""
    fs, at = _folder(spark, folder)
    if not fs.exists(at):
        return []
    found = [f for b in fs.listStatus(at) if b.isDirectory() and b.getPath().getName().startswith("batch=") for f in fs.listStatus(b.getPath())]
    return sorted((f.getPath().toString(), f.getLen()) for f in found if f.getPath().getName().startswith("part-"))


def write_log(events: DataFrame, folder: str, batch: int, max_bytes: int = 10 << 20, backups: int | None = None) -> None:
    """Writes the lines (one string column) of a trigger into files of at most max_bytes each (more only for one longer line).

    backups: files kept besides the newest; older ones are deleted when this trigger's are
    written.  None keeps all.  Writing a trigger again replaces it.
    """
    spark = events.sparkSession
    line = events.columns[0]
    size = F.octet_length(line) + 1
    longest, total = events.agg(F.max(size), F.sum(size)).first()
    if longest is not None:
        rows = max(1, max_bytes // longest)
        # no more tasks, and so files, than the lines fill
        events.coalesce(total // max_bytes + 1).write.mode("overwrite").option("maxRecordsPerFile", rows).text(f"{folder}/{_BATCH.format(batch)}")
    if backups is not None:
        files = log_files(spark, folder)
        for path, _ in files[: max(0, len(files) - backups - 1)]:
            fs, at = _folder(spark, path)
            fs.delete(at, False)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """event: the lines that the log holds."""
    fs, at = _folder(spark, f"{folder}/batch=*/part-*")
    if not fs.globStatus(at):
        return spark.createDataFrame([], StructType([StructField("event", StringType())]))
    # Spark lists the files, however many there are
    return spark.read.text(f"{folder}/batch=*").withColumnRenamed("value", "event")


def log_sink(folder: str, max_bytes: int = 10 << 20, backups: int | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the log's lines of a stream of decided requests (what cascade_stream gives, with ts, method and rel_url)."""

    def write(decided: DataFrame, batch: int) -> None:
        # the trigger is read more than once, but its state may be moved on once only
        lines = decision.log_events(decided.withColumnRenamed("http_status", "status")).select(decision.log_json().alias("event")).persist()
        try:
            write_log(lines, folder, batch, max_bytes, backups)
        finally:
            lines.unpersist()

    return write


def counter_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the counts of a trigger of decided requests."""

    def write(decided: DataFrame, batch: int) -> None:
        counted = decision.counters(decided).withColumn("ended_at", F.col("started_at") + F.col("uptime_seconds"))
        counted.write.mode("overwrite").parquet(f"{folder}/{_BATCH.format(batch)}")

    return write


def live_counters(spark: SparkSession, folder: str) -> DataFrame:
    """The counters of all triggers so far, a row for each trigger being added up."""
    rows = spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    kinds = [name for name, kind, _ in METRICS.values() if kind == "counter"]
    ended, started = F.max("ended_at"), F.min("started_at")
    return rows.agg(*(F.sum(c).alias(c) for c in kinds), started.alias("started_at"), (ended - started).alias("uptime_seconds"))


class Exposition(StreamingQueryListener):
    """The text to scrape, made anew after every trigger of the query that fills the folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.text, self.triggers = spark, folder, "", 0

    def refresh(self) -> str:
        self.text = prometheus_text(live_counters(self.spark, self.folder)).first()[0]
        return self.text

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows:
            self.triggers += 1
            self.refresh()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
