"""A trigger of the streaming cascade is read by many tasks, and its state has a row for a group of clients."""

import datetime as dt

from pyspark.sql import functions as F

from sparksentry.operators.ratelimit import Limits
from sparksentry.plans import queries
from sparksentry.streaming import traffic


def test_a_trigger_has_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "FILE_ROWS", 50)
    seen = []

    def sink(df, batch):
        seen.append(df.select("ts", F.input_file_name().alias("file")).agg(F.count_distinct("file"), F.count("*"), F.min("ts"), F.max("ts")).first())

    queries._request_stream(spark, "/root/testdata/sf0.001").writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 4 and len({r[0] for r in seen}) == 1 and seen[0][0] > 1
    assert sum(r[1] for r in seen) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert all(a[3] < b[2] for a, b in zip(seen, seen[1:]))


def test_the_state_has_a_row_for_a_group(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    rows = [(i, f"client{i % 3000}" if i % 3000 else None, start + dt.timedelta(seconds=i), 1) for i in range(6000)]
    rows += [(6000, "no time", None, 1), (6001, "no weight", start, None)]
    spark.createDataFrame(rows, "id long, ip string, ts timestamp, weight int").write.parquet(str(tmp_path / "in"))
    stream = traffic.limit_stream(spark.readStream.schema("id long, ip string, ts timestamp, weight int").parquet(str(tmp_path / "in")), Limits(10_000, 2, 60))
    at = str(tmp_path / "c")
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    out = {r["id"]: (r["ip"], r["status"], r["seconds_banned"]) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()}
    assert out == {i: (ip, "passed", 0) if i >= 6000 else (ip, "ban_triggered", 60) if i >= 3000 else (ip, "offence", 0) for i, ip, _, _ in rows}
    assert spark.read.format("statestore").load(at).count() <= traffic.GROUPS
    held = traffic.limiter_state(spark, at)
    assert held.count() == 3000 and held.filter("ip is null and until is not null").count() == 1
