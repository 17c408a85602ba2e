"""Streams that stop and go on, state that is forgotten, and captured TCP streams."""

import datetime as dt
import ipaddress
import random
import struct

import pytest
from pyspark.sql import functions as F

from sparksentry.operators.ratelimit import Client, Limits
from sparksentry.plans.queries import _rocksdb
from sparksentry.sources import capture
from sparksentry.streaming import traffic

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
OFFENCES = "id long, ip string, ts timestamp, weight int"


def run(spark, folder, path, limits, late=None):
    stream = traffic.limit_stream(spark.readStream.schema(OFFENCES).option("maxFilesPerTrigger", 1).parquet(folder), limits, late=late)
    with _rocksdb(spark):
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return {r["id"]: r["status"] for r in spark.read.schema(stream.schema).parquet(f"{path}/out").collect()}


def folded(rows, limits):
    out, clients = {}, {}
    for id, ip, ts, weight in sorted(rows, key=lambda r: (r[2], r[0])):
        out[id] = clients.setdefault(ip, Client()).step((ts - START) // dt.timedelta(microseconds=1), weight, limits)
    return out


def test_a_stopped_limiter_goes_on(spark, tmp_path):
    random.seed(3)
    limits = Limits(60, 3, 100)
    rows = [(i, random.choice("abc"), START + dt.timedelta(seconds=4 * i), random.choice([1, 1, 2, None])) for i in range(120)]
    folder, path = str(tmp_path / "in"), str(tmp_path / "run")
    spark.createDataFrame(rows[:70], OFFENCES).coalesce(1).write.parquet(folder)
    run(spark, folder, path, limits)
    with _rocksdb(spark):
        state = {r["ip"]: r["until"] for r in traffic.limiter_state(spark, f"{path}/checkpoint").collect()}
    clients = {}
    for _, ip, ts, weight in rows[:70]:
        clients.setdefault(ip, Client()).step(int(ts.timestamp()) * 1_000_000, weight, limits)
    assert {ip: c.until for ip, c in clients.items()} == state
    now = int(rows[69][2].timestamp()) * 1_000_000
    with _rocksdb(spark):
        counted = traffic.tracked(traffic.limiter_state(spark, f"{path}/checkpoint"), F.lit(now)).first()
    assert tuple(counted) == (3, sum(c.until > now for c in clients.values()))
    spark.createDataFrame(rows[70:], OFFENCES).coalesce(1).write.mode("append").parquet(folder)
    assert run(spark, folder, path, limits) == folded(rows, limits)


def test_clients_are_forgotten(spark, tmp_path):
    """One client an hour: what is held doesn't grow with the clients there have been."""
    limits = Limits(60, 2, 600)
    rows = [(10 * h + k, f"client{h}", START + dt.timedelta(hours=h, seconds=k), 1) for h in range(8) for k in range(3)]
    folder = str(tmp_path / "in")
    for h in range(8):
        spark.createDataFrame(rows[3 * h : 3 * h + 3], OFFENCES).coalesce(1).write.mode("append").parquet(folder)
    held = {}
    for late in (None, "10 minutes"):
        path = str(tmp_path / f"run{len(held)}")
        assert run(spark, folder, path, limits, late) == folded(rows, limits)
        with _rocksdb(spark):
            held[late] = traffic.limiter_state(spark, f"{path}/checkpoint").count()
    assert held[None] == 8 and held["10 minutes"] <= 2


def packet(us, src, sport, dst, dport, seq, flags, payload):
    return {"us": us, "src": src, "src_port": sport, "dst": dst, "dst_port": dport, "seq": seq, "flags": flags, "payload": payload}


def test_captures_of_other_forms(spark, tmp_path):
    tcp = struct.pack(">HHIIBBHHH", 5, 80, 9, 0, 6 << 4, 24, 1, 0, 0) + b"opt." + b"hello"
    four = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0, bytes([1, 2, 3, 4]), bytes([5, 6, 7, 8])) + tcp
    six = struct.pack(">IHBB16s16s", 6 << 28, len(tcp), 6, 64, ipaddress.ip_address("::1").packed, ipaddress.ip_address("::2").packed) + tcp
    udp = four[:9] + bytes([17]) + four[10:]
    later = four[:6] + struct.pack(">H", 5) + four[8:]
    ether = lambda kind, data: bytes(12) + struct.pack(">H", kind) + data
    tagged = bytes(12) + struct.pack(">HHH", 0x8100, 7, 0x0800) + four

    def made(order, magic, link, frames):
        return struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link) + b"".join(struct.pack(order + "IIII", 1, 5000, len(f), len(f)) + f for f in frames)

    files = {
        "a": made("<", capture.MAGIC_MICRO, 1, [ether(0x0800, four) + bytes(9), tagged, ether(0x86DD, six), ether(0x0800, udp), ether(0x0806, four), ether(0x0800, later), b"short"]),
        "b": made(">", capture.MAGIC_NANO, 101, [four, six]),
        "c": made("<", capture.MAGIC_MICRO, 1, [ether(0x0800, four), ether(0x0800, four)])[:-3],
        "d": made("<", capture.MAGIC_MICRO, 1, []),
    }
    for name, data in files.items():
        (tmp_path / f"{name}.pcap").write_bytes(data)
    rows = capture.packets(capture.read_captures(spark, str(tmp_path))).withColumn("us", F.unix_micros("ts")).collect()
    of = lambda name: sorted((r["src"], r["us"], r["seq"], bytes(r["payload"])) for r in rows if r["path"].endswith(f"{name}.pcap"))
    assert of("a") == [("1.2.3.4", 1_005_000, 9, b"hello")] * 2 + [("::1", 1_005_000, 9, b"hello")]
    assert of("b") == [("1.2.3.4", 1_000_005, 9, b"hello"), ("::1", 1_000_005, 9, b"hello")] and len(of("c")) == 1 and of("d") == []
    with pytest.raises(ValueError):
        list(capture.frames_of(b"GIF89a" + bytes(30)))


def test_streams_are_put_together(spark):
    random.seed(5)
    rows, wanted = [], {}
    for s in range(40):
        requests = []
        for k in range(random.randint(1, 5)):
            body = bytes(random.randrange(256) for _ in range(random.randint(0, 60)))
            head = b"POST /%d HTTP/1.1\r\nhost: x\r\ncontent-length: %d\r\n\r\n" % (k, len(body))
            requests.append(head + body)
        data, start = b"".join(requests), random.choice([5, (1 << 32) - 20, (1 << 32) - 1])
        sent, at = [(start, capture.SYN, b"")], 0
        while at < len(data):
            n = random.randint(1, 40)
            back = random.randint(0, min(at, 10))  # overlaps what was sent
            sent.append(((start + 1 + at - back) % (1 << 32), 24, data[at - back : at + n]))
            at += n
        sent += random.sample(sent, len(sent) // 3)
        random.shuffle(sent)
        if s == 7:  # bytes of the second request are missing
            requests, data = [b"GET /%d HTTP/1.1\r\n\r\n" % k for k in range(3)], None
            first = 0
            sent = [(start, capture.SYN, b"")]
            for k, r in enumerate(requests):
                cut = r if k != 1 else r[6:]
                sent.append(((start + 1 + first + (6 if k == 1 else 0)) % (1 << 32), 24, cut))
                first += len(r)
            requests = [requests[0], requests[1][6:], requests[2]]
        rows += [packet(1000 * i, "10.0.0.1", 2000 + s, "10.0.0.9", 80, seq, flags, data_) for i, (seq, flags, data_) in enumerate(sent)]
        wanted[2000 + s] = requests
    rows += [packet(1, "10.0.0.1", 7, "10.0.0.9", 443, 1, 24, b"GET / HTTP/1.1\r\n\r\n")]
    df = spark.createDataFrame(rows, "us long, src string, src_port int, dst string, dst_port int, seq long, flags int, payload binary").repartition(5)
    found = capture.requests_in(capture.packets(capture.captured(df, most=17))).orderBy("src_port", "nth").collect()
    got = {}
    for r in found:
        got.setdefault(r["src_port"], []).append(bytes(r["request"]))
    assert got == wanted and [r["nth"] for r in found if r["src_port"] == found[0]["src_port"]] == list(range(len(got[found[0]["src_port"]])))
    assert capture.requests_in(capture.packets(capture.captured(df.limit(0)))).count() == 0


def test_large_requests_are_left_out():
    large = b"POST /a HTTP/1.1\r\nContent-Length: 5000\r\n\r\n" + b"x" * 5000
    small = b"GET /b HTTP/1.1\r\n\r\n"
    for step in (1, 7, 6000):
        parser, out = capture.Requests(1000), []
        data = large + small + large + small
        for at in range(0, len(data), step):
            out += parser.feed(data[at : at + step])
        assert out == [small, small]


def test_requests_arrive_as_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1, "body": "ok"}\n{"id": 2, "body": "' + "x" * 50 + '"}\n{"id": 3}\n')
    schema = spark.createDataFrame([], "id long, body string").schema
    stream = traffic.request_stream(spark, str(tmp_path / "in"), schema, max_bytes=20)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3]


def test_the_log_rolls_and_survives_a_failing_batch(spark, tmp_path):
    from sparksentry.streaming import live

    folder, source = str(tmp_path / "log"), str(tmp_path / "in")
    lines = [f"event {i} {'x' * (i % 40)}" for i in range(300)]
    for k in range(3):
        spark.createDataFrame([(x,) for x in lines[100 * k : 100 * k + 100]], "event string").coalesce(1).write.mode("append").parquet(source)
    failures = [1]

    def sink(df, batch):
        live.write_log(df, folder, batch, max_bytes=1000)
        if batch == 1 and failures:
            failures.pop()
            raise RuntimeError("lost after the files were written")

    def go():
        stream = spark.readStream.schema("event string").option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="lost after"):
        go()
    go()
    files = live.log_files(spark, folder)
    assert sorted(r["event"] for r in live.read_log(spark, folder).collect()) == sorted(lines)
    assert len(files) > 8 and all(size <= 1000 for _, size in files)
    live.write_log(spark.createDataFrame([("last",)], "event string"), folder, 3, 1000, backups=4)
    kept = live.log_files(spark, folder)
    assert [f for f, _ in kept][:4] == [f for f, _ in files][-4:] and len(kept) == 5
    live.write_log(spark.createDataFrame([], "event string"), folder, 4)
    assert len(live.log_files(spark, folder)) == 5 and live.read_log(spark, str(tmp_path / "none")).count() == 0


def test_counters_are_live(spark, tmp_path):
    import time

    from sparksentry.operators.decision import METRICS
    from sparksentry.streaming import live

    schema = "ts timestamp, decision string, ban_triggered boolean"
    rows = [(START + dt.timedelta(seconds=i), ["allowed", "blocked", "blocked_recon", "blocked_static_deny"][i % 4], i % 8 == 1) for i in range(60)]
    source, folder = str(tmp_path / "in"), str(tmp_path / "counts")
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(source)
    scraped = live.Exposition(spark, folder)
    spark.streams.addListener(scraped)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.foreachBatch(live.counter_sink(folder)).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if scraped.triggers == 3 and "waf_requests_allowed_total 15" in scraped.text:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(scraped)
    said = dict(line.split() for line in scraped.text.splitlines() if not line.startswith("#"))
    assert scraped.triggers == 3 and len(said) == len(METRICS)
    assert (said["waf_requests_allowed_total"], said["waf_requests_blocked_total"], said["waf_static_denied_total"], said["waf_bans_triggered_total"], said["waf_uptime_seconds"]) == ("15", "30", "15", "8", "59.0")
