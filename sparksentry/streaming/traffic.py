"""Structured Streaming forms: windowed counts with a watermark, and the keyed limiter."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import decision
from ..operators.decision import DETECTORS, known, request_payload
from ..operators.ratelimit import NEVER, Client, Limits
from ..operators.settings import Settings

#: Groups that the limiter's clients are hashed into: a group's clients are folded in one call and share one row of the state.
GROUPS = 1024
#: That row: clients, the ends of their bans, how many offences each has, and all offence times.
HELD = "ips array<string>, until array<long>, sizes array<int>, offences array<long>"


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Tumbling-window counts by key; rows later than `late` are left out."""
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return stamped.groupBy(F.window("_ts", width).alias("w"), key).count().select(F.col("w.start").alias("window_start"), key, F.col("count").alias("n"))


def session_counts(events: DataFrame, ts: str, key: str, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return stamped.groupBy(F.session_window("_ts", gap).alias("w"), key).count().select(F.col("w.start").alias("session_start"), key, F.col("count").alias("n"))


def _last(client: Client, limits: Limits) -> int:
    """The time from which on nothing of a client's state counts."""
    return max([client.until, *(t + limits.window * 1_000_000 + 1 for t in client.offences)])


def _held(state: GroupState) -> dict[str | None, Client]:
    clients, at = {}, 0
    if state.exists:
        ips, until, sizes, offences = state.get
        for ip, end, n in zip(ips, until, sizes):
            clients[ip] = Client(deque(offences[at : at + n]), end)
            at += n
    return clients


def limiter(limits: Limits, carried: tuple[str, ...] = (), forget: bool = False) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Folds the rows of a group of clients; its state has offence times and the end of the ban of each client that offended.

    carried: columns that go through as they are.  With forget, a client is dropped as soon as its
    state can't matter any more, when the watermark has passed its ban and the window of its last
    offence; a group that gets no rows is woken for that by a timeout of event time.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clients = _held(state)
        if full := [f for f in frames if len(f)]:
            batch = pd.concat(full, ignore_index=True) if len(full) > 1 else full[0].reset_index(drop=True)
            code, names = pd.factorize(batch["ip"], use_na_sentinel=False)
            names = [None if pd.isna(x) else x for x in names]
            order = pd.DataFrame({"code": code, "us": batch["us"], "id": batch["id"]}).sort_values(["code", "us", "id"]).index.to_numpy()
            batch, status, left, own, client = batch.take(order), [], [], -1, Client()
            for c, us, weight in zip(code[order].tolist(), batch["us"].tolist(), batch["weight"].tolist()):
                if c != own:
                    own, client = c, clients.setdefault(names[c], Client())
                status.append("passed" if us == NEVER else client.step(us, weight or None, limits))
                left.append(0 if us == NEVER else client.left(us))
            made = {"id": batch["id"].to_numpy(), "ip": batch["ip"].to_numpy(), "status": status, "seconds_banned": left}
            yield pd.DataFrame(made | {c: batch[c].to_numpy() for c in carried})
        # rows up to this watermark still come in this batch, but in none after it
        passed = state.getCurrentWatermarkMs() * 1000 if forget else NEVER
        kept = {ip: c for ip, c in clients.items() if _last(c, limits) > passed}
        if not kept:
            if state.exists:
                state.remove()
            return
        state.update(([*kept], [c.until for c in kept.values()], [len(c.offences) for c in kept.values()], [t for c in kept.values() for t in c.offences]))
        if forget:
            state.setTimeoutTimestamp(max(1, min(-(-_last(c, limits) // 1000) for c in kept.values())))

    return run


def limit_stream(offences: DataFrame, limits: Limits = Limits(), carried: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """id, ip, status, seconds_banned and the carried columns of a stream of (id, ip, ts, weight); each batch is folded in (ts, id) order.

    Clients are hashed into GROUPS groups, whose rows of one batch are sorted in memory: bound a batch by the
    source's own options (maxFilesPerTrigger, maxOffsetsPerTrigger).  Null ts and weight count as in rate_limit.
    late: how late rows may come in event time; then clients are forgotten when nothing of
    them counts any more.  Without it every client that offended stays in the state.
    """
    stamped = offences.withColumn("ts", F.col("ts").cast("timestamp"))
    stamped = stamped.withWatermark("ts", late) if late else stamped
    extra = [c for c in carried if c not in ("id", "ip")]
    # no time: NEVER; no weight: 0
    us = F.coalesce(F.unix_micros("ts"), F.lit(NEVER)).alias("us")
    weight = F.when(F.col("weight").isNull(), 0).otherwise(F.greatest(F.col("weight").cast("int"), F.lit(1)))
    group = F.pmod(F.xxhash64("ip"), F.lit(GROUPS)).cast("int").alias("_group")
    slim = stamped.select(group, "id", "ip", us, weight.alias("weight"), *([F.col("ts").alias("_time")] if late and "ts" not in extra else []), *extra)
    shown = "".join(f", `{c}` {slim.schema[c].dataType.simpleString()}" for c in extra)
    schema = f"id {slim.schema['id'].dataType.simpleString()}, ip string, status string, seconds_banned long{shown}"
    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    return slim.groupBy("_group").applyInPandasWithState(limiter(limits, tuple(extra), bool(late)), schema, HELD, "append", timeout)


def limiter_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """ip, until (microseconds; null: no ban yet) of every client that a stopped limit_stream holds, read from its checkpoint."""
    held = spark.read.format("statestore").load(checkpoint).select(F.explode(F.arrays_zip("value.groupState.ips", "value.groupState.until")).alias("c"))
    return held.select("c.ips", F.nullif(F.col("c.until"), F.lit(NEVER))).toDF("ip", "until")


def tracked(state: DataFrame, now: Column) -> DataFrame:
    """tracked_ips and active_bans of limiter_state at a time in microseconds."""
    return state.agg(F.count("*").alias("tracked_ips"), F.count_if(F.col("until") > now).alias("active_bans"))


CASCADE_COLUMNS = ("client", "decision", "label", "http_status", "offense_weight", "triggered_by", "malformed_json")


def cascade_stream(requests: DataFrame, headers: Column, settings: Settings, late: str = "2 days", keep: tuple[str, ...] = ()) -> DataFrame:
    """The whole cascade on a stream of requests: id, the kept columns and CASCADE_COLUMNS (http_status: status), ban_triggered and seconds_banned.

    The stateless steps are those of the batch; the ban step holds a client's state until its
    ban and its window have passed.  Static denials have no part in it.
    """
    decided = decision.cascade(requests, headers, settings).withColumnRenamed("status", "http_status")
    denied = F.coalesce(F.col("decision") == decision.STATIC_DENY[0], F.lit(False))
    weight = F.when(F.col("offense_weight") > 0, F.col("offense_weight"))
    # a denied client's rows have no weight and lose nothing
    seen = decided.select("id", F.when(denied, F.concat(F.lit("denied:"), F.col("client"))).otherwise(F.col("client")).alias("ip"), "ts", F.when(~denied, weight).alias("weight"), *CASCADE_COLUMNS, *(c for c in keep if c != "ts"))
    limited = limit_stream(seen, settings.limits, (*CASCADE_COLUMNS, *keep), late)
    banned = F.col("status") == "banned"
    name, label, status, _, by = decision.RATE_LIMIT
    fixed = {"decision": F.lit(name), "label": F.lit(label), "http_status": F.lit(status), "offense_weight": F.lit(0), "triggered_by": F.array(F.lit(by))}
    counted = (F.col("status") == "ban_triggered") & F.col("decision").isin(decision.RECON[0], decision.PAYLOAD[0])
    changed = limited.withColumns({"ban_triggered": counted, "malformed_json": F.col("malformed_json") & ~banned} | {c: F.when(banned, v).otherwise(F.col(c)) for c, v in fixed.items()})
    return changed.select("id", *keep, *CASCADE_COLUMNS, "ban_triggered", "seconds_banned")


def payload_stream(segments: DataFrame, port: int = 80) -> DataFrame:
    """ts, src, payload of the inspected texts among TCP segments (ts, src, dst_port, tcp_bytes)."""
    return segments.filter(F.col("dst_port") == port).withColumn("payload", request_payload(F.col("tcp_bytes"))).filter("payload is not null").select("ts", "src", "payload")


def request_stream(spark: SparkSession, folder: str, schema: StructType, max_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """Requests from JSON lines as they arrive, without those whose body is larger than the cap."""
    return spark.readStream.schema(schema).json(folder).filter(F.coalesce(F.octet_length("body"), F.lit(0)) <= max_bytes)


def classify_stream(segments: DataFrame, detector: str, port: int = 80) -> DataFrame:
    """ts, src, payload, label of the inspected texts, by one registered detector (rules or a fitted model)."""
    known([detector])
    return payload_stream(segments, port).withColumn("label", DETECTORS[detector](F.array("payload"))[0])


def session_summary(classified: DataFrame, model: str) -> DataFrame:
    """model, packets, malicious: what was analysed, and how much of it isn't benign."""
    return classified.agg(F.count("*").alias("packets"), F.count_if(F.col("label") != "benign").alias("malicious")).select(F.lit(model).alias("model"), "packets", "malicious")
