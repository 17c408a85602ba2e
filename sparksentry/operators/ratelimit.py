"""Sliding-window offence counting with temporary bans, per client, in event-time order.

A client's automaton is sequential, but a busy client isn't folded by one task: rows are
range-sorted by (client, time), so it spans partitions, and what a partition does to a
client that comes into it depends on one number only, the end of the ban it comes with.
Each row that could set off a ban is found from the rows before it (fewer than the threshold);
from these follows, for every possible end of a ban, the end of the last ban that the
partition leaves behind: a table of steps, short as most entries meet sooner or later.
The driver walks from partition to partition through these tables, and then all
partitions are folded at once, each from the state it was entered with.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import cut, stored

#: The end of no ban at all.
NEVER = -(1 << 62)
#: Rows of one client in a batch from which on they are folded by arrays.
MANY = 64
#: Steps of a partition's table that the driver holds; longer tables are asked by a query.
STEPS = 4096


@dataclass(frozen=True)
class Limits:
    """Seconds and counts; the window includes its oldest instant, a ban (of a second at least) ends at its last instant."""

    window: int = 2 * 86_400
    threshold: int = 3
    ban: int = 86_400


@dataclass
class Client:
    """One client's state; times are microseconds."""

    offences: deque = field(default_factory=deque)
    until: int = NEVER

    def step(self, ts: int, weight: int | None, limits: Limits) -> str:
        """banned: no effect; ban_triggered: the window is full, it is emptied and a ban begins; offence; passed: no weight, so only the ban is looked at."""
        if ts < self.until:
            return "banned"
        if weight is None:
            return "passed"
        self.offences.extend([ts] * max(1, weight))
        while self.offences and self.offences[0] < ts - limits.window * 1_000_000:
            self.offences.popleft()
        if len(self.offences) >= limits.threshold:
            self.offences.clear()
            self.until = ts + limits.ban * 1_000_000
            return "ban_triggered"
        return "offence"

    def left(self, ts: int) -> int:
        return max(0, self.until - ts) // 1_000_000


def triggers_possible(us: np.ndarray, weight: np.ndarray, before: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Rows that set off a ban if no ban is on since a time, and for each the latest such time; both ascend.

    us: times, ascending; weight: 0 for rows that are no offence; before: times of earlier
    offences, each of weight 1, the last threshold - 1 at least if there are so many.
    """
    n = len(before)
    times = np.concatenate([before, us])
    w = np.concatenate([np.ones(n, np.int64), weight])
    total = np.cumsum(w)
    wanted = total - limits.threshold
    first = np.searchsorted(total - w, wanted, side="right") - 1
    since = times[np.maximum(first, 0)]
    full = (w > 0) & (wanted >= 0) & (since >= times - limits.window * 1_000_000)
    full[:n] = False
    at = np.flatnonzero(full)
    return at - n, since[at]


def fold(us: np.ndarray, weight: np.ndarray, client: Client, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """For every row the end of the last ban set off up to it, and whether it sets one off; client is moved behind the rows."""
    at, since = triggers_possible(us, weight, np.array(client.offences, np.int64), limits)
    until, rows, ends = client.until, [], [client.until]
    k = int(np.searchsorted(since, until))
    while k < len(at):
        rows.append(int(at[k]))
        until = int(us[at[k]]) + limits.ban * 1_000_000
        ends.append(until)
        k = int(np.searchsorted(since, until))
    set_off = np.zeros(len(us), bool)
    set_off[rows] = True
    later = slice(rows[-1] + 1 if rows else 0, None)
    counted = np.where(us[later] >= until, weight[later], 0)
    old = [] if rows else list(client.offences)
    kept = [*old, *np.repeat(us[later], np.minimum(counted, limits.threshold)).tolist()][-max(limits.threshold - 1, 1) :]
    client.offences, client.until = deque(kept), until
    return np.array(ends, np.int64)[np.cumsum(set_off)], set_off


def _weights(weight: pa.Array) -> np.ndarray:
    """0 for null, else 1 at least."""
    known = weight.is_valid().to_numpy(zero_copy_only=False)
    return np.where(known, np.maximum(weight.fill_null(1).to_numpy(zero_copy_only=False).astype(np.int64), 1), 0)


def _by_client(batch: pa.RecordBatch) -> Iterator[tuple[str | None, int, int]]:
    """(client, first row, end) of the batch's runs of one client."""
    coded = batch.column("ip").dictionary_encode(null_encoding="encode")
    code = coded.indices.to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), batch.num_rows]
    names = coded.dictionary.to_pylist()
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield names[code[lo]], lo, hi


def _rows(batch: pa.RecordBatch, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Times and weights of the rows that have a time."""
    us = batch.column("us").slice(lo, hi - lo)
    timed = us.is_valid().to_numpy(zero_copy_only=False)
    return us.drop_null().to_numpy(zero_copy_only=False), _weights(batch.column("weight").slice(lo, hi - lo))[timed]


def _ends(batches: Iterator[pa.RecordBatch], limits: Limits) -> dict | None:
    """First and last client of a partition, whether they are one, and the last one's offences at the end, each as often as it weighs."""
    first, last, single, tail = None, None, True, np.zeros(0, np.int64)
    seen = False
    for batch in batches:
        for ip, lo, hi in _by_client(batch):
            if not seen:
                first, last, seen = ip, ip, True
            elif ip != last:
                last, single, tail = ip, False, tail[:0]
            us, w = _rows(batch, max(lo, hi - 4 * limits.threshold), hi)
            if np.count_nonzero(w) < min(limits.threshold - 1, hi - lo):
                us, w = _rows(batch, lo, hi)
            tail = np.concatenate([tail, np.repeat(us, np.minimum(w, limits.threshold))])[-max(limits.threshold - 1, 1) :]
    return {"first": first, "last": last, "single": single, "tail": tail.tolist()} if seen else None


def _exits(us: np.ndarray, weight: np.ndarray, before: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """A table (upper, exit): whoever comes with a ban that ends at `until` leaves with the exit of the first upper >= until; beyond the table with its own."""
    at, since = triggers_possible(us, weight, before, limits)
    if not len(at):
        return at, since
    end = us[at] + limits.ban * 1_000_000
    last, then = np.arange(len(at)), np.searchsorted(since, end)
    while (then < len(at)).any():
        # twice as many bans in every round
        going = then < len(at)
        last = np.where(going, last[np.minimum(then, len(at) - 1)], last)
        then = np.where(going, then[np.minimum(then, len(at) - 1)], then)
    # a ban set off earlier ends within its length from here
    reach = int(np.searchsorted(since, us[0] + limits.ban * 1_000_000)) + 1
    # of rows that need the same time without a ban, the first sets one off
    upper, first = np.unique(since[:reach], return_index=True)
    leaves = end[last][first]
    kept = np.append(leaves[1:] != leaves[:-1], True)
    return upper[kept], leaves[kept]


def entered_with(rows: DataFrame, limits: Limits) -> dict[int, tuple[int, list[int]]]:
    """For each partition that continues the client before it: the end of that client's ban, and its last offences."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := _ends(batches, limits):
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId()} | found], pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("single", pa.bool_()), ("tail", pa.list_(pa.int64()))]))

    # a row for each partition, with fewer times than the threshold
    parts = sorted(rows.mapInArrow(look, "part int, first string, last string, single boolean, tail array<long>").collect(), key=lambda r: r["part"])
    continued = {b["part"] for a, b in zip(parts, parts[1:]) if a["last"] == b["first"]}
    if not continued:
        return {}
    # the offences before each partition that goes on with a client; None: none of the client are before
    tails: dict[int, list[int] | None] = {}
    tail: list[int] = []
    for p in parts:
        tails[p["part"]] = tail if p["part"] in continued else None
        tail = [*(tail if p["single"] and p["part"] in continued else []), *p["tail"]][-max(limits.threshold - 1, 1) :]
    asked = {a["part"]: tails[a["part"]] if a["single"] else None for a, b in zip(parts, parts[1:]) if b["part"] in continued}
    shared = rows.sparkSession.sparkContext.broadcast(asked)

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        if part not in shared.value:
            return
        before = shared.value[part]
        if before is None:
            own, client = None, Client()
            for batch in batches:
                for ip, lo, hi in _by_client(batch):
                    if ip != own:
                        own, client = ip, Client()
                    fold(*_rows(batch, lo, hi), client, limits)
            upper, leaves = np.array([1 << 62]), np.array([client.until])
        else:
            # times and weights of one partition
            us, w = (np.concatenate(x) for x in zip(*(_rows(b, 0, b.num_rows) for b in batches)))
            upper, leaves = _exits(us, w, np.array(before, np.int64), limits)
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(upper), pa.int32()), pa.array(upper, pa.int64()), pa.array(leaves, pa.int64())], ["part", "upper", "leaves"])

    tables = stored(rows.mapInArrow(leave, "part int, upper long, leaves long"))
    sizes = {r["part"]: r["count"] for r in tables.groupBy("part").count().collect()}
    short = [p for p, n in sizes.items() if n <= STEPS]
    known: dict[int, list] = {}
    for r in tables.filter(F.col("part").isin(short)).orderBy("part", "upper").collect():
        known.setdefault(r["part"], []).append((r["upper"], r["leaves"]))

    def left(part: int, until: int) -> int:
        if part in known:
            at = np.searchsorted([u for u, _ in known[part]], until)
            return known[part][at][1] if at < len(known[part]) else until
        if part not in sizes:
            return until
        found = tables.filter((F.col("part") == part) & (F.col("upper") >= until)).agg(F.min_by("leaves", "upper")).first()[0]
        return until if found is None else found

    entered, until = {}, NEVER
    for p in parts:
        if p["part"] in continued:
            entered[p["part"]] = (until, [t for t in tails[p["part"]] if t >= until])
        else:
            until = NEVER
        if p["part"] in asked:
            until = left(p["part"], until if p["single"] else NEVER)
    return entered


def rate_limit(offences: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """id, ip, status, seconds_banned for every row of (id, ip, ts, weight).

    A null weight is no offence, so the row only looks at the ban.  A null ts can't be placed in
    time: its row passes, with no seconds, and changes nothing.  Null clients are one client.
    Rows are ordered by (ts, id) in a client; a client of any size is spread over partitions,
    and so are equal rows.
    """
    if limits.ban < 1 or limits.threshold < 1:
        raise ValueError("a ban lasts a second at least, a threshold is 1 at least")
    spark = offences.sparkSession
    slim = offences.select("id", "ip", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("weight").cast("int").alias("weight"))
    order = ["ip", "us", "id"]
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the row's number lets even equal rows be spread
    rows = cut(slim.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(many, *order, "_row").sortWithinPartitions(*order, "_row").drop("_row"))
    shared = spark.sparkContext.broadcast(entered_with(rows.select("ip", "us", "weight"), limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        until, tail = shared.value.get(TaskContext.get().partitionId(), (NEVER, []))
        own, client, begun = None, Client(deque(tail), until), False
        for batch in batches:
            status, left = np.full(batch.num_rows, "passed", object), np.zeros(batch.num_rows, np.int64)
            timed = batch.column("us").is_valid().to_numpy(zero_copy_only=False)
            for ip, lo, hi in _by_client(batch):
                if begun and ip != own:
                    client = Client()
                own, begun = ip, True
                place = lo + np.flatnonzero(timed[lo:hi])
                if len(place) < MANY:
                    for i, us, weight in zip(place.tolist(), batch.column("us").take(pa.array(place)).to_pylist(), batch.column("weight").take(pa.array(place)).to_pylist()):
                        status[i] = client.step(us, weight, limits)
                        left[i] = client.left(us)
                else:
                    us, weight = _rows(batch, lo, hi)
                    ends, set_off = fold(us, weight, client, limits)
                    status[place] = np.where(set_off, "ban_triggered", np.where(us < ends, "banned", np.where(weight > 0, "offence", "passed")))
                    left[place] = np.maximum(ends - us, 0) // 1_000_000
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("ip"), pa.array(status, pa.string()), pa.array(left)], ["id", "ip", "status", "seconds_banned"])

    kind = slim.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ip string, status string, seconds_banned long")


def ban_intervals(offences: DataFrame, limited: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """ip, begin, until (microseconds) and id of the row that set off each ban; limited: rate_limit's rows for the offences."""
    at = offences.select(F.col("id").alias("_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("begin"))
    return limited.filter("status = 'ban_triggered'").join(at, F.col("id") == F.col("_id")).select("ip", "id", "begin", (F.col("begin") + limits.ban * 1_000_000).alias("until"))


def banned_by(rows: DataFrame, bans: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows (ip, ts, id and any others) with _until, the end of the ban that each falls into, or null.

    An interval join: time is cut into buckets as wide as a ban, so that a ban lies in two of
    them at most, and rows meet only the bans of their client's bucket.  A client's rows are
    thus spread by time.  Bans of one client don't overlap, so a row falls into one at most;
    one that stands at the very time a ban begins falls into it if its id isn't smaller.
    """
    width = limits.ban * 1_000_000
    each = bans.select(F.col("ip").alias("_ip"), F.col("id").alias("_begun_by"), F.col("begin").alias("_begin"), F.col("until").alias("_until"))
    of = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    each = each.withColumn("_bucket", F.explode(F.sequence(of("_begin"), of("_until"))))
    us = rows.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    us = us.withColumn("_own", F.floor(F.col("_us") / F.lit(width)).cast("long"))
    inside = (F.col("_us") > F.col("_begin")) | ((F.col("_us") == F.col("_begin")) & (F.col("id") >= F.col("_begun_by")))
    found = us.join(each, F.col("ip").eqNullSafe(F.col("_ip")) & (F.col("_own") == F.col("_bucket")) & inside & (F.col("_us") < F.col("_until")), "left")
    return found.drop("_ip", "_begun_by", "_begin", "_bucket", "_own")


def active_bans(limited: DataFrame, offences: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """tracked_ips and active_bans at the time of the last offence."""
    at = offences.select("id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "ip")
    bans = limited.filter("status = 'ban_triggered'").join(at.select("id", "us"), "id").groupBy("ip").agg((F.max("us") + limits.ban * 1_000_000).alias("until"))
    end = at.agg(F.max("us").alias("end"), F.count_distinct("ip").alias("tracked_ips"))
    return end.join(bans, F.col("until") > F.col("end"), "left").groupBy("end", "tracked_ips").agg(F.count("until").alias("active_bans")).select("tracked_ips", "active_bans")


def sliding_count(offences: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """id, in_window: offences of the client in the window that ends with the row, without resets.

    Time is cut into stretches as long as the window; a row is seen in its own and the next
    one, which hold all that a window there reaches.  A busy client is thus spread by time.
    Rows without a time are counted among themselves.
    """
    width = limits.window * 1_000_000
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    own = F.floor(F.col("_us") / F.lit(width)).cast("long")
    each = F.when(F.col("_us").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(F.col("_own"), F.col("_own") + 1))
    seen = offences.select("id", "ip", "weight", us.alias("_us")).withColumn("_own", own).withColumn("_stretch", F.explode(each))
    w = Window.partitionBy("ip", "_stretch").orderBy("_us").rangeBetween(-width, 0)
    counted = seen.withColumn("in_window", F.sum("weight").over(w).cast("long"))
    return counted.filter(F.col("_own").eqNullSafe(F.col("_stretch"))).select("id", "in_window")
