"""Ensemble votes, the request cascade, evaluation aggregates and reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import percent_decode
from ..sources.scratch import stored
from . import ratelimit
from .json_leaves import json_strings
from .settings import POLICIES, Settings

DETECTORS: dict[str, Callable[[Column], Column]] = {}


def register_detector(name: str, of_text: Callable[[Column], Column]) -> None:
    """A detector that is a Column function from a text to its label."""
    DETECTORS[name] = lambda texts: F.transform(texts, lambda t: of_text(t))  # noqa: PLW0108  a lambda of one argument is wanted


def register_model(name: str, classifier) -> None:
    """A detector that is a fitted model, with of_texts from an array of texts to one of labels."""
    DETECTORS[name] = classifier.of_texts


register_detector("signature_baseline", rules.signature)
register_detector("anomaly", rules.anomaly)
register_detector("keyword", lambda t: F.when(F.lower(t).rlike(r"\b(select|union|drop|script|alert)\b"), F.when(F.lower(t).contains("<"), "xss").otherwise("sqli")).otherwise("benign"))


def known(names: Sequence[str]) -> Sequence[str]:
    if unknown := [n for n in names if n not in DETECTORS]:
        raise ValueError(f"unknown detectors {unknown}: train and register them first")
    return names


def votes(text: Column, names: Sequence[str]) -> Column:
    return F.create_map(*(x for n in known(names) for x in (F.lit(n), DETECTORS[n](F.array(text))[0])))


def verdict(vote_map: Column, policy: str = "any", detectors: int = 1) -> Column:
    """struct(blocked, final_label, triggered_by); the label is the commonest one, smaller if they tie; detectors stand in the map's order."""
    if policy not in POLICIES or detectors < 1:
        raise ValueError("an unknown policy or no detectors")
    hit = F.map_filter(vote_map, lambda k, v: v != "benign")
    n = F.cardinality(hit)
    blocked = {"any": n >= 1, "majority": n * 2 > detectors, "all": n == detectors}[policy]
    labels = F.map_values(hit)
    counted = F.transform(F.array_distinct(labels), lambda x: F.struct((-F.size(F.filter(labels, lambda y: y == x))).alias("n"), x.alias("label")))
    label = F.array_min(counted)["label"]
    return F.struct(blocked.alias("blocked"), F.when(blocked, label).otherwise("benign").alias("final_label"), F.map_keys(hit).alias("triggered_by"))


def first_blocked(labels: dict[str, Column], texts: Column, policy: str) -> Column:
    """The verdict on the first text that is blocked, null if none is; labels: of every text by each detector."""
    of = lambda i: verdict(F.create_map(*(x for n, c in labels.items() for x in (F.lit(n), F.get(c, i)))), policy, len(labels))
    all_of = F.transform(texts, lambda _, i: of(i))
    return F.get(F.filter(all_of, lambda v: v["blocked"]), F.lit(0))


# The decisions, with label, status, offence weight and who decided (where it is always the same).
STATIC_DENY = ("blocked_static_deny", "denylisted", 403, 0, "static_deny_list")
RATE_LIMIT = ("blocked_ratelimit", "banned_ip", 429, 0, "rate_limiter")
RECON = ("blocked_recon", "recon", 403, 2, None)
MALFORMED = ("blocked_malformed", "malformed_request", 400, 2, None)
WEBSOCKET = ("blocked_websocket", "websocket_not_allowed", 400, 0, "websocket_upgrade")
PASSED_THROUGH = ("allowed_websocket_passthrough", "benign", 200, 0, None)
PAYLOAD = ("blocked", None, 403, 1, None)
ALLOWED = ("allowed", "benign", 200, 0, None)
FAILED = ("error", "internal_error", 500, 0, None)
MALFORMED_JSON = ("note_malformed_json", "malformed_json", None, 0, "json_extraction")
FIELDS = ("decision", "label", "status", "offense_weight", "triggered_by")


def _decision(fixed: tuple, label: Column | None = None, triggered_by: Column | None = None) -> Column:
    name, own, status, weight, by = fixed
    none = F.array().cast("array<string>")
    who = triggered_by if triggered_by is not None else F.array(F.lit(by)) if by else none
    values = (F.lit(name), label if label is not None else F.lit(own), F.lit(status).cast("int"), F.lit(weight), who)
    return F.struct(*(v.alias(n) for n, v in zip(FIELDS, values)))


def cascade(requests: DataFrame, headers: Column, settings: Settings) -> DataFrame:
    """The request table with client, decision, label, status, offense_weight, triggered_by and malformed_json.

    The order is: static deny (an allow-listed client is spared), reconnaissance, framing headers,
    websocket, the ensemble over the decoded URL and the body (a JSON body's strings and keys), the
    signature rules over header texts, allow.  A step is only computed for rows that no earlier one
    has decided.  with_bans applies the ban step, which needs the clients' history.

    A request that can't be handled, having no URL or method or a body whose walk breaks off, gets
    an error with status 500, which says nothing of the cause: one bad row ends no job.
    It is neither counted nor logged as a decision.
    """
    trusted = list(settings.trusted_proxies)
    deny = F.col("client").isin(*settings.static_deny_ips) & ~F.col("client").isin(*settings.static_allow_ips)
    df = requests.withColumn("client", rules.client_ip(F.col("remote"), F.col("xff"), trusted)).withColumn("_deny", deny)
    unfit = F.col("rel_url").isNull() | F.col("method").isNull()
    df = df.withColumn("_recon", F.when(~F.col("_deny") & ~unfit, rules.recon(F.col("rel_url"), headers, F.col("client"), trusted)))
    df = df.withColumn("_open", F.coalesce(~F.col("_recon")["flagged"], F.lit(False)))
    df = df.withColumn("_bad", F.when(F.col("_open"), rules.integrity_reason(F.col("content_length"), F.col("transfer_encoding"))))
    df = df.withColumn("_ws", F.col("_open") & F.col("_bad").isNull() & rules.websocket_upgrade(F.col("connection"), F.col("upgrade")))
    df = df.withColumn("_left", F.col("_open") & F.col("_bad").isNull() & ~F.col("_ws"))
    is_json = F.col("_left") & F.coalesce(F.col("content_type"), F.lit("")).contains("application/json")
    df = df.withColumn("_json", json_strings(F.when(is_json, F.coalesce("body", F.lit("")))))
    of_json = F.concat(F.array(percent_decode(F.col("rel_url"))), F.col("_json")["string_values"])
    texts = F.when(is_json, of_json).when(F.col("_left"), rules.inspectable_texts(F.col("rel_url"), F.col("body"), F.col("content_type")))
    df = df.withColumn("_texts", F.filter(texts, lambda x: x != ""))
    names = known(settings.models)
    for i, n in enumerate(names):
        df = df.withColumn(f"_votes{i}", DETECTORS[n](F.col("_texts")))
    df = df.withColumn("_body", first_blocked({n: F.col(f"_votes{i}") for i, n in enumerate(names)}, F.col("_texts"), settings.voting_policy))
    heads = F.filter(F.transform(rules.header_texts(headers), lambda t: rules.signature(t)), lambda x: x != "benign")
    df = df.withColumn("_head", F.when(F.col("_left") & F.col("_body").isNull(), F.get(heads, F.lit(0))))
    passed = rules.path_of(F.col("rel_url")).isin(*settings.allow_websocket_paths)
    made = (
        F.when(F.col("_deny"), _decision(STATIC_DENY))
        .when(unfit | F.coalesce(F.col("_json")["failed"], F.lit(False)), _decision(FAILED))
        .when(F.col("_recon")["flagged"], _decision(RECON, triggered_by=F.col("_recon")["reasons"]))
        .when(F.col("_bad").isNotNull(), _decision(MALFORMED, triggered_by=F.array("_bad")))
        .when(F.col("_ws") & passed, _decision(PASSED_THROUGH))
        .when(F.col("_ws"), _decision(WEBSOCKET))
        .when(F.col("_body").isNotNull(), _decision(PAYLOAD, F.col("_body")["final_label"], F.col("_body")["triggered_by"]))
        .when(F.col("_head").isNotNull(), _decision(PAYLOAD, F.col("_head"), F.array(F.lit("signature_baseline"))))
        .otherwise(_decision(ALLOWED))
    )
    bad_json = F.coalesce(is_json & ~F.col("_json")["was_valid_json"], F.lit(False))
    df = df.withColumn("malformed_json", bad_json).withColumn("_made", made)
    return df.select(*requests.columns, "client", *(F.col(f"_made.{c}").alias(c) for c in FIELDS), "malformed_json")


def with_bans(decided: DataFrame, limits: ratelimit.Limits) -> DataFrame:
    """Cascade rows after the ban step, with ban_triggered and seconds_banned.

    All rows but the static denials look at their client's ban, in the order of (ts, id); those under
    it lose their own decision and count no offence.  Only offences are folded; the bans they set off
    are intervals, and all other rows are joined with them.  A ban that bad framing headers set off holds
    like any other, but isn't marked in ban_triggered: the original doesn't count it.  decided is read
    three times and should be stored.
    """
    denied = F.coalesce(F.col("decision") == STATIC_DENY[0], F.lit(False))
    offends = ~denied & (F.col("offense_weight") > 0)
    row = F.struct("id", *(c for c in decided.columns if c != "id"))
    limited = ratelimit.rate_limit(decided.filter(offends).select(row.alias("id"), F.col("client").alias("ip"), "ts", F.col("offense_weight").alias("weight")), limits)
    folded = stored(limited)
    offences = folded.select("id.*", F.col("status").alias("_limit"), "seconds_banned")
    begin = F.unix_micros(F.col("id.ts").cast("timestamp"))
    bans = folded.filter("status = 'ban_triggered'").select("ip", F.col("id.id").alias("id"), begin.alias("begin"), (begin + limits.ban * 1_000_000).alias("until"))
    others = ratelimit.banned_by(decided.filter(~denied & ~offends).withColumn("ip", F.col("client")), bans, limits)
    left = F.floor((F.col("_until") - F.col("_us")) / 1_000_000).cast("long")
    others = others.withColumns({"_limit": F.when(F.col("_until").isNotNull(), "banned").otherwise("passed"), "seconds_banned": F.coalesce(left, F.lit(0).cast("long"))})
    df = offences.unionByName(others.select(*offences.columns))
    banned = F.col("_limit") == "banned"
    counted = (F.col("_limit") == "ban_triggered") & F.col("decision").isin(RECON[0], PAYLOAD[0])
    own = F.when(banned, _decision(RATE_LIMIT)).otherwise(F.struct(*FIELDS))
    df = df.withColumns({"ban_triggered": counted, "malformed_json": F.col("malformed_json") & ~banned, "_own": own})
    df = df.select(*decided.columns[: decided.columns.index(FIELDS[0])], *(F.col(f"_own.{c}").alias(c) for c in FIELDS), "malformed_json", "ban_triggered", "seconds_banned")
    return df.unionByName(decided.filter(denied).withColumns({"ban_triggered": F.lit(False), "seconds_banned": F.lit(0).cast("long")}))


def log_events(decided: DataFrame) -> DataFrame:
    """The rows to log: every decision, and a note before it where a JSON body is malformed."""
    none = F.array().cast("array<string>")
    # one pass over the decisions, which may be a stream's
    both = F.when(F.col("malformed_json"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = decided.filter(F.col("decision") != FAILED[0]).withColumn("triggered_by", F.coalesce("triggered_by", none)).withColumn("_note", F.explode(both))
    note = {"decision": F.lit(MALFORMED_JSON[0]), "label": F.lit(MALFORMED_JSON[1]), "status": F.lit(None).cast("int"), "offense_weight": F.lit(0), "triggered_by": F.array(F.lit(MALFORMED_JSON[4]))}
    return rows.withColumns({c: F.when(F.col("_note"), v).otherwise(F.col(c)) for c, v in note.items()}).drop("_note")


def logged_path() -> Column:
    """The URL, without its query for websocket decisions."""
    return F.when(F.col("decision").isin(WEBSOCKET[0], PASSED_THROUGH[0]), rules.path_of(F.col("rel_url"))).otherwise(F.col("rel_url"))


def log_json(latency_ms: Column | None = None) -> Column:
    """A logged row as one JSON object; latency_ms: 0 where requests aren't timed."""
    late = F.round(F.lit(0.0) if latency_ms is None else latency_ms, 3)
    return F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("decision"), F.col("client").alias("client_ip"), F.col("method"), F.left(logged_path(), F.lit(300)).alias("path"), F.col("label"), F.col("triggered_by"), late.alias("latency_ms")))


# What a console line begins with.
TAGS = {"allowed": "ALLOW", "blocked": "BLOCK", "blocked_static_deny": "DENY ", "blocked_recon": "RECON", "blocked_malformed": "MALFD", "blocked_websocket": "WS   ", "allowed_websocket_passthrough": "WS-OK", "note_malformed_json": "JSON?", "blocked_ratelimit": "BAN  "}


def console_line(latency_ms: Column | None = None) -> Column:
    """A logged row as one line of fixed-width fields; longer ones aren't cut, but for the path."""
    tags = F.create_map(*(F.lit(x) for pair in TAGS.items() for x in pair))
    wide = lambda c, n, pad: F.when(F.length(c) < n, pad(c, n, " ")).otherwise(c)
    late = F.lit(0.0) if latency_ms is None else latency_ms
    path = F.rpad(F.left(logged_path(), F.lit(60)), 60, " ")
    return F.concat(F.coalesce(tags[F.col("decision")], F.col("decision")), F.lit(" "), wide(F.col("client"), 15, F.lpad), F.lit(" "), wide(F.col("method"), 6, F.rpad), F.lit(" "), path, F.lit(" label="), wide(F.col("label"), 8, F.rpad), F.lit(" latency="), F.format_string("%6.2f", late), F.lit("ms"))


def counters(banned: DataFrame) -> DataFrame:
    """allowed, blocked, banned_ips_triggered, static_denied, started_at and uptime_seconds of what with_bans gives.

    Event time stands for the clock: the first request starts it, the last one asks.
    """
    is_ = lambda *d: F.count_if(F.col("decision").isin(*d))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return banned.agg(
        is_(ALLOWED[0], PASSED_THROUGH[0]).alias("allowed"),
        is_(RATE_LIMIT[0], RECON[0], MALFORMED[0], WEBSOCKET[0], PAYLOAD[0]).alias("blocked"),
        F.count_if("ban_triggered").alias("banned_ips_triggered"),
        is_(STATIC_DENY[0]).alias("static_denied"),
        seconds(F.min("ts")).alias("started_at"),
        (seconds(F.max("ts")) - seconds(F.min("ts"))).alias("uptime_seconds"),
    )


# Names, kinds and help texts of the exported series.
METRICS = {
    "waf_requests_allowed_total": ("allowed", "counter", "Requests forwarded to the backend"),
    "waf_requests_blocked_total": ("blocked", "counter", "Requests blocked by the WAF"),
    "waf_static_denied_total": ("static_denied", "counter", "Requests rejected by the static deny list"),
    "waf_bans_triggered_total": ("banned_ips_triggered", "counter", "Times an IP crossed the auto-ban threshold"),
    "waf_uptime_seconds": ("uptime_seconds", "gauge", "Seconds since this WAF process started"),
}


def prometheus_text(counted: DataFrame) -> DataFrame:
    lines = []
    for metric, (column, kind, text) in METRICS.items():
        shown = F.format_string("%.1f", F.col(column)) if kind == "gauge" else F.col(column).cast("string")
        lines += [F.lit(f"# HELP {metric} {text}"), F.lit(f"# TYPE {metric} {kind}"), F.concat(F.lit(f"{metric} "), shown)]
    return counted.select(F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("exposition"))


def admin_stats(banned: DataFrame, settings: Settings) -> DataFrame:
    """One JSON object: counters, uptime, policy, detectors, and the limiter's tracked clients and active bans with the seconds left."""
    counted = counters(banned)
    # offences are tracked per client; a ban lasts its time from the row that set it off
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = banned.withColumn("_us", us).groupBy("client").agg(F.count_if(F.col("offense_weight") > 0).alias("_n"), F.max(F.col("_us") + F.col("seconds_banned") * 1_000_000).alias("_until"))
    last = banned.agg(F.max(us).alias("_now"))
    limiter = ends.join(F.broadcast(last)).agg(F.count_if(F.col("_n") > 0).alias("tracked_ips"), F.count_if(F.col("_until") > F.col("_now")).alias("active_bans"))
    names = F.array(*map(F.lit, settings.models))
    return counted.join(F.broadcast(limiter)).select(F.to_json(F.struct("allowed", "blocked", "banned_ips_triggered", "static_denied", F.floor("started_at").alias("started_at"), F.round("uptime_seconds", 1).alias("uptime_seconds"), F.lit(settings.voting_policy).alias("policy"), names.alias("detectors"), F.struct(F.lit("memory").alias("backend"), "tracked_ips", "active_bans").alias("rate_limiter"))).alias("stats"))


# The paths that the admin endpoint answers.
ADMIN_PREFIX = "/__waf/"
ADMIN_PAGES = ("health", "stats", "metrics")


def admin_route(rel_url: Column, client: Column, settings: Settings) -> Column:
    """struct(status, page) for an admin path: 403 to strangers, 404 for unknown pages; null for other paths."""
    path = rules.path_of(rel_url)
    page = F.substring(path, len(ADMIN_PREFIX) + 1, 1000)
    answer = lambda status, what: F.struct(F.lit(status).alias("status"), what.alias("page"))
    stranger = ~client.isin(*settings.admin_allowed_ips)
    return F.when(path.startswith(ADMIN_PREFIX), F.when(stranger, answer(403, F.lit(None).cast("string"))).when(page.isin(*ADMIN_PAGES), answer(200, page)).otherwise(answer(404, F.lit(None).cast("string"))))


def evaluation_table(labelled: DataFrame, detectors: Sequence[str], labels: list[str]) -> DataFrame:
    """A row for each detector, best on the obfuscated split first: accuracy and macro F1 on both splits, and the drop.

    labelled: split ('clean' or 'obfuscated'), label, payload.  Every detector reads a row once.
    """
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("detector"), DETECTORS[n](F.array("payload"))[0].alias("y_pred")) for n in known(detectors)))).alias("e")
    scored = metrics(labelled.select("split", F.col("label").alias("y_true"), each).select("split", "y_true", "e.*"), labels, ["detector", "split"])
    of = lambda split, c: F.max(F.when(F.col("split") == split, F.col(c)))
    found = scored.groupBy("detector").agg(of("clean", "accuracy").alias("accuracy_clean"), of("clean", "macro_f1").alias("f1_clean"), of("obfuscated", "accuracy").alias("accuracy_obfuscated"), of("obfuscated", "macro_f1").alias("f1_obfuscated"))
    return found.withColumn("f1_drop_evasion", F.col("f1_clean") - F.col("f1_obfuscated")).orderBy(F.desc("f1_obfuscated"), "detector")


def save_metrics(table: DataFrame, folder: str) -> None:
    """The evaluation table, a few rows in their order, as one CSV file."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def confusion(predicted: DataFrame, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """y_true, y_pred, n for every pair of labels; predictions outside the labels vanish."""
    grouped = predicted.filter(F.col("y_true").isin(*labels)).groupBy(*(by or []), "y_true").pivot("y_pred", labels).count().na.fill(0)
    pairs = F.explode(F.array(*(F.struct(F.lit(x).alias("y_pred"), F.col(x).alias("n")) for x in labels)))
    return grouped.select(*(by or []), "y_true", pairs.alias("p")).select(*(by or []), "y_true", "p.y_pred", "p.n")


def metrics(predicted: DataFrame, labels: list[str], by: list[str]) -> DataFrame:
    """accuracy and macro precision, recall and F1 in one pass."""
    aggregates, sums = [F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy")], {}
    for x in labels:
        aggregates += [F.count_if((F.col("y_true") == x) & (F.col("y_pred") == x)).alias(f"_tp_{x}"), F.count_if(F.col("y_pred") == x).alias(f"_p_{x}"), F.count_if(F.col("y_true") == x).alias(f"_t_{x}")]
    out = predicted.groupBy(*by).agg(*aggregates)
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    for x in labels:
        tp, p, t = F.col(f"_tp_{x}"), F.col(f"_p_{x}"), F.col(f"_t_{x}")
        sums.setdefault("macro_precision", []).append(safe(tp, p))
        sums.setdefault("macro_recall", []).append(safe(tp, t))
        sums.setdefault("macro_f1", []).append(safe(2 * tp, p + t))
    return out.select(*by, "accuracy", *((sum(v[1:], v[0]) / len(labels)).alias(k) for k, v in sums.items()))


def confusion_text(matrix: DataFrame, labels: list[str]) -> DataFrame:
    """One fixed-width line for each true label."""
    wide = matrix.groupBy("y_true").pivot("y_pred", labels).sum("n").na.fill(0)
    return wide.select(F.concat(F.rpad("y_true", 10, " "), *(F.lpad(F.col(x).cast("string"), 10, " ") for x in labels)).alias("line"), "y_true")


def request_payload(tcp: Column) -> Column:
    """The inspected text of a raw HTTP/1.x segment: a GET's query or a POST's body, percent-decoded once; else null."""
    text = F.decode(tcp, "ISO-8859-1")
    line = r"(?m)^(GET|POST) +(\S+) +HTTP/1\.[01]"
    method, target = F.regexp_extract(text, line, 1), F.regexp_extract(text, line, 2)
    query = F.when(target.contains("?"), F.regexp_replace(target, r"^[^?]*\?", ""))
    at = F.instr(text, "\r\n\r\n")
    body = F.when(at > 0, F.substring(text, at + 4, F.length(text)))
    raw = F.when(method == "GET", query).when(method == "POST", F.when(F.length(body) > 0, body))
    return percent_decode(raw)
