"""Payload and request tables derived from the star-schema tables, and their SQL twins for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = [
    ("benign", "item=42&page=3"), ("benign", "q=garden+chairs&sort=price"), ("benign", "user=mira&lang=de"), ("benign", "city=Oslo&limit=20"),
    ("benign", "note=see you at 5; bring tea"), ("benign", "path=/a/b/c.html"), ("benign", "discount=15%25&code=SPRING"), ("benign", "body=hello world, this is fine"),
    ("sqli", "x' OR 1=1 --"), ("sqli", "7 UNION ALL SELECT login, pin FROM staff"), ("sqli", "1; DROP TABLE logs"), ("sqli", "5 AND SLEEP(3)"),
    ("sqli", "b' HAVING 2=2"), ("sqli", "0 or 1 = 1"), ("sqli", "id=9 and exists(select 1)"), ("sqli", "z') or ('3'='3"),
    ("xss", "<script>alert(7)</script>"), ("xss", "<img src=q onerror=run()>"), ("xss", "<a href='javascript: go()'>x</a>"), ("xss", "<svg/onload=alert(2)>"),
    ("xss", "<b onmouseover=alert(1)>"), ("xss", "<video src=x onplay=f()>"),
    ("sqli", "%27%20OR%201%3D1%20--"), ("xss", "%3Cscript%3Ealert(1)%3C%2Fscript%3E"), ("benign", "!!??##$$%%^^&&**(())__++"), ("benign", "%41%42%43%44%45%46%47%48%49"),
]
AGENTS = ["Mozilla/5.0 (X11; Linux x86_64)", "curl/8.4.0", "sqlmap/1.7", "python-requests/2.31", "Mozilla/5.0 (compatible; Nikto/2.5)", None, "curl/8 feroxbuster", "Mozilla/5.0 ' OR 1=1 --"]
FORWARDED = [None, None, "203.0.113.9", "198.51.100.7, 10.0.0.1", "not-an-ip", None, "300.1.1.1"]
LENGTHS = [["12"], None, ["12", "12"], ["12", "13"], ["-5"], ["1a"], None, [" 7 "], ["0"], None, ["99"]]
ENCODINGS = [None, None, ["chunked"], None, ["xchunked"], None, None, [" Chunked "], None, None, None, None, None]
CONNECTIONS = [None, "keep-alive", "Upgrade", "keep-alive, upgrade", "close"]
UPGRADES = [None, "websocket", "h2c"]
SUFFIXES = ["", "", "", "", "", "?next=/.env", "", "?q=1%27%20OR%201%3D1%20--", "", "", "?f=<script>alert(1)</script>", "", "", "&x=/.git/config", "", "", ""]
CONTENT_TYPES = [None, "application/json", "application/x-www-form-urlencoded", "text/plain", "application/json; charset=utf-8"]
BODIES = ["", "{\"a\": \"x' OR 1=1 --\", \"b\": [1, \"ok\"]}", "q=%3Cscript%3Ealert(1)%3C%2Fscript%3E", "plain words", "{not json", "a=1&b=2", ""]
TRUSTED = ["10.0.0.7", "10.0.0.21"]
DENIED, ALLOWED = ["10.0.0.13", "10.0.0.14"], ["10.0.0.14"]
WEBSOCKET_PATHS = ["/0", "/live"]
ADMINS = ["10.0.0.5", "10.0.0.6", "10.0.0.8", "10.0.0.9"]
ADMIN_URLS = ["/__waf/health", "/index.html", "/__waf/stats?x=1", "/__waf/metrics", "/__wafer/stats", "/__waf/other", "/__waf/"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, by: Column) -> Column:
    def lit(v) -> Column:
        if isinstance(v, list):
            return F.array(*map(F.lit, v))
        return F.lit(v)

    kind = "array<string>" if any(isinstance(v, list) for v in values) else "string"
    return F.element_at(F.array(*(lit(v).cast(kind) for v in values)), (by % len(values) + 1).cast("int"))


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, list):
        return "[" + ", ".join(map(_sql, v)) + "]"
    return "'" + v.replace("'", "''") + "'"


def _sql_pick(values: list, by: str) -> str:
    return f"(([{', '.join(map(_sql, values))}])[CAST({by} AS BIGINT) % {len(values)} + 1])"


def _with_pages(spark: SparkSession, sf_dir: str, *columns: Column) -> DataFrame:
    """The events, each with these columns of the page that its id points at, or nulls where there is none."""
    pages = table(spark, sf_dir, "pages").select("page_id", *columns)
    events = table(spark, sf_dir, "events")
    return events.join(pages, F.pmod(F.col("event_id"), F.lit(max(pages.count(), 1))) == F.col("page_id"), "left")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, payload, label: for every event a sample string, most with something of the event or its page behind it."""
    id = F.col("event_id")
    own = (
        F.when(id % 5 == 1, F.concat(F.lit("&ref="), F.coalesce("url", F.lit(""))))
        .when(id % 5 == 2, F.concat(F.lit("&n="), id.cast("string")))
        .when(id % 5 == 3, F.concat(F.lit("#"), F.left(F.md5(id.cast("string").cast("binary")), F.lit(8))))
        .when(id % 5 == 4, F.concat(F.lit("&p="), F.coalesce("props", F.lit(""))))
        .otherwise("")
    )
    return _with_pages(spark, sf_dir, F.col("url")).select(id.alias("id"), F.concat(_pick([p for _, p in SAMPLES], id), own).alias("payload"), _pick([s for s, _ in SAMPLES], id).alias("label"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for each event; its URL is that of the page that its id points at, or / where there is none."""
    id = F.col("event_id")
    df = _with_pages(spark, sf_dir, F.regexp_extract("url", r"https?://[^/]+(.*)", 1).alias("_path"))
    method = F.when(F.col("event_type") == "click", "POST").when(F.col("event_type") == "error", "PUT").otherwise("GET")
    return df.select(
        id.alias("id"), F.col("ts"), F.concat(F.lit("10.0.0."), F.col("user_id")).alias("remote"), method.alias("method"),
        F.concat(F.coalesce("_path", F.lit("/")), _pick(SUFFIXES, id)).alias("rel_url"), _pick(AGENTS, id).alias("user_agent"), _pick(FORWARDED, id).alias("xff"),
        _pick(LENGTHS, id).alias("content_length"), _pick(ENCODINGS, id).alias("transfer_encoding"), _pick(CONNECTIONS, id).alias("connection"), _pick(UPGRADES, id).alias("upgrade"),
        _pick(CONTENT_TYPES, id).alias("content_type"), F.when(F.col("event_type") == "click", _pick(BODIES, id)).otherwise("").alias("body"),
    )


def admin_url() -> Column:
    """Every fifth request's URL becomes an admin path, or one that looks like it."""
    return F.when(F.col("id") % 5 == 0, _pick(ADMIN_URLS, F.floor(F.col("id") / 5))).otherwise(F.col("rel_url"))


def headers_map() -> Column:
    """The request view's single-valued headers as a map from lower-case names; absent ones are absent."""
    every = F.create_map(F.lit("user-agent"), F.col("user_agent"), F.lit("x-forwarded-for"), F.col("xff"))
    return F.map_filter(every, lambda k, v: v.isNotNull())


_PAGES_SQL = "events LEFT JOIN pages ON event_id % greatest((SELECT count(*) FROM pages), 1) = page_id"
PAYLOADS_SQL = f"""SELECT event_id AS id, {_sql_pick([p for _, p in SAMPLES], 'event_id')} || CASE event_id % 5 WHEN 1 THEN '&ref=' || coalesce(url, '') WHEN 2 THEN '&n=' || event_id
WHEN 3 THEN '#' || left(md5(CAST(event_id AS VARCHAR)), 8) WHEN 4 THEN '&p=' || coalesce(props, '') ELSE '' END AS payload, {_sql_pick([s for s, _ in SAMPLES], 'event_id')} AS label FROM {_PAGES_SQL}"""
REQUESTS_SQL = f"""SELECT event_id AS id, ts, '10.0.0.' || user_id AS remote, CASE event_type WHEN 'click' THEN 'POST' WHEN 'error' THEN 'PUT' ELSE 'GET' END AS method,
coalesce(regexp_extract(url, 'https?://[^/]+(.*)', 1), '/') || {_sql_pick(SUFFIXES, 'event_id')} AS rel_url, {_sql_pick(AGENTS, 'event_id')} AS user_agent, {_sql_pick(FORWARDED, 'event_id')} AS xff,
{_sql_pick(LENGTHS, 'event_id')} AS content_length, {_sql_pick(ENCODINGS, 'event_id')} AS transfer_encoding, {_sql_pick(CONNECTIONS, 'event_id')} AS connection, {_sql_pick(UPGRADES, 'event_id')} AS upgrade,
{_sql_pick(CONTENT_TYPES, 'event_id')} AS content_type, CASE WHEN event_type = 'click' THEN {_sql_pick(BODIES, 'event_id')} ELSE '' END AS body
FROM {_PAGES_SQL}"""
