"""One query for each operator, over whole tables; plans/oracle.py has their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import augment, rules, text
from ..operators import decision, json_leaves, models, ranks, ratelimit
from ..operators.settings import Settings
from ..operators.stored_models import fit_weighted
from ..sources import capture, corpus
from ..sources.scratch import scratch, stored
from ..sources.views import ADMINS, ALLOWED, DENIED, TRUSTED, WEBSOCKET_PATHS, admin_url, headers_map, payloads, requests, table
from ..streaming import live, traffic

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.ascii_fold(F.col("text")).alias("text"), "lang")


@query
def signature_by_lang(spark, sf_dir):
    df = folded(spark, sf_dir).select("lang", rules.signature(F.col("text")).alias("verdict"), rules.anomaly(F.col("text")).alias("anomaly"))
    return df.groupBy("lang", "verdict", "anomaly").agg(F.count("*").alias("n"))


@query
def signature_verdicts(spark, sf_dir):
    return payloads(spark, sf_dir).select("id", rules.signature(F.col("payload")).alias("verdict"))


@query
def signature_rule_hits(spark, sf_dir):
    return payloads(spark, sf_dir).select(F.explode(rules.signature_hits(F.col("payload"))).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query
def anomaly_verdicts(spark, sf_dir):
    return folded(spark, sf_dir).select("id", rules.anomaly(F.col("text")).alias("verdict"))


@query
def anomaly_reasons(spark, sf_dir):
    return payloads(spark, sf_dir).select("id", F.array_join(rules.anomaly_reasons(F.col("payload")), ";").alias("reasons"))


@query
def recon_flags(spark, sf_dir):
    df = requests(spark, sf_dir).withColumn("r", rules.recon(F.col("rel_url"), headers_map(), F.col("remote"), TRUSTED))
    return df.select("id", F.col("r.flagged").alias("flagged"), F.array_join("r.reasons", ";").alias("reasons"))


@query
def recon_user_agent(spark, sf_dir):
    return requests(spark, sf_dir).groupBy(rules.agent_reason(F.col("user_agent")).alias("reason")).agg(F.count("*").alias("n"))


@query
def recon_sensitive_path(spark, sf_dir):
    return requests(spark, sf_dir).select("id", rules.path_reason(F.col("rel_url")).alias("reason")).filter("reason is not null")


@query
def recon_spoofed_headers(spark, sf_dir):
    reasons = rules.spoof_reasons(headers_map(), F.col("remote"), TRUSTED)
    return requests(spark, sf_dir).select("id", F.array_join(reasons, ";").alias("reasons")).filter("reasons <> ''")


@query
def header_integrity(spark, sf_dir):
    return requests(spark, sf_dir).select("id", rules.integrity_reason(F.col("content_length"), F.col("transfer_encoding")).alias("reason"))


@query
def websocket_upgrade(spark, sf_dir):
    return requests(spark, sf_dir).select("id", rules.websocket_upgrade(F.col("connection"), F.col("upgrade")).alias("websocket"))


@query
def client_ip_resolution(spark, sf_dir):
    return requests(spark, sf_dir).select("id", rules.client_ip(F.col("remote"), F.col("xff"), TRUSTED).alias("client"))


@query
def inspectable_texts(spark, sf_dir):
    texts = rules.inspectable_texts(F.col("rel_url"), F.col("body"), F.col("content_type"))
    return requests(spark, sf_dir).select("id", F.posexplode(texts).alias("pos", "text"))


@query
def header_texts(spark, sf_dir):
    return requests(spark, sf_dir).select("id", F.posexplode(rules.header_texts(headers_map())).alias("pos", "text"))


@query
def http_payload_extract(spark, sf_dir):
    raw = F.concat("method", F.lit(" "), "rel_url", F.lit(" HTTP/1.1\r\nHost: h\r\n\r\n"), "body")
    return requests(spark, sf_dir).select("id", decision.request_payload(raw.cast("binary")).alias("payload")).filter("payload is not null")


@query
def url_decode_lenient(spark, sf_dir):
    return payloads(spark, sf_dir).select("id", text.percent_decode(F.col("payload")).alias("decoded"))


@query
def url_encode_strict(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.percent_encode(F.col("url")).alias("encoded"))


@query
def url_encode_double(spark, sf_dir):
    return payloads(spark, sf_dir).select("id", augment.TECHNIQUES["double_url_encode"](F.col("payload"), F.col("id")).alias("encoded"))


@query
def token_counts(spark, sf_dir):
    return folded(spark, sf_dir).select("id", F.size(text.tokenize(F.col("text"))).cast("long").alias("tokens"))


@query
def tokens_top(spark, sf_dir):
    tokens = folded(spark, sf_dir).select(F.explode(text.tokenize(F.col("text"))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(100)


@query
def ngrams_top(spark, sf_dir):
    # only terms that can be among the largest are counted exactly, by row, so not all pairs of words are shuffled
    found = models.fit_features(models.tokens(folded(spark, sf_dir)), 100).vocabulary
    return spark.createDataFrame(list(zip(found.terms, found.total.tolist())), "gram string, n long").orderBy(F.desc("n"), "gram")


def _features(spark, sf_dir) -> models.Features:
    """The terms of the documents, counted by row, with label (the language); and their vocabulary."""
    docs = folded(spark, sf_dir).withColumn("label", F.col("lang"))
    return models.fit_features(models.tokens(docs, keep=("label",)), keep=("label",))


@query
def tfidf_vocab(spark, sf_dir):
    found = _features(spark, sf_dir).vocabulary
    rows = list(zip(found.terms, found.df.tolist(), found.total.tolist(), found.idf.round(6).tolist()))  # at most MAX_FEATURES
    return spark.createDataFrame(rows, "term string, df long, total long, idf double")


@query
def tfidf_weights(spark, sf_dir):
    weighted = models.weights(_features(spark, sf_dir))
    total = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w)
    return weighted.filter(F.size("weights") > 0).select("id", F.size("weights").cast("long").alias("terms"), F.round(total, 6).alias("weight"), F.round(F.array_max("weights"), 6).alias("largest"))


def _predicted(spark, sf_dir, name, **limit) -> tuple[models.Features, DataFrame]:
    features = _features(spark, sf_dir)
    fitted = fit_weighted(name, models.weights(features, ("label",)), features.vocabulary, **limit)
    return features, models.predict_rows(features, fitted)


@query
def nb_train(spark, sf_dir):
    features = _features(spark, sf_dir)
    return models.nb_fit(models.weights(features, ("label",)), features.vocabulary)[0].select("term", "label", F.round("logp", 6).alias("logp"))


@query
def nb_predict(spark, sf_dir):
    return _predicted(spark, sf_dir, "naive_bayes")[1]


@query
def nb_confusion(spark, sf_dir):
    features, found = _predicted(spark, sf_dir, "naive_bayes")
    both = found.join(features.rows.select("id", "label"), "id").select(F.col("label").alias("y_true"), F.col("predicted").alias("y_pred"))
    return decision.confusion(both, ["de", "en", "es", "fr"])


@query
def lr_predict(spark, sf_dir):
    return _predicted(spark, sf_dir, "logistic_regression", max_iter=1000)[1]


@query
def svm_predict(spark, sf_dir):
    return _predicted(spark, sf_dir, "svm")[1]


def _ensemble(spark, sf_dir, policy):
    names = ["signature_baseline", "anomaly", "keyword"]
    df = payloads(spark, sf_dir).withColumn("v", decision.verdict(decision.votes(F.col("payload"), names), policy, len(names)))
    return df.select("id", F.col("v.blocked").alias("blocked"), F.col("v.final_label").alias("final_label"), F.array_join("v.triggered_by", ",").alias("triggered_by"))


for _policy in decision.POLICIES:
    QUERIES[f"ensemble_{_policy}"] = lambda spark, sf_dir, p=_policy: _ensemble(spark, sf_dir, p)


def evaluated(spark, sf_dir):
    """split, y_true, y_pred of the signature detector on the samples, plain and percent-encoded."""
    df = payloads(spark, sf_dir)
    both = df.select(F.lit("clean").alias("split"), "label", "payload").unionByName(df.select(F.lit("encoded").alias("split"), "label", text.percent_encode(F.col("payload")).alias("payload")))
    return both.select("split", F.col("label").alias("y_true"), rules.signature(F.col("payload")).alias("y_pred"))


@query
def eval_metrics(spark, sf_dir):
    out = decision.metrics(evaluated(spark, sf_dir), corpus.LABELS, ["split"])
    return out.select("split", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query
def eval_confusion(spark, sf_dir):
    return decision.confusion(evaluated(spark, sf_dir), corpus.LABELS, ["split"])


@query
def eval_f1_drop(spark, sf_dir):
    f1 = decision.metrics(evaluated(spark, sf_dir), corpus.LABELS, ["split"]).agg(F.max(F.when(F.col("split") == "clean", F.col("macro_f1"))).alias("clean"), F.max(F.when(F.col("split") == "encoded", F.col("macro_f1"))).alias("encoded"))
    return f1.select(F.round("clean", 6).alias("f1_clean"), F.round("encoded", 6).alias("f1_encoded"), F.round(F.col("clean") - F.col("encoded"), 6).alias("f1_drop"))


@query
def eval_report_lines(spark, sf_dir):
    clean = decision.confusion(evaluated(spark, sf_dir).filter("split = 'clean'"), corpus.LABELS)
    return decision.confusion_text(clean, corpus.LABELS).select("line")


@query
def latency_quantiles(spark, sf_dir):
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.95).alias("p95"), F.max("value").alias("longest"))
    return out.select("event_type", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "longest")))


@query
def label_counts(spark, sf_dir):
    return payloads(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


LIMITS = ratelimit.Limits(window=86_400, threshold=4, ban=43_200)
SETTINGS = Settings(models=("signature_baseline", "anomaly"), voting_policy="any", trusted_proxies=tuple(TRUSTED), static_deny_ips=tuple(DENIED), static_allow_ips=tuple(ALLOWED), allow_websocket_paths=tuple(WEBSOCKET_PATHS), admin_allowed_ips=tuple(ADMINS), limits=LIMITS)
SHOWN = ["id", "client", "decision", "label", "status", "offense_weight", "array_join(triggered_by, ';') AS triggered_by", "malformed_json"]


def decided(spark, sf_dir):
    return decision.cascade(requests(spark, sf_dir), headers_map(), SETTINGS)


def banned(spark, sf_dir):
    # stored: the ban step reads the decisions twice, and a filter on them mustn't be pushed into the cascade's own plan
    return decision.with_bans(stored(decided(spark, sf_dir)), LIMITS)


@query
def cascade_decisions(spark, sf_dir):
    """The cascade without the ban step."""
    return decided(spark, sf_dir).selectExpr(*SHOWN)


@query
def cascade_status(spark, sf_dir):
    return decided(spark, sf_dir).groupBy("decision", "status").agg(F.count("*").alias("n"), F.sum("offense_weight").cast("long").alias("weight"))


@query
def cascade_with_bans(spark, sf_dir):
    """The whole cascade: a banned client's requests get 429, whatever they are."""
    return banned(spark, sf_dir).selectExpr(*SHOWN, "ban_triggered", "seconds_banned")


@query
def decision_counters(spark, sf_dir):
    return decision.counters(banned(spark, sf_dir))


@query
def prometheus_text(spark, sf_dir):
    return decision.prometheus_text(decision.counters(banned(spark, sf_dir)))


@query
def admin_stats(spark, sf_dir):
    return decision.admin_stats(banned(spark, sf_dir), SETTINGS)


@query
def admin_routes(spark, sf_dir):
    """Admin paths among the requests: every fifth one asks for one."""
    asked = requests(spark, sf_dir).withColumn("rel_url", admin_url())
    client = rules.client_ip(F.col("remote"), F.col("xff"), TRUSTED)
    return asked.select("id", "rel_url", decision.admin_route(F.col("rel_url"), client, SETTINGS).alias("a")).filter("a is not null").select("id", "rel_url", "a.status", "a.page")


@query
def decision_log_json(spark, sf_dir):
    return decision.log_events(banned(spark, sf_dir)).select("id", decision.log_json().alias("event"))


@query
def console_lines(spark, sf_dir):
    return decision.log_events(banned(spark, sf_dir)).select("id", decision.console_line().alias("line"))


@query
def eval_table(spark, sf_dir):
    """A row for each detector, on the samples and their percent-encoded forms, best first."""
    df = payloads(spark, sf_dir)
    both = df.select(F.lit("clean").alias("split"), "label", "payload").unionByName(df.select(F.lit("obfuscated").alias("split"), "label", text.percent_encode(F.col("payload")).alias("payload")))
    out = decision.evaluation_table(both, ["signature_baseline", "anomaly", "keyword"], corpus.LABELS)
    return out.select("detector", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


def offences(spark, sf_dir, weighted=False):
    kinds = ["error", "signup"] if weighted else ["error"]
    weight = F.when(F.col("event_type") == "signup", 2).otherwise(1)
    return table(spark, sf_dir, "events").filter(F.col("event_type").isin(*kinds)).select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("ip"), "ts", weight.alias("weight"))


@query
def ratelimit_fold(spark, sf_dir):
    return ratelimit.rate_limit(offences(spark, sf_dir))


@query
def ratelimit_weighted(spark, sf_dir):
    return ratelimit.rate_limit(offences(spark, sf_dir, True), ratelimit.Limits(threshold=5)).select("id", "status")


@query
def ratelimit_active_bans(spark, sf_dir):
    rows = offences(spark, sf_dir)
    return ratelimit.active_bans(ratelimit.rate_limit(rows), rows)


@query
def offense_sliding_count(spark, sf_dir):
    return ratelimit.sliding_count(offences(spark, sf_dir, True))


@query
def json_string_leaves(spark, sf_dir):
    body = F.to_json(F.struct("role", F.array(F.struct("text", "turn")).alias("parts")))
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", json_leaves.json_strings(body).alias("j"))
    return found.select("conv_id", "turn", F.array_join("j.string_values", "|").alias("strings"), F.col("j.max_depth").alias("max_depth"))


@query
def json_malformed(spark, sf_dir):
    found = requests(spark, sf_dir).filter(F.col("content_type").startswith("application/json")).select("id", json_leaves.json_strings(F.col("body")).alias("j"))
    return found.select("id", F.col("j.was_valid_json").alias("valid"), F.size("j.string_values").cast("long").alias("n"))


@query
def split_exact(spark, sf_dir):
    return corpus.exact_split(payloads(spark, sf_dir).select("id", "payload"), 0.25, 42, "id", "payload").select("id", "split")


@query
def shuffle_permutation(spark, sf_dir):
    """Every payload's place in a seeded permutation of all."""
    return ranks.permuted(payloads(spark, sf_dir).select("id", "payload"), ["id", "payload"]).select("id", "nth")


@query
def stratified_folds(spark, sf_dir):
    """Three folds of the documents, each with its share of every language."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    return ranks.stratified(docs, "label", ["id"], 3)


@query
def rank_in_group(spark, sf_dir):
    """Every event's place among those of its type, by value."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", "value")
    return ranks.numbered(events, [F.col("value"), F.col("id")], [F.col("event_type")]).select("id", "event_type", "nth")


@query
def dedupe_benign(spark, sf_dir):
    return corpus.combine([payloads(spark, sf_dir).select("payload", "label")]).groupBy("label").agg(F.count("*").alias("n"))


NOISY_LABELS = ["1", " SQLi ", "0", "benign", "TRUE", "normal", "Attack"]


@query
def label_normalise(spark, sf_dir):
    named = F.element_at(F.array(*map(F.lit, NOISY_LABELS)), (F.col("id") % len(NOISY_LABELS) + 1).cast("int"))
    return corpus.normalise_labels(payloads(spark, sf_dir).select("id", "payload", named.alias("label")), "sqli").groupBy("label").agg(F.count("*").alias("n"))


@query
def union_sources(spark, sf_dir):
    named = F.element_at(F.array(*map(F.lit, NOISY_LABELS)), (F.col("id") % len(NOISY_LABELS) + 1).cast("int"))
    rows = payloads(spark, sf_dir)
    first, second = rows.select("payload", "label"), corpus.normalise_labels(rows.select("payload", named.alias("label")), "xss")
    return corpus.combine([first, second]).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("payload").alias("payloads"))


@query
def synthetic_corpus(spark, sf_dir):
    return corpus.synthetic_corpus(table(spark, sf_dir, "documents"), table(spark, sf_dir, "events"))


def _variant(name):
    return lambda spark, sf_dir: payloads(spark, sf_dir).select("id", augment.TECHNIQUES[name](F.col("payload"), F.col("id").cast("string")).alias("variant"))


for _name, _key in (("url_encode", "aug_url_encode"), ("partial_url_encode", "aug_partial"), ("whitespace", "aug_whitespace"), ("case_toggle", "aug_keyword_case"), ("comment_insertion", "aug_comment"), ("unicode_substitution", "aug_unicode")):
    QUERIES[_key] = _variant(_name)


@query
def aug_case_all(spark, sf_dir):
    return payloads(spark, sf_dir).select("id", augment.case_toggle_all(F.col("payload"), F.col("id").cast("string")).alias("variant"))


@query
def aug_random(spark, sf_dir):
    return augment.with_random_variant(payloads(spark, sf_dir), "payload", F.col("id").cast("string")).select("id", "variant", F.array_join("techniques", "+").alias("techniques"))


@query
def recon_cube(spark, sf_dir):
    return decided(spark, sf_dir).cube("method", "decision").agg(F.count("*").alias("n"))


def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


def _finished(spark, stream, mode, path=None):
    """Runs a stream over what is there and returns what it wrote: a file sink, whose log drops what a failed try left, or each trigger's whole result in a folder of its own."""
    path = path or scratch(spark)
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        out.format("parquet").option("path", f"{path}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/out")
    written = []

    def write(df, batch):
        df.write.mode("overwrite").parquet(f"{path}/out/{batch}")
        written.append(batch)

    out.foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{path}/out/{max(written)}")


@contextmanager
def _rocksdb(spark):
    """The state store that processors with named state need."""
    key, wanted = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, wanted)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@query
def stream_window_counts(spark, sf_dir):
    counts = _finished(spark, traffic.windowed_counts(_event_stream(spark, sf_dir), "ts", "event_type"), "complete")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query
def stream_session_counts(spark, sf_dir):
    counts = _finished(spark, traffic.session_counts(_event_stream(spark, sf_dir), "ts", "user_id", "1 day"), "complete")
    return counts.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").cast("long").alias("n"))


def _offence_stream(spark, sf_dir):
    return _event_stream(spark, sf_dir).filter("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("ip"), "ts", F.lit(1).alias("weight"))


@query
def stream_ratelimit(spark, sf_dir):
    with _rocksdb(spark):
        return _finished(spark, traffic.limit_stream(_offence_stream(spark, sf_dir)), "append").select("id", "ip", "status")


@query
def limiter_state(spark, sf_dir):
    """Tracked clients and active bans at the last offence, from the state that a stopped stream left in its checkpoint."""
    path = scratch(spark)
    with _rocksdb(spark):
        _finished(spark, traffic.limit_stream(_offence_stream(spark, sf_dir)), "append", path)
        last = offences(spark, sf_dir).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] or 0
        return stored(traffic.tracked(traffic.limiter_state(spark, f"{path}/checkpoint"), F.lit(last)))


#: Rows of a file of the request stream, about: a trigger's files are read by as many tasks.
FILE_ROWS = 25_000


def _request_stream(spark, sf_dir):
    """The requests as a stream that arrives in four parts, in time order, each in the same number of files."""
    asked = requests(spark, sf_dir)
    us, path = F.unix_micros(F.col("ts").cast("timestamp")), scratch(spark)
    times = table(spark, sf_dir, "events").select(us.alias("us"))
    # the first three quarters, by time, end about here
    ends = sorted(set(times.agg(F.percentile_approx("us", [0.25, 0.5, 0.75]).alias("q")).first()["q"] or []))
    part = lambda c: sum((F.when(c > e, 1).otherwise(0) for e in ends), F.lit(0))
    sizes = dict(times.groupBy(part(F.col("us"))).count().collect())
    # no part has so few rows that one of its files would be empty, and so missing
    files = 1 + min(sizes.values(), default=0) // FILE_ROWS
    for k in sorted(sizes) or [0]:
        asked.filter(part(us) == k).repartition(files).write.mode("append").parquet(f"{path}/requests")
    return spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/requests")


@query
def cascade_stream(spark, sf_dir):
    """The whole cascade as a stream."""
    with _rocksdb(spark):
        made = _finished(spark, traffic.cascade_stream(_request_stream(spark, sf_dir), headers_map(), SETTINGS), "append")
    return made.withColumnRenamed("http_status", "status").selectExpr(*SHOWN, "ban_triggered", "seconds_banned")


def _sunk(spark, sf_dir, sink):
    """Runs the streaming cascade into a sink for foreachBatch."""
    stream = traffic.cascade_stream(_request_stream(spark, sf_dir), headers_map(), SETTINGS, keep=("ts", "method", "rel_url"))
    with _rocksdb(spark):
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{scratch(spark)}/checkpoint").trigger(availableNow=True).start().awaitTermination()


@query
def decision_log_files(spark, sf_dir):
    """The event log of the streaming cascade, read back from its files of at most 1 MB."""
    folder = scratch(spark)
    _sunk(spark, sf_dir, live.log_sink(folder, 1 << 20))
    return live.read_log(spark, folder)


@query
def prometheus_live(spark, sf_dir):
    """The text to scrape after the last trigger of the streaming cascade."""
    folder = scratch(spark)
    _sunk(spark, sf_dir, live.counter_sink(folder))
    return decision.prometheus_text(live.live_counters(spark, folder))


@query
def live_classify(spark, sf_dir):
    """Raw segments as a stream, scored by one detector; and the session's summary."""
    raw = F.concat("method", F.lit(" "), "rel_url", F.lit(" HTTP/1.1\r\nHost: h\r\n\r\n"), "body")
    segments = requests(spark, sf_dir).select("ts", F.col("remote").alias("src"), F.lit(80).alias("dst_port"), raw.cast("binary").alias("tcp_bytes"))
    found = stored(segments)
    stream = spark.readStream.schema(found.schema).parquet(found.inputFiles()[0].rsplit("/", 1)[0])
    scored = _finished(spark, traffic.classify_stream(stream, "signature_baseline"), "append")
    return traffic.session_summary(scored, "signature_baseline")


def _captures(spark, sf_dir):
    """Captures of one stream for each request: a SYN, and the request in four segments, one of them twice, not in order."""
    body = F.encode("body", "UTF-8")
    head = F.concat("method", F.lit(" "), F.replace("rel_url", F.lit(" "), F.lit("%20")), F.lit(" HTTP/1.1\r\nHost: h\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    id, user = F.col("id"), F.substring_index("remote", ".", -1).cast("long")
    src = F.concat(F.lit("10.0."), F.floor(user / 256) % 256, F.lit("."), user % 256)
    raw = requests(spark, sf_dir).select(id, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), src.alias("src"), (id % 60_000 + 1024).cast("int").alias("src_port"), F.concat(F.lit("192.168."), F.floor(id / 15_360_000) % 256, F.lit("."), F.floor(id / 60_000) % 256).alias("dst"), F.lit(80).alias("dst_port"), F.concat(F.encode(head, "UTF-8"), body).alias("raw"))
    quarter = F.floor(F.octet_length("raw") / 4).cast("int")
    # numbers wrap around in some streams
    start = F.pmod(F.lit((1 << 32) - 40) + id % 100, F.lit(1 << 32))
    piece = lambda k: F.struct(F.lit(k).alias("k"), F.pmod(start + 1 + quarter * k, F.lit(1 << 32)).alias("seq"), F.lit(24).alias("flags"), F.substring(F.col("raw"), quarter * k + 1, F.lit(1 << 30) if k == 3 else quarter).alias("payload"))
    syn = F.struct(F.lit(-1).alias("k"), start.alias("seq"), F.lit(capture.SYN).alias("flags"), F.lit(b"").alias("payload"))
    each = raw.select("*", F.explode(F.array(syn, *map(piece, (2, 0, 3, 2, 1)))).alias("s"))
    sent = each.select((F.col("us") + F.col("s.k") * 7).alias("us"), "src", "src_port", "dst", "dst_port", F.col("s.seq").alias("seq"), F.col("s.flags").alias("flags"), F.col("s.payload").alias("payload"))
    return capture.captured(sent)


@query
def capture_requests(spark, sf_dir):
    """Requests put together from captured segments, and the text that is inspected of each."""
    found = capture.requests_in(capture.packets(capture.kept(_captures(spark, sf_dir))))
    return found.select("src", "src_port", "dst", "nth", decision.request_payload(F.col("request")).alias("payload")).filter("payload is not null")


@query
def capture_summary(spark, sf_dir):
    """The session's summary of a capture: packets, requests, and how many of them the signature rules call malicious."""
    seen = capture.packets(capture.kept(_captures(spark, sf_dir)))
    label = rules.signature(decision.request_payload(F.col("request")))
    counted = capture.requests_in(seen).agg(F.count("*").alias("requests"), F.count_if(label != "benign").alias("malicious"))
    return seen.agg(F.count("*").alias("packets")).crossJoin(counted)  # one row each
