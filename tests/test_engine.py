import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sparksentry.functions import augment
from sparksentry.operators.ratelimit import Client, Limits, rate_limit
from sparksentry.sources import corpus
from sparksentry.sources.views import payloads

SMALL = "/root/testdata/sf0.001"


def test_third_offence_bans_and_bans_end():
    c, limits, s = Client(), Limits(window=30, threshold=3, ban=10), 1_000_000
    assert [c.step(t * s, 1, limits) for t in (0, 10, 20, 25, 30, 31)] == ["offence", "offence", "ban_triggered", "banned", "offence", "offence"]
    c = Client()
    assert [c.step(t * s, w, limits) for t, w in ((0, 2), (31, 1), (61, 1), (62, 2))] == ["offence", "offence", "offence", "ban_triggered"]


def test_limits_are_by_client(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, ip, t + dt.timedelta(seconds=i), 1) for i, ip in enumerate(["a", "b"] * 3)]
    got = {r["id"]: r["status"] for r in rate_limit(spark.createDataFrame(rows, "id long, ip string, ts timestamp, weight int"), Limits(30, 3, 10)).collect()}
    assert [got[i] for i in range(6)] == ["offence"] * 4 + ["ban_triggered"] * 2


def test_published_limiter_totals(spark):
    from sparksentry.plans.queries import QUERIES

    got = {r["status"]: r["count"] for r in QUERIES["ratelimit_fold"](spark, "/root/testdata/sf0.01").groupBy("status").count().collect()}
    assert got == {"offence": 1658, "ban_triggered": 247, "banned": 109}


@pytest.mark.parametrize("name", ["lr_predict", "svm_predict"])
def test_linear_models_see_the_documents(spark, name):
    from sparksentry.plans.queries import QUERIES

    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").collect()}
    got = {r["id"]: r["predicted"] for r in QUERIES[name](spark, SMALL).collect()}
    assert set(got) == set(lang)
    assert sum(got[i] == lang[i] for i in lang) >= 0.9 * len(lang)


def test_bans_apply_to_all_requests(spark):
    """The whole cascade against a plain loop over the stateless decisions."""
    from sparksentry.operators import decision
    from sparksentry.plans.queries import LIMITS, QUERIES, decided

    rows = decided(spark, SMALL).select("id", "client", "ts", "decision", "label", "status", "offense_weight", "triggered_by", "malformed_json").collect()
    wanted, offences, until, bans = {}, {}, {}, 0
    for r in sorted(rows, key=lambda r: (r["ts"], r["id"])):
        own, client = (r["decision"], r["label"], r["status"], r["offense_weight"], ";".join(r["triggered_by"]), r["malformed_json"]), r["client"]
        if r["decision"] == "blocked_static_deny":
            pass
        elif client in until and r["ts"] < until[client]:
            own = ("blocked_ratelimit", "banned_ip", 429, 0, "rate_limiter", False)
        elif r["offense_weight"]:
            past = [t for t in offences.get(client, []) if t >= r["ts"] - dt.timedelta(seconds=LIMITS.window)] + [r["ts"]] * r["offense_weight"]
            if len(past) >= LIMITS.threshold:
                past, until[client] = [], r["ts"] + dt.timedelta(seconds=LIMITS.ban)
                bans += r["decision"] in ("blocked_recon", "blocked")
            offences[client] = past
        wanted[r["id"]] = own
    got = {r["id"]: tuple(r[2:8]) for r in QUERIES["cascade_with_bans"](spark, SMALL).collect()}
    assert got == wanted
    ids = {r["id"]: r["decision"] for r in rows}
    assert {"allowed", "blocked_websocket"} <= {ids[i] for i, v in wanted.items() if v[0] == "blocked_ratelimit"}
    counts = QUERIES["decision_counters"](spark, SMALL).first()
    kinds = [v[0] for v in wanted.values()]
    denied = kinds.count("blocked_static_deny")
    assert tuple(counts)[:4] == (sum(k.startswith("allowed") for k in kinds), sum(k.startswith("blocked") for k in kinds) - denied, bans, denied) and bans
    text = QUERIES["prometheus_text"](spark, SMALL).first()[0].splitlines()
    assert f"waf_bans_triggered_total {bans}" in text and any(x.startswith("waf_uptime_seconds ") for x in text) and len(text) == 3 * len(decision.METRICS)
    events = [r["event"] for r in QUERIES["decision_log_json"](spark, SMALL).collect()]
    assert sum('"blocked_ratelimit"' in e for e in events) == kinds.count("blocked_ratelimit")
    assert len(events) == len(wanted) + sum(v[5] for v in wanted.values()) and all(len(json.loads(e)) == 8 for e in events)


def test_cascade_in_the_original_s_order(spark):
    """One request for each step, with a JSON body, an allowed websocket path and a model that votes."""
    from sparksentry.operators import decision, stored_models
    from sparksentry.operators.settings import Settings

    rows = [(i, f"q=apple+{i}&page={i}", "benign") for i in range(12)] + [(100 + i, f"id={i} zzz union zzz", "sqli") for i in range(12)]
    decision.register_model("learned", stored_models.fit("naive_bayes", spark.createDataFrame(rows, "id long, text string, label string")))
    schema = "id int, remote string, xff string, method string, rel_url string, user_agent string, content_length array<string>, transfer_encoding array<string>, connection string, upgrade string, content_type string, body string, ts timestamp"
    now = dt.datetime(2024, 1, 1)
    one = lambda i, remote="9.9.9.9", url="/", agent=None, cl=None, te=None, up=None, kind=None, body="": (i, remote, None, "GET", url, agent, cl, te, "upgrade" if up else None, up, kind, body, now)
    asked = [
        one(0, remote="6.6.6.6", url="/.git/config"), one(1, url="/.git/config"), one(2, cl=["1", "2"]), one(3, up="websocket"), one(4, url="/live?x=1", up="websocket"),
        one(5, kind="application/json", body='{"a": ["<script>alert(1)</script>"]}'), one(6, kind="application/json", body="{no"), one(7, agent="x' OR 1=1 --"), one(8, url="/?q=zzz+union+zzz"), one(9), one(10, remote="7.7.7.7"),
        one(11, kind="application/json", body='{"sleep (": 1}'),
    ]
    settings = Settings(models=("signature_baseline", "learned"), static_deny_ips=("6.6.6.6", "7.7.7.7"), static_allow_ips=("7.7.7.7",), allow_websocket_paths=("/live",))
    headers = F.map_filter(F.create_map(F.lit("user-agent"), F.col("user_agent"), F.lit("x-forwarded-for"), F.col("xff")), lambda k, v: v.isNotNull())
    got = {r["id"]: (r["decision"], r["label"], r["status"], list(r["triggered_by"]), r["malformed_json"]) for r in decision.cascade(spark.createDataFrame(asked, schema), headers, settings).collect()}
    assert got[0] == ("blocked_static_deny", "denylisted", 403, ["static_deny_list"], False)
    assert got[1][:3] == ("blocked_recon", "recon", 403) and got[2][:3] == ("blocked_malformed", "malformed_request", 400)
    assert got[3] == ("blocked_websocket", "websocket_not_allowed", 400, ["websocket_upgrade"], False) and got[4] == ("allowed_websocket_passthrough", "benign", 200, [], False)
    assert got[5][0] == "blocked" and got[5][3][0] == "signature_baseline" and got[6][4] and got[6][0] == "allowed"
    assert got[7] == ("blocked", "sqli", 403, ["signature_baseline"], False)
    assert got[8] == ("blocked", "sqli", 403, ["learned"], False) and got[9][0] == got[10][0] == "allowed" and got[11][1] == "sqli"
    with pytest.raises(ValueError):
        decision.known(["forest"])


def test_null_times_and_weights_pass(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(0, "a", None, 1), (1, "a", t, None), (2, "a", t, 3), (3, "a", t, None), (4, None, t, 1)]
    got = {r["id"]: r["status"] for r in rate_limit(spark.createDataFrame(rows, "id long, ip string, ts timestamp, weight int"), Limits(30, 3, 10)).collect()}
    assert got == {0: "passed", 1: "passed", 2: "ban_triggered", 3: "banned", 4: "offence"}


def test_settings_are_checked(tmp_path):
    from sparksentry.operators.settings import load_settings

    good = {"listen_host": "h", "listen_port": 1, "backend_url": "u", "models": ["anomaly"], "rate_limit": {"offense_threshold": 7}}
    path = tmp_path / "c.json"
    for change in ({"backend_url": None}, {"models": []}, {"voting_policy": "some"}, {"tls": {"enabled": True, "certfile": "/none", "keyfile": "/none"}}):
        bad = {k: v for k, v in (good | change).items() if v is not None}
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            load_settings(str(path))
    path.write_text(json.dumps(good))
    found = load_settings(str(path))
    assert found.models == ("anomaly",) and found.limits.threshold == 7 and found.voting_policy == "any"
    with pytest.raises(FileNotFoundError):
        load_settings(str(tmp_path / "none.json"))


def test_another_tokenizer(spark):
    from sparksentry.operators import models

    docs = spark.createDataFrame([(1, "a,b"), (2, None), (3, "a,a")], "id long, text string")
    tokenised = models.tokens(docs, tokenizer=lambda t: F.split(t, ","))
    found = {r["term"]: (r["df"], r["total"]) for r in models.fit_vocabulary(tokenised, 3).collect()}
    assert found == {"a": (2, 3), "b": (1, 1), "a b": (1, 1), "a a": (1, 1)}
    weighted = {r["id"]: r["weights"] for r in models.transform(tokenised, models.collected(models.fit_vocabulary(tokenised, 3))).collect()}
    assert weighted[2] == [] and abs(sum(w * w for w in weighted[1]) - 1) < 1e-9


def test_variants_change_and_repeat(spark):
    df = payloads(spark, SMALL).filter("label <> 'benign'").limit(60)
    make = lambda: augment.with_random_variant(df, "payload", F.col("id").cast("string")).orderBy("id").collect()
    rows = make()
    assert rows == make()
    assert all(r["variant"] != r["payload"] and 1 <= len(r["techniques"]) <= 4 for r in rows)


def test_keyword_case_flips_each_keyword(spark):
    df = spark.createDataFrame([("1 union select a",)], "p string").select(augment.case_toggle(F.col("p"), F.lit("k")).alias("v"))
    v = df.first()[0]
    assert v.lower() == "1 union select a" and v.split()[1] != "union" and v.split()[2] != "select"


def test_exact_split_and_corpus(spark):
    docs, events = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "events"))
    c = corpus.synthetic_corpus(docs, events).cache()
    parts = corpus.build_dataset(spark, c)
    n = c.count()
    assert parts["test_clean"].count() == int(n * 0.25) == parts["test_obfuscated"].count()
    assert {r[0] for r in parts["train"].select("label").distinct().collect()} == {"benign", "sqli", "xss"}
    assert c.filter("label = 'benign'").count() == c.filter("label = 'benign'").distinct().count()


def test_exact_split_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(corpus, "CHUNK_ROWS", 7)
    for hot in (("a", None), ("b", "benign")):
        df = spark.createDataFrame([hot] * 60 + [(f"p{i}", "sqli") for i in range(20)], "payload string, label string")
        parts = corpus.exact_split(df, 0.25)
        assert parts.filter("split = 'test'").count() == 20 and parts.drop("split").exceptAll(df).count() == 0 and parts.count() == 80


def test_csv_columns_are_detected(spark, tmp_path):
    (tmp_path / "k.csv").write_text('Sentence,Label\n"a\nb",1\nplain,0\n,1\n')
    rows = {(r["payload"], r["label"]) for r in corpus.load_labelled(spark, str(tmp_path / "k.csv"), "sqli").collect()}
    assert rows == {("a\nb", "sqli"), ("plain", "benign")}


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
