"""The command lines from raw tables to an evaluated model, and requests that can't be handled."""

import json

import pytest
from pyspark.sql import functions as F

from sparksentry.__main__ import main, parser
from sparksentry.operators import decision, json_leaves, stored_models
from sparksentry.operators.settings import Settings
from sparksentry.plans.queries import _captures
from sparksentry.sources import corpus
from sparksentry.sources.views import headers_map, requests

SMALL = "/root/testdata/sf0.001"


def test_from_tables_to_an_evaluation(spark, tmp_path, capsys):
    main(["build", "--docs", f"{SMALL}/documents.parquet", "--events", f"{SMALL}/events.parquet", "--out", f"{tmp_path}/data"])
    train, clean = (corpus.read_csv(spark, f"{tmp_path}/data/{n}").count() for n in ("train", "test_clean"))
    assert f"'train': {train}" in capsys.readouterr().out and abs(clean - (train + clean) // 4) <= 1
    main(["train", "--data", f"{tmp_path}/data/train", "--models", f"{tmp_path}/models"])
    assert set(stored_models.load_all(spark, f"{tmp_path}/models")) == set(stored_models.NAMES)
    main(["evaluate", "--data", f"{tmp_path}/data", "--models", f"{tmp_path}/models", "--out", f"{tmp_path}/metrics"])
    table = {r["detector"]: r for r in spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/metrics").collect()}
    assert set(table) == {"signature_baseline", "anomaly", *stored_models.NAMES}
    # attacks repeat a few forms, so the models know them; benign rows are few here, which holds naive Bayes back
    assert all(table[n]["accuracy_clean"] > 0.95 for n in ("logistic_regression", "svm"))
    assert 0.95 > table["naive_bayes"]["accuracy_clean"] > table["signature_baseline"]["accuracy_clean"]
    main(["evaluate", "--data", f"{tmp_path}/data", "--out", f"{tmp_path}/short", "--top", "20"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/short").count() == 2


def test_captures_and_requests(spark, tmp_path, capsys):
    for r in _captures(spark, SMALL).limit(3).collect():
        (tmp_path / r["path"]).write_bytes(r["content"])
    main(["classify", "--captures", str(tmp_path)])
    shown = capsys.readouterr().out
    assert "signature_baseline" in shown and "malicious" in shown
    requests(spark, SMALL).write.parquet(f"{tmp_path}/requests")
    (tmp_path / "c.json").write_text(json.dumps({"listen_host": "h", "listen_port": 1, "backend_url": "u", "models": ["anomaly"]}))
    main(["cascade", "--requests", f"{tmp_path}/requests", "--config", f"{tmp_path}/c.json", "--out", f"{tmp_path}/out"])
    assert "blocked_ratelimit" in capsys.readouterr().out and spark.read.parquet(f"{tmp_path}/out").count() == 1000
    with pytest.raises(SystemExit):
        parser().parse_args(["build"])


def test_one_bad_request_ends_no_job(spark, monkeypatch):
    """No URL, no method, a body whose walk breaks off: an error of its own, and all others as they were."""
    rows = requests(spark, SMALL)
    settings = Settings(models=("signature_baseline",), static_deny_ips=("10.0.0.13",))
    before = {r["id"]: r["decision"] for r in decision.cascade(rows, headers_map(), settings).select("id", "decision").collect()}
    bad = rows.withColumn("rel_url", F.when(F.col("id") % 10 != 3, F.col("rel_url"))).withColumn("method", F.when(F.col("id") % 10 != 4, F.col("method")))

    def broken(body):
        raise KeyError("unexpected")

    monkeypatch.setattr(json_leaves, "walk", broken)
    assert json_leaves._walked(b"{}") == ([], False, 0, True)
    monkeypatch.undo()
    decided = decision.cascade(bad, headers_map(), settings)
    after = {r["id"]: (r["decision"], r["status"], r["label"]) for r in decided.select("id", "decision", "status", "label").collect()}
    for i, d in before.items():
        assert after[i][0] == (d if i % 10 not in (3, 4) or d == "blocked_static_deny" else "error")
    assert {v for v in after.values() if v[0] == "error"} == {("error", 500, "internal_error")}
    logged = decision.log_events(decided.withColumn("ts", F.col("ts"))).select("decision").distinct().collect()
    assert "error" not in {r[0] for r in logged}
