"""What must hold when one client, term or label is most of the data."""

import datetime as dt
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparksentry.operators import decision, models, ratelimit
from sparksentry.operators.ratelimit import Client, Limits, rate_limit
from sparksentry.sources.scratch import stored

SMALL = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1)
OFFENCES = "id long, ip string, ts timestamp, weight int"


def folded(rows, limits):
    """id to (status, seconds), row by row."""
    out, clients = {}, {}
    for id, ip, ts, weight in sorted(rows, key=lambda r: (r[2] or START, r[0])):
        if ts is None:
            out[id] = ("passed", 0)
            continue
        client, us = clients.setdefault(ip, Client()), (ts - START) // dt.timedelta(microseconds=1) + 1_704_067_200_000_000
        out[id] = (client.step(us, weight, limits), client.left(us))
    return out


@pytest.mark.parametrize(("limits", "span", "steps"), [(Limits(30, 3, 10), 900, 0), (Limits(5, 4, 60), 400, 4096), (Limits(1000, 2, 1), 5000, 4096), (Limits(60, 3, 100), 90, 4096)])
def test_a_busy_client_is_folded_in_parallel(spark, monkeypatch, limits, span, steps):
    monkeypatch.setattr(ratelimit, "STEPS", steps)
    random.seed(span)
    rows = [(i, "hot" if random.random() < 0.9 else random.choice(["a", "b", "zz", None]), START + dt.timedelta(seconds=random.randrange(span)), random.choice([1, 1, 1, 2, None])) for i in range(1500)]
    rows += [(5000 + i, "hot", None, 1) for i in range(3)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        made = rate_limit(spark.createDataFrame(rows, OFFENCES).repartition(5), limits).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r["id"]: (r["status"], r["seconds_banned"]) for r in made} == folded(rows, limits)
    largest = Counter(r["part"] for r in made if r["ip"] == "hot").most_common(1)[0][1]
    assert largest < 0.3 * len(rows)


def test_equal_offences_are_spread(spark):
    rows = [(1, "hot", START, 1)] * 900
    limits = Limits(30, 5, 10)
    made = rate_limit(spark.createDataFrame(rows, OFFENCES), limits).withColumn("part", F.spark_partition_id()).collect()
    assert Counter(r["status"] for r in made) == {"offence": 4, "ban_triggered": 1, "banned": 895}
    assert len({r["part"] for r in made}) > 1
    with pytest.raises(ValueError):
        rate_limit(spark.createDataFrame(rows, OFFENCES), Limits(30, 5, 0))
    assert rate_limit(spark.createDataFrame([], OFFENCES)).count() == 0


def test_exits_of_a_partition():
    random.seed(6)
    for _ in range(1500):
        limits = Limits(random.randint(1, 12), random.randint(1, 5), random.randint(1, 10))
        us = np.sort([random.randrange(random.choice([20, 60, 200])) for _ in range(random.randint(2, 40))]) * 1_000_000
        weight = np.array([random.choice([0, 1, 1, 2, 6]) for _ in us])
        k, client = random.randrange(1, len(us)), Client()
        ratelimit.fold(us[:k], weight[:k], client, limits)
        before = np.repeat(us[:k], weight[:k])[-max(limits.threshold - 1, 1) :]
        upper, leaves = ratelimit._exits(us[k:], weight[k:], before, limits)
        at = np.searchsorted(upper, client.until)
        wanted = leaves[at] if at < len(upper) else client.until
        ratelimit.fold(us[k:], weight[k:], client, limits)
        assert wanted == client.until


def test_only_offences_are_folded(spark, monkeypatch):
    from sparksentry.plans.queries import LIMITS, banned, decided

    seen = []
    whole = ratelimit.rate_limit
    monkeypatch.setattr(ratelimit, "rate_limit", lambda df, limits: seen.append(df.count()) or whole(df, limits))
    # stored, so that no filter is pushed into the cascade's own plan
    busy = stored(decided(spark, SMALL).withColumn("client", F.lit("9.9.9.9")))
    monkeypatch.setattr("sparksentry.plans.queries.decided", lambda *_: busy)
    rows = banned(spark, SMALL)
    offences = busy.filter("offense_weight > 0 and decision <> 'blocked_static_deny'").count()
    assert seen == [offences] and 0 < offences < busy.count()
    assert rows.count() == busy.count() and rows.filter("decision = 'blocked_ratelimit' and seconds_banned <= 0").count() == 0
    bans = spark.createDataFrame([("9.9.9.9", 0, 0, LIMITS.ban * 1_000_000)], "ip string, id long, begin long, until long")
    looks = spark.range(4000).select("id", F.lit("9.9.9.9").alias("ip"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    found = ratelimit.banned_by(looks, bans, LIMITS)
    assert found.filter("_until is not null").count() == LIMITS.ban // 60 and found.count() == 4000
    # keys of the join are client and time, so one client's rows aren't one key
    assert looks.select(F.floor(F.unix_micros("ts") / F.lit(LIMITS.ban * 1_000_000))).distinct().count() > 4


def test_bans_as_intervals_are_those_of_the_fold(spark):
    random.seed(8)
    limits = Limits(30, 3, 10)
    rows = [(i, random.choice(["a", None]), START + dt.timedelta(seconds=random.randrange(500)), 1) for i in range(300)]
    looks = [(1000 + i, random.choice(["a", None, "b"]), START + dt.timedelta(seconds=random.randrange(500)), None) for i in range(300)]
    wanted = folded(rows + looks, limits)
    offences = spark.createDataFrame(rows, OFFENCES)
    bans = ratelimit.ban_intervals(offences, rate_limit(offences, limits), limits)
    got = {r["id"]: r["_until"] is not None for r in ratelimit.banned_by(spark.createDataFrame(looks, OFFENCES), bans, limits).collect()}
    assert got == {i: wanted[i][0] == "banned" for i in got} and len(got) == 300 and any(got.values())


def test_summary_bounds_hold():
    random.seed(9)
    for capacity in (3, 10, 50):
        summary, true = models.Summary(capacity), Counter()
        for _ in range(60):
            count = Counter(str(int(random.paretovariate(0.7))) for _ in range(100))
            true += count
            some = [(t, n) for t, n in count.items() if n > 1]
            summary.add(pa.array([t for t, _ in some], pa.string()), np.array([n for _, n in some]), 1)
        names, low = summary.merge()
        held = dict(zip(names.to_pylist(), low.tolist()))
        assert len(held) <= capacity
        assert all(held.get(t, 0) <= n <= held.get(t, 0) + summary.lost for t, n in true.items())


@pytest.mark.parametrize(("capacities", "tries"), [((1 << 16,), 1), ((40, 1500), 2), ((5, 9), 3)])
def test_vocabulary_is_exact_whatever_the_summaries_hold(spark, monkeypatch, capacities, tries):
    monkeypatch.setattr(models, "CAPACITIES", capacities)
    monkeypatch.setattr(models, "SLICE_BYTES", 20_000)
    shuffled = []
    every = models.all_totals
    monkeypatch.setattr(models, "all_totals", lambda df: shuffled.append(1) or every(df))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").alias("id"), "text").limit(60)
    df, total = Counter(), Counter()
    for r in docs.collect():
        found = models.coded(pa.array([r["text"]]))
        words = [found.words[i].as_py() for i in found.code.tolist()]
        own = Counter([*words, *map(" ".join, zip(words, words[1:]))])
        total += own
        df.update(own.keys())
    best = sorted(total, key=lambda t: (-total[t], t.encode()))[:50]
    got = {r["term"]: (r["df"], r["total"]) for r in models.fit_vocabulary(models.tokens(docs), 60, 50).collect()}
    assert got == {t: (df[t], total[t]) for t in best}
    assert bool(shuffled) == (tries == 3)


def test_tokens_are_those_of_the_column(spark):
    from sparksentry.functions.text import tokenize

    texts = ["SELECT a_1 FROM <B x='1'> -- /*!50000 c*/ %2f%zz 12ab <Script </DIV", "", "ünïon ＳＥＬＥＣＴ select٣ --- <ñ é_a _Q", "a" * 5000 + " 1;2", None, "yİS A"]
    texts += [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(80).collect()]
    wanted = [r["t"] or [] for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("t", tokenize(F.col("text"))).orderBy("i").collect()]
    found = models.coded(pa.array(texts, pa.string()))
    ends = np.cumsum(found.sizes)
    assert [[found.words[i].as_py() for i in found.code[b - n : b].tolist()] for b, n in zip(ends, found.sizes)] == wanted


def test_learned_models_hold_on_other_documents(spark):
    """Languages of documents that the models didn't see."""
    from sparksentry.operators import stored_models

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))
    seen = docs.filter("id % 3 <> 0")
    held = docs.filter("id % 3 = 0")
    label = {r["id"]: r["label"] for r in held.collect()}
    for name, model in stored_models.train_all(seen).items():
        right = sum(label[r["id"]] == r["predicted"] for r in model.predict(held).collect())
        assert right >= 0.9 * len(label), name


def test_ranks_are_dense_and_spread(spark):
    from sparksentry.operators import ranks

    rows = [(i, "hot" if i % 10 else None, i % 7) for i in range(600)] + [(5, "hot", 3)] * 300
    df = spark.createDataFrame(rows, "id long, label string, _by int")
    found = ranks.numbered(df, [F.col("id")], [F.col("label")]).withColumn("part", F.spark_partition_id()).collect()
    for label in ("hot", None):
        mine = sorted((r["nth"], r["id"]) for r in found if r["label"] == label)
        assert [n for n, _ in mine] == list(range(len(mine))) and [i for _, i in mine] == sorted(i for i, x, _ in rows if x == label)
    assert max(Counter(r["part"] for r in found).values()) < 500 and {r["_by"] for r in found} == set(range(7))
    order = [r["id"] for r in ranks.permuted(df, ["id"], seed=1).orderBy("nth").collect()]
    assert order != sorted(order) and order == [r["id"] for r in ranks.permuted(df.orderBy(F.desc("id")), ["id"], seed=1).orderBy("nth").collect()]
    assert order != [r["id"] for r in ranks.permuted(df, ["id"], seed=2).orderBy("nth").collect()]
    folds = Counter((r["label"], r["fold"]) for r in ranks.stratified(df, "label", ["id"], 4).collect())
    for label in ("hot", None):
        each = [folds[label, k] for k in range(4)]
        assert max(each) - min(each) <= 1
    whole = [folds["hot", k] + folds[None, k] for k in range(4)]
    assert max(whole) - min(whole) <= 1 and sum(whole) == 900
    assert ranks.numbered(df.limit(0), [F.col("id")]).count() == 0


def test_combined_sources(spark, tmp_path):
    from sparksentry.sources import corpus

    (tmp_path / "a.csv").write_text("query,Label\n1 OR 1=1,1\nx=1,0\nx=1,0\n")
    (tmp_path / "b.csv").write_text("payload,label\n<b>,xss\ny=2,benign\nodd,other\n")
    paths = {"sqli": f"{tmp_path}/a.csv", "labelled": f"{tmp_path}/b.csv", "xss": f"{tmp_path}/none.csv"}
    with pytest.warns(UserWarning, match="none.csv"):
        found = [tuple(r) for r in corpus.combined_dataset(spark, paths).collect()]
    assert sorted(found) == [("1 OR 1=1", "sqli"), ("<b>", "xss"), ("x=1", "benign"), ("y=2", "benign")]
    own = spark.createDataFrame([("a=1", "benign"), ("2", "sqli")], "payload string, label string")
    with pytest.warns(UserWarning):
        assert corpus.combined_dataset(spark, {"xss": f"{tmp_path}/none.csv"}, own).count() == 2
    for bad in ({"xss": f"{tmp_path}/none.csv"}, {"other": "x"}):
        with pytest.raises(ValueError), pytest.warns(UserWarning) if "xss" in bad else pytest.MonkeyPatch.context():
            corpus.combined_dataset(spark, bad)
    corpus.save_partitions(corpus.build_dataset(spark, own), f"{tmp_path}/out")
    back = corpus.read_csv(spark, f"{tmp_path}/out/train").unionByName(corpus.read_csv(spark, f"{tmp_path}/out/test_clean"))
    assert sorted(map(tuple, back.collect())) == [("2", "sqli"), ("a=1", "benign")]


def test_sliding_counts_of_a_busy_client(spark):
    random.seed(12)
    limits = Limits(window=50)
    rows = [(i, random.choice(["hot", "hot", "hot", None]), None if i % 97 == 0 else START + dt.timedelta(seconds=random.randrange(-300, 900)), random.choice([1, 2, None])) for i in range(500)]
    wanted = {}
    for id, ip, ts, _ in rows:
        near = [w for _, other, t, w in rows if other == ip and w and ((t is None and ts is None) or (t and ts and ts - dt.timedelta(seconds=50) <= t <= ts))]
        wanted[id] = sum(near) or None
    got = {r["id"]: r["in_window"] for r in ratelimit.sliding_count(spark.createDataFrame(rows, OFFENCES), limits).collect()}
    assert got == wanted


def test_readers_hold_a_few_captures(spark):
    """What a reader decodes as one, a row group, doesn't grow with the number of capture files."""
    import pyarrow.parquet as pq

    from sparksentry.sources import capture

    packet = F.struct(F.col("id").alias("us"), F.lit("10.0.0.1").alias("src"), F.lit(2000).alias("src_port"), F.lit("10.0.0.9").alias("dst"), F.lit(80).alias("dst_port"), F.col("id").alias("seq"), F.lit(24).alias("flags"), F.encode(F.repeat(F.sha2(F.col("id").cast("string"), 512), 8), "UTF-8").alias("payload"))
    sent = spark.range(60_000, numPartitions=1).select(packet.alias("p")).select("p.*")
    kept = capture.kept(capture.captured(sent, most=100))
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in kept.inputFiles()]
    groups = [m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)]
    assert sum(groups) > 60_000_000 and max(groups) < 25_000_000
    assert capture.packets(kept).agg(F.count("*"), F.count_distinct("seq")).first()[:] == (60_000, 60_000)


def test_what_a_slice_took_is_freed():
    """Without a search for cycles: a task counts many slices and makes few objects that would set one off."""
    import gc

    texts = pa.array([f"select name{i} from table{i}" for i in range(200)])
    models.coded(texts)
    gc.collect()
    gc.disable()
    try:
        for _ in range(5):
            models.coded(texts)
        gc.set_debug(gc.DEBUG_SAVEALL)
        gc.collect()
        assert not [x for x in gc.garbage if isinstance(x, dict) and "select" in x]
    finally:
        gc.set_debug(0)
        gc.garbage.clear()
        gc.enable()


def test_pairs_of_words_are_not_shuffled(spark, monkeypatch):
    from sparksentry.functions import text
    from sparksentry.plans import queries

    grams = queries.folded(spark, SMALL).select(F.explode(text.one_two_grams(text.tokenize(F.col("text")))).alias("gram"))
    plain = [tuple(r) for r in grams.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(100).collect()]
    monkeypatch.delattr(text, "one_two_grams")
    assert [tuple(r) for r in queries.ngrams_top(spark, SMALL).collect()] == plain
