"""Source mixing, ranked search and periodic runs against plain loops, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparksentry.llm import lexical, mixing, queries, runs

SMALL = "/root/testdata/sf0.001"
ODD = ["", None, " \n\t", "one", "one one one one one one", "a b " * 12, "Σ\x01 ΑΣ é́ 12,345!!! don't", "x y z", "word " * 4000, "-" * 5001, "a a a b b b a a a b b b a a a b b b a a a b b b", "日本 語 日本 語 日本 語 日本 語"]


def written(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, null ids and sources, repeated rows, and columns whose names the operators use themselves."""
    rows = [(i, t, ["a", "b", None, "é"][i % 4]) for i, t in enumerate(ODD)]
    rows += [(3, "one", "é")] * 40 + [(None, "no id here", "b")] * 3 + [(None, "none", None), (50, "repeat me twice", "a"), (50, "repeat me twice", "a")]
    extra = [F.lit(7).alias(c) for c in ("size", "hash", "_source", "left", "n", "terms", "runs", "rank", "a.b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *extra)


# periodic runs


def runs_brute(words, exponent=4, least=6):
    found, n = {}, len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("pairs", [5, 1 << 21])
def test_runs_are_all_found(monkeypatch, pairs):
    monkeypatch.setattr(runs, "PAIRS", pairs)
    random.seed(4)
    for _ in range(700):
        exponent = random.choice([2, 3, 4, 4])
        least = 6 if exponent == 4 else random.choice([2, 4, 6])
        docs = []
        for _ in range(random.randint(1, 4)):
            words = [random.randrange(random.choice([1, 2, 3, 6])) for _ in range(random.randint(0, 50))]
            if words and random.random() < 0.6:
                a = random.randrange(len(words))
                p = random.randint(1, max(1, (len(words) - a) // 3))
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
                words = random.choice([words, [*words, 9, *words, *words[:5]]])
            docs.append(words)
        at = np.cumsum([0, *map(len, docs)])
        codes = np.array([w for d in docs for w in d], np.int64)
        wanted = [(s + a, e + a, q) for d, a in zip(docs, at.tolist()) for s, e, q in runs_brute(d, exponent, least)]
        assert [tuple(r) for r in runs.find_runs(codes, at, exponent, least).tolist()] == wanted
        may = runs.may_hold_runs(codes, at, exponent, least)
        assert all(m or not runs_brute(d, exponent, least) for d, m in zip(docs, may))


def run_row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = runs_brute(words)
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    longest = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return doc_id, len(found), *longest, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_periodic_runs(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").filter("length(text) < 4000")
    docs = docs.unionByName(odd.select("doc_id", "text").filter("length(text) < 6000 or text is null"))
    got = queries.op13_periodic_runs(spark, written(spark, tmp_path, documents=docs)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted((run_row(*r) for r in docs.collect()), key=key)
    assert sum(r["n_runs"] > 0 for r in got) > 10
    one = {r["doc_id"]: r for r in runs.periodic_runs(odd).collect()}
    assert [tuple(r) for r in one[8]["runs"]] == [(0, 4000, 1)] and one[8]["collapsed"] == "word" and one[1]["n_words"] == 0 and one[1]["collapsed"] == ""
    assert runs.periodic_runs(odd).count() == odd.count() and runs.periodic_runs(odd.limit(0)).count() == 0


# ranked search


def search_brute(docs, items, k=20):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(low))
    each = [(d, c) for d, c in ((d, Counter(terms(t))) for d, t in docs) if c]
    total, size = len(each), sum(sum(c.values()) for _, c in each)
    df = Counter(t for _, c in each for t in c)
    out = []
    for item, text in sorted({tuple(r) for r in items}, key=str):
        asked, scored = Counter(terms(text)), []
        for d, c in each:
            m = 75 + 25 * sum(c.values()) * total // size
            s = sum(q * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if s:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("postings", "few", "size"), [(1 << 19, 256, 16 << 20), (300, 0, 700)])
def test_ranked_search(spark, odd, tmp_path, monkeypatch, postings, few, size):
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(lexical, "FEW", few)
    monkeypatch.setattr(lexical, "SLICE_BYTES", size)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(8)
    items = items.unionByName(spark.createDataFrame([(None, "one word"), (900, None), (901, "--"), (902, "One one ONE repeat"), (902, "twice"), (902, "twice"), (903, "neverseenword")], "item_id long, text string"))
    got = queries.op12_lexical_search(spark, written(spark, tmp_path, documents=docs, benchmark=items)).collect()
    assert sorted(map(tuple, got), key=str) == search_brute([tuple(r) for r in docs.collect()], items.collect())


def test_ranked_search_of_nothing(spark, odd):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical.rank_documents(odd.limit(0), items).count() == lexical.rank_documents(odd, items.limit(0)).count() == 0
    assert lexical.rank_documents(odd, items, k=3).count() == 3


# source mixing


def mix_brute(rows, weights=(1, 2, 3), most=3, passes=4):
    """Sorted by hash, source by source."""
    sized = [(d, t, s, len(re.findall("[^\x20\x09-\x0d]+", t or ""))) for d, t, s in rows]
    of = defaultdict(int)
    for _, _, s, n in sized:
        of[s] += n
    order = sorted(of, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = set(), sum(of.values())
    while True:
        free = [s for s in order if s not in capped]
        each = (total - sum(most * of[s] for s in capped)) / max(1, sum(w[s] for s in free))
        over = {s for s in free if w[s] * each > most * of[s]}
        if not over:
            break
        capped |= over
    target = {s: min(w[s] * each, float(most * of[s])) for s in order}
    copies, out = Counter(), []
    for d, t, s, n in sized:
        text = hashlib.md5((t or "").encode()).hexdigest()
        k = copies[d, s, n, text]
        copies[d, s, n, text] += 1
        out.append((int(hashlib.md5(f"{'' if d is None else d}|{text}|{k}".encode()).hexdigest()[:15], 16), d, s, n))
    taken = []
    for s in order:
        mine = sorted((r for r in out if r[2] == s), key=lambda r: r[0])
        budget = math.floor(target[s] + 0.5)
        whole = budget // of[s] if of[s] else 0
        left, open_, once = budget - whole * of[s], [i for i, r in enumerate(mine) if r[3]], set()
        for k in range(passes):
            upto, rest = 0, []
            fits = [i for i in open_ if not k or mine[i][3] <= left]
            for at, i in enumerate(fits):
                if upto + mine[i][3] > left:
                    rest = fits[at:]
                    break
                upto += mine[i][3]
                once.add(i)
            left, open_ = left - upto, rest
        taken += [(r[1], r[3], of[s], target[s], r[3] * (whole + (i in once))) for i, r in enumerate(mine)]
    return sorted(taken, key=str)


@pytest.mark.parametrize(("bits", "chunk"), [(12, 100_000), (3, 7)])
def test_mix(spark, odd, tmp_path, monkeypatch, bits, chunk):
    monkeypatch.setattr(mixing, "STEP_BITS", bits)
    monkeypatch.setattr(mixing, "CHUNK_ROWS", chunk)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").unionByName(odd.select("doc_id", "text", "source"))
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    rows = [tuple(r) for r in docs.collect()]
    got = queries.op11_source_mix(spark, written(spark, tmp_path, documents=docs)).collect()
    assert sorted(map(tuple, got), key=str) == mix_brute(rows)
    again = mixing.mix_sources(docs.orderBy(F.desc("text"))).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(again, key=str) == sorted(got, key=str)


def test_mix_meets_targets(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = mixing.mix_sources(docs, weights=(5, 1)).groupBy("source", "source_size", "target").agg(F.sum("taken").alias("taken"), F.max("copies").alias("copies")).collect()
    assert len(mixed) == 20 and {r["copies"] for r in mixed} <= {0, 1, 2, 3}
    for r in mixed:
        assert r["target"] <= 3 * r["source_size"] and abs(r["taken"] - r["target"]) < 0.01 * r["target"] + 1
    assert abs(sum(r["target"] for r in mixed) - sum(r["source_size"] for r in mixed)) < 1
    # thrice the words of all: every document thrice
    assert {r["copies"] for r in mixing.mix_sources(odd.filter("source = 'a'")).collect()} <= {0, 1}
    assert mixing.mix_sources(odd.limit(0)).count() == 0 and mixing.mix_sources(odd.filter("text is null")).first()["taken"] == 0
