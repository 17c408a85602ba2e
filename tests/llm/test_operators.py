"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparksentry.llm import ann, decontaminate, frames, labelled, licenses, near_duplicates, packing, quality, queries, sharding, token_counts, token_files, toxicity
from sparksentry.llm.arrowtext import Words, text_buffers
from sparksentry.llm.wordtokens import ChunkEncoder, tokenizer_path

SMALL = "/root/testdata/sf0.001"
VOCAB = tokenizer_path("word_bpe_49k.json")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ODD = ["", None, "   \n", "one", "one", "Σ\x01 ΑΣ <|endoftext|>x <|startoftext|>", "é́ ñandú 12,345!!! don't I'LL", "a" * 3000, "-" * 5001, "日本語 テキスト 👍🏽", "word " * 4000, "the quick brown fox jumps over the lazy dog"]


def words(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCAB)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", 7, None) for i, t in enumerate(ODD)] + [(3, "one", "en", 7, None), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, _rank int, _key string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def encoded(library, text, end):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_counts_and_ids_are_the_library_s(library):
    random.seed(3)
    letters = "aab<|endoftext|> 'sΣé́ñ\x01!.,019²½日本İßǅ ​😀STRE'll"
    texts = [t or "" for t in ODD] + ["".join(random.choice(letters) for _ in range(random.randint(0, 50))) for _ in range(800)]
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert token_counts.count_array(pa.array(texts), VOCAB)[1].tolist() == [len(w) for w in wanted]
    encoder = ChunkEncoder(VOCAB, memo=5)
    for _ in range(3):
        ids, at = encoder.block(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == wanted


def test_token_counts(spark, odd, none, library):
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(odd).collect())
    rows = odd.collect()
    wanted = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), len(encoded(library, r["text"], 0)) - 1, len(encoded(library, r["text"], 0)) - 1 > 2048) for r in rows)
    assert got == wanted and token_counts.token_counts(none).count() == 0


@pytest.mark.parametrize("capacity", [7, 2048])
def test_packing(spark, odd, none, library, capacity):
    rows = packing.best_fit_pack(odd, capacity).collect()
    ids = defaultdict(list)
    for r in odd.collect():
        ids[r["doc_id"]].append(encoded(library, r["text"], 0))
    for doc, own in defaultdict(list, {d: [r for r in rows if r["doc_id"] == d] for d in ids}).items():
        assert sum(r["length"] for r in own) == sum(map(len, ids[doc]))
        assert Counter(r["ids_crc32"] for r in own) == Counter(crc(i[a : a + capacity]) for i in ids[doc] for a in range(0, len(i), capacity))
        assert all(r["start"] == r["piece"] * capacity for r in own)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // capacity) + 2
    assert packing.best_fit_pack(none, capacity).count() == 0


def test_steps_are_best_fit_decreasing():
    random.seed(5)
    for _ in range(20):
        sizes = sorted((random.randint(1, 60) for _ in range(random.randint(1, 200))), reverse=True)
        gaps: list[int] = []
        for s in sizes:
            fit = [g for g in range(len(gaps)) if gaps[g] >= s]
            if fit:
                gaps[min(fit, key=lambda g: gaps[g])] -= s
            else:
                gaps.append(60 - s)
        plan = packing.plan_steps(Counter(sizes), 60)
        last = max(int(b) + (taken - 1) // int(e) for (_, r, b, e, o), taken in zip(plan, taken_of(plan, Counter(sizes))))
        assert last + 1 == len(gaps)


def taken_of(plan, counts):
    for k, (length, rank, *_) in enumerate(plan):
        ends = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == length else counts[length]
        yield int(ends - rank)


def test_token_files(spark, odd, none, library, tmp_path):
    token_files.write_token_files(odd, str(tmp_path / "ids"), end_id=2)
    rows = token_files.read_token_files(spark, str(tmp_path / "ids"), with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in odd.collect()), key=lambda d: -1 if d is None else d)
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r["doc_id"]].append(encoded(library, r["text"], 2))
    at = 0
    for r in rows:
        assert r["start"] == at and r["ids"] in texts[r["doc_id"]] and r["ids_crc32"] == crc(r["ids"]) and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    token_files.write_token_files(none, str(tmp_path / "none"))
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_blocks_are_decoded_alone(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 1000)
    rng = np.random.default_rng(1)
    sizes = np.array([*rng.integers(1, 400, 60), 5000, 1, 1])
    ids = (rng.zipf(1.3, sizes.sum()) % 3000).astype(np.uint32)
    named = [None, *range(1, len(sizes))]
    table, blocks = token_files.encode_segment(named, sizes, ids)
    assert len(blocks) > 5 and sum(b[1] for b in blocks) == len(sizes)
    for first, docs, n, data in reversed(blocks):
        got, own, decoded = token_files.Decoder()(table, data)
        at = int(np.searchsorted(np.cumsum(sizes) - sizes, first))
        assert (decoded == ids[first : first + n]).all() and got == named[at : at + docs] and (own == sizes[at : at + docs]).all()


@pytest.mark.parametrize("at", [3, 20, 60, -5, -1])
def test_a_spoilt_block_is_noticed(at):
    ids = np.random.default_rng(1).integers(0, 300, 9000).astype(np.uint32)
    table, [(_, _, _, data)] = token_files.encode_segment([1], np.array([9000]), ids)
    assert (token_files.Decoder()(table, data)[2] == ids).all()
    spoilt = bytearray(data)
    spoilt[at] ^= 1
    with pytest.raises(ValueError):
        token_files.Decoder()(table, bytes(spoilt))
    with pytest.raises(ValueError):
        token_files.Decoder()(token_files.encode_segment([1], np.array([9000]), ids // 2)[0], data)


def test_token_files_of_one_id(spark, library, tmp_path):
    """A third of the rows and more may hold one id, or be equal in full."""
    docs = spark.createDataFrame([(7, "same")] * 300 + [(7, f"text {i}") for i in range(50)] + [(None, None)] * 50 + [(i, "x") for i in range(20)], "doc_id long, text string")
    sums = []
    for name in "ab":
        token_files.write_token_files(docs, str(tmp_path / name), end_id=2)
        sums.append([tuple(r) for r in token_files.read_token_files(spark, str(tmp_path / name)).orderBy("start").collect()])
    assert sums[0] == sums[1] and len(sums[0]) == 420
    parts = [r[0] for r in spark.read.parquet(str(tmp_path / "a")).groupBy("part").agg(F.sum("docs")).select("sum(docs)").collect()]
    assert max(parts) < 200
    wanted = Counter((r["doc_id"], crc(encoded(library, r["text"], 2))) for r in docs.collect())
    assert Counter((d, c) for d, _, _, c in sums[0]) == wanted


def test_equal_rows_are_spread(spark, library):
    """Most rows may be equal: they are numbered by several tasks, and packed and sharded like any others."""
    docs = spark.createDataFrame([(7, "same words here")] * 400 + [(None, None)] * 100 + [(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    numbered = frames.ranked(frames.cut(docs), "doc_id", ["text"]).withColumn("part", F.spark_partition_id()).collect()
    assert sorted(r["_rank"] for r in numbered if r["doc_id"] == 7 and r["text"] == "same words here") == list(range(400))
    assert max(Counter(r["part"] for r in numbered).values()) < 250
    rows = packing.best_fit_pack(docs, 64, VOCAB).collect()
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert len(rows) == 520 and all(a[0] != b[0] and b[1] == 0 or a[1] + a[2] == b[1] for a, b in zip(places, places[1:]))
    shards = sharding.shard_by_bytes(docs, 3).collect()
    by_shard = defaultdict(list)
    for r in shards:
        by_shard[r["shard"]].append(r["slot"])
    assert len(shards) == 520 and all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_shards(spark, odd, none):
    got = sharding.shard_by_bytes(odd, 3).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 1) for r in odd.collect())
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert len({r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"one")}) == 1
    assert sharding.shard_by_bytes(none, 3).count() == 0
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sums = [r[0] for r in sharding.shard_by_bytes(docs, 8).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sums) == 8 and max(sums) - min(sums) <= 0.01 * max(sums)


def differencing_brute(sizes, shards):
    """Lists of units by shard, largest sum first."""
    parts = [(-n, k, [[n, [k]]] + [[0, []] for _ in range(shards - 1)]) for k, n in enumerate(sizes)]
    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (p[0], p[1]))
        (_, _, a), (_, _, b), *parts = parts
        both = [[x[0] + y[0], x[1] + y[1]] for x, y in zip(a, reversed(b))]
        both = [p for _, _, p in sorted(((-p[0], -k, p) for k, p in enumerate(both)))]
        parts.append((both[-1][0] - both[0][0], made, both))
        made += 1
    return [sorted(p[1]) for p in parts[0][2]]


@pytest.mark.parametrize("shards", [1, 2, 3, 8])
def test_differencing_against_lists(shards):
    random.seed(shards)
    for n in (1, 2, 5, 40, 120):
        for top in (3, 1000):
            sizes = [random.randint(1, top) for _ in range(n)]
            where = sharding.karmarkar_karp(sizes, shards)
            assert [[k for k, w in enumerate(where) if w == s] for s in range(shards)] == differencing_brute(sizes, shards)


def test_shards_against_lists(spark):
    """With fewer texts than buckets every text is a unit or shares a bucket, which a plain loop can follow."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.pmod(F.xxhash64(F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))), F.lit(sharding.UNITS)).alias("b")).collect()
    total = sum(len(r["t"].encode()) + 1 for r in rows)
    groups = Counter()
    bucket = {}
    for r in rows:
        groups[r["t"]] += len(r["t"].encode()) + 1
        bucket[r["t"]] = r["b"]
    heavy = sorted((t for t in groups if groups[t] * sharding.UNITS >= total), key=lambda t: (-groups[t], hashlib.md5(t.encode()).digest()))
    light = Counter()
    for t in groups:
        if t not in heavy:
            light[bucket[t]] += groups[t]
    units = [*heavy, *sorted(light)]
    parts = differencing_brute([groups[t] for t in heavy] + [light[b] for b in sorted(light)], 8)
    of = {units[k]: s for s, part in enumerate(parts) for k in part}
    got = {(r["doc_id"], r["size"], r["shard"]) for r in sharding.shard_by_bytes(docs, 8).collect()}
    assert got == {(r["doc_id"], len(r["t"].encode()) + 1, of[r["t"]] if r["t"] in of else of[r["b"]]) for r in rows}


def test_differencing_beats_greedy():
    random.seed(1)
    sizes = [random.randint(1, 10**6) for _ in range(500)]
    where = sharding.karmarkar_karp(sizes, 4)
    sums = [sum(s for s, w in zip(sizes, where) if w == k) for k in range(4)]
    assert max(sums) - min(sums) < 50 and sharding.karmarkar_karp([], 4) == []


def jaccard_brute(texts):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [set() for _ in texts]
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                links[i].add(j)
                links[j].add(i)
    return links


def test_near_duplicates_against_all_pairs(spark, none, monkeypatch):
    random.seed(8)
    base = [" ".join(random.choice("abcdefghijklmnop") * 2 + str(random.randint(0, 99)) for _ in range(60)) for _ in range(3)]
    texts = list(ODD)
    for b in base:
        for _ in range(25):
            w = b.split()
            for _ in range(random.randint(0, 2)):
                w[random.randrange(len(w))] = random.choice(["x", "y", "z"])
            texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    links = jaccard_brute(texts)
    root = list(range(len(texts)))
    for _ in texts:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(texts))]
    for block in (400, 7):  # whole groups, and groups cut into blocks
        monkeypatch.setattr(near_duplicates, "BLOCK_TEXTS", block)
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates.near_duplicates(docs).collect()}
        assert got == {i: (root[i], len(links[i])) for i in range(len(texts))}
    kept = {r[0] for r in near_duplicates.one_of_each(docs).select("doc_id").collect()}
    assert kept == {i for i in range(len(texts)) if root[i] == i}
    assert near_duplicates.near_duplicates(none).count() == 0 and near_duplicates.one_of_each(none).count() == 0


def test_repeated_rows_are_copies(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["class_id"], r["n_links"]) for r in near_duplicates.near_duplicates(docs).collect()) == [(0, 1, 2), (1, 1, 2), (1, 1, 2), (2, 2, 0)]


def test_one_row_of_each_class_stays(spark):
    """Whatever the ids: repeated, null, or the same for two near copies; and texts without words."""
    rows = [(1, "A b c d e f"), (1, "a  b c d e f"), (None, "x y"), (None, "x y"), (None, "x y"), (3, "--"), (4, "--"), (5, "--"), (6, ""), (7, None), (1, "another text of its own")]
    kept = near_duplicates.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter((r["doc_id"], " ".join(words(r["text"])) or r["text"]) for r in kept)
    assert got == Counter([(1, "a b c d e f"), (None, "x y"), (3, "--"), (6, ""), (7, None), (1, "another text of its own")])


def contamination_brute(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(len(w) - min(13, len(w)) + 1):
            if w:
                windows[tuple(w[i : i + 13])] |= {str(item)} - {"None"}
    out = {}
    for key, text in docs:
        w, hit, named = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    named |= windows[tuple(w[i : i + m])]
        out[key] = (len(w), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("slice_bytes", [1 << 24, 40])
def test_contamination_against_brute_force(spark, none, monkeypatch, slice_bytes):
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", slice_bytes)
    random.seed(2)
    items = [(1, " ".join(f"w{i}" for i in range(20))), (2, "short item"), (3, None), (4, "..."), (5, "Über die Brücke, gehen wir"), (6, "x " * 30), (7, "one"), (None, "the quick brown fox"), (None, "short item")]
    docs = [(i, t) for i, t in enumerate([*ODD, "A short ITEM here", "w1 w2", " ".join(f"W{i}" for i in range(3, 18)) + " end", "über-die brücke gehen wir", "x " * 100, "x " * 12, " ".join(random.choice(["w1", "w2", "x", "short", "item"]) for _ in range(900))])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["item_ids"]), r["contaminated"]) for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == contamination_brute(docs, items)
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench.limit(0)).filter("n_hit > 0").count() == 0


def test_licenses(spark, odd, none):
    mit = licenses.TEMPLATES["MIT-permission"]
    texts = [f"intro words\n{mit} more", "RELEASED under   the MIT license", "Released under the BSD License.", "Nothing here", None, f"{mit.replace('without restriction', 'with no restriction at all')} and {mit}"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = licenses.license_scan(docs).collect()
    found = {(r["doc_id"], r["license"]) for r in rows}
    assert found == {(0, "MIT-permission"), (1, "MIT"), (2, "MIT"), (5, "MIT-permission")} and sum(r["doc_id"] == 5 for r in rows) == 2
    for r in rows:
        if r["coverage"] == 1:
            assert words(texts[r["doc_id"]].encode()[r["first_byte"] : r["end_byte"]].decode()) == words(licenses.TEMPLATES[r["license"]])
    assert licenses.license_scan(odd).count() == 0 and licenses.license_scan(none).count() == 0


def test_full_licenses_with_changes():
    """Of the full texts, those with a coverage of 0.8 are found, also where names are put in or a clause is left out."""
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    full = [n for n in licenses.TEMPLATES if n.endswith("-full")]
    for name in full:
        w = words(licenses.TEMPLATES[name])
        for said, least in ((w, 1.0), (w[:40] + ["acme", "corp"] + w[40:], 0.95), (w[: len(w) // 2] + w[len(w) // 2 + 5 :], 0.9)):
            found = {index.names[t]: c for _, t, c, _, _ in licenses.find_licenses(index, licenses.words_of("before " + " ".join(said) + " after"))}
            assert found.get(name, 0) >= least and not (found.keys() & set(full)) - {name}
    half = words(licenses.TEMPLATES["MIT-full"])[:80]
    assert "MIT-full" not in {index.names[r[1]] for r in licenses.find_licenses(index, licenses.words_of(" ".join(half)))}


def test_what_cannot_fit_is_not_aligned():
    rng = np.random.default_rng(2)
    for _ in range(300):
        template, text = rng.integers(0, 12, 10).astype(np.uint64), rng.integers(0, 12, rng.integers(1, 25)).astype(np.uint64)
        matches = licenses.align(template, text, 0)[1]
        assert licenses.may_fit(template, text, 0.6) or matches / len(template) < 0.6


def test_neighbours_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)) + np.repeat(rng.normal(size=(15, 16)) * 2, 100, axis=0)
    x[700:760] = x[700]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, None), (9050, [0.0] * 16), (9100, [float("nan")] * 16), (9150, [None] + [1.0] * 15), (9200, [1.0]), (None, [1.0] * 16), (50, [float(v) for v in x[50]])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index, books = ann.build_index(vectors)
    got = defaultdict(list)
    for r in ann.search(index, books, vectors.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        cosine = unit @ unit[q]
        wanted = [i for i in np.lexsort((np.arange(1500), -np.round(cosine, 12))) if i != q][:5]
        hits += len(set(wanted) & {v for v, _ in got[q]})
        assert all(abs(cosine[v] - s) < 1e-9 for v, s in got[q])
    assert sorted(got) == list(range(0, 1500, 50)) and hits >= 0.9 * 150
    assert [v for v, _ in got[700]] == [701, 702, 703, 704, 705]
    whole = set(ann.search(index, books, vectors.filter("vec_id % 50 = 0")).collect())
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    assert set(ann.search(index, books, vectors.filter("vec_id % 50 = 0")).collect()) == whole
    empty = vectors.limit(0)
    index, books = ann.build_index(empty)
    assert ann.search(index, books, empty).count() == 0


def test_licenses_back_to_back():
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    random.seed(3)
    short = ["MIT", "Apache-2.0", "CC-BY-NC-4.0", "All-rights-reserved", "GPL-3.0"]
    cases = [["All-rights-reserved"] * 1000, ["MIT"] * 2, ["MIT"] * 10, ["MIT-permission"] * 5]
    cases += [[random.choice(short + [None]) for _ in range(60)] for _ in range(20)]
    for case in cases:
        text = " ".join(licenses.TEMPLATES[x] if x else "other" for x in case)
        # brute force: every place where the words of a template stand
        w, wanted = words(text), set()
        for t, x in enumerate(index.names):
            own = words(licenses.TEMPLATES[x])
            if x in case:
                wanted |= {(t, i, i + len(own)) for i in range(len(w) - len(own) + 1) if w[i : i + len(own)] == own}
        got = [r[1:] for r in licenses.find_licenses(index, licenses.words_of(text)) if index.names[r[1]] in case]
        assert len(wanted) == sum(x is not None for x in case)
        assert {(t, a, b) for t, c, a, b in got if c == 1} == wanted and len(got) == len(wanted)


def hot_vectors():
    """A third of the rows lies together in one tight cluster."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 32))
    x[1000:2000] = x[1000] + rng.normal(size=(1000, 32)) * 1e-4
    return x


def neighbours_brute(x, q):
    cosine = ann.exact_cosine(x, x[q])
    return [int(i) for i in np.lexsort((np.arange(len(x)), -cosine)) if i != q][:5]


def test_neighbours_in_a_tight_cluster(spark):
    x = hot_vectors()
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    index, books = ann.build_index(vectors)
    got = defaultdict(list)
    for r in ann.search(index, books, vectors.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert {q: neighbours_brute(x, q) for q in range(0, 3000, 50)} == got


def test_neighbours_of_repeated_rows(spark):
    x = hot_vectors()[:150]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x) for _ in range(6)], "vec_id long, embedding array<double>").coalesce(1)
    index, books = ann.build_index(vectors)
    got = defaultdict(list)
    for r in ann.search(index, books, vectors.filter("vec_id % 10 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert {q: neighbours_brute(x, q) for q in range(0, 150, 10)} == got


@pytest.mark.parametrize("batch", ["50", "10000"])
def test_neighbours_beyond_the_sample(spark, batch):
    """Recall where codebooks and reach are fitted on a sixth of the rows, whatever the batches are."""
    x = hot_vectors()
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(2)
    index, books = ann.build_index(vectors, sample=500)
    assert len(books.ids) < 800 and 0 < books.reach <= 1
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rows = ann.search(index, books, vectors.filter("vec_id % 50 = 0")).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    got = defaultdict(set)
    for r in rows:
        got[r["query_id"]].add(r["vec_id"])
    assert np.mean([len(got[q] & set(neighbours_brute(x, q))) / 5 for q in range(0, 3000, 50)]) >= 0.95


def held_out(spark, sf, name, threshold, label):
    rows = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    return [(r["score"], int(r["score"] >= threshold) == r["predicted"], r["predicted"] == r[label]) for r in rows]


def test_classifiers_on_held_out_rows(spark):
    for name, threshold, label, least in (("op1_toxicity", 0.5, "toxic", 0.93), ("op8_quality", 0.7, "quality", 0.95)):
        rows = held_out(spark, "/root/testdata/sf0.1", name, threshold, label)
        assert all(0 <= s <= 1 and same for s, same, _ in rows)
        assert sum(ok for *_, ok in rows) >= least * len(rows), name


def test_classifiers_on_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (99, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        net, votes = toxicity.fit_toxicity(odd, some), quality.fit_quality(odd, some)
        for found in (toxicity.score_toxicity(odd, net), quality.score_quality(odd, votes)):
            assert found.count() == len(ODD) + 2 and found.filter("score is null or score < 0 or score > 1").count() == 0
        assert toxicity.score_toxicity(none, net).count() == quality.score_quality(none, votes).count() == 0


def test_a_sample_holds_an_id_once_and_isn_t_empty_for_billions_of_labels(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("case when id < 2000 then 1 else id end as doc_id", "concat('text ', id) as text", "'en' as lang")
    labels = spark.range(3000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    got = labelled.labelled_sample(docs, labels, "quality", F.lit(True))
    assert len(got) == 1001 and got.column("text").to_pylist().count("text 0") == 1
    assert 20 < len(labelled.labelled_sample(docs, labels, "quality", F.lit(True), rows=300)) < 300
    assert 20 < len(labelled.labelled_sample(docs, labels, "quality", F.lit(True), size=1000)) < 300


def words_of(text):
    return Words(*text_buffers(pa.array([text or ""])))


def plain_score(net, text):
    """Every window of one text, one after the other."""
    words = words_of(text)
    e = net.embed[net.slots[toxicity.buckets(words)]].sum(axis=1).astype(np.float64)
    pools = []
    for w, f, bias in zip(toxicity.WIDTHS, net.filters, net.bias.reshape(len(toxicity.WIDTHS), -1)):
        best = bias.astype(np.float64)
        for i in range(len(e)):
            window = np.zeros((w, toxicity.DIM))
            window[: len(e[i : i + w])] = e[i : i + w]
            best = np.maximum(best, window.ravel() @ f + bias)
        pools.append(np.maximum(best, 0))
    return 1 / (1 + np.exp(-(np.concatenate(pools) @ net.out + net.base)))


def test_gradients_are_those_of_the_loss(monkeypatch):
    """Against central differences, in double precision, on a few short texts (one of them empty)."""
    rng = np.random.default_rng(3)
    texts = ["a b c d e f", "", "c c d", "x", "f e d c b a x y z"]
    net = toxicity.constant_net(0.4)
    net.known = np.unique(np.concatenate([toxicity.buckets(words_of(t)).ravel() for t in texts if t]))
    net.embed = rng.normal(0, 0.5, (len(net.known) + 1, toxicity.DIM))
    net.embed[0] = 0
    net.filters = [rng.normal(0, 0.5, f.shape) for f in net.filters]
    net.bias, net.out = rng.normal(0, 0.1, net.bias.shape), rng.normal(0, 0.5, net.out.shape)
    made = [net.slots[toxicity.buckets(words_of(t))] if t else np.zeros((0, 3), np.int32) for t in texts]
    sizes = np.array([len(m) for m in made])
    rows, starts = toxicity.padded(np.concatenate(made), np.cumsum(sizes) - sizes, sizes)
    batch = toxicity.Batch(rows, starts, starts + sizes, np.array([1.0, 0, 1, 0, 1]))
    _, touched, of_embed, others = toxicity.gradients(net, batch)
    whole = np.zeros_like(net.embed)
    whole[touched] = of_embed

    def slope(array, at):
        kept, step, sides = array[at], 1e-6, []
        for sign in (1, -1):
            array[at] = kept + sign * step
            sides.append(toxicity.gradients(net, batch)[0])
        array[at] = kept
        return (sides[0] - sides[1]) / (2 * step)

    for array, grad in zip([net.embed, *net.filters, net.bias, net.out], [whole, *others[:-1]]):
        for flat in rng.choice(array.size, min(60, array.size), replace=False):
            at = np.unravel_index(flat, array.shape)
            if array is not net.embed or at[0]:
                assert abs(slope(array, at) - grad[at]) < 1e-6


def test_a_long_text_scores_the_same_in_stretches(monkeypatch):
    random.seed(4)
    texts = [" ".join(random.choice("abcdefgh") for _ in range(n)) for n in (0, 1, 2, 3, 50, 700)]
    net = toxicity.train(pa.array(texts * 8), np.array([0, 1, 0, 1, 0, 1] * 8), [None] * 48, epochs=2)
    whole = toxicity.score_texts(net, pa.array(texts))
    for size in (1, 3, 64):
        monkeypatch.setattr(toxicity, "SCORE_WORDS", size)
        assert np.abs(toxicity.score_texts(net, pa.array(texts)) - whole).max() < 2e-6


def plain_vote(votes, text):
    """Vote of the nearest by a full sort, and whether the last voter is told apart."""
    counts = quality.term_counts(words_of(text))
    if not counts.any():
        return votes.share, True
    cosine = (votes.vectors.astype(np.float64) @ votes.latent(counts)[0].astype(np.float64)).tolist()
    order = sorted(range(len(cosine)), key=lambda i: -cosine[i])
    k = min(quality.NEIGHBOURS, len(order))
    weight = [max(cosine[i], 0) ** 4 for i in order[:k]]
    clear = k == len(order) or cosine[order[k - 1]] - cosine[order[k]] > 1e-5
    return sum(w * votes.labels[i] for w, i in zip(weight, order)) / sum(weight) if sum(weight) else votes.share, clear


def test_scores_against_plain_loops(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    net, votes = toxicity.fit_toxicity(docs, labels), quality.fit_quality(docs, labels)
    texts = [r["text"] for r in docs.select("text").orderBy("doc_id").collect()] + ODD
    found = toxicity.score_texts(net, pa.array(texts, pa.string()))
    assert np.abs(found - [plain_score(net, t) for t in texts]).max() < 1e-5 and found.max() > 0.5 > found.min()
    wanted = [plain_vote(votes, t) for t in texts]
    clear = np.array([c for _, c in wanted])
    assert clear.mean() > 0.5 and np.abs(quality.score_votes(votes, pa.array(texts, pa.string())) - [v for v, _ in wanted])[clear].max() < 1e-3


def test_pipeline_against_brute_force(spark, library, tmp_path):
    """run() on whole small tables, against plain loops for every stage."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    small = spark.read.parquet(f"{sf}/documents.parquet")
    clean = small.orderBy("doc_id").first()["text"]
    docs = small.select("doc_id", "text", "lang").withColumn("_key", F.concat(F.lit("own "), "doc_id")).withColumn("_row", F.lit(5))
    odd = [(100_000 + i, t, None, "own", None) for i, t in enumerate([*ODD, clean, clean + " and more"])]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, _key string, _row int"))
    for name, df in (("documents", docs), ("labels", spark.read.parquet(f"{sf}/labels.parquet")), ("benchmark", spark.read.parquet(f"{sf}/benchmark.parquet"))):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    docs, labels, items = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    net = toxicity.fit_toxicity(docs, labels, labelled.fold("_id", 5) != 0)
    kept = {d: t for d, t in texts.items() if plain_score(net, t) < 0.5}
    left = docs.filter(F.col("doc_id").isin(list(kept)))
    votes = quality.fit_quality(left, labels, labelled.fold("_id", 4) != 2)
    good = {d: t for d, t in kept.items() if plain_vote(votes, t)[0] >= 0.7}
    ids = sorted(good)
    links = jaccard_brute([good[d] for d in ids])
    root = list(range(len(ids)))
    for _ in ids:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(ids))]
    single = {ids[i]: good[ids[i]] for i in range(len(ids)) if root[i] == i}
    judged = contamination_brute(list(single.items()), [tuple(r) for r in items.select("item_id", "text").collect()])
    last = {d: t for d, t in single.items() if not judged[d][3]}
    assert len(texts) > len(kept) > len(good) > len(single) > len(last) > 0

    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == set(last)
    wanted = []
    for d, t in last.items():
        own = encoded(library, t, 0)
        wanted += [(d, k, 2048 * k, len(own[2048 * k : 2048 * (k + 1)]), crc(own[2048 * k : 2048 * (k + 1)])) for k in range(-(-len(own) // 2048))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(wanted)


def test_stages_carry_clashing_columns_along(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", F.concat(F.lit("own "), "doc_id").alias("_key"), F.col("doc_id").alias("_row"), F.lit(1).alias("_gone"), F.lit(2).alias("a.b"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        rows = out.collect()
        assert out.schema.names == docs.schema.names and rows
        assert all(r["_key"] == f"own {r['doc_id']}" and r["_row"] == r["doc_id"] and r["a.b"] == 2 for r in rows)


def test_pipeline_stages_keep_columns_and_clean_rows(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        assert stage(spark, odd, SMALL).count() > 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.concat_ws(",", F.array().cast("array<string>")), 256)).first()[0]
