"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, lexical, licenses, mixing, near_duplicates, packing, quality, runs, sharding, token_counts, token_files, toxicity
from .frames import shared_folder, table
from .labelled import fold

VOCABULARY = "word_bpe_49k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), fold("_id", 5) != 0)
    scored = toxicity.score_toxicity(docs, net)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "lang_threshold", "toxic_for_lang")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.tokenizer_path(VOCABULARY), limit=2048)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), 2048, packing.tokenizer_path(VOCABULARY), end_id=0)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token_files/{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, token_files.tokenizer_path(VOCABULARY), end_id=2)
    return token_files.read_token_files(spark, path)


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    votes = quality.fit_quality(docs, table(spark, sf_dir, "labels"), fold("_id", 4) != 2)
    scored = quality.score_quality(docs, votes)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "item_ids"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    index, books = ann.build_index(vectors)
    return ann.search(index, books, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def planted_period(doc_id: int | None, n: int) -> np.ndarray | None:
    """Every tenth document, by its id's hash, repeats a stretch of its words from some word on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < first, i, first + (i - first) % period)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted_period).withColumn("_longest", runs.longest_run(F.col("runs")))
    longest = [F.col(f"_longest.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.floor(F.col("_longest.length") * 1000 / F.col("_longest.period")).alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *longest, milli, F.sha2(runs.runs_text(F.col("runs")).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_ngram_jaccard_join, op3_token_counts, op4_best_fit_packing, op5_license_scan, op6_token_files, op7_byte_shards, op8_quality, op9_decontamination, op10_nearest_neighbours, op11_source_mix, op12_lexical_search, op13_periodic_runs)
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_SPLIT = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

#: A pass of the mix: what a threshold covers, and what then is left of each source's budget.
_PASS = """
p{k} AS (SELECT e.*, l.rest, sum(e.size) OVER (PARTITION BY e.source ORDER BY e.hash) AS upto FROM {rows} e JOIN l{k} l ON e.source IS NOT DISTINCT FROM l.source WHERE {fits}),
l{n} AS (SELECT l.source, l.rest - coalesce(max(p.upto) FILTER (p.upto <= p.rest), 0) AS rest FROM l{k} l LEFT JOIN p{k} p ON p.source IS NOT DISTINCT FROM l.source GROUP BY l.source, l.rest),
o{k} AS (SELECT r, source, size, hash FROM p{k} WHERE upto > rest),"""

ORACLE_SQL: dict[str, str] = {
    "op11_source_mix": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len({_SPLIT}) AS size, md5(coalesce(text, '')) AS t FROM documents),
h AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), t, CAST(row_number() OVER (PARTITION BY doc_id, source, size, t) - 1 AS VARCHAR))), 1, 15) AS BIGINT) AS hash FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
ordered AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER up, 0) AS num, sum(w) OVER () - coalesce(sum(w) OVER up, 0) AS den, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS nth FROM s WINDOW up AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
share AS (SELECT arg_min(CAST(num AS DOUBLE) / CAST(den AS DOUBLE), nth) AS each FROM ordered WHERE w * num <= 3 * source_size * den),
t AS (SELECT source, source_size, least(w * each, CAST(3 * source_size AS DOUBLE)) AS target FROM s, share),
b AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS whole FROM t),
l0 AS (SELECT source, words - whole * source_size AS rest FROM b),{"".join(_PASS.format(k=k, n=k + 1, rows=f"o{k - 1}" if k else "h", fits="e.size <= l.rest" if k else "e.size > 0") for k in range(4))}
once AS ({" UNION ALL ".join(f"SELECT r FROM p{k} WHERE upto <= rest" for k in range(4))})
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (whole + (r IN (SELECT r FROM once))::INT) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
""",
    "op12_lexical_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents WHERE len({_WORDS}) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(len(ws)) AS BIGINT) AS words FROM d),
item AS (SELECT row_number() OVER () AS k, item_id, {_WORDS} AS ws FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
asked AS (SELECT k, t, count(*) AS q FROM (SELECT k, unnest(ws) AS t FROM item) GROUP BY k, t),
tf AS (SELECT r, n, t, count(*) AS f FROM (SELECT r, len(ws) AS n, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY r, n, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY t),
impact AS (SELECT r, t, w * ((1000000000 * f) // (1000 * f + 12 * (75 + (25 * n * docs) // words))) AS s FROM tf JOIN w USING (t), total),
scored AS (SELECT k, r, CAST(sum(q * s) AS BIGINT) AS score FROM impact JOIN asked USING (t) GROUP BY k, r HAVING sum(q * s) > 0),
best AS (SELECT k, doc_id, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored JOIN d USING (r))
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM best JOIN item USING (k) WHERE rank <= 20
""",
    "op13_periodic_runs": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS ws, CASE WHEN doc_id IS NULL THEN 1 ELSE
xor(list_reduce(list_prepend(4294967295::BIGINT, [unicode(CAST(doc_id AS VARCHAR)[i])::BIGINT FOR i IN range(1, len(CAST(doc_id AS VARCHAR)) + 1)]),
lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) END AS h FROM documents),
p AS (SELECT *, h % 10 = 0 AND len(ws) > 0 AS planted, (h // 10) % greatest(len(ws), 1) AS a, 1 + (len(ws) - (h // 10) % greatest(len(ws), 1)) // (3 + (h // 10) % 8) AS q FROM d),
word AS (SELECT r, i, ws[CASE WHEN planted AND i >= a THEN a + (i - a) % q ELSE i END + 1] AS w, len(ws) AS n FROM (SELECT *, unnest(range(len(ws))) AS i FROM p)),
same AS (SELECT x.r, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
island AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM same),
stretch AS (SELECT r, q, min(i) AS s, count(*) + q AS n FROM island GROUP BY r, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT r, s, n, min(q) AS q FROM stretch GROUP BY r, s, n),
of_doc AS (SELECT r, count(*) AS n_runs, arg_min(struct_pack(s := s, n := n, q := q), [-n, s, q]) AS m, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS said FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + n)) AS i FROM run),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS said FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(m.s AS BIGINT) AS start, CAST(m.n AS BIGINT) AS length, CAST(m.q AS BIGINT) AS period, CAST(1000 * m.n // m.q AS BIGINT) AS exponent_milli,
sha256(coalesce(o.said, '')) AS runs_sha256, sha256(coalesce(k.said, '')) AS collapsed_sha256 FROM d LEFT JOIN of_doc o USING (r) LEFT JOIN kept k USING (r)
""",
    "op2_ngram_jaccard_join": rf"""
WITH RECURSIVE docs AS (SELECT doc_id, array_to_string({_WORDS}, ' ') AS k, {_WORDS} AS ws FROM documents),
texts AS (SELECT k, any_value(ws) AS ws, count(*) AS copies, min(doc_id) AS first FROM docs WHERE len(ws) > 0 GROUP BY k),
sh AS (SELECT DISTINCT k, unnest([array_to_string(ws[i:i+4], ' ') FOR i IN range(1, greatest(len(ws) - 4, 1) + 1)]) AS s FROM texts),
n AS (SELECT k, count(*) AS n FROM sh GROUP BY k),
shared AS (SELECT a.k AS x, b.k AS y, count(*) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.k <> b.k GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM shared JOIN n p ON p.k = x JOIN n q ON q.k = y WHERE 5 * m >= 4 * (p.n + q.n - m)),
reach(x, y) AS (SELECT k, k FROM texts UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
class AS (SELECT r.x AS k, min(t.first) AS class_id FROM reach r JOIN texts t ON t.k = r.y GROUP BY r.x),
partners AS (SELECT l.x AS k, sum(t.copies) AS c FROM links l JOIN texts t ON t.k = l.y GROUP BY l.x)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, CAST(coalesce(t.copies - 1 + coalesce(p.c, 0), 0) AS BIGINT) AS n_links
FROM docs d LEFT JOIN texts t ON t.k = d.k LEFT JOIN class c ON c.k = t.k LEFT JOIN partners p ON p.k = t.k
""",
    "op9_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(ws), 13) AS m, unnest([array_to_string(ws[i:i+least(len(ws), 13)-1], ' ') FOR i IN range(1, len(ws) - least(len(ws), 13) + 2)]) AS w FROM b WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT r, m, unnest(range(1, len(ws) - m + 2)) AS i, unnest([array_to_string(ws[i:i+m-1], ' ') FOR i IN range(1, len(ws) - m + 2)]) AS w FROM d, sizes WHERE len(ws) >= m),
found AS (SELECT dw.r, dw.i, dw.m, bw.item FROM dw JOIN bw ON bw.w = dw.w AND bw.m = dw.m),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + m)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
""",
}
