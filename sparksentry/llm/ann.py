"""Approximate nearest neighbours by cosine with additive quantisation.

A unit vector is coded as a sum of one full-dimensional codeword from each of several
codebooks.  Codebooks are fitted on a bounded sample: k-means on residuals first, then
alternately beam-search codes and least-squares codewords.  Every vector is coded by beam
search and keeps the norm of its code sum and its own cosine with it.  A query scores a code
by table look-ups (its dot products with all codewords) over that norm.

From a code's score s and its row's own cosine a follows what the row's cosine with the query
is: a * s + t * sqrt((1 - a^2) * (1 - s^2)), where t, from -1 to 1, is how far the
row's residual points to the query.  A row is ranked again, by exact cosine in double
precision, if that reaches the query's k-th best for t = reach: 1.1 times the most that any
true neighbour needed among the sample's own queries.  Where the k-th best is nearer to the
query than the code is to its row (as inside a tight cluster), reach is 1, which
rules nothing out that could be among the best.  There is no other limit on candidates, and
batches play no part.  The k-th best is first known from the sample, then from what was found.

Vectors that are null, zero, or hold a null or non-finite component take no part, nor do
vectors of another length than most.  Equal vectors tie, smaller vec_id first.  A row isn't
a candidate for queries of its own vec_id.  Repeated rows count once; an id with several
vectors asks with the smallest of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import map_arrow, prepare, stored

#: Vectors in the fitting sample, codebooks, codewords in each, and beam width.
SAMPLE, BOOKS, WORDS, BEAM = 8_192, 32, 64, 3
#: Values of the sample's coin: far more than vectors.
COIN = 1 << 40
#: Sample vectors that ask for their neighbours in the sample, to find the reach; neighbours each; and the margin.
REACH_QUERIES, REACH_NEIGHBOURS, REACH_MARGIN = 512, 5, 1.1
#: Queries broadcast at once, rows coded or scored at once, queries whose look-up tables are read together, and pairs ranked at once.
QUERY_BLOCK, CODE_BLOCK, LOOKUP_QUERIES, PAIR_BLOCK = 8_192, 4_096, 256, 1 << 15


@dataclass
class Codebooks:
    """books[book, word, dimension]; the sample (unit vectors by id) that they were fitted on; and the reach."""

    books: np.ndarray
    ids: np.ndarray
    sample: np.ndarray
    reach: float


def usable(vectors: DataFrame, vector: str = "embedding", length: int | None = None) -> DataFrame:
    """vec_id and _v (doubles) of the rows that take part; length: theirs, by default that of most."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    df = vectors.select(F.col("vec_id"), v.alias("_v")).filter(F.col("vec_id").isNotNull() & F.col("_v").isNotNull() & (F.size("_v") > 0))
    df = df.filter(~bad & F.exists("_v", lambda x: x != 0))
    if length is None:
        most = df.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        length = most["d"] if most else 0
    return df.filter(F.size("_v") == length)


def one_each(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("vec_id").agg(F.min("_v").alias("_v"))


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def units(x: np.ndarray) -> np.ndarray:
    """Unit rows; scaled first, so that very large and very small vectors keep their direction."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """[vectors, books] codes by beam search over the residuals."""
    n, (m, k, d) = len(x), books.shape
    codes = np.zeros((n, 1, 0), np.uint8)
    residual, cost = x[:, None, :], (x * x).sum(axis=1)[:, None]
    row = np.arange(n)
    for book in books:
        width = residual.shape[1]
        costs = (residual.reshape(-1, d) @ (-2 * book.T)).reshape(n, width, k)
        costs += (book * book).sum(axis=1)
        costs += cost[:, :, None]
        flat = costs.reshape(n, -1)
        best, least = [], []
        for _ in range(min(beam, width * k)):
            at = flat.argmin(axis=1)
            best.append(at)
            least.append(flat[row, at])
            flat[row, at] = np.inf
        best, cost = np.stack(best, axis=1), np.stack(least, axis=1)
        parent, word = best // k, best % k
        codes = np.concatenate([codes[row[:, None], parent], word[:, :, None].astype(np.uint8)], axis=2)
        residual = residual[row[:, None], parent] - book[word]
    return codes[:, 0]


def encode_all(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    parts = [encode(x[lo : lo + CODE_BLOCK], books) for lo in range(0, len(x), CODE_BLOCK)]
    return np.concatenate(parts) if parts else np.zeros((0, len(books)), np.uint8)


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[j][codes[:, j]] for j in range(len(books)))


def code_cosines(x: np.ndarray, codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit rows: the norm of the code sum, its cosine with the row, and how far look-ups in single precision may err."""
    words = books.astype(np.float64)
    total = decode(codes, words)
    norm = np.maximum(np.linalg.norm(total, axis=1), 1e-12)
    lengths = np.linalg.norm(words, axis=2)
    error = 2.0**-23 * (sum(books.shape) + 4) * sum(lengths[j][codes[:, j]] for j in range(len(books))) / norm
    return norm, (x * total).sum(axis=1) / norm, error


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book * book).sum(axis=1) - 2 * (x @ book.T), axis=1)


def fit_books(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 4, refits: int = 1, seed: int = 5) -> np.ndarray:
    """Codebooks for unit vectors."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    d, out, residual, which = x.shape[1], [], x, np.eye(words, dtype=np.float32)
    for _ in range(books):
        book = residual[rng.integers(0, len(x), words)]
        for _ in range(rounds):
            own = which[nearest(residual, book)]
            n = own.sum(axis=0)[:, None]
            book = np.where(n > 0, own.T @ residual / np.maximum(n, 1), residual[rng.integers(0, len(x), words)])
        residual = residual - book[nearest(residual, book)]
        out.append(book)
    fitted = np.stack(out)
    size = books * words
    for _ in range(refits):
        column = encode_all(x, fitted).astype(np.int64) + np.arange(books) * words
        pairs = np.zeros(size * size)
        for j in range(books):
            pairs += np.bincount((column[:, j : j + 1] * size + column).ravel(), minlength=size * size)
        aim = np.stack([np.bincount(column.ravel(), np.repeat(x[:, i].astype(np.float64), books), size) for i in range(d)], axis=1)
        fitted = np.linalg.solve(pairs.reshape(size, size) + 1e-2 * np.eye(size), aim + 1e-2 * fitted.reshape(-1, d)).astype(np.float32).reshape(books, words, d)
    return fitted


def fitted_reach(x: np.ndarray, books: np.ndarray, seed: int = 6) -> float:
    """REACH_MARGIN times the most that a true neighbour in the sample needed, where its k-th best is farther than codes are from rows."""
    n = min(REACH_NEIGHBOURS, len(x) - 1)
    if n < 1:
        return 1.0
    asked = np.random.default_rng(seed).permutation(len(x))[:REACH_QUERIES]
    cosine = x @ x[asked].T
    cosine[asked, np.arange(len(asked))] = -2
    near = np.argpartition(-cosine, n - 1, axis=0)[:n]
    least = np.take_along_axis(cosine, near, axis=0).min(axis=0)
    codes = encode_all(x.astype(np.float32), books)
    norm, own, _ = code_cosines(x, codes, books)
    score = np.clip(decode(codes, books.astype(np.float64)) @ x[asked].T / norm[:, None], -1, 1)
    s, a = np.take_along_axis(score, near, axis=0), np.clip(own[near], -1, 1)
    room = np.sqrt((1 - a * a) * (1 - s * s))
    needed = ((least - a * s) / np.maximum(room, 1e-12))[(least <= a) & (room > 1e-12)]
    return float(np.clip(REACH_MARGIN * needed.max(), 0, 1)) if len(needed) else 1.0


def build_index(vectors: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, Codebooks]:
    """(vec_id, _v, codes, and what code_cosines gives) of every vector, and the codebooks."""
    spark = vectors.sparkSession
    prepare(spark)
    base = usable(vectors)
    n = base.count()
    coin = F.pmod(F.xxhash64("vec_id", F.lit(23)), F.lit(COIN))
    drawn = one_each(base.filter(coin < int(COIN * min(1.0, sample / max(n, 1))))).toArrow()
    drawn = drawn.sort_by([("vec_id", "ascending")]) if len(drawn) else drawn
    x = matrix(drawn.column("_v"))
    x = units(x) if len(x) else x
    books = fit_books(x) if len(x) else np.zeros((BOOKS, WORDS, 1), np.float32)
    made = Codebooks(books, drawn.column("vec_id").to_numpy(), x, fitted_reach(x, books))
    shared = spark.sparkContext.broadcast(books)

    def of_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        for lo in range(0, batch.num_rows, CODE_BLOCK):
            part = batch.slice(lo, CODE_BLOCK)
            x = units(matrix(part.column("_v")))
            codes = encode(x.astype(np.float32), shared.value)
            norm, own, error = code_cosines(x, codes, shared.value)
            yield {"vec_id": part.column("vec_id"), "_v": part.column("_v"), "_codes": pa.array([c.tobytes() for c in codes], pa.binary()), "_norm": norm, "_own": own, "_error": error}

    return stored(map_arrow(base, of_batch, "vec_id long, _v array<double>, _codes binary, _norm double, _own double, _error double")), made


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def exact_cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of rows of x with one vector, in double precision."""
    return (x * q).sum(axis=1) / (lengths(x) * lengths(q[None]))


def known_bounds(ids: np.ndarray, queries: np.ndarray, fitted: Codebooks, k: int) -> np.ndarray:
    """What the k-th best of each query is at least: that among the sample; -1 if it holds fewer."""
    out = np.full(len(ids), -1.0)
    if len(fitted.ids) <= k:
        return out
    for lo in range(0, len(ids), LOOKUP_QUERIES):
        cosine = units(queries[lo : lo + LOOKUP_QUERIES]) @ fitted.sample.T
        cosine[ids[lo : lo + LOOKUP_QUERIES, None] == fitted.ids] = -2
        out[lo : lo + LOOKUP_QUERIES] = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, -k] - 1e-9
    return out


def search(index: DataFrame, fitted: Codebooks, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest indexed rows but those of its own id.

    Queries go out in blocks of bounded size, dealt by a hash of their id; every block is
    searched in every partition of the index, which returns its k best for each query.
    """
    spark = index.sparkSession
    sample = spark.sparkContext.broadcast(fitted)

    def bounded(batch: pa.RecordBatch) -> dict:
        ids, v = batch.column("vec_id"), batch.column("_v")
        return {"vec_id": ids, "_v": v, "_bound": known_bounds(ids.to_numpy(), matrix(v), sample.value, k) if len(ids) else np.zeros(0)}

    q = stored(map_arrow(one_each(usable(queries, length=fitted.books.shape[2])), bounded, "vec_id long, _v array<double>, _bound double"))
    blocks = q.count() // QUERY_BLOCK + 1
    parts = []
    for b in range(blocks):
        own = q.filter(F.pmod(F.xxhash64("vec_id", F.lit(29)), F.lit(blocks)) == b).toArrow()
        own = own.sort_by([("vec_id", "ascending")]) if len(own) else own
        shared = spark.sparkContext.broadcast((fitted.books, fitted.reach, own.column("vec_id").to_numpy(), matrix(own.column("_v")), own.column("_bound").to_numpy()))
        part = _search_block(index, shared, k)
        if blocks > 1:  # written block by block, so that one block's queries are held at a time
            part = stored(part)
            shared.destroy()
        parts.append(part)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    hits = found.select("query_id", F.explode("_hits").alias("h")).select("query_id", F.col("h.vec_id").alias("vec_id"), F.col("h.score").alias("score")).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Nearest:
    """The k best (score, vec_id) so far of each query; places not yet taken have score -inf."""

    def __init__(self, queries: int, k: int):
        self.score, self.id = np.full((queries, k), -np.inf), np.zeros((queries, k), np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        """Of equal scores the smaller id comes first, and a repeated (score, id) counts once."""
        k = self.score.shape[1]
        some = np.unique(query)
        query = np.concatenate([np.repeat(some, k), query])
        score, id = np.concatenate([self.score[some].ravel(), score]), np.concatenate([self.id[some].ravel(), id])
        order = np.lexsort((id, -score, query))
        query, score, id = query[order], score[order], id[order]
        fresh = np.ones(len(query), bool)
        fresh[1:] = (query[1:] != query[:-1]) | (score[1:] != score[:-1]) | (id[1:] != id[:-1])
        query, score, id = query[fresh], score[fresh], id[fresh]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        best = rank < k
        self.score[some], self.id[some] = -np.inf, 0
        self.score[query[best], rank[best]], self.id[query[best], rank[best]] = score[best], id[best]


class BlockSearch:
    """One block of queries against rows of the index, a bounded number at a time."""

    def __init__(self, books: np.ndarray, reach: float, ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int):
        self.reach, self.ids, self.queries, self.bounds = reach, ids, queries, bounds
        self.best, self.lengths = Nearest(len(ids), k), lengths(queries)
        self.blocks = [slice(lo, lo + LOOKUP_QUERIES) for lo in range(0, len(ids), LOOKUP_QUERIES)]
        # [words, queries] for each block and book: a code's look-up reads its row, for all queries of the block
        self.tables = [[book @ units(queries[own]).astype(np.float32).T for book in books] for own in self.blocks]

    def add(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norm: np.ndarray, own: np.ndarray, error: np.ndarray) -> None:
        own = np.clip(own, -1, 1)
        a, room, over = own.astype(np.float32)[:, None], np.sqrt(1 - own * own).astype(np.float32)[:, None], error.astype(np.float32)[:, None]
        of_norm, long = norm.astype(np.float32)[:, None], lengths(x)
        for block, of_book in zip(self.blocks, self.tables):
            score = of_book[0][codes[:, 0]]
            for j in range(1, len(of_book)):
                score += of_book[j][codes[:, j]]
            score /= of_norm
            score = np.clip(score + over, -1, 1)
            least = np.maximum(self.bounds[block], self.best.score[block, -1])
            floor = (least - 1e-6).astype(np.float32)
            side = room * np.sqrt(1 - score * score)
            reached = np.where(least.astype(np.float32) > a, side, self.reach * side) + a * score >= floor
            row, query = np.nonzero(reached)
            query += block.start
            for lo in range(0, len(row), PAIR_BLOCK):
                r, q = row[lo : lo + PAIR_BLOCK], query[lo : lo + PAIR_BLOCK]
                exact = (x[r] * self.queries[q]).sum(axis=1) / (long[r] * self.lengths[q])
                near = (ids[r] != self.ids[q]) & (exact >= self.best.score[q, -1])
                if near.any():
                    self.best.add(q[near], exact[near], ids[r[near]])


def _search_block(index: DataFrame, shared, k: int) -> DataFrame:
    kind = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = BlockSearch(*shared.value, k)
        if not len(block.ids):
            return
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            x = matrix(rows.column("_v"))
            if x.shape[1] == block.queries.shape[1]:
                codes = np.frombuffer(b"".join(rows.column("_codes").to_pylist()), np.uint8).reshape(len(x), -1)
                block.add(rows.column("vec_id").to_numpy(), x, codes, *(rows.column(c).to_numpy() for c in ("_norm", "_own", "_error")))

        for batch in batches:
            for lo in range(0, batch.num_rows, CODE_BLOCK):
                held.append(batch.slice(lo, CODE_BLOCK))
                if sum(b.num_rows for b in held) >= CODE_BLOCK:
                    flush()
        if held:
            flush()
        hits = [[{"vec_id": v, "score": s} for s, v in zip(*both) if s > -np.inf] for both in zip(block.best.score.tolist(), block.best.id.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(hits, kind)], ["query_id", "_hits"])

    return index.select("vec_id", "_v", "_codes", "_norm", "_own", "_error").mapInArrow(run, "query_id long, _hits array<struct<vec_id: long, score: double>>")
