"""Approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one full-dimensional codeword from each of ``LEVELS`` codebooks. Codebooks
start from k-means on residuals, level by level, and are refitted by sweeps of least squares; codes come from a
beam search over the codebooks. The index holds codes, the norms of the vector and of the coded vector, and the
original vector. A query scores codes by table lookup (one inner product per codeword), corrected by the ratio of the
stored norms, takes the best ``rerank`` distinct vectors of every block of rows, and scores those exactly in double
precision. A block is what a task has read, up to ``ROW_BLOCK_BYTES`` of vectors, however Arrow batches are cut.

Codebooks are fitted on a bounded sample (about ``SAMPLE`` vectors, chosen by a hash of the id); every vector is
indexed. Queries go out in blocks of at most ``QUERY_BLOCK_BYTES``, each against all rows, and every task
returns at most k rows a query, so nothing that is broadcast or gathered grows without a bound.

Equal vectors: within a block each distinct vector is scored once and stands for its k + 1 smallest ids; more
can't be needed, so a very common vector neither hides others nor breaks ties wrongly.

Defined cases: vectors that are null, all zero or hold null or non-finite components take no part; vectors of different
lengths are searched apart, each among those of its own length; rows that repeat an id and vector count once; of rows
that share an id but not the vector, each asks as a query, and an id is found once, with its best score; ties go to the
smaller id; fewer candidates than k give fewer rows; an empty table gives none. Only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, small_batches

LEVELS, CODEWORDS, BEAM = 24, 256, 4
SAMPLE, ROUNDS, REFITS = 16_384, 6, 1
QUERY_BLOCK_BYTES = 16 << 20
ROW_BLOCK_BYTES = 32 << 20
#: Vectors of a block that are scored exactly for each query, and queries that are scored at once.
RERANK, ASKED = 256, 128
INDEX_SCHEMA = "vec_id long, vector array<double>, codes binary, norm float, coded_norm float"


class Quantiser:
    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)  # levels x codewords x dimensions
        self.norms = (self.books**2).sum(axis=2)

    @staticmethod
    def fit(sample: np.ndarray, levels: int = LEVELS, codewords: int = CODEWORDS, seed: int = 7) -> Quantiser:
        rng, x = np.random.default_rng(seed), sample.astype(np.float32)
        size = min(codewords, len(x))
        books, rest = [], x.copy()
        for _ in range(levels):
            centres = rest[rng.choice(len(rest), size, replace=False)].copy()
            for _ in range(ROUNDS):
                near = _nearest(rest, centres)
                n = np.bincount(near, minlength=size)
                sums = np.zeros((size, x.shape[1]), dtype=np.float64)
                order = np.argsort(near, kind="stable")
                some = np.flatnonzero(n)
                sums[some] = np.add.reduceat(rest[order].astype(np.float64), (np.cumsum(n) - n)[some], axis=0)
                centres[some] = (sums[some] / n[some, None]).astype(np.float32)
                empty = np.flatnonzero(n == 0)
                centres[empty] = rest[rng.choice(len(rest), len(empty))]
            books.append(centres)
            rest = rest - centres[_nearest(rest, centres)]
        fitted = Quantiser(np.stack(books))
        for _ in range(REFITS):
            fitted = fitted._refit(x, fitted.encode(x))
        return fitted

    def _refit(self, x: np.ndarray, codes: np.ndarray, sweeps: int = 3, ridge: float = 1.0) -> Quantiser:
        """Codebooks of less squared error for given codes, with a small ridge: least squares of one codebook at a time, in sweeps, so memory stays that of the sample."""
        old, books = self.books, self.books.copy()
        rest = x - self.decode(codes)
        for _ in range(sweeps):
            for m in range(len(books)):
                word = codes[:, m].astype(np.int64)
                rest += books[m][word]
                n = np.bincount(word, minlength=books.shape[1])
                order, some = np.argsort(word, kind="stable"), np.flatnonzero(n)
                books[m] = old[m]
                sums = np.add.reduceat(rest[order], (np.cumsum(n) - n)[some], axis=0, dtype=np.float64)
                books[m][some] = (sums + ridge * old[m][some]) / (n[some, None] + ridge)
                rest -= books[m][word]
        return Quantiser(books)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (rows x levels, uint8) by beam search: each level keeps the ``beam`` best partial sums."""
        levels, size, d = self.books.shape
        out = np.zeros((len(x), levels), dtype=np.uint8)
        for first in range(0, len(x), 2048):
            part = x[first : first + 2048].astype(np.float32)
            rows = np.arange(len(part))[:, None]
            rest = part[:, None, :]
            codes = np.zeros((len(part), 1, 0), dtype=np.uint8)
            for m in range(levels):
                width = rest.shape[1]
                cost = self.norms[m] - 2 * (rest.reshape(-1, d) @ self.books[m].T)
                cost = cost.reshape(len(part), width, size) + (rest**2).sum(axis=2)[:, :, None]
                cost = cost.reshape(len(part), -1)
                keep = min(beam if m < levels - 1 else 1, cost.shape[1])
                best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
                parent, word = best // size, best % size
                rest = rest[rows, parent] - self.books[m][word]
                codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
            out[first : first + len(part)] = codes[:, 0]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m][codes[:, m]] for m in range(len(self.books)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of queries with all codewords: levels x codewords x queries."""
        return self.books @ np.ascontiguousarray(queries.astype(np.float32).T)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norms = (centres**2).sum(axis=1)
    return np.concatenate([np.argmin(norms - 2 * (x[k : k + 4096] @ centres.T), axis=1) for k in range(0, len(x), 4096)])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    v = F.col("vector")
    df = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(F.forall(v, finite) & F.exists(v, lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def fit(rows: DataFrame, count: int, sample: int = SAMPLE) -> Quantiser:
    """Codebooks from about ``sample`` of ``count`` vectors, by a hash of id; the cut is made in the cluster."""
    share = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 30)) * F.lit(float(count)) < F.lit(float(sample) * (1 << 30))
    got = rows.where(share).select("vector").limit(2 * sample).collect() or rows.select("vector").limit(sample).collect()
    return Quantiser.fit(np.array([r[0] for r in got]))


def build_index(rows: DataFrame, quantiser: Quantiser) -> DataFrame:
    """All rows with codes and the norms of the vectors and of the coded ones, as INDEX_SCHEMA."""
    shared = rows.sparkSession.sparkContext.broadcast(quantiser)  # levels x codewords x dimensions floats

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                codes = shared.value.encode(x)
                norms = [np.linalg.norm(v, axis=1).astype(np.float32) for v in (x, shared.value.decode(codes))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), *map(pa.array, norms)], names=["vec_id", "vector", "codes", "norm", "coded_norm"])

    return rows.mapInArrow(coded, INDEX_SCHEMA)


def _distinct(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, members): the first row of each distinct vector, and the up to k + 1 smallest ids of each (-1: none)."""
    order = np.argsort(ids, kind="stable")
    bits = np.ascontiguousarray(x[order] + 0.0)  # -0.0 becomes 0.0
    _, first, group = np.unique(bits.view(np.dtype((np.void, bits.itemsize * bits.shape[1]))).ravel(), return_index=True, return_inverse=True)
    by = np.lexsort((ids[order], group))
    g, i = group[by], ids[order][by]
    fresh = np.concatenate(([True], (g[1:] != g[:-1]) | (i[1:] != i[:-1])))
    g, i = g[fresh], i[fresh]
    place = np.arange(len(g)) - np.searchsorted(g, g)
    members = np.full((len(first), min(k + 1, int(place.max()) + 1)), -1, dtype=np.int64)
    near = place <= k
    members[g[near], place[near]] = i[near]
    return order[first], members


class _Best:
    """The k best distinct (score, id) of each query so far; a row that several batches repeat takes one place."""

    def __init__(self, own: np.ndarray, k: int):
        self.own, self.k = own, k
        self.scores, self.ids = np.full((len(own), k), -np.inf), np.full((len(own), k), np.iinfo(np.int64).max)

    def add(self, at: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.where((ids < 0) | (ids == self.own[at, None]), -np.inf, scores)
        ids = np.where(np.isneginf(scores), np.iinfo(np.int64).max, ids)
        scores, ids = np.concatenate([self.scores[at], scores], axis=1), np.concatenate([self.ids[at], ids], axis=1)
        order = np.lexsort((ids, -scores), axis=1)
        scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
        fresh = ~np.isneginf(scores)
        fresh[:, 1:] &= (scores[:, 1:] != scores[:, :-1]) | (ids[:, 1:] != ids[:, :-1])
        place = np.cumsum(fresh, axis=1) - 1
        row, column = np.nonzero(fresh & (place < self.k))
        best = np.full((len(scores), self.k), -np.inf), np.full((len(scores), self.k), np.iinfo(np.int64).max)
        for into, values in zip(best, (scores, ids), strict=True):
            into[row, place[row, column]] = values[row, column]
        self.scores[at], self.ids[at] = best


def search(index: DataFrame, quantiser: Quantiser, queries: DataFrame, k: int = 20, rerank: int = RERANK) -> DataFrame:
    """(query_id, vec_id, score): each query's k nearest by inner product, its own id left out."""
    spark, d = index.sparkSession, quantiser.books.shape[2]
    queries = queries.dropDuplicates(["vec_id", "vector"])
    spread = max(1, -(-queries.count() * d * 8 // QUERY_BLOCK_BYTES))
    parts = []
    for b in range(spread):
        block = queries if spread == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(spread)) == b)
        got = block.collect()
        if not got:
            continue
        shared = spark.sparkContext.broadcast((quantiser, np.array([r[0] for r in got]), np.array([r[1] for r in got])))

        def scored(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            quantiser, own, asked = shared.value
            best = _Best(own, k)

            def score(held: list[pa.RecordBatch]) -> None:
                part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                x, ids = _matrix(part.column(1)), part.column(0).to_numpy()
                rows, members = _distinct(ids, x, k)
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.uint8).reshape(len(ids), -1)[rows]
                norm, coded = (part.column(c).to_numpy()[rows] for c in (3, 4))
                x, ratio = x[rows], (norm / np.where(coded > 0, coded, 1))[:, None]
                for at in (slice(q, q + ASKED) for q in range(0, len(own), ASKED)):
                    tables = quantiser.tables(asked[at])
                    rough = tables[0][codes[:, 0]]
                    for m in range(1, len(tables)):
                        rough += tables[m][codes[:, m]]
                    rough = np.ascontiguousarray((rough * -ratio).T)
                    n = min(rerank, len(rows))
                    near = np.argpartition(rough, n - 1, axis=1)[:, :n]
                    exact = np.einsum("qd,qnd->qn", asked[at], x[near])
                    found = members[near]
                    best.add(at, np.repeat(exact[:, :, None], found.shape[2], axis=2).reshape(len(exact), -1), found.reshape(len(exact), -1))

            held, size = [], 0
            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    size += batch.num_rows * d * 8
                if size >= ROW_BLOCK_BYTES:
                    score(held)
                    held, size = [], 0
            if held:
                score(held)
            some = ~np.isneginf(best.scores)
            rows = np.nonzero(some)[0]
            yield pa.RecordBatch.from_arrays([pa.array(own[rows], pa.int64()), pa.array(best.ids[some], pa.int64()), pa.array(best.scores[some], pa.float64())], names=["query_id", "vec_id", "score"])

        parts.append(index.mapInArrow(scored, "query_id long, vec_id long, score double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, vec_id long, score double")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ranked(found: DataFrame, k: int = 20) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest of all vectors for each vector that satisfies ``is_query`` (a condition on vec_id)."""
    small_batches(vectors.sparkSession)
    rows, found = usable(vectors, id_col, vector_col), vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for d, n in rows.groupBy(F.size("vector")).count().orderBy(F.desc("count")).collect():
        same = rows.where(F.size("vector") == d)
        quantiser = fit(same, n)
        index = materialize(build_index(same, quantiser), "vector-index")
        found = found.unionByName(search(index, quantiser, index.where(is_query).select("vec_id", "vector"), k))
    return ranked(found, k)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
