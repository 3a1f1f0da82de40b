"""Approximate nearest neighbours by inner product: an inverted file with product-quantised residuals.

Coarse centroids and residual codebooks are fitted on a bounded sample (`sample` vectors, first by a hash of the id); every
vector is indexed: its nearest centroid's list, one code for each part of the residual, and how far the codes are from the
vector. A query probes the lists whose centroids have the largest inner products with it, as many as hold the share `recall` of
the nearest of PROBE_QUERIES of the queries, which one pass over all vectors finds: so the share is that of these queries and
vectors, however they lie. In a list, an asymmetric distance table (the query against every code word) estimates the products;
no estimate is wrong by more than the length of the query times the distance of the codes. What by that bound can be among the
best `rerank` of its block is scored exactly, so within the probed lists none is missed. Queries whose lists hold too few
vectors probe all lists.

A list is dealt to blocks of bounded size, and so are a list's queries, so that a list with a third of all vectors is shared
by many tasks; each block returns its best for each query.

Everything is in double precision, so a score is the inner product of the vectors as they are.

Defined results: vectors that are null, zero, hold null or non-finite components or are not of length `dim` (the commonest, where
it is not given) take no part, neither as query nor as candidate; equal scores go to the smaller id; repeated ids are candidates each, but none of a
query's own id; with no vectors the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pieces, stored

#: Vectors, and queries, of one block of a list.
BLOCK = 4096
#: Queries that are asked of all vectors to find out how many lists to probe.
PROBE_QUERIES = 256
CODE_WORDS = 256


def usable(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = nearest(x, centroids)
        sums, n = np.zeros_like(centroids), np.bincount(at, minlength=len(centroids))
        np.add.at(sums, at, x)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(centroids))])
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 8192] @ centroids.T - half, axis=1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Codebook:
    """centroids: lists x dimension; words: part x code word x dimension of the part."""

    centroids: np.ndarray
    words: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, lists: int, parts: int) -> Codebook:
        centroids = kmeans(x, lists, 12, 1)
        residuals = (x - centroids[nearest(x, centroids)]).reshape(len(x), parts, -1)
        k = min(CODE_WORDS, len(x))
        return Codebook(centroids, np.stack([kmeans(residuals[:, p], k, 8, p) for p in range(parts)]))

    def probes(self, queries: np.ndarray, row: np.ndarray, at: np.ndarray, target: float) -> int:
        """How many lists queries have to probe so that they hold that share of the nearest: at is the list of each, row its query."""
        if not len(row):
            return 1
        place = np.argsort(np.argsort(-(queries @ self.centroids.T), axis=1), axis=1)
        return int(np.quantile(place[row, at], target, method="higher")) + 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The list of each vector, its codes, and the distance between what they stand for and the vector."""
        at = nearest(x, self.centroids)
        residuals = (x - self.centroids[at]).reshape(len(x), len(self.words), -1)
        codes = np.stack([nearest(residuals[:, p], w) for p, w in enumerate(self.words)], axis=1).astype(np.uint8)
        left = residuals - np.stack([w[codes[:, p]] for p, w in enumerate(self.words)], axis=1)
        return at, codes, np.linalg.norm(left.reshape(len(x), -1), axis=1)

    def approximate(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of all queries with the vectors of one list, from the table of each query."""
        table = np.einsum("qpd,pwd->qpw", queries.reshape(len(queries), len(self.words), -1), self.words)
        out = np.repeat((queries @ self.centroids[at])[:, None], len(codes), axis=1)
        for p in range(len(self.words)):
            out += table[:, p][:, codes[:, p]]
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _reach(near: np.ndarray, wrong: np.ndarray, k: int) -> np.ndarray:
    """Which columns can be among the k largest of their row, if no value is wrong by more than that."""
    if near.shape[1] <= k:
        return np.ones(near.shape, bool)
    high, low = np.nan_to_num(near + wrong, nan=np.inf), np.nan_to_num(near - wrong, nan=-np.inf)  # what overflows is scored exactly
    return high >= np.partition(low, -k, axis=1)[:, -k][:, None]


def best_of_block(book: Codebook, at: int, queries: pa.Table, vectors: pa.Table, dim: int, k: int, rerank: int) -> pa.Table:
    qid, vid = queries.column("query_id").to_numpy(), vectors.column("vec_id").to_numpy()
    q, x = _matrix(queries.column("q").combine_chunks(), dim), _matrix(vectors.column("v").combine_chunks(), dim)
    codes = np.frombuffer(b"".join(vectors.column("codes").to_pylist()), np.uint8).reshape(len(vid), -1)
    rounding = 1e-15 * (dim + 16)
    size = np.linalg.norm(x, axis=1)
    wrong = vectors.column("wrong").to_numpy() + 4 * rounding * (size + np.linalg.norm(book.centroids[at]))
    out_q, out_v, out_s = [], [], []
    for i in range(0, len(q), 256):
        own, length = qid[i : i + 256, None] == vid[None, :], np.linalg.norm(q[i : i + 256], axis=1)[:, None]
        with np.errstate(over="ignore", invalid="ignore"):
            near = book.approximate(q[i : i + 256], at, codes)
            near[own] = -np.inf
            within = _reach(near, length * wrong, max(k, rerank)) & ~own
            near = np.where(within, q[i : i + 256] @ x.T, -np.inf)
            row, col = np.nonzero(_reach(near, length * (rounding * size), k) & within)
        exact = np.zeros(len(row))
        for d in range(dim):  # in order of the components, in double precision
            exact += q[i + row, d] * x[col, d]
        order = np.lexsort((vid[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        out_q.append(qid[i + row[keep]])
        out_v.append(vid[col[keep]])
        out_s.append(exact[keep])
    return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})


def lists_of_nearest(indexed: DataFrame, qid: np.ndarray, q: np.ndarray, dim: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of q, list) of the k nearest of each query, by brute force: a task keeps its best of its rows only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, vid, at = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int32)
        for b in pieces(batches, 4096):
            ids = b.column(1).to_numpy()
            with np.errstate(over="ignore", invalid="ignore"):
                new = np.nan_to_num(q @ _matrix(b.column(2), dim).T, nan=-np.inf)
            new[qid[:, None] == ids[None, :]] = -np.inf
            score = np.concatenate([score, new], axis=1)
            vid, at = (np.concatenate([old, np.broadcast_to(x, new.shape)], axis=1) for old, x in ((vid, ids), (at, b.column(0).to_numpy())))
            if score.shape[1] > k:
                best = np.argpartition(-score, k - 1, axis=1)[:, :k]
                score, vid, at = (np.take_along_axis(x, best, axis=1) for x in (score, vid, at))
        row, col = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(vid[row, col]), pa.array(score[row, col]), pa.array(at[row, col], pa.int32())], names=["row", "vec_id", "score", "list"])

    found = indexed.select("list", "vec_id", "v").mapInArrow(run, "row int, vec_id long, score double, list int")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k).select("row", "list").toArrow()
    return best.column(0).to_numpy(), best.column(1).to_numpy()


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", dim: int | None = None, sample: int = 16_384, lists: int | None = None, recall: float = 0.96, rerank: int = 96) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of queries, which has the columns of vectors.

    lists: the root of the number of vectors where it is not given, but no more than a quarter of the sample that they are
    fitted on. For tables of billions give more of both: the work of a query falls with lists."""
    spark = vectors.sparkSession
    named = lambda df: df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    every = named(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = (every.where(F.size("v") == dim) if dim else every).groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, total = sizes["dim"], sizes["n"]
    every = every.where(F.size("v") == dim)
    drawn = np.array([r["v"] for r in every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()], np.float64)
    lists = lists or max(1, min(len(drawn) // 4, int(math.sqrt(total))))
    parts = next(p for p in (16, 8, 4, 2, 1) if dim % p == 0)
    book = Codebook.fit(drawn, min(lists, len(drawn)), parts)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 4096):
            at, codes, wrong = book.encode(_matrix(b.column(1), dim))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(wrong)], names=["list", "vec_id", "v", "codes", "wrong"])

    indexed = stored(every.mapInArrow(index, "list int, vec_id long, v array<double>, codes binary, wrong double"), "vectors")
    n_of = indexed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row for each list
    asked = named(queries).where(F.size("v") == dim).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    some = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(PROBE_QUERIES).collect()
    ids, some = np.array([r["query_id"] for r in some], np.int64), np.array([r["q"] for r in some], np.float64).reshape(len(some), dim)
    probes = book.probes(some, *lists_of_nearest(indexed, ids, some, dim, k), recall)

    def found(asked: DataFrame, probes: int) -> DataFrame:
        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, 4096):
                near = _matrix(b.column(1), dim) @ book.centroids.T
                n = min(probes, near.shape[1])
                at = np.argpartition(-near, n - 1, axis=1)[:, :n].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(at), pa.list_(pa.int32()))], names=["query_id", "q", "lists"])

        probed = asked.mapInArrow(probe, "query_id long, q array<double>, lists array<int>").select("query_id", "q", F.explode("lists").alias("list"))
        of_list = probed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("q_blocks")).join(F.broadcast(n_of), "list")
        place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = probed.join(F.broadcast(of_list), "list").withColumn("i", place("query_id", "q_blocks")).withColumn("j", all_of("blocks")).select("list", "i", "j", "query_id", "q")
        right = indexed.join(F.broadcast(of_list), "list").withColumn("j", place("vec_id", "blocks")).withColumn("i", all_of("q_blocks")).select("list", "i", "j", "vec_id", "v", "codes", "wrong")

        def best(cell: tuple, q: pa.Table, x: pa.Table) -> pa.Table:
            if not q.num_rows or not x.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            return best_of_block(book, cell[0].as_py(), q, x, dim, k, rerank)

        cells = left.groupBy("list", "i", "j").cogroup(right.groupBy("list", "i", "j")).applyInArrow(best, "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = stored(found(asked, probes), "found")
    enough = first.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, total - 1)).select("query_id")
    short = stored(asked.join(enough, "query_id", "left_anti"), "short")
    if short.isEmpty():
        return first
    return first.join(short.select("query_id"), "query_id", "left_anti").unionByName(found(short, len(book.centroids)))
