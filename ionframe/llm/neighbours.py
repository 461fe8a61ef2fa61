"""Approximate nearest neighbours by cosine: inverted lists and an adaptive dimension scan.

Index: unit vectors are dealt to lists by their nearest centroid (k-means on at most
``sample`` vectors, those of least hash of vec_id; every row is indexed).  A list is split
into blocks of about ``block`` rows by a hash, however large it is.

Search: a query goes to all blocks of its ``probes`` nearest lists.  How many that takes is
measured on the sample: the least number by which ``target`` of the sample's true nearest
neighbours (by brute force over the sample, for some hundred of its vectors) are in a list
that is probed.  In a block, vectors and
query are rotated by one random orthogonal matrix, so that any d of the D dimensions are a
random sample, and laid out in blocks of columns.  After each block of columns a candidate
whose partial distance p fails the test ``p * D / d > t * (1 + eps / sqrt(d)) ** 2`` (t: the
k-th best distance among the first 64 rows of the list's block) is abandoned.  Candidates stand in the order of vec_id, so that
among equals the smaller ids come first.  What is left is scored exactly, in double
precision, on the original vectors.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor
do rows without vec_id; vectors meet only those of their own dimension.  Rows of one vec_id
are all candidates, but not of the query with that id.  Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import need, written

COLUMNS = 16
FOUND = "query_id long, vec_id long, score double"


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, d)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # else squares of very small or large numbers vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Lists:
    """Centroids and the rotation."""

    def __init__(self, sample: np.ndarray, n_lists: int, seed: int = 11, rounds: int = 8):
        rng = np.random.default_rng(seed)
        x = _unit(sample)
        d = x.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        distinct = np.unique(x, axis=0)
        c = distinct[rng.permutation(len(distinct))[:n_lists]]
        for _ in range(rounds):
            own = self.nearest(x, c)
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            norm = np.sqrt((sums * sums).sum(1, keepdims=True))
            c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
        self.centroids = c

    def probes(self, sample: np.ndarray, k: int, target: float, queries: int = 300, seed: int = 12) -> int:
        x = np.unique(_unit(sample), axis=0)
        if len(x) <= k:
            return len(self.centroids)
        at = np.random.default_rng(seed).permutation(len(x))[:queries]
        near = x[at] @ x.T
        near[np.arange(len(at)), at] = -2
        best = np.argpartition(-near, k, axis=1)[:, :k]
        rank = np.argsort(np.argsort(-(x[at] @ self.centroids.T), axis=1), axis=1)
        own = self.nearest(x, self.centroids)
        return int(np.quantile(np.take_along_axis(rank, own[best], 1), target)) + 1

    @staticmethod
    def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.concatenate([np.argmax(x[i : i + 4096] @ c.T, 1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def adaptive_scan(query: np.ndarray, blocks: list[np.ndarray], k: int, eps: float, head: int = 64) -> np.ndarray:
    """Rows of the candidates (in blocks of columns of the rotated unit vectors) that may be among the k nearest."""
    n, d = len(blocks[0]), sum(b.shape[1] for b in blocks)
    parts = np.split(query, np.cumsum([b.shape[1] for b in blocks])[:-1])
    m = min(n, head)
    dist = np.zeros(m)
    for b, q in zip(blocks, parts, strict=True):
        y = b[:m] - q
        dist += np.einsum("ij,ij->i", y, y)
    if n == m:
        return np.arange(n)
    bound = np.partition(dist, k - 1)[k - 1] if m >= k else np.inf
    alive, partial, seen = np.arange(m, n), np.zeros(n - m), 0
    for b, q in zip(blocks, parts, strict=True):
        y = b[alive] - q
        partial += np.einsum("ij,ij->i", y, y)
        seen += len(q)
        keep = partial * (d / seen) <= bound * (1 + (eps / np.sqrt(seen) if seen < d else 1e-9)) ** 2 + 1e-12
        alive, partial = alive[keep], partial[keep]
    return np.concatenate([np.arange(m)[dist <= bound + 1e-9], alive])


def _search_one(rows: DataFrame, d: int, every: int, k: int, probes: int | None, target: float, eps: float, sample: int, block: int, most_lists: int) -> DataFrame:
    n = rows.count()
    n_lists = int(min(most_lists, max(1, round(n**0.5 / 2))))
    ids = rows.select("vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    drawn = rows.join(F.broadcast(ids.distinct()), "vec_id").orderBy("vec_id").limit(sample).select("v").toArrow()["v"].combine_chunks()
    drawn = _matrix(drawn, d)
    lists = Lists(drawn, n_lists)
    probes = probes or lists.probes(drawn, k, target)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = lists.nearest(_unit(_matrix(batch.column("v"), d)), lists.centroids)
            yield pa.record_batch([pa.array(own.astype(np.int32)), batch.column("vec_id"), batch.column("v")], ["list", "vec_id", "v"])

    index = written(rows.mapInArrow(assign, "list int, vec_id long, v array<double>"), "neighbours")
    blocks = {r[0]: -(-r[1] // block) for r in index.groupBy("list").count().collect()}  # as many as lists at most

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argsort(-(_unit(_matrix(batch.column("v"), d)) @ lists.centroids.T), axis=1, kind="stable")[:, :probes]
            out = [(i, int(c), b) for i, row in enumerate(near) for c in row for b in range(blocks.get(int(c), 0))]
            at = pa.array([o[0] for o in out], pa.int64())
            yield pa.record_batch([pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()), batch.column("vec_id").take(at), batch.column("v").take(at)], ["list", "block", "query_id", "q"])

    n_blocks = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]) if blocks else F.create_map(F.lit(0), F.lit(1))
    dealt = index.withColumn("block", F.pmod(F.xxhash64("vec_id"), n_blocks[F.col("list")]).cast("int"))
    queries = index.where(F.col("vec_id") % every == 0).select("vec_id", "v").mapInArrow(ask, "list int, block int, query_id long, q array<double>")

    def scan(key: tuple, own: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if own.num_rows and asked.num_rows:
            own = own.sort_by("vec_id")
            ids, x = np.asarray(own["vec_id"]), _matrix(own["v"].combine_chunks(), d)
            turned = _unit(x) @ lists.rotation
            columns = [np.ascontiguousarray(turned[:, i : i + COLUMNS]) for i in range(0, d, COLUMNS)]
            size = np.abs(x).max(1)
            norm = np.sqrt(((x / size[:, None]) ** 2).sum(1))
            for q_id, q in zip(np.asarray(asked["query_id"]).tolist(), _matrix(asked["q"].combine_chunks(), d), strict=True):
                top = np.abs(q).max()
                q = q / top
                got = adaptive_scan((q / np.sqrt(q @ q)) @ lists.rotation, columns, k + 1, eps)
                got = got[ids[got] != q_id]
                score = ((x[got] / size[got, None]) * q).sum(1) / (norm[got] * np.sqrt((q * q).sum()))
                best = np.lexsort((ids[got], -score))[:k]
                found.append((np.full(len(best), q_id), ids[got][best], score[best]))
        join = lambda i, t: np.concatenate([f[i] for f in found]).astype(t) if found else np.empty(0, t)
        return pa.table({"query_id": join(0, np.int64), "vec_id": join(1, np.int64), "score": join(2, np.float64)})

    return dealt.groupBy("list", "block").cogroup(queries.groupBy("list", "block")).applyInArrow(scan, FOUND)


def search(vectors: DataFrame, every: int = 50, k: int = 5, probes: int | None = None, target: float = 0.97, eps: float = 3.0, sample: int = 20_000, block: int = 4096, most_lists: int = 4096) -> DataFrame:
    """The k nearest of each query (rows whose vec_id is divisible by ``every``): query_id, rank, vec_id, score."""
    rows = need(vectors, ["vec_id", "embedding"]).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    inf = float("inf")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)
    found = None
    for (d,) in rows.select(F.size("v")).distinct().collect():
        one = _search_one(rows.where(F.size("v") == d), d, every, k, probes, target, eps, sample, block, most_lists)
        found = one if found is None else found.unionAll(one)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
