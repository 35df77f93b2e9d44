"""Exact top-k inner-product search by columnar branch and bound.

Candidates are held in vertical layout, a row a dimension. Scores of a block of queries are
accumulated ``STEP`` dimensions at a time; after each step a pair can still gain at most the
product of the two vectors' remaining norms, and a pair whose bound is below its query's k-th
best score so far is dropped. While most pairs survive a step is one matrix product over the
candidates that some query still needs; once few do, the survivors are compacted to a list of
pairs. Dimensions are visited in the order of the queries' energy, so bounds tighten early.

The queries are taken in blocks of about ``QUERY_BLOCK`` rows or ``QUERY_BYTES`` bytes at most, hashed by
id, so what is collected and broadcast is bounded whatever the dimension; every task streams its
candidates past the block and emits k rows a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import scratch, written

QUERY_BLOCK, QUERY_BYTES = 32_768, 64_000_000
#: Queries and candidates multiplied at once.
TILE, BATCH = 256, 4096
STEP = 16
#: Below this share of surviving pairs they are compacted to a list.
SPARSE = 0.1


class Best:
    """The k best (score, id) of each of a tile's n queries; ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query, self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.floor = np.full(n, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, s, i = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        begin = np.searchsorted(q, q)
        keep = np.arange(len(q)) - begin < self.k
        self.query, self.score, self.id = q[keep], s[keep], i[keep]
        full = np.bincount(self.query, minlength=len(self.floor)) >= self.k
        least = np.full(len(self.floor), np.inf)
        np.minimum.at(least, self.query, self.score)
        self.floor = np.where(full, least, -np.inf)


def number_type(queries: np.ndarray, candidates: np.ndarray) -> type:
    """The fastest type in which all partial sums are exact."""
    most = queries.shape[1] * float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0))
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def scan(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, best: Best) -> None:
    """Offer candidates ``c`` (n x d integers) to queries ``q`` (m x d), those of ``best``."""
    kind = number_type(q, c)
    dims = q.shape[1]
    order = np.argsort(-(q.astype(np.float64) ** 2).sum(0), kind="stable")
    q, tall = q[:, order].astype(kind), np.ascontiguousarray(c[:, order].T.astype(kind))

    def rest(x: np.ndarray) -> np.ndarray:
        """Norms of what follows each dimension, (d + 1) x n."""
        squares = np.concatenate([x.astype(np.float64) ** 2, np.zeros((1, x.shape[1]))])
        return np.sqrt(squares[::-1].cumsum(0)[::-1])

    q_rest, c_rest = rest(q.T), rest(tall)
    floor = best.floor
    columns = np.arange(tall.shape[1])
    acc = np.zeros((len(q), len(columns)), kind)
    pairs = None
    for at in range(0, dims, STEP):
        end = min(at + STEP, dims)
        if pairs is None:
            acc += q[:, at:end] @ tall[at:end, columns]
            alive = acc + q_rest[end][:, None] * c_rest[end][columns] * (1 + 1e-9) + 1e-6 >= floor[:, None]
            if end < dims and alive.mean() < SPARSE:
                rows, cols = np.nonzero(alive)
                pairs = rows, columns[cols], acc[rows, cols]
            elif end < dims:
                needed = alive.any(0)
                if not needed.all():
                    columns, acc = columns[needed], acc[:, needed]
        else:
            rows, cols, got = pairs
            got = got + np.einsum("ij,ji->i", q[rows, at:end], tall[at:end, cols])
            alive = got + q_rest[end][rows] * c_rest[end][cols] * (1 + 1e-9) + 1e-6 >= floor[rows]
            pairs = rows[alive], cols[alive], got[alive]
    if pairs is None:
        own = q_ids[:, None] == c_ids[columns][None, :]
        if acc.shape[1] > best.k:  # the batch alone may raise the floors
            bare = np.where(own, np.iinfo(np.int64).min if kind is np.int64 else -np.inf, acc)
            floor = np.maximum(floor, np.partition(bare, acc.shape[1] - best.k, axis=1)[:, acc.shape[1] - best.k])
        rows, cols = np.nonzero((acc >= floor[:, None]) & ~own)
        pairs = rows, columns[cols], acc[rows, cols]
    rows, cols, got = pairs
    other = q_ids[rows] != c_ids[cols]
    best.add(rows[other], got[other].astype(np.int64), c_ids[cols[other]])


def whole(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; rows with nulls or non-finite components are left out."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows of each length: their places and a matrix of them."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return {int(d): (at, flat[starts[at][:, None] + np.arange(d)]) for d in np.unique(lengths) for at in [np.flatnonzero(lengths == d)]}


def _partial(queries: pa.Table, candidates: DataFrame, k: int) -> tuple[DataFrame, Broadcast]:
    """(query_id, vec_id, score): the k best of each partition of ``candidates`` for each query of a block."""
    by_length = {}
    if queries.num_rows:
        ids, vectors = (queries.column(i).combine_chunks() for i in (0, 1))
        for d, (places, v) in _matrix(vectors).items():
            own = ids.to_numpy()[places]
            order = np.lexsort((*v.T[::-1], own))
            by_length[d] = own[order], v[order]
    shared = candidates.sparkSession.sparkContext.broadcast(by_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = {d: [(ids[i : i + TILE], q[i : i + TILE]) for i in range(0, len(q), TILE)] for d, (ids, q) in shared.value.items()}
        best = {d: [Best(len(ids), k) for ids, _ in own] for d, own in tiles.items()}
        for b in batches:
            ids = b.column(0).to_numpy()
            for d, (places, c) in _matrix(b.column(1)).items():
                for i in range(0, len(places), BATCH):
                    part = slice(i, i + BATCH)
                    for (q_ids, q), found in zip(tiles.get(d, ()), best.get(d, ()), strict=True):
                        scan(q, q_ids, c[part], ids[places[part]], found)
        for d, own in best.items():
            for (q_ids, _), found in zip(tiles[d], own, strict=True):
                yield pa.record_batch([pa.array(q_ids[found.query]), pa.array(found.id), pa.array(found.score)], names=["query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, "query_id long, vec_id long, score long"), shared


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores among the vectors with another id.

    Both tables have vec_id and v (array of longs), as ``whole`` makes them. Ties go to the smaller
    id; fewer candidates than k give all. Repeated rows (same id, same vector) count once in either
    table, before any cut; rows of one id with different vectors count each, and a query's are ranked
    together. None is a candidate of its own id. Vectors of different lengths don't meet. Empty tables give no rows. Scores must fit a long.
    """
    spark = vectors.sparkSession
    vectors, queries = (t.select("vec_id", "v").dropDuplicates() for t in (vectors, queries))
    counted = queries.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("x")).first()
    blocks = max(1, math.ceil(counted["n"] / QUERY_BLOCK), math.ceil(8 * (counted["x"] or 0) / QUERY_BYTES))
    block_of = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    path, out = scratch(spark), None
    if blocks > 1:
        vectors, queries = written(vectors), written(queries)
    for i in range(blocks):
        partial, shared = _partial(queries.where(block_of == i).select("vec_id", "v").toArrow(), vectors, k)
        out = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            out.write.mode("append").parquet(path)
            shared.destroy()
    return out if blocks == 1 else spark.read.parquet(path)
