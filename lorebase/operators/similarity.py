"""Exact nearest neighbours of stated queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.operators.gates import top_of_each

#: Queries that are sent to the tasks at once, and vectors compared with them at once.
QUERY_BLOCK, VECTOR_BLOCK = 4_096, 1_024


def _least(at: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of each query with the least (distance, id)."""
    order = np.lexsort((ids, d, at))
    at, ids, d = at[order], ids[order], d[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], ids[keep], d[keep]


def _block(ids: np.ndarray, q: np.ndarray, own: np.ndarray, v: np.ndarray, k: int, prior_only: bool, with_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, distance) of at least the k nearest of a block of vectors.

    A matrix product gives all distances but for rounding; those that rounding leaves in doubt
    are kept, and distances of what is kept are summed up exactly."""
    sizes, mine = (q**2).sum(axis=1), (v**2).sum(axis=1)
    rough = sizes[:, None] + mine[None, :] - 2 * (q @ v.T)
    doubt = 1e-9 * (sizes[:, None] + mine[None, :]) + 1e-12
    if prior_only:
        rough[own[None, :] >= ids[:, None] + (1 if with_self else 0)] = np.inf
    elif not with_self:
        rough[own[None, :] == ids[:, None]] = np.inf
    least = np.partition(rough, min(k, len(own)) - 1, axis=1)[:, min(k, len(own)) - 1]
    i, j = np.nonzero((rough <= least[:, None] + 2 * doubt) & np.isfinite(rough))
    d = np.zeros(len(i))
    for c in range(q.shape[1]):
        d += (q[i, c] - v[j, c]) ** 2
    return _least(i, own[j], d, k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, prior_only: bool = False, with_self: bool = False, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, <key>, distance, rank): the k nearest vectors of each query by squared L2.

    Queries are a stated set: they are taken in blocks of QUERY_BLOCK, each broadcast, and every
    task keeps k rows a query of what it holds; only those meet in the final ranking. prior_only
    compares a query with smaller keys only, as a collection that grows row by row does; its own
    row counts only with_self.

    Null vectors and keys are left out, vectors of another length than the query too. Ties go to
    the smaller key. Fewer than k vectors give fewer rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    asked = queries.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    parts: list[DataFrame] = []
    block: list[tuple[int, list[float]]] = []

    def send(block: list[tuple[int, list[float]]]) -> None:
        shared = spark.sparkContext.broadcast((np.array([b[0] for b in block]), np.array([b[1] for b in block], dtype=np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for b in batches:
                lists = b.column(1)
                fit = pa.compute.equal(pa.compute.list_value_length(lists), q.shape[1])
                own_all = b.column(0).filter(fit).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = lists.filter(fit).flatten().to_numpy(zero_copy_only=False).reshape(-1, q.shape[1])
                for a in range(0, len(own_all), VECTOR_BLOCK):
                    found = _block(ids, q, own_all[a : a + VECTOR_BLOCK], flat[a : a + VECTOR_BLOCK], k, prior_only, with_self)
                    held = _least(*(np.concatenate(x) for x in zip(held, found, strict=True)), k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2])], names=["query_id", "id", "distance"])

        parts.append(rows.mapInArrow(run, "query_id bigint, id bigint, distance double"))

    for r in asked.toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == QUERY_BLOCK:
            send(block)
            block = []
    if block or not parts:
        if not block:
            return rows.select(F.col("id").alias("query_id"), F.col("id").alias(key), F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
        send(block)
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    best = top_of_each(all_, ["query_id"], [F.col("distance"), F.col("id")], k)
    return best.select("query_id", F.col("id").alias(key), "distance", "rank")
