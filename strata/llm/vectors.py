"""Exact top-k search by inner product with a vector-approximation file.

Vectors become integers, floor(scale * x). The file holds, for blocks of them, each component's cell among sixteen
equal ones between the block's least and greatest value, and the exact integers. A scan derives an upper bound of every
score from the cells alone, then reads exact vectors in the order of their bounds until the k-th score found is above
all bounds left, so results are exact. Queries are taken in blocks of at most ``QUERY_BLOCK``; a block is what is
broadcast, however many queries there are. Each pass reads the file once, and a task keeps k results a query.

Rows whose id or vector is null, or whose vector is empty or holds null or non-finite components, take no part, neither
do vectors of another length than the query's. A finite component of 2**61 or more when scaled is an error, as is a score
that is no 64-bit integer: neither is dropped. A row that shares the query's id is its own, too. Repeated query rows are answered each. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

CELLS = 16
FILE_BLOCK, QUERY_BLOCK = 2048, 4096

_FILE = "size int, ids binary, low binary, step binary, cells binary, exact binary"


def quantise(exact: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each component's lowest value and cell width, and every vector's cells."""
    low, high = exact.min(axis=0), exact.max(axis=0)
    step = np.maximum(1, -(-(high - low + 1) // cells))
    return low, step, ((exact - low) // step).astype(np.uint8)


def upper_bounds(queries: np.ndarray, low: np.ndarray, step: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """No inner product of a query with any vector in its cells is above these, (queries, vectors)."""
    lowest = (low + cells.astype(np.int64) * step).astype(np.float64)
    highest = lowest + (step - 1)
    up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    bound = up @ highest.T + down @ lowest.T
    if _greatest(queries, max(np.abs(highest).max(initial=0), np.abs(lowest).max(initial=0))) >= 2**52:  # sums of doubles are rounded
        bound += 1e-12 * (up @ np.abs(highest).T - down @ np.abs(lowest).T)
    return bound


def _greatest(vectors: np.ndarray, other: float) -> float:
    """No inner product of these vectors with one whose components are at most ``other`` is above this."""
    return float(np.abs(vectors.astype(np.float64)).sum(axis=-1).max(initial=0)) * float(other)


def products(exact: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Exact inner products; an error where one is no 64-bit integer, instead of a wrong score."""
    if _greatest(vector[None, :], np.abs(exact.astype(np.float64)).max(initial=0)) < 2**62:
        return exact @ vector
    found = exact.astype(object) @ vector.astype(object)
    if any(not -(2**63) <= x < 2**63 for x in found):
        raise OverflowError("an inner product is no 64-bit integer")
    return found.astype(np.int64)


def _nibbles(cells: np.ndarray) -> bytes:
    flat = cells.reshape(-1)
    if len(flat) % 2:
        flat = np.append(flat, 0).astype(np.uint8)
    return (flat[::2] | (flat[1::2] << 4)).tobytes()


def _cells(packed: bytes, n: int, size: int) -> np.ndarray:
    flat = np.frombuffer(packed, np.uint8)
    return np.stack([flat & 15, flat >> 4], axis=1).reshape(-1)[: n * size].reshape(n, size)


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch["v"]
        sizes = np.diff(np.asarray(column.offsets))
        ids, flat = batch["id"].to_numpy(), np.asarray(column.flatten())
        ends = np.cumsum(sizes)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            for k in range(0, len(at), FILE_BLOCK):
                own = at[k : k + FILE_BLOCK]
                exact = flat[(ends[own] - size)[:, None] + np.arange(size)]
                low, step, cells = quantise(exact)
                row = {"size": int(size), "ids": ids[own].astype("<i8").tobytes(), "low": low.astype("<i8").tobytes(), "step": step.astype("<i8").tobytes(), "cells": _nibbles(cells), "exact": exact.astype("<i8").tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("size", pa.int32()), *((c, pa.binary()) for c in ("ids", "low", "step", "cells", "exact"))]))


def integers(df: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """(id, v) of the rows that take part."""
    x = F.col(f"`{vector}`")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    rows = df.where(F.col(f"`{id_column}`").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.coalesce(fine, F.lit(False)))
    scaled = lambda e: F.lit(float(scale)) * e.cast("double")
    whole = lambda e: F.when(F.abs(scaled(e)) < float(2**61), F.floor(scaled(e)).cast("long")).otherwise(F.raise_error(F.lit("a scaled component is no integer of 61 bits")).cast("long"))
    return rows.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.transform(x, whole).alias("v"))


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
        self.least = np.full(n, -np.inf)

    def offer(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[query], scores]), np.concatenate([self.ids[query], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[query], self.ids[query] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[query] = scores[order[-1]]


def _searched(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, vectors = queries.value
        lengths = np.array([len(v) for v in vectors])
        best = _Best(len(vectors), k)
        for batch in batches:
            for row in batch.to_pylist():
                size, ids = row["size"], np.frombuffer(row["ids"], "<i8")
                at = np.flatnonzero(lengths == size)
                exact = np.frombuffer(row["exact"], "<i8").reshape(len(ids), size)
                if not len(at):
                    continue
                wanted = np.stack([vectors[i] for i in at])
                bounds = upper_bounds(wanted, np.frombuffer(row["low"], "<i8"), np.frombuffer(row["step"], "<i8"), _cells(row["cells"], len(ids), size))
                bounds[ids[None, :] == own_ids[at][:, None]] = -np.inf
                for query, vector, bound in zip(at, wanted, bounds, strict=True):
                    left = np.flatnonzero((bound >= best.least[query]) & (bound > -np.inf))
                    left = left[np.argsort(-bound[left], kind="stable")]
                    while len(left):  # in the order of the bounds; stops once the k-th score is certain
                        some, left = left[: 4 * k], left[4 * k :]
                        best.offer(query, products(exact[some], vector), ids[some])
                        left = left[bound[left] >= best.least[query]]
        n = [len(x) for x in best.ids]
        columns = [np.repeat(np.arange(len(n)), n), np.repeat(own_ids, n), *(np.concatenate([*x, np.zeros(0, np.int64)]) for x in (best.ids, best.scores))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["place", "query_id", "vec_id", "score"])

    return run


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", scale: int = 256, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` greatest inner products with other rows, ties to the smaller id."""
    spark = df.sparkSession
    rows = integers(df, id_column, vector, scale)
    found = common.materialize(common.arrow_map(rows, _filed, _FILE), "cells")
    asked = common.materialize(integers(df.where(is_query), id_column, vector, scale), "queries")
    blocks = max(1, -(-asked.count() // query_block))
    order = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
    path = common.new_path(spark, "top")
    for block in range(blocks):  # a block's queries are gone from driver and executors before the next come
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toPandas().sort_values("id")
        queries = spark.sparkContext.broadcast((own["id"].to_numpy(np.int64), [np.asarray(v, np.int64) for v in own["v"]]))
        part = common.arrow_map(found, _searched(queries, k), "place long, query_id long, vec_id long, score long")
        best = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        best.write.mode("append").parquet(path)
        queries.destroy()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)
