"""Pairs of row blocks: both sides are packed into blocks of bounded size, and blocks meet by an equi join on bucket numbers.

Both sides are dealt out to buckets of some ``PER_BUCKET`` full blocks, counted group by group, and a key is a pair of
buckets: a cell of a grid. A block is copied once for each bucket of the other side, so one key holds a bounded number of
blocks of either side however large a group is, and nothing reaches the driver. A task sorts its cells, holds the asked
blocks of one and streams those that ask. Rows with a null vector, an empty one or
one with null, NaN or infinite components take no part, and only vectors of equal lengths meet. If both sides have a
group ``g``, a block is of one group and meets only blocks of the same one; rows with a null group take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

#: Rows of a block, and full blocks that share a bucket.
BLOCK, PER_BUCKET = 2048, 8
#: Buckets that a smaller side is dealt out to, so that all cores have work.
LEAST_BUCKETS = 6
#: Bytes that a Python worker is handed at a time.
BATCH_BYTES = 16 << 20


class Side(NamedTuple):
    """A block: ids, vectors in double, and further numbers of each row."""

    ids: np.ndarray
    v: np.ndarray
    x: np.ndarray


def complete(df: DataFrame, vector: str = "v") -> DataFrame:
    """The rows whose vector is neither null nor empty and holds finite numbers only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN is above all
    return df.where(F.coalesce((F.size(vector) > 0) & finite, F.lit(False)))


def packed(df: DataFrame, extra: list[str], grouped: bool, block: int) -> DataFrame:
    """(g, size, ids, v, x): blocks of at most ``block`` rows, of one group and vector length each; single precision stays so, as blocks are copied."""
    kind = "<f4" if isinstance(df.schema["v"].dataType.elementType, FloatType) else "<f8"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[pd.DataFrame]] = {}
        rows: dict[tuple, int] = {}

        def close(key: tuple) -> pd.DataFrame:
            own = pd.concat(held.pop(key))
            rows.pop(key)
            v, x = np.stack([np.asarray(a, kind) for a in own["v"]]), own[extra].to_numpy(np.float64)
            return pd.DataFrame({"g": [key[0]], "size": [key[1]], "ids": [own["id"].to_numpy("<i8").tobytes()], "v": [v.tobytes()], "x": [x.tobytes()]})

        for frame in frames:
            for whole, own in frame.groupby(["g", frame["v"].map(len).rename("size")]):
                key = int(whole[0]), int(whole[1])
                while len(own):
                    room = block - rows.get(key, 0)
                    held.setdefault(key, []).append(own.iloc[:room])
                    rows[key] = rows.get(key, 0) + len(own.iloc[:room])
                    own = own.iloc[room:]
                    if rows[key] == block:
                        yield close(key)
            if sum(rows.values()) > 8 * block:  # many small groups
                for key in list(held):
                    yield close(key)
        for key in list(held):
            yield close(key)

    return _taking_part(df, extra, grouped).mapInPandas(run, "g long, size int, ids binary, v binary, x binary")


def _taking_part(df: DataFrame, extra: list[str], grouped: bool) -> DataFrame:
    group = F.col("g").cast("long") if grouped else F.lit(0).cast("long")
    chosen = complete(df).where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), "v", group.alias("g"), *[F.col(c).cast("double").alias(c) for c in extra])
    return chosen.where("g IS NOT NULL")


def _buckets(df: DataFrame, grouped: bool, rows: int, spread: int, name: str) -> DataFrame:
    """(g, size, name): how many buckets of some ``rows`` rows a side's rows of a group and vector length make, and up to ``LEAST_BUCKETS`` where they fill as many of ``spread``."""
    held = _taking_part(df, [], grouped).groupBy("g", F.size("v").alias("size")).agg(F.count("*").alias("n"))
    return held.select("g", "size", F.greatest(F.ceil(F.col("n") / rows), F.least(F.ceil(F.col("n") / spread), F.lit(LEAST_BUCKETS))).cast("int").alias(name))


def block_runs(queries: DataFrame, ref: DataFrame, function: Callable[[Side, list[Side]], Iterator[pd.DataFrame]], schema: str, extra: tuple[list[str], list[str]] = ((), ()), block: int = BLOCK, whole: bool = False) -> DataFrame:
    """What ``function(own, others)`` gives for each block of ``queries`` and the blocks of ``ref`` of each bucket; sides are (id, v[, g], extra..).

    A task holds a bucket's blocks of ``ref`` and reads the blocks that ask one after the other, so what a block finds in a
    bucket can be brought together before it leaves the task. With ``whole``, the others are all blocks of the group, so the
    task's memory grows with the group's rows, never with its pairs; a group is copied once for each bucket that asks.
    """
    spark = ref.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    grouped = "g" in queries.columns and "g" in ref.columns
    of_queries = _buckets(queries, grouped, block * PER_BUCKET, block, "q_buckets")
    of_ref = _buckets(ref, grouped, block * PER_BUCKET, block, "buckets")
    cells = of_ref.join(of_queries, ["g", "size"]).withColumn("buckets", F.lit(1) if whole else F.col("buckets"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own_bucket = lambda n: F.pmod(F.xxhash64("ids"), n).cast("int")
    asking = packed(queries, list(extra[0]), grouped, block).join(cells, ["g", "size"]).withColumn("q_bucket", own_bucket("q_buckets")).withColumn("bucket", every("buckets")).withColumn("asks", F.lit(1))
    asked = packed(ref, list(extra[1]), grouped, block).join(cells, ["g", "size"]).withColumn("bucket", own_bucket("buckets")).withColumn("q_bucket", every("q_buckets")).withColumn("asks", F.lit(0))
    key = ["g", "size", "bucket", "q_bucket"]
    columns = [*key, "asks", "ids", "v", "x"]
    parts = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # a cell is some 16 MB, but long work
    met = asking.select(*columns).unionByName(asked.select(*columns)).repartition(parts, *key).sortWithinPartitions(*key, "asks")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def side(r) -> Side:
            found = np.frombuffer(r.ids, "<i8")
            kind = "<f4" if len(r.v) == 4 * len(found) * r.size else "<f8"
            return Side(found, np.frombuffer(r.v, kind).reshape(len(found), r.size).astype(np.float64), np.frombuffer(r.x, np.float64).reshape(len(found), -1))

        cell, others = None, []
        for frame in frames:
            for r in frame.itertuples(index=False):
                if cell != (at := (r.g, r.size, r.bucket, r.q_bucket)):
                    cell, others = at, []
                if not r.asks:
                    others.append(side(r))
                elif others:
                    yield from (out for out in function(side(r), others) if out is not None and len(out))

    return met.mapInPandas(run, schema)


def block_pairs(queries: DataFrame, ref: DataFrame, function: Callable[[Side, Side], pd.DataFrame | None], schema: str, extra: tuple[list[str], list[str]] = ((), ()), block: int = BLOCK) -> DataFrame:
    """What ``function(own, other)`` gives for every pair of a block of ``queries`` and one of ``ref``; sides are (id, v[, g], extra..)."""
    return block_runs(queries, ref, lambda own, others: (function(own, other) for other in others), schema, extra, block)
