"""Bootstrap intervals of any measure that follows from sums over rows.

A row has a weight in every resample: a Poisson count drawn from a hash of the row's id and the resample's number, so
rows are never copied, a lost executor's rows come out the same, and other engines can repeat the draws. A measure is a
pair of functions: ``features`` gives numbers for each row, ``final`` takes their weighted sums and gives named values.
Sums of all resamples are one matrix product a batch, add up over partitions, and only then become values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Constants of the hash; counts up to this are drawn, and a count's probability is cut to 32 bits.
MIX, MOST = (0x9E3779B1, 0x7FEB352D, 0x846CA68B, 0x85EBCA6B, 0xC2B2AE35), 8
THRESHOLDS = [math.floor(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(MOST)]
#: Rows of a matrix product, resamples that one row of sums holds, and groups that a task keeps.
ROWS, CHUNK, GROUPS = 1024, 256, 64


class Measure(NamedTuple):
    """``features(frame)`` is (rows, m); ``final(sums)`` takes (resamples, m) and gives values of each resample, NaN where undefined."""

    features: Callable[[pd.DataFrame], np.ndarray]
    final: Callable[[np.ndarray], dict[str, np.ndarray]]


def draws_of(ids: np.ndarray, first: int, last: int, seed: int) -> np.ndarray:
    """(rows, resamples): how often each row is in resamples first .. last - 1; resample 0 holds each row once."""
    b = np.arange(first, last, dtype=np.uint64)[None, :]
    mask = np.uint64(0xFFFFFFFF)
    a, c, s, m, n = (np.uint64(x) for x in MIX)
    with np.errstate(over="ignore"):
        x = ((ids.astype(np.int64).astype(np.uint64)[:, None] & mask) * a + b * c + np.uint64(seed) * s) & mask
        x ^= x >> np.uint64(16)
        x = (x * m) & mask
        x ^= x >> np.uint64(13)
        x = (x * n) & mask
        x ^= x >> np.uint64(16)
    counts = np.searchsorted(np.array(THRESHOLDS, dtype=np.uint64), x.reshape(-1), side="right").reshape(x.shape).astype(np.float64)
    return np.where(b == 0, 1.0, counts)


def draws_sql(row_id: str, b: str, seed: int) -> str:
    """The same counts in SQL, for whole-number columns."""
    low, (a, c, s, m, n) = 2**32, MIX
    shifted = lambda x, by: f"xor({x}, {x} >> {by})"
    times = lambda x, by: f"((({x})::HUGEINT * {by}) % {low})::BIGINT"
    start = f"((({row_id} % {low})::HUGEINT * {a} + {b}::HUGEINT * {c} + {seed}::HUGEINT * {s}) % {low})::BIGINT"
    levels = [start, lambda x: times(shifted(x, 16), m), lambda x: times(shifted(x, 13), n), lambda x: shifted(x, 16)]
    mixed = f"list_reduce([{start}, 0, 1, 2], lambda x, k: CASE k WHEN 0 THEN {levels[1]('x')} WHEN 1 THEN {levels[2]('x')} ELSE {levels[3]('x')} END)"
    return f"CASE WHEN {b} = 0 THEN 1 ELSE len(list_filter({THRESHOLDS}::BIGINT[], lambda t: t <= {mixed})) END"


def resampled(df: DataFrame, group: str, id_column: str, measure: Measure, columns: list[str], draws: int = 1000, seed: int = 0) -> DataFrame:
    """(group string, b, metric, value) of every resample b, and of the rows themselves as resample 0; rows without an id or a group take no part, undefined values are null."""
    chunks = [(at, min(at + CHUNK, draws + 1)) for at in range(0, draws + 1, CHUNK)]

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[np.ndarray]] = {}

        def out() -> pd.DataFrame:
            rows = [(g, k, s.shape[1], s.tobytes()) for g, own in held.items() for k, s in enumerate(own)]
            held.clear()
            return pd.DataFrame(rows, columns=["g", "chunk", "m", "sums"])

        for frame in frames:
            for g, own in frame.groupby("g"):
                for at in range(0, len(own), ROWS):
                    part = own.iloc[at : at + ROWS]
                    x = np.asarray(measure.features(part), np.float64)
                    sums = [draws_of(part["row"].to_numpy(), *c, seed).T @ x for c in chunks]
                    held[g] = [a + s for a, s in zip(held[g], sums, strict=True)] if g in held else sums
            if len(held) > GROUPS:
                yield out()
        yield out()

    def total(frame: pd.DataFrame) -> np.ndarray:
        return np.sum([np.frombuffer(s).reshape(-1, int(m)) for s, m in zip(frame["sums"], frame["m"], strict=True)], axis=0)

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        sums = total(frame)
        return pd.DataFrame({"g": [frame["g"].iloc[0]], "chunk": [frame["chunk"].iloc[0]], "m": [sums.shape[1]], "sums": [sums.tobytes()]})

    def finished(frame: pd.DataFrame) -> pd.DataFrame:
        values = measure.final(total(frame))
        b = np.arange(*chunks[int(frame["chunk"].iloc[0])])
        return pd.concat([pd.DataFrame({"group": frame["g"].iloc[0], "b": b, "metric": name, "value": v}) for name, v in values.items()])

    kept = df.where(F.col(id_column).isNotNull() & F.col(group).isNotNull())
    rows = kept.select(F.col(group).cast("string").alias("g"), F.col(id_column).cast("long").alias("row"), *columns)
    kind = "g string, chunk int, m int, sums binary"
    parts = rows.mapInPandas(add, kind).withColumn("salt", F.spark_partition_id() % 32)
    found = parts.groupBy("g", "chunk", "salt").applyInPandas(merged, kind).groupBy("g", "chunk").applyInPandas(finished, "group string, b int, metric string, value double")
    return found.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def intervals(df: DataFrame, group: str, id_column: str, measure: Measure, columns: list[str], draws: int = 1000, seed: int = 0) -> DataFrame:
    """(group, metric, mean, lo, hi, n): each measure of the rows, and its 2.5 and 97.5 percentiles over the resamples; the macro rows average the groups inside each resample, without those where it is undefined."""
    runs = resampled(df, group, id_column, measure, columns, draws, seed)
    macro = runs.groupBy("b", "metric").agg(F.avg("value").alias("value")).withColumn("group", F.lit("macro"))
    sizes = df.where(F.col(id_column).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("group")).agg(F.count("*").alias("n"))
    sizes = sizes.unionByName(sizes.agg(F.count("*").alias("n")).withColumn("group", F.lit("macro")))
    drawn = F.when(F.col("b") > 0, F.col("value"))
    ends = [F.percentile(drawn, F.lit(q)).alias(name) for q, name in ((0.025, "lo"), (0.975, "hi"))]
    summed = runs.unionByName(macro).groupBy("group", "metric").agg(F.max(F.when(F.col("b") == 0, F.col("value"))).alias("mean"), *ends)
    return summed.join(sizes, "group").select("group", "metric", "mean", "lo", "hi", "n")


def means_of(names: list[str]) -> Measure:
    """The means of these columns, each over the rows where it is not null."""

    def features(frame: pd.DataFrame) -> np.ndarray:
        x = frame[names].to_numpy(np.float64)
        return np.concatenate([np.nan_to_num(x), ~np.isnan(x)], axis=1)

    def final(sums: np.ndarray) -> dict[str, np.ndarray]:
        with np.errstate(invalid="ignore", divide="ignore"):
            means = sums[:, : len(names)] / sums[:, len(names) :]
        return {name: means[:, i] for i, name in enumerate(names)}

    return Measure(features, final)


def correlation_of(x: str, y: str) -> Measure:
    """The correlation of two columns over rows that have both."""

    def features(frame: pd.DataFrame) -> np.ndarray:
        a, b = frame[x].to_numpy(np.float64), frame[y].to_numpy(np.float64)
        both = ~(np.isnan(a) | np.isnan(b))
        a, b = np.where(both, a, 0), np.where(both, b, 0)
        return np.stack([both, a, b, a * a, b * b, a * b], axis=1)

    def final(sums: np.ndarray) -> dict[str, np.ndarray]:
        n, a, b, aa, bb, ab = sums.T
        with np.errstate(invalid="ignore", divide="ignore"):
            return {"correlation": (n * ab - a * b) / np.sqrt((n * aa - a * a) * (n * bb - b * b))}

    return Measure(features, final)
