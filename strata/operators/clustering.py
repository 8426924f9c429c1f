"""Assignment, clustering accuracy, k-means and temperature: small models fitted from distributed sums.

What reaches the driver is bounded by labels, clusters and dimensions (a contingency table, centres), never by rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.sampling import hash_uniform

from .blocks import complete
from .durable import settled

#: Labels on a side of an assignment; more is an error, as the solver takes cubic time.
MOST_LABELS = 4000


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a one-to-one assignment of least total cost; a rectangle leaves the longer side's rest unassigned.

    Rows join one by one along shortest augmenting paths; reduced costs stay non-negative by dual prices.
    """
    cost = np.asarray(cost, dtype=np.float64)
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    n, m = cost.shape
    row_price, column_price, taken = np.zeros(n), np.zeros(m), np.full(m, -1)
    for free in range(n):
        reach, came, scanned = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        row, at, length = free, -1, 0.0
        while True:
            through = length + cost[row] - row_price[row] - column_price
            better = ~scanned & (through < reach)
            reach[better], came[better] = through[better], at
            at = int(np.argmin(np.where(scanned, np.inf, reach)))
            length, scanned[at] = reach[at], True
            if taken[at] < 0:
                break
            row = int(taken[at])
        done = np.flatnonzero(scanned)
        held = done[taken[done] >= 0]
        row_price[taken[held]] += length - reach[held]
        row_price[free] += length
        column_price[done] -= length - reach[done]
        while at >= 0:
            before = int(came[at])
            taken[at] = taken[before] if before >= 0 else free
            at = before
    return sorted((int(r), c) for c, r in enumerate(taken) if r >= 0)


def match_clusters(df: DataFrame, y: str, c: str) -> DataFrame:
    """(c, y, n): the one-to-one match of clusters with labels that covers most rows. Rows with a null in either take no part."""
    counted = df.where(F.col(y).isNotNull() & F.col(c).isNotNull()).groupBy(y, c).agg(F.count("*").alias("n"))
    sides = counted.agg(F.count_distinct(y), F.count_distinct(c)).first()
    if max(sides) > MOST_LABELS:
        raise ValueError(f"{max(sides)} labels on one side; an assignment takes {MOST_LABELS} at most")
    cells = counted.toPandas().pivot(index=c, columns=y, values="n").fillna(0).sort_index().sort_index(axis=1)
    chosen = assign(-cells.to_numpy()) if cells.size else []
    kinds = df.schema[c].dataType.simpleString(), df.schema[y].dataType.simpleString()
    found = [(cells.index[i].item() if hasattr(cells.index[i], "item") else cells.index[i], cells.columns[j].item() if hasattr(cells.columns[j], "item") else cells.columns[j], int(cells.iloc[i, j])) for i, j in chosen]
    return df.sparkSession.createDataFrame(found, f"c {kinds[0]}, y {kinds[1]}, n long")


def clustering_accuracy(df: DataFrame, y: str, c: str) -> DataFrame:
    """One row: acc, the share of rows that the best match covers, and the number of clusters; null without rows."""
    total = df.where(F.col(y).isNotNull() & F.col(c).isNotNull()).agg(F.count("*").alias("t"), F.count_distinct(c).alias("clusters"))
    covered = match_clusters(df, y, c).agg(F.sum("n").alias("n"))
    return total.crossJoin(F.broadcast(covered)).select(F.try_divide("n", "t").alias("acc"), "clusters")  # one row each


def _nearest(frame: pd.DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in frame["v"]])
    square = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T
    best = square.argmin(axis=1)
    return x, best, np.maximum(0, square[np.arange(len(x)), best])


def predict(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, c, d2): the nearest centre of each row (id, v), the first of equals, and the squared distance."""
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                _, best, square = _nearest(frame, shared.value)
                yield pd.DataFrame({"id": frame["id"], "c": best, "d2": square})

    return df.select("id", "v").mapInPandas(run, f"id {df.schema['id'].dataType.simpleString()}, c int, d2 double")


def _seeds(df: DataFrame, k: int, seed: int) -> np.ndarray:
    """k-means++: each next centre is drawn in proportion to its squared distance, as the least of -ln(u) / d2 with u a hash of (seed, draw, id)."""
    centres: list[np.ndarray] = []
    for draw in range(k):
        u = hash_uniform(F.lit(seed), F.lit(draw), F.col("id"))
        if centres:
            far = predict(df, np.stack(centres)).where("d2 > 0").withColumn("key", -F.ln(u + 1e-12) / F.col("d2"))
            chosen = far.agg(F.min(F.struct("key", "id"))["id"].alias("id"))
        else:
            chosen = df.agg(F.min(F.struct(u.alias("key"), "id"))["id"].alias("id"))
        got = df.join(F.broadcast(chosen), "id").select("v").first()  # one row
        if got is None:  # fewer distinct rows than centres
            break
        centres.append(np.asarray(got["v"], dtype=np.float64))
    return np.stack(centres) if centres else np.zeros((0, 0))


def k_means(df: DataFrame, k: int, seed: int = 0, starts: int = 1, iterations: int = 50) -> tuple[np.ndarray, float]:
    """(centres, inertia) of the best of several starts over rows (id, v). Rows with a null vector take no part.

    An iteration broadcasts the centres and sums rows by cluster inside each partition, so k rows a partition move.
    Fewer distinct rows than k give fewer centres; a cluster that loses its rows keeps its centre; no rows give none.
    """
    df = settled(complete(df).select("id", "v"))

    def step(centres: np.ndarray) -> tuple[np.ndarray, float]:
        shared = df.sparkSession.sparkContext.broadcast(centres)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, n, inertia = np.zeros_like(shared.value), np.zeros(len(shared.value), dtype=np.int64), np.zeros(len(shared.value))
            for frame in frames:
                if len(frame):
                    x, best, square = _nearest(frame, shared.value)
                    np.add.at(sums, best, x)
                    np.add.at(inertia, best, square)
                    n += np.bincount(best, minlength=len(n))
            own = np.flatnonzero(n)
            if len(own):  # a partition without rows has no sums, and Arrow makes no list column of none
                yield pd.DataFrame({"c": own, "n": n[own], "d2": inertia[own], "s": [s.tolist() for s in sums[own]]})

        parts = df.mapInPandas(run, "c int, n long, d2 double, s array<double>")
        totals = parts.groupBy("c").agg(F.sum("n").alias("n"), F.sum("d2").alias("d2"))
        sums = parts.select("c", F.posexplode("s").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("x")).groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("s"))
        moved, cost = centres.copy(), 0.0
        for row in totals.join(sums, "c").collect():  # k rows at most
            moved[row["c"]] = np.asarray(row["s"]) / row["n"]
            cost += row["d2"]
        return moved, cost

    best: tuple[np.ndarray, float] = (np.zeros((0, 0)), 0.0)
    for start in range(starts):
        centres = _seeds(df, k, seed + start)
        if not len(centres):
            return best
        cost = np.inf
        for _ in range(iterations):
            moved, cost = step(centres)
            if np.allclose(moved, centres, rtol=0, atol=1e-9):
                break
            centres = moved
        if start == 0 or cost < best[1]:
            best = centres, cost
    return best


def _loss(logits: Column, label: Column, beta: Column) -> Column:
    scaled = F.transform(logits, lambda z: z.cast("double") * beta)
    top = F.array_max(scaled)
    return top + F.ln(F.aggregate(scaled, F.lit(0.0), lambda s, z: s + F.exp(z - top))) - F.get(scaled, label)


def fit_temperature(df: DataFrame, logits: str, label: str, rounds: int = 5, steps: int = 24) -> DataFrame:
    """One row, temperature and nll: the softmax temperature in [0.01, 100] of least mean negative log-likelihood; null without rows.

    The loss is convex in 1 / T, so each round tries a grid of ``steps`` in one pass and the next refines around the best.
    ``label`` is the place of the true class, from 0. Rows with a null in either take no part.
    """
    rows = df.where(F.col(logits).isNotNull() & F.col(label).isNotNull())
    low, high, best = np.log(0.01), np.log(100.0), None
    for _ in range(rounds):
        grid = np.exp(np.linspace(low, high, steps))
        losses = rows.agg(*[F.avg(_loss(F.col(logits), F.col(label), F.lit(float(b)))).alias(f"l{i}") for i, b in enumerate(grid)]).first()
        if losses[0] is None:
            break
        at = int(np.argmin(losses))
        best = float(1 / grid[at]), float(losses[at])
        low, high = np.log(grid[max(0, at - 1)]), np.log(grid[min(steps - 1, at + 1)])
    return df.sparkSession.createDataFrame([best or (None, None)], "temperature double, nll double")
