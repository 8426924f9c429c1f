"""Set-versus-set distances and spectra, as Arrow-batched partial sums over blocks. Rows with a null vector take no part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK, Side, block_pairs


def _dense(v) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in v])


def _kernel_sum(left: DataFrame, right: DataFrame, block: int) -> DataFrame:
    """(s, n): sum and number of (x.y / d + 1) ** 3 over pairs of different ids."""

    def add(own: Side, other: Side) -> pd.DataFrame:
        kernel = np.where(own.ids[:, None] != other.ids[None, :], (own.v @ other.v.T / own.v.shape[1] + 1) ** 3, np.nan)
        return pd.DataFrame({"s": [np.nansum(kernel)], "n": [int(np.isfinite(kernel).sum())]})

    return block_pairs(left, right, add, "s double, n long", block=block).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def kernel_by(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """(g, h, s, n): kernel sums over pairs of different ids by the groups ``g`` of the left and ``h`` of the right rows (id, v, group long)."""

    def add(own: Side, other: Side) -> pd.DataFrame:
        kernel = (own.v @ other.v.T / own.v.shape[1] + 1) ** 3
        different = own.ids[:, None] != other.ids[None, :]
        rows, row_of = np.unique(own.x[:, 0], return_inverse=True)
        columns, column_of = np.unique(other.x[:, 0], return_inverse=True)
        cell = row_of[:, None] * len(columns) + column_of[None, :]
        size = len(rows) * len(columns)
        s = np.bincount(cell[different], weights=kernel[different], minlength=size)
        n = np.bincount(cell[different], minlength=size)
        return pd.DataFrame({"g": np.repeat(rows, len(columns)).astype(np.int64), "h": np.tile(columns, len(rows)).astype(np.int64), "s": s, "n": n})

    found = block_pairs(left, right, add, "g long, h long, s double, n long", (["group"], ["group"]), block)
    return found.groupBy("g", "h").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def kernel_distance(x: DataFrame, y: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row, kid: unbiased squared MMD with the cubic kernel between two sets (id, v); null if a side has under two rows."""
    parts = [_kernel_sum(a, b, block).select(F.try_divide("s", "n").alias(name)) for name, a, b in (("xx", x, x), ("yy", y, y), ("xy", x, y))]
    one = parts[0].crossJoin(F.broadcast(parts[1])).crossJoin(F.broadcast(parts[2]))  # one row each
    return one.select((F.col("xx") + F.col("yy") - 2 * F.col("xy")).alias("kid"))


def participation(df: DataFrame, key: str) -> DataFrame:
    """(key, pr): (trace G)^2 / sum G_ij^2 of each group's centred Gram matrix, from sums of outer products; null if all rows are equal."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for value, own in frame.groupby(key):
                x = _dense(own["u"])
                out.append((value, len(own), x.sum(axis=0).tolist(), (x.T @ x).reshape(-1).tolist()))
            if out:
                yield pd.DataFrame(out, columns=[key, "n", "s", "g"])

    kind = df.schema[key].dataType.simpleString()
    parts = df.select(key, "u").mapInPandas(run, f"{key} {kind}, n long, s array<double>, g array<double>")
    counts = parts.groupBy(key).agg(F.sum("n").alias("n"))
    add = lambda c: parts.select(key, F.posexplode(c).alias("i", "x")).groupBy(key, "i").agg(F.sum("x").alias("x"))
    gram, sums = add("g"), add("s")
    size = F.sqrt(F.count("*").over(Window.partitionBy(key))).cast("int")
    gram = gram.withColumn("d", size).select(key, F.col("x").alias("g"), F.floor(F.col("i") / F.col("d")).cast("int").alias("r"), (F.col("i") % F.col("d")).alias("c"))
    left, right = sums.select(key, F.col("i").alias("r"), F.col("x").alias("s_r")), sums.select(key, F.col("i").alias("c"), F.col("x").alias("s_c"))
    centred = gram.join(left, [key, "r"]).join(right, [key, "c"]).join(counts, key).select(key, "r", "c", (F.col("g") - F.col("s_r") * F.col("s_c") / F.col("n")).alias("g"))
    return centred.groupBy(key).agg(F.try_divide(F.pow(F.sum(F.when(F.col("r") == F.col("c"), F.col("g"))), F.lit(2)), F.nullif(F.sum(F.col("g") * F.col("g")), F.lit(0.0))).alias("pr"))


def _distances(own: Side, other: Side) -> np.ndarray:
    square = (own.v * own.v).sum(axis=1)[:, None] + (other.v * other.v).sum(axis=1)[None, :] - 2 * own.v @ other.v.T
    return np.sqrt(np.maximum(0, square))


def radii(side: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(id, r): the Euclidean distance of each row (id, v[, g]) to its k-th nearest other; rows with fewer others are left out."""

    def nearest(own: Side, other: Side) -> pd.DataFrame:
        distance = np.where(own.ids[:, None] == other.ids[None, :], np.inf, _distances(own, other))
        first = np.sort(distance, axis=1)[:, :k]
        kept = np.isfinite(first)
        return pd.DataFrame({"id": np.repeat(own.ids, kept.sum(axis=1)), "d": first[kept]})

    place = F.row_number().over(Window.partitionBy("id").orderBy("d"))
    return block_pairs(side, side, nearest, "id long, d double", block=block).withColumn("place", place).where(F.col("place") == k).select("id", F.col("d").alias("r"))


def inside_balls(rows: DataFrame, balls: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, n, own): for rows (id, v, r[, g]), how many balls (id, v, r[, g]) hold each, boundary included, and whether its own ball holds one of their centres."""

    def inside(own: Side, other: Side) -> pd.DataFrame:
        distance = _distances(own, other)
        return pd.DataFrame({"id": own.ids, "n": (distance <= other.x[:, 0][None, :]).sum(axis=1), "own": (distance <= own.x[:, 0][:, None]).any(axis=1)})

    found = block_pairs(rows, balls, inside, "id long, n long, own boolean", (["r"], ["r"]), block)
    return found.groupBy("id").agg(F.sum("n").alias("n"), F.max("own").alias("own"))


def precision_recall(real: DataFrame, made: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """One row: precision, recall, density and coverage by k-nearest-neighbour balls (inclusive) of two sets (id, v); null if a side has at most k rows."""
    real, made = real.join(radii(real, k, block), "id"), made.join(radii(made, k, block), "id")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    a = inside_balls(made, real, block).agg(share(F.col("n") > 0).alias("precision"), (F.avg("n") / k).alias("density"))
    b = inside_balls(real, made, block).agg(share(F.col("n") > 0).alias("recall"), share(F.col("own")).alias("coverage"))
    return a.crossJoin(F.broadcast(b))  # one row each


def _moments(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance with n - 1) of vectors ``v``; each partition adds up its own, and one matrix reaches the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, g = 0, None, None
        for frame in frames:
            if len(frame):
                x = _dense(frame["v"])
                own = x.sum(axis=0), x.T @ x
                n, s, g = n + len(x), own[0] if s is None else s + own[0], own[1] if g is None else g + own[1]
        if n:
            yield pd.DataFrame({"n": [n], "x": [[*s, *g.reshape(-1)]]})

    parts = df.where("v IS NOT NULL").select("v").mapInPandas(run, "n long, x array<double>")
    n = parts.agg(F.sum("n")).first()[0] or 0
    sums = parts.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")["x"].to_numpy()
    d = int((np.sqrt(1 + 4 * len(sums)) - 1) / 2)
    mean = sums[:d] / max(n, 1)
    return n, mean, (sums[d:].reshape(d, d) - n * np.outer(mean, mean)) / max(n - 1, 1)


def frechet_distance(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row, frechet: squared distance of means + traces - 2 * the trace of the root of the covariances' product; null if a side has under two rows."""
    (n, mean_x, cov_x), (m, mean_y, cov_y) = _moments(x), _moments(y)
    found = None
    if min(n, m) > 1:
        roots = np.sqrt(np.maximum(np.linalg.eigvals(cov_x @ cov_y).real, 0))
        found = float(((mean_x - mean_y) ** 2).sum() + np.trace(cov_x) + np.trace(cov_y) - 2 * roots.sum())
    return x.sparkSession.createDataFrame([(found,)], "frechet double")
