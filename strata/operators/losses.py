"""Training losses in their evaluation form: aggregates over rows, soft assignments and pairs, with no gradients.

Pair losses meet in blocks (see blocks), so what a task holds is bounded. Undefined values are null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Side, block_pairs, complete
from .similarity import _units


def log_sum_exp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.ln(F.aggregate(F.zip_with(values, F.array_repeat(top, F.size(values)), lambda z, m: F.exp(z - m)), F.lit(0.0), lambda s, x: s + x))


def supervised_contrastive(df: DataFrame, temperature: float = 0.1) -> DataFrame:
    """One row, loss: the mean over rows (id, v, y) with a partner of their label of -mean over partners of log softmax(cosine / temperature) over all others."""

    def part(own: Side, other: Side) -> pd.DataFrame:
        u, w, out = _units(own.v), _units(other.v), []
        for low in range(0, len(u), 256):  # few tables of a block's pairs at a time
            ids, y = own.ids[low : low + 256], own.x[low : low + 256, 0]
            z = u[low : low + 256] @ w.T / temperature
            other_row = ids[:, None] != other.ids[None, :]
            same = other_row & (y[:, None] == other.x[:, 0][None, :])
            # cosines are at most one, so no power is above that of the temperature's inverse
            out.append(pd.DataFrame({"id": ids, "e": np.where(other_row, np.exp(z - 1 / temperature), 0).sum(axis=1), "p": np.where(same, z, 0).sum(axis=1), "n": same.sum(axis=1)}))
        return pd.concat(out)

    sums = block_pairs(df, df, part, "id long, e double, p double, n long", (["y"], ["y"])).groupBy("id").agg(F.sum("e").alias("e"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.where("n > 0").agg(F.avg(F.ln("e") + 1 / temperature - F.col("p") / F.col("n")).alias("loss"))


def soft_assignment(similarities: Column, temperature: float) -> Column:
    """Softmax of similarities to prototypes over a temperature."""
    scaled = F.transform(similarities, lambda s: s / temperature)
    whole = F.array_repeat(log_sum_exp(scaled), F.size(similarities))
    return F.zip_with(scaled, whole, lambda z, t: F.exp(z - t))


def entropy(probs: Column) -> Column:
    return -F.aggregate(probs, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.ln(p)).otherwise(0.0))


def usage(df: DataFrame, group: str, probs: str) -> DataFrame:
    """(group, z, share): the mean probability of each prototype."""
    return df.select(group, F.posexplode(probs).alias("z", "p")).groupBy(group, "z").agg(F.avg("p").alias("share"))


def active(usage_table: DataFrame, least: float) -> DataFrame:
    return usage_table.withColumn("active", F.col("share") >= least)


def active_prototypes(assigned: DataFrame, group: str, prototype: str, least: int) -> DataFrame:
    """(group, prototype, n): prototypes that are nearest to at least ``least`` rows."""
    return assigned.groupBy(group, prototype).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def joint_log(log_z: Column, log_y_given_z: Column) -> Column:
    """log p(y | x) for each coarse class: logsumexp over prototypes of log p(z | x) + log p(y | z); the second is one array over prototypes for each class."""
    return F.transform(log_y_given_z, lambda row: log_sum_exp(F.zip_with(log_z, row, lambda a, b: a + b)))


def cross_entropy(log_probs: Column, label: Column) -> Column:
    return -F.get(log_probs, label)


def hierarchy_penalty(inner: Column, outer: Column, margin: float = 0.0) -> Column:
    """How far a distance inside a subclass is above that between subclasses, with a margin; never negative."""
    return F.greatest(inner - outer + margin, F.lit(0.0))


def sinkhorn(df: DataFrame, scores: str, epsilon: float = 0.05, tolerance: float = 0.1, check: int = 10, most: int = 200) -> DataFrame:
    """``df`` with q: the assignment with rows that sum to one and equal columns nearest to the softmax of ``scores`` / epsilon (Sinkhorn-Knopp).

    Only the columns' scale is kept between rounds, one number a column: a round sums the columns of rows scaled to one. It ends when
    the columns' shares are within ``tolerance`` of equal in sum, looked at every ``check`` rounds, or after ``most`` rounds.
    """
    top = F.array_max(scores)
    powers = F.zip_with(scores, F.array_repeat(top, F.size(scores)), lambda s, m: F.exp((s - m) / epsilon))
    rows = df.withColumn("__k", powers).where(F.col("__k").isNotNull())
    first = rows.agg(F.max(F.size("__k"))).first()[0]
    if first is None:
        return df.withColumn("q", F.array().cast("array<double>"))
    scale = np.ones(first)

    def scaled(by: np.ndarray) -> Column:
        column = F.zip_with("__k", F.array(*[F.lit(float(x)) for x in by]), lambda a, b: a * b)
        whole = F.array_repeat(F.aggregate(column, F.lit(0.0), lambda s, x: s + x), F.size("__k"))
        return F.zip_with(column, whole, lambda a, t: a / t)

    for turn in range(most):
        sums = rows.select(scaled(scale).alias("q")).agg(*[F.avg(F.get("q", F.lit(i))).alias(str(i)) for i in range(first)]).first()
        share = np.array(sums, dtype=np.float64)
        if turn % check == 0 and np.abs(share - 1 / first).sum() <= tolerance:
            break
        scale = scale / np.maximum(share * first, 1e-300)
        scale /= scale.max()
    return rows.withColumn("q", scaled(scale)).drop("__k")


def fine_to_coarse(votes: np.ndarray, penalty: float = 0.0) -> list[int]:
    """A coarse class for each fine one (votes: fine x coarse) of greatest total votes less ``penalty`` for each further slot of a coarse class; every coarse class gets one at least.

    Each coarse class has as many slots as there can be fine ones, the n-th of them dearer by (n - 1) penalties; its first slot is free to
    whoever takes it and must be taken, which a great reward sees to.
    """
    from .clustering import assign

    n, m = votes.shape
    if n < m:
        raise ValueError(f"{n} fine classes cannot cover {m} coarse ones")
    slots = n - m + 1
    must = np.abs(votes).max() * n + penalty * n * n + 1
    cost = np.concatenate([-votes + penalty * s - (must if s == 0 else 0) for s in range(slots)], axis=1)
    return [column % m for _, column in sorted(assign(cost))]


# ---- how far embeddings are from an isotropic normal distribution

#: Groups that a task keeps sums of.
_KEPT = 32


def directions(size: int, slices: int, seed: int = 0) -> np.ndarray:
    """(size, slices): unit vectors of normal numbers, each drawn from two md5 keys seed:slice:component:0 and :1, so any engine can repeat them."""

    def uniform(s: int, i: int, k: int) -> float:
        return (int(hashlib.md5(f"{seed}:{s}:{i}:{k}".encode()).hexdigest()[:8], 16) + 1) / 2**32

    drawn = [[math.sqrt(-2 * math.log(uniform(s, i, 0))) * math.cos(2 * math.pi * uniform(s, i, 1)) for s in range(slices)] for i in range(size)]
    found = np.array(drawn).reshape(size, slices)
    return found / np.sqrt((found * found).sum(axis=0))


def directions_sql(size: int, slices: int, seed: int = 0) -> str:
    """The same as a query (s, d): a list for each slice."""
    uniform = lambda k: f"((('0x' || substr(md5('{seed}:' || s || ':' || i || ':{k}'), 1, 8))::BIGINT + 1) / 4294967296.0)"
    drawn = f"SELECT s, list(sqrt(-2 * ln({uniform(0)})) * cos(2 * pi() * {uniform(1)}) ORDER BY i) AS d FROM range({slices}) a(s), range({size}) b(i) GROUP BY s"
    return f"SELECT s, list_transform(d, lambda x: x / sqrt(list_inner_product(d, d))) AS d FROM ({drawn})"


def normality(df: DataFrame, group: str, slices: int = 1024, points: int = 17, seed: int = 0) -> DataFrame:
    """(group, n, sigreg) of rows (group, v): the mean over random directions of the Epps-Pulley distance between the rows' characteristic function along it and that of a standard normal distribution, times the rows.

    One pass: partitions add up cosines and sines at ``points`` places in [-5, 5], so what is moved does not grow with the rows. Rows whose vector is not whole take no part.
    """
    t = np.linspace(-5, 5, points)
    normal = np.exp(-t * t / 2)
    weights = np.full(points, t[1] - t[0])
    weights[[0, -1]] /= 2
    kind = "g string, n long, sums binary"

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        drawn: dict[int, np.ndarray] = {}

        def out() -> pd.DataFrame:
            found = pd.DataFrame([(g, n, s.tobytes()) for g, (n, s) in held.items()], columns=["g", "n", "sums"])
            held.clear()
            return found

        for frame in frames:
            for g, own in frame.groupby("g"):
                x = np.stack([np.asarray(v, np.float64) for v in own["v"]])
                if x.shape[1] not in drawn:
                    drawn[x.shape[1]] = directions(x.shape[1], slices, seed)
                angle = x @ drawn[x.shape[1]]
                s = np.stack([np.stack([f(angle * at).sum(axis=0) for at in t]) for f in (np.cos, np.sin)])
                held[g] = [held[g][0] + len(x), held[g][1] + s] if g in held else [len(x), s]
            if len(held) > _KEPT:
                yield out()
        yield out()

    def total(frame: pd.DataFrame) -> tuple[int, np.ndarray]:
        return int(frame["n"].sum()), np.sum([np.frombuffer(s) for s in frame["sums"]], axis=0)

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        n, sums = total(frame)
        return pd.DataFrame({"g": [frame["g"].iloc[0]], "n": [n], "sums": [sums.tobytes()]})

    def finished(frame: pd.DataFrame) -> pd.DataFrame:
        n, sums = total(frame)
        cos, sin = sums.reshape(2, points, slices) / n
        distance = (((cos - normal[:, None]) ** 2 + sin**2) * (normal * weights)[:, None]).sum(axis=0) * n
        return pd.DataFrame({group: [frame["g"].iloc[0]], "n": [n], "sigreg": [distance.mean()]})

    rows = complete(df).where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("g"), "v")
    parts = rows.mapInPandas(add, kind).withColumn("salt", F.spark_partition_id() % 32)
    return parts.groupBy("g", "salt").applyInPandas(merged, kind).groupBy("g").applyInPandas(finished, f"{group} string, n long, sigreg double")


def joint_embedding(df: DataFrame, share: float = 0.05, slices: int = 1024, points: int = 17, seed: int = 0) -> DataFrame:
    """One row, loss, invariance and sigreg, of rows (id, view, v): (1 - share) times the mean squared distance of a view's component to its mean over the id's views, and share times the views' mean ``normality``."""
    parts = complete(df).select("id", F.posexplode("v").alias("i", "x")).groupBy("id", "i").agg(F.count("x").alias("n"), F.avg(F.col("x").cast("double")).alias("m"), F.var_pop(F.col("x").cast("double")).alias("var"))
    invariance = parts.agg((F.sum(F.col("n") * F.col("var")) / F.sum("n")).alias("invariance"))
    sigreg = normality(df, "view", slices, points, seed).agg(F.avg("sigreg").alias("sigreg"))
    one = invariance.crossJoin(F.broadcast(sigreg))  # one row each
    return one.select(((1 - share) * F.col("invariance") + share * F.col("sigreg")).alias("loss"), "invariance", "sigreg")
