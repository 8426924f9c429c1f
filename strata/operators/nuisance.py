"""How much of a group's leading components covariates tell: ridge regressions with a cross-validated penalty, against shuffled covariates.

Rows are (id long, g long, v array, covariates..); rows without a whole vector, a group, an id or a covariate take no part.
Fits follow from sums by group and fold, and every penalty's leave-one-out error from one decomposition of them, so rows
are read once for the sums, once for the penalties and once for the errors. What reaches the driver is bounded by groups,
folds and the squared number of covariates and components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.sampling import hash_int, hash_key

from . import quality, resampling
from .blocks import complete
from .durable import settled
from .prefix import totals_before
from .spectra import _moments, _partial, axes, scores

#: Penalties that are tried, and the rows that a group needs.
PENALTIES, LEAST_ROWS = tuple(float(x) for x in np.logspace(-2, 3, 12)), 20


def shuffled(df: DataFrame, columns: list[str], seed: int = 0) -> DataFrame:
    """(id, g, columns..): rows (id, g, columns..) whose columns come from another row of the group, or the same one, every row giving once.

    The n-th row of a group by one hash of the id takes the values of the n-th by another. Groups stand one after another
    in both orders, so places in the whole order pair rows of one group, and no task holds a group.
    """
    keyed = df.where("id IS NOT NULL AND g IS NOT NULL").select("id", "g", *columns, *[hash_key(F.lit(seed), F.lit(side), F.col("id")).alias(f"_{side}") for side in ("to", "from")], F.lit(1).cast("long").alias("_place"))
    placed = lambda side, kept: totals_before(keyed.select(side, "_place", *kept), [F.col("g"), F.col(side), F.col("id")], ["_place"])
    taking = placed("_to", ["id", "g"]).select("id", "g", "_place_before")
    giving = placed("_from", ["id", "g", *columns]).select("_place_before", *columns)
    return taking.join(giving, "_place_before").drop("_place_before")


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"g": [frame["g"].iloc[0]], "n": [int(frame["n"].sum())], "x": [np.sum([np.asarray(x) for x in frame["x"]], axis=0)]})


class _Fold:
    """The regression of one group on all rows but a fold's, for any penalty."""

    def __init__(self, sums: pd.DataFrame, p: int) -> None:
        self.n, mean, product = _moments(sums)
        self.p, self.mean = p, mean
        deviation = np.sqrt(np.maximum(np.diag(product)[:p] / self.n, 0))
        self.scale = np.where(deviation > 1e-12, deviation, 1.0)
        own, self.turn = np.linalg.eigh(product[:p, :p] / np.outer(self.scale, self.scale))
        self.own = np.maximum(own, 0)
        self.onto = self.turn.T @ (product[:p, p:] / self.scale[:, None])

    def left(self, rows: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
        """What the fit leaves of these rows' components, and each row's leverage, as if it were one of the fitted."""
        z = (rows[:, : self.p] - self.mean[: self.p]) / self.scale @ self.turn
        return rows[:, self.p :] - self.mean[self.p :] - z / (self.own + penalty) @ self.onto, 1 / self.n + (z * z / (self.own + penalty)).sum(axis=1)


def explained(df: DataFrame, covariates: list[str], n_components: int = 5, folds: int = 5, seed: int = 0, penalties: tuple[float, ...] = PENALTIES) -> DataFrame:
    """(g, n, share, r2_first): the out-of-fold R^2 of a group's components, weighted by eigenvalue, and that of the first one.

    A fold is a hash of the id. Each fold's penalty has the least leave-one-out error on the other folds, ties to the
    smaller; covariates are standardised there. Groups of fewer than ``LEAST_ROWS`` rows are left out.
    """
    usable = complete(df).dropna(subset=["id", "g", *covariates])
    usable = usable.join(usable.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS), "g")
    found = settled(axes(usable.select("g", "v"), n_components))
    rows = scores(usable.select("id", "g", "v"), found, n_components).join(usable.select("id", *covariates), "id")
    wide = F.concat(F.array(*[F.col(c).cast("double") for c in covariates]), "v")
    rows = settled(rows.select(F.col("g").cast("long").alias("g"), (hash_int(F.lit(seed), F.col("id")) % folds).cast("long").alias("fold"), wide.alias("v")))
    sums = _partial(rows.select((F.col("g") * folds + F.col("fold")).alias("g"), "v")).groupBy("g").applyInPandas(_merged, "g long, n long, x array<double>").toPandas()
    fits: dict[tuple[int, int], _Fold] = {}
    for g, own in sums.groupby(sums["g"] // folds):
        for fold in own["g"] % folds:
            others = own[own["g"] % folds != fold]
            if others["n"].sum() > 1:
                fits[int(g), int(fold)] = _Fold(others, len(covariates))
    context = df.sparkSession.sparkContext
    shared = context.broadcast(fits)

    def by_fold(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, np.ndarray]]:
        for frame in frames:
            for (g, fold), own in frame.groupby(["g", "fold"]):
                yield int(g), int(fold), np.stack([np.asarray(v, np.float64) for v in own["v"]])

    def tried(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for g, fold, x in by_fold(frames):
            for other in range(folds):
                if other != fold and (g, other) in shared.value:
                    errors = []
                    for penalty in penalties:
                        left, leverage = shared.value[g, other].left(x, penalty)
                        errors.append(((left / (1 - leverage)[:, None]) ** 2).sum())
                    held[g, other] = held.get((g, other), 0) + np.array(errors)
        yield pd.DataFrame([(g, fold, i, float(e)) for (g, fold), own in held.items() for i, e in enumerate(own)], columns=["g", "fold", "i", "e"])

    errors = rows.mapInPandas(tried, "g long, fold long, i int, e double").groupBy("g", "fold", "i").agg(F.sum("e").alias("e"))
    best = errors.groupBy("g", "fold").agg(F.min_by("i", F.struct("e", "i")).alias("i")).collect()  # groups x folds
    chosen = context.broadcast({(r["g"], r["fold"]): penalties[r["i"]] for r in best})

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, fold, x in by_fold(frames):
            if (g, fold) in chosen.value:
                left, y = shared.value[g, fold].left(x, chosen.value[g, fold])[0], x[:, len(covariates) :]
                yield pd.DataFrame({"g": g, "i": np.arange(y.shape[1]), "e": (left**2).sum(axis=0), "n": len(x), "s": y.sum(axis=0), "q": (y**2).sum(axis=0)})

    added = rows.mapInPandas(told, "g long, i int, e double, n long, s double, q double").groupBy("g", "i").agg(*[F.sum(c).alias(c) for c in "ensq"])
    r2 = added.select("g", "i", "n", (1 - F.try_divide(F.col("e"), F.col("q") - F.col("s") * F.col("s") / F.col("n"))).alias("r2"))
    joined = r2.join(found.select("g", F.posexplode("eigenvalues").alias("i", "w")), ["g", "i"])
    return joined.groupBy("g").agg(F.max("n").alias("n"), F.try_divide(F.sum(F.col("w") * F.col("r2")), F.sum("w")).alias("share"), F.max(F.when(F.col("i") == 0, F.col("r2"))).alias("r2_first"))


def table(df: DataFrame, sets: dict[str, list[str]], control: str | None = None, n_components: int = 5, folds: int = 5, seed: int = 0) -> DataFrame:
    """(g, n, name_share, name_r2_first ..): ``explained`` for each named set of covariates, and as "shuffled" for the set ``control`` of other rows of the group."""
    df = settled(df)
    out = None
    frames = {name: (df, columns) for name, columns in sets.items()}
    if control is not None:
        frames["shuffled"] = df.select("id", "g", "v").join(shuffled(df.select("id", "g", *sets[control]), sets[control], seed).drop("g"), "id"), sets[control]
    for name, (rows, columns) in frames.items():
        found = explained(rows, columns, n_components, folds, seed).select("g", F.col("n").alias(f"{name}_n"), F.col("share").alias(f"{name}_share"), F.col("r2_first").alias(f"{name}_r2_first"))
        out = found if out is None else out.join(found, "g", "full")
    return out.withColumn("n", F.coalesce(*[f"{name}_n" for name in frames])).drop(*[f"{name}_n" for name in frames])


def summary(found: DataFrame, draws: int = 1000, seed: int = 0) -> DataFrame:
    """(metric, mean, lo, hi, n, band): each column of a ``table`` averaged over its groups, with an interval by resampling groups, and the band of a share."""
    names = [c for c in found.columns if c not in ("g", "n")]
    rows = resampling.intervals(found.withColumn("all", F.lit("all")), "all", "g", resampling.means_of(names), names, draws, seed).where(F.col("group") == "all")
    return rows.select("metric", "mean", "lo", "hi", "n", F.when(F.col("metric").endswith("_share"), quality.share_band(F.col("mean"))).alias("band"))
