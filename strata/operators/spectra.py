"""Covariances, principal components, regressions on covariates and probes, from sums that partitions add up.

A group's matrix of sums has d x d cells whatever its rows, so one task may take it apart. Rows without a whole vector take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import complete


def _partial(df: DataFrame) -> DataFrame:
    """(g, n, x): each partition's rows, vector sum and sum of outer products, as one array a group."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for frame in frames:
            for g, own in frame.groupby("g"):
                x = np.stack([np.asarray(v, np.float64) for v in own["v"]])
                new = [len(x), x.sum(axis=0), x.T @ x]
                held[int(g)] = [a + b for a, b in zip(held[int(g)], new, strict=True)] if int(g) in held else new
        for g, (n, s, o) in held.items():
            yield pd.DataFrame({"g": [g], "n": [n], "x": [[*s, *o.reshape(-1)]]})

    return complete(df).where("g IS NOT NULL").select(F.col("g").cast("long").alias("g"), "v").mapInPandas(run, "g long, n long, x array<double>")


def _moments(frame: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and summed products of deviations."""
    total = np.sum([np.asarray(x) for x in frame["x"]], axis=0)
    d = int((np.sqrt(1 + 4 * len(total)) - 1) / 2)
    n, mean = int(frame["n"].sum()), total[:d] / frame["n"].sum()
    return n, mean, total[d:].reshape(d, d) - n * np.outer(mean, mean)


def covariance(df: DataFrame) -> DataFrame:
    """(g, i, j, cov): the sample covariance matrix of each group of rows (g, v), cell by cell; groups of one row are left out."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        n, _, product = _moments(frame)
        if n < 2:
            return pd.DataFrame({"g": [], "i": [], "j": [], "cov": []})
        i, j = np.indices(product.shape)
        return pd.DataFrame({"g": frame["g"].iloc[0], "i": i.ravel(), "j": j.ravel(), "cov": (product / (n - 1)).ravel()})

    return _partial(df).groupBy("g").applyInPandas(run, "g long, i int, j int, cov double")


def axes(df: DataFrame, n_components: int) -> DataFrame:
    """(g, mean, axes, eigenvalues): principal axes of each group of rows (g, v), at most min(n_components, n - 1, d), by falling eigenvalue.

    Eigenvalues are squared singular values of the centred rows. An axis points where its largest component is positive.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        n, mean, product = _moments(frame)
        values, vectors = np.linalg.eigh(product)
        kept = np.argsort(-values, kind="stable")[: min(n_components, max(n - 1, 0), len(mean))]
        chosen = vectors[:, kept].T
        for row in chosen:
            row *= np.sign(row[np.abs(row).argmax()]) or 1.0
        return pd.DataFrame({"g": [frame["g"].iloc[0]], "mean": [mean.tolist()], "axes": [chosen.tolist()], "eigenvalues": [np.maximum(values[kept], 0).tolist()]})

    return _partial(df).groupBy("g").applyInPandas(run, "g long, mean array<double>, axes array<array<double>>, eigenvalues array<double>")


def scores(df: DataFrame, found: DataFrame, n_components: int) -> DataFrame:
    """(id, g, v): rows (id, g, v) on their own group's axes, filled up with zeros to ``n_components``."""

    def along(v: Column, mean: Column, axis: Column) -> Column:
        return F.aggregate(F.zip_with(F.zip_with(v, mean, lambda x, m: x.cast("double") - m), axis, lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x)

    joined = complete(df).join(F.broadcast(found.select("g", "mean", "axes")), "g")  # one row a group
    on = F.transform("axes", lambda a: along(F.col("v"), F.col("mean"), a))
    filled = F.concat(on, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(n_components) - F.size("axes"))))
    return joined.select("id", "g", filled.alias("v"))


def standardise(df: DataFrame, train: DataFrame) -> DataFrame:
    """(id, i, x): (x - mean) / (population deviation + 1e-6) / sqrt(d), component by component, with the statistics of ``train`` (v)."""
    of = complete(train).select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s"))
    rows = complete(df).select("id", F.size("v").alias("d"), F.posexplode("v").alias("i", "x"))
    return rows.join(F.broadcast(of), "i").select("id", "i", ((F.col("x") - F.col("m")) / (F.col("s") + 1e-6) / F.sqrt("d")).alias("x"))


def regression(df: DataFrame, covariates: list[str]) -> np.ndarray:
    """(1 + covariates, d): the least-squares coefficients of vectors ``v`` on an intercept and the covariates; the sums of products are what reaches the driver."""
    wide = complete(df).dropna(subset=covariates).select(F.lit(0).alias("g"), F.concat(F.array(*[F.col(c).cast("double") for c in covariates]), F.transform("v", lambda x: x.cast("double"))).alias("v"))
    parts = _partial(wide).toPandas()  # one row a partition, of (covariates + d) squared cells
    n, mean, product = _moments(parts)
    p = len(covariates)
    slopes = np.linalg.lstsq(product[:p, :p], product[:p, p:], rcond=None)[0]
    return np.vstack([mean[p:] - mean[:p] @ slopes, slopes])


def residuals(df: DataFrame, covariates: list[str]) -> DataFrame:
    """``df`` with v replaced by what a linear fit on the covariates leaves of it."""
    table = regression(df, covariates)
    fitted = F.array(*[F.lit(0.0) + float(row[0]) + sum((F.col(c).cast("double") * float(b) for c, b in zip(covariates, row[1:], strict=True)), F.lit(0.0)) for row in table.T])
    return complete(df).dropna(subset=covariates).withColumn("v", F.zip_with("v", fitted, lambda x, y: x.cast("double") - y))


def gram_features(vector: Column, rows: int, width: int) -> Column:
    """The upper triangle, row by row with its diagonal, of the products of a vector's ``rows`` pieces of ``width``, over the width."""
    piece = lambda i: F.slice(vector, i * width + 1, width)
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x) / width
    return F.array(*[product(piece(i), piece(j)) for i in range(rows) for j in range(i, rows)])


def weighted_centroids(df: DataFrame, key: str, weight: str) -> DataFrame:
    """(key, i, x, var): weighted mean and variance of each component of the group's vectors; a group without weight is left out."""
    parts = complete(df).select(key, F.col(weight).cast("double").alias("w"), F.posexplode("v").alias("i", "x")).select(key, "w", "i", F.col("x").cast("double").alias("x"))
    sums = parts.groupBy(key, "i").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("wx"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("wxx")).where("w > 0")
    mean = F.col("wx") / F.col("w")
    return sums.select(key, "i", mean.alias("x"), (F.col("wxx") / F.col("w") - mean * mean).alias("var"))


def probe(train: DataFrame, test: DataFrame, c: float = 10.0, iterations: int = 500) -> DataFrame:
    """(id, y, predicted, correct) of ``test`` rows (id, y, u): a multinomial logistic regression fitted on ``train`` (y, u), penalised by |w|^2 / (2 c n)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    ready = lambda df: df.where("u IS NOT NULL").withColumn("features", array_to_vector("u")).withColumn("label", F.col("y").cast("double"))
    fit = ready(train)
    n = fit.count()
    model = LogisticRegression(family="multinomial", regParam=1 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=iterations).fit(fit)
    found = model.transform(ready(test)).select("id", "y", F.col("prediction").cast("int").alias("predicted"))
    return found.withColumn("correct", F.col("y") == F.col("predicted"))


def explained_share(df: DataFrame, covariates: list[str], n_components: int = 5, folds: int = 5, ridge: float = 1.0, seed: int = 0) -> DataFrame:
    """(g, share, r2_first): how much of a group's leading components a ridge regression on its covariates tells out of fold, weighted by eigenvalue.

    Rows are (id, g, v, covariates..). A fold is a hash of the id; standardised covariates' sums per group and fold give every
    fold's fit, so rows are read once for the fits and once for the errors, whatever the folds.
    """
    from strata.functions.sampling import hash_int

    found = axes(df, n_components)
    rows = scores(df, found, n_components).join(complete(df).select("id", *covariates), "id").dropna(subset=covariates)
    wide = F.concat(F.array(*[F.col(c).cast("double") for c in covariates]), "v")
    rows = rows.select("id", F.col("g"), (hash_int(F.lit(seed), F.col("id")) % folds).cast("long").alias("fold"), wide.alias("v"))
    sums = _partial(rows.select((F.col("g") * folds + F.col("fold")).alias("g"), "v")).toPandas()  # groups x folds x partitions
    p, tables = len(covariates), {}
    for g, own in sums.groupby(sums["g"] // folds):
        for fold in range(folds):
            held = own[own["g"] % folds != fold]
            if len(held):
                n, mean, product = _moments(held)
                scale = np.sqrt(np.maximum(np.diag(product)[:p] / n, 1e-12))
                slopes = np.linalg.solve(product[:p, :p] / np.outer(scale, scale) + ridge * np.eye(p), product[:p, p:] / scale[:, None])
                tables[int(g), fold] = mean, scale, slopes
    shared = df.sparkSession.sparkContext.broadcast(tables)

    def errors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (g, fold), own in frame.groupby(["g", "fold"]):
                if (int(g), int(fold)) in shared.value:
                    mean, scale, slopes = shared.value[int(g), int(fold)]
                    x = np.stack([np.asarray(v, np.float64) for v in own["v"]])
                    left = x[:, p:] - mean[p:] - (x[:, :p] - mean[:p]) / scale @ slopes
                    yield pd.DataFrame({"g": int(g), "i": np.arange(left.shape[1]), "e": (left**2).sum(axis=0), "n": len(x), "s": x[:, p:].sum(axis=0), "q": (x[:, p:] ** 2).sum(axis=0)})

    added = rows.mapInPandas(errors, "g long, i int, e double, n long, s double, q double").groupBy("g", "i").agg(*[F.sum(c).alias(c) for c in "ensq"])
    r2 = added.select("g", "i", (1 - F.try_divide(F.col("e"), F.col("q") - F.col("s") * F.col("s") / F.col("n"))).alias("r2"))
    weights = found.select("g", F.posexplode("eigenvalues").alias("i", "w"))
    joined = r2.join(weights, ["g", "i"])
    return joined.groupBy("g").agg(F.try_divide(F.sum(F.col("w") * F.col("r2")), F.sum("w")).alias("share"), F.max(F.when(F.col("i") == 0, F.col("r2"))).alias("r2_first"))
