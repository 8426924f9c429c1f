"""Clusterings by name, so that callers choose one in a configuration, and class-wise measures as functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusterings import Fit, choose_k, fit_many, labels_of

#: name -> function(rows (id, g, v), clusters of each class or None, seed, **parameters) -> (id, g, c)
_FITS: dict[str, Callable[..., DataFrame]] = {}


def fit(name: str) -> Callable:
    """Decorator: make a clustering known under ``name``."""

    def add(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _FITS:
            raise ValueError(f"{name} is known already")
        _FITS[name] = function
        return function

    return add


def fitter(name: str, **parameters) -> Callable[..., DataFrame]:
    """The clustering of that name, with its parameters set."""
    return partial(_FITS[name], **parameters)


@fit("k_means")
def k_means(df: DataFrame, k_of: dict[int, int] | None = None, seed: int = 0, starts: int = 10) -> DataFrame:
    """k-means with the given number of clusters in each class, or with one that is chosen without labels."""
    if k_of is None:
        k_of = {g: k for g, (k, _) in choose_k(df, seed=seed).items()}
    found = fit_many(df, [Fit(g, k, seed) for g, k in k_of.items()], starts)
    centres: dict[int, list[np.ndarray]] = {f.g: [c] for f, (c, _) in found.items()}
    return labels_of(df, centres).select("id", "g", F.get("labels", F.lit(0)).alias("c"))


def class_table(df: DataFrame, group: str, measures: dict[str, Callable[[], object]]) -> DataFrame:
    """(group, metric, mean): measures are functions that give an aggregate column; each runs once in every group, and the macro row averages the groups."""
    wide = df.groupBy(group).agg(*[make().alias(name) for name, make in measures.items()])
    long = wide.withColumn("group", F.col(group).cast("string")).unpivot(["group"], list(measures), "metric", "mean")
    return long.unionByName(long.groupBy("metric").agg(F.lit("macro").alias("group"), F.avg("mean").alias("mean")).select("group", "metric", "mean"))
