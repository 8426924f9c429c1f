"""Registered queries that fit a model over ``embeddings``; SQL has no twin for them, so tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import clustering, sets
from strata.operators.blocks import complete

from .embedding_queries import rows
from .registry import register


@register("frechet_halves")
def frechet_halves(spark, sf_dir):
    side = rows(spark, sf_dir)
    return sets.frechet_distance(side.where("id % 2 = 0"), side.where("id % 2 = 1"))


def _clusters(spark, sf_dir):
    side = rows(spark, sf_dir)
    centres, _ = clustering.k_means(side, 4)
    return side.select("id", "coarse").join(clustering.predict(complete(side), centres).select("id", "c"), "id")


@register("k_means_labels")
def k_means_labels(spark, sf_dir):
    return _clusters(spark, sf_dir)


@register("clustering_accuracy")
def clustering_accuracy(spark, sf_dir):
    return clustering.clustering_accuracy(_clusters(spark, sf_dir), "coarse", "c")


@register("cluster_match")
def cluster_match(spark, sf_dir):
    return clustering.match_clusters(_clusters(spark, sf_dir), "coarse", "c")


@register("temperature_fit")
def temperature_fit(spark, sf_dir):
    # eight times the first ten components stand for the logits of the fine classes
    logits = F.transform(F.slice("v", 1, 10), lambda x: 8 * x.cast("double"))
    return clustering.fit_temperature(rows(spark, sf_dir).select(logits.alias("z"), "fine"), "z", "fine")
