"""Assignment, clustering, distances, temperature and codecs against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from strata.operators import clustering, sets
from strata.sources import files


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (5, 5), (3, 5), (5, 3)])
def test_assign(shape):
    for seed in range(20):
        cost = np.random.default_rng(seed).integers(-9, 9, shape)
        got = clustering.assign(cost)
        wide = cost if shape[0] <= shape[1] else cost.T
        least = min(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert len(got) == min(shape) and len({r for r, _ in got}) == len({c for _, c in got}) == len(got)
        assert sum(cost[r, c] for r, c in got) == least


def test_accuracy(spark):
    df = spark.createDataFrame([(0, 7), (0, 7), (0, 8), (1, 8), (1, 8), (1, None), (None, 7)], "y int, c int")
    assert clustering.clustering_accuracy(df, "y", "c").collect() == [(0.8, 2)]
    assert sorted(clustering.match_clusters(df, "y", "c").collect()) == [(7, 0, 2), (8, 1, 2)]
    assert clustering.clustering_accuracy(df.where("y > 5"), "y", "c").collect() == [(None, 0)]


def test_k_means(spark):
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 0.1, (40, 3)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(999, None)], "id long, v array<float>")
    centres, inertia = clustering.k_means(df, 3, starts=2)
    assert np.allclose(sorted(centres.mean(axis=1)), [points[i * 40 : i * 40 + 40].mean() for i in range(3)], atol=1e-4)
    true = sum(((p - p.mean(axis=0)) ** 2).sum() for p in np.split(points, 3))
    assert inertia == pytest.approx(true, rel=1e-4)
    found = clustering.predict(df.where("v IS NOT NULL"), centres).orderBy("id").collect()
    assert all(len({r["c"] for r in found[i * 40 : i * 40 + 40]}) == 1 for i in range(3))
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, v array<float>")
    assert clustering.k_means(same, 3)[0].tolist() == [[1.0, 2.0]]
    assert clustering.k_means(same.where("id < 0"), 3)[0].size == 0


def test_frechet(spark):
    x = np.random.default_rng(1).normal(size=(50, 4))
    side = lambda a: spark.createDataFrame([(p.tolist(),) for p in a], "v array<double>")
    assert sets.frechet_distance(side(x), side(x + [3, 0, 0, 0])).first()[0] == pytest.approx(9, abs=1e-6)
    assert sets.frechet_distance(side(x), side(x)).first()[0] == pytest.approx(0, abs=1e-6)
    assert sets.frechet_distance(side(x), side(x[:1])).first()[0] is None
    empty = side(x).where("false")
    assert sets.frechet_distance(empty, side(x)).first()[0] is None


def test_temperature(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(300, 3)) * 4
    p = np.exp(z / 2.5)
    y = [int(rng.choice(3, p=r / r.sum())) for r in p]
    df = spark.createDataFrame([(r.tolist(), c) for r, c in zip(z, y, strict=True)] + [(None, 1)], "z array<double>, y int")
    got, nll = clustering.fit_temperature(df, "z", "y").first()

    def loss(t):
        s = z / t
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(300), y]))

    assert nll == pytest.approx(loss(got), abs=1e-9)
    assert nll <= min(map(loss, np.exp(np.linspace(-4, 4, 4000)))) + 1e-6
    assert clustering.fit_temperature(df.where("y > 9"), "z", "y").collect() == [(None, None)]


def test_codecs(spark, tmp_path):
    df = spark.createDataFrame([("a,b", [0.123456789, -2.0]), ("c", None)], "name string, v array<float>")
    files.write_embeddings(df, f"{tmp_path}/e", "name", "v", 2)
    got = {r["filename"]: r["v"] for r in files.read_embeddings(spark, f"{tmp_path}/e", 2).collect()}
    assert got["c"] is None and got["a,b"] == pytest.approx([0.123457, -2.0], abs=1e-7)
    files.write_ids(df.select(F.explode(F.array(F.col("name"), F.lit(None))).alias("name")), f"{tmp_path}/i", "name")
    assert sorted(r["id"] for r in files.read_ids(spark, f"{tmp_path}/i").collect()) == ["a,b", "c"]
    files.write_json(df, f"{tmp_path}/j")
    assert sorted(files.read_json(spark, f"{tmp_path}/j", df.schema).collect()) == sorted(df.collect())


def test_k_means_of_partitions_without_rows(spark):
    rows = [(i, [float(i % 2 * 10 + i), 1.0]) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(40)
    centres, inertia = clustering.k_means(df, 2, iterations=5)
    c = {r["id"]: r["c"] for r in clustering.predict(df, centres).collect()}
    x = np.array([v for _, v in rows])
    own = np.array([c[i] for i in range(6)])
    assert inertia == pytest.approx(sum(((x[own == k] - x[own == k].mean(axis=0)) ** 2).sum() for k in set(own)))
