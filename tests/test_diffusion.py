"""Diffusion maps against numpy."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from strata.operators import diffusion

SCHEMA = "g long, a long, b long, w double"


def neighbour_graph(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    s = np.take_along_axis(d, near, 1)[:, -1]
    a = np.zeros_like(d)
    for i, row in enumerate(near):
        a[i, row] = np.exp(-d[i, row] ** 2 / (s[i] * s[row]))
    return np.maximum(a, a.T)


def edges_of(g, a, first=0):
    return [(g, first + int(i), first + int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]


def eigen(a):
    d = a.sum(axis=1)
    values, vectors = np.linalg.eigh(a / np.sqrt(np.outer(d, d)))
    return values[::-1], vectors[:, ::-1] / np.sqrt(d)[:, None]


@pytest.fixture(scope="module")
def graphs():
    rng = np.random.default_rng(5)
    noise = rng.normal(size=(500, 16))  # no clusters: close eigenvalues
    groups = np.concatenate([4 * c + rng.normal(size=(30, 6)) for c in rng.normal(size=(4, 6))])
    return {3: neighbour_graph(noise, 15), 8: neighbour_graph(groups, 15), 9: np.array([[0, 1.0, 0], [1, 0, 2], [0, 2, 0]])}


@pytest.fixture(scope="module")
def found(spark, graphs):
    edges = spark.createDataFrame([e for g, a in graphs.items() for e in edges_of(g, a, 1000 * g)], SCHEMA)
    return edges, diffusion.spectrum(edges.where("g > 3"), 26), diffusion.spectrum(edges.where("g = 3"), 6)


def test_eigenvalues_and_gaps_equal_numpy(found, graphs):
    for spectrum, size, own in ((found[1], 26, (8, 9)), (found[2], 6, (3,))):
        assert set(spectrum.values) == set(own)
        for g in own:
            assert np.allclose(spectrum.values[g], eigen(graphs[g])[0][:size], rtol=0, atol=1e-8)
    values = eigen(graphs[8])[0]
    assert diffusion.eigengap(found[1].values[8], 120) == 2 + int(np.argmax(values[1:25] - values[2:26]))
    assert diffusion.eigengap(found[1].values[9], 3) == 1


def test_coordinates_equal_numpy_but_for_signs(found, graphs):
    values, vectors = eigen(graphs[3])  # the other graph falls apart, so its first eigenvectors are any of their space
    own = np.array([r["v"] for r in diffusion.coordinates(found[2], {3: 6}).orderBy("id").collect()])
    want = vectors[:, 1:6] * values[1:6]
    assert own.shape == want.shape
    assert np.allclose(own @ own.T, want @ want.T, atol=1e-6)


def test_clusters_follow_the_groups(found):
    labels = diffusion.clusters(found[0].where("g > 3"), {8: 4, 9: 1}, starts=3)
    rows = labels.collect()
    assert len(rows) == 123 and {r["k"] for r in rows if r["g"] == 9} == {1}
    pairs = {((r["id"] - 8000) // 30, r["c"]) for r in rows if r["g"] == 8}
    assert len(pairs) == 4 == len({c for _, c in pairs})


def test_no_edges_give_no_rows(spark):
    assert diffusion.clusters(spark.createDataFrame([], SCHEMA)).count() == 0
    assert diffusion.clusters(spark.createDataFrame([(0, 1, 2, 0.0), (0, 2, 1, 0.0)], SCHEMA), {0: 2}).agg(F.count("*")).first()[0] == 0


def test_steps_that_nothing_reads_again_leave_no_files(spark):
    from urllib.parse import urlparse

    from strata.operators.durable import forget, settled

    held = settled(spark.range(10).repartition(3))
    path = urlparse(held._jdf.queryExecution().logical().rdd().getCheckpointFile().get()).path
    assert os.path.isdir(path) and held.count() == 10
    forget(held)
    assert not os.path.exists(path)


def test_a_round_of_products_is_one_written_table(spark, graphs, monkeypatch):
    """Time went with the products, ten written tables a round, at some two seconds each whatever the graph's size."""
    written, write = [], diffusion.settled
    monkeypatch.setattr(diffusion, "settled", lambda df: written.append(1) or write(df))
    edges = spark.createDataFrame(edges_of(3, graphs[3], 3000), SCHEMA)
    monkeypatch.setattr(diffusion, "ROWS", 64)  # vectors of 500 nodes meet in eight ranges
    found = diffusion.spectrum(edges, 26)
    assert np.allclose(found.values[3], eigen(graphs[3])[0][:26], rtol=0, atol=1e-8)
    assert len(written) <= 20
    y = np.array([r[2:28] for r in found.vectors.orderBy("v").collect()])
    assert np.allclose(y.T @ y, np.eye(26), atol=1e-8)


def test_graphs_too_large_for_a_task_go_by_joins(spark, graphs, monkeypatch):
    rows = edges_of(8, graphs[8], 8000) + edges_of(9, graphs[9], 9000)
    monkeypatch.setattr(diffusion, "HELD", 100)  # graph 9 has seven links with its nodes' own
    joined, by_joins = [], diffusion._by_joins
    monkeypatch.setattr(diffusion, "_by_joins", lambda links, *more: joined.extend(r["g"] for r in links.select("g").distinct().collect()) or by_joins(links, *more))
    found = diffusion.spectrum(spark.createDataFrame(rows, SCHEMA), 4)
    assert joined == [8] and set(found.values) == {8, 9}
    for g in (8, 9):
        assert np.allclose(found.values[g], eigen(graphs[g])[0][:4], rtol=0, atol=1e-8)
    assert {r["g"]: r["count"] for r in found.vectors.groupBy("g").count().collect()} == {8: 120, 9: 3}
