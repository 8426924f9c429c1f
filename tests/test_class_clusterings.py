"""Batched clusterings, spectra and probes against numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from strata.operators import clusterings, fits, losses, spectra, synthesis
from strata.operators.clusterings import Fit


def frame(spark, x, g, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), int(c), list(map(float, v))) for i, c, v in zip(ids, g, x, strict=True)], "id long, g long, v array<double>")


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0], [9, 0], [0, 9]])
    x = np.concatenate([c + rng.normal(size=(20, 2)) * 0.3 for c in centres] + [rng.uniform(size=(40, 2))])
    return x, np.array([0] * 60 + [1] * 40), np.array([0] * 20 + [1] * 20 + [2] * 20 + [0] * 40)


def test_fits_are_fixpoints_of_their_class(spark, blobs):
    x, g, _ = blobs
    found = clusterings.fit_many(frame(spark, x, g), [Fit(0, 3), Fit(1, 4), Fit(7, 2)], starts=2)
    assert set(found) == {Fit(0, 3), Fit(1, 4)}
    for f, (centres, inertia) in found.items():
        own = x[g == f.g]
        square = ((own[:, None] - centres[None]) ** 2).sum(axis=2)
        best = square.argmin(axis=1)
        assert np.isclose(inertia, square.min(axis=1).sum())
        for c in range(f.k):
            assert np.allclose(centres[c], own[best == c].mean(axis=0), atol=1e-6)


def test_null_vectors_and_classes_take_no_part(spark):
    df = spark.createDataFrame([(0, 0, [0.0]), (1, 0, [1.0]), (2, 0, None), (3, None, [5.0]), (4, 0, [None])], "id long, g long, v array<double>")
    found = clusterings.fit_many(df, [Fit(0, 2)])
    assert sorted(found[Fit(0, 2)][0].ravel()) == [0.0, 1.0]


def silhouette(x, y):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        own = (y == y[i]).sum()
        if own == 1:
            out.append(0.0)
            continue
        a = d[i, y == y[i]].sum() / (own - 1)
        b = min(d[i, y == c].mean() for c in set(y) if c != y[i])
        out.append((b - a) / max(a, b))
    return np.mean(out)


def test_silhouettes_match_brute_force(spark, blobs, monkeypatch):
    x, g, y = blobs
    labels = np.stack([y, (np.arange(len(x)) % 4), np.zeros(len(x), int)], axis=1)
    df = spark.createDataFrame([(i, int(c), list(map(float, v)), [int(z) for z in l]) for i, (c, v, l) in enumerate(zip(g, x, labels, strict=True))], "id long, g long, v array<double>, labels array<int>")
    found = {(r["g"], r["at"]): r["score"] for r in clusterings.silhouettes(df, [0, 1, 2]).collect()}
    assert np.isclose(found[0, 0], silhouette(x[:60], y[:60])) and np.isclose(found[0, 1], silhouette(x[:60], labels[:60, 1]))
    assert found[0, 2] is None and found[1, 0] is None


def test_k_is_found_without_labels(spark, blobs):
    x, g, _ = blobs
    chosen = clusterings.choose_k(frame(spark, x, g), k_max=5, references=4, starts=2)
    assert chosen[0] == (3, "silhouette") and chosen[1][1] in ("silhouette", "gap")
    lone = np.random.default_rng(0).normal(size=(60, 20))  # one round cloud in many dimensions has no good split
    assert clusterings.choose_k(frame(spark, lone, [5] * 60), k_max=4, references=6)[5] == (1, "gap")


def test_gap_choice():
    assert clusterings.gap_choice({1: 10.0, 2: 9.9, 3: 9.8}, {1: [10, 11], 2: [7, 8], 3: [5, 6]}) == 1
    assert clusterings.gap_choice({1: 100.0, 2: 1.0, 3: 0.9}, {1: [100, 101], 2: [50, 51], 3: [40, 41]}) == 2
    assert clusterings.gap_choice({1: 4.0}, {1: [4, 5]}) == 1


def test_stable_clusters_agree_over_seeds_and_resamples(spark, blobs):
    x, g, _ = blobs
    rows = clusterings.stability_labels(frame(spark, x, g), {0: 3}, seeds=2, resamples=2, starts=4).collect()
    assert len(rows) == 60
    table = np.array([r["labels"] for r in rows])
    for j in range(1, 4):
        assert len(set(map(tuple, table[:, [0, j]]))) == 3


def test_resampling_weights_are_poisson():
    w = clusterings._view(np.arange(200_000), np.zeros((200_000, 1)), -5, None)[1]
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    u = clusterings.uniforms(np.arange(50_000), 2, 3)
    assert u.min() >= 0 and u.max() < 1 and np.abs(u.mean(axis=0) - 0.5).max() < 0.01 and abs(np.corrcoef(u.T)[0, 1]) < 0.02


def test_fits_by_name(spark, blobs):
    x, g, _ = blobs
    out = fits.fitter("k_means", starts=2)(frame(spark, x, g), {0: 3}).collect()
    assert len({r["c"] for r in out}) == 3 and {r["g"] for r in out} == {0}
    with pytest.raises(KeyError):
        fits.fitter("nothing")
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "g int, x double")
    assert {(r["group"], r["mean"]) for r in fits.class_table(df, "g", {"m": lambda: F.avg("x")}).collect()} == {("0", 2.0), ("1", 5.0), ("macro", 3.5)}


def test_axes_and_scores_match_svd(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1])
    df = frame(spark, x, [0] * 40 + [1] * 10)
    found = {r["g"]: r for r in spectra.axes(df, 3).collect()}
    for g, own in ((0, x[:40]), (1, x[40:])):
        u, s, vt = np.linalg.svd(own - own.mean(axis=0), full_matrices=False)
        assert np.allclose(found[g]["eigenvalues"], s[:3] ** 2)
        assert np.allclose(np.abs(np.array(found[g]["axes"]) @ vt[:3].T), np.eye(3), atol=1e-8)
    scored = {r["id"]: r["v"] for r in spectra.scores(df, spectra.axes(df, 3), 5).collect()}
    u, s, vt = np.linalg.svd(x[:40] - x[:40].mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(np.array([scored[i] for i in range(40)])[:, :3]), np.abs(u[:, :3] * s[:3])) and scored[0][3:] == [0.0, 0.0]


def test_residuals_and_shares(spark):
    rng = np.random.default_rng(6)
    c = rng.normal(size=(80, 2))
    x = c @ rng.normal(size=(2, 4)) * 3 + 1 + rng.normal(size=(80, 4)) * 0.1
    rows = [(i, 0, list(map(float, v)), float(a), float(b)) for i, (v, (a, b)) in enumerate(zip(x, c, strict=True))]
    df = spark.createDataFrame(rows, "id long, g long, v array<double>, a double, b double")
    design = np.column_stack([np.ones(80), c])
    expected = x - design @ np.linalg.lstsq(design, x, rcond=None)[0]
    got = np.array([r["v"] for r in spectra.residuals(df, ["a", "b"]).orderBy("id").collect()])
    assert np.allclose(got, expected)
    told = spectra.explained_share(df, ["a", "b"], 2).first()
    assert told["share"] > 0.98 and told["r2_first"] > 0.98
    noise = spectra.explained_share(df.withColumn("a", F.rand(1)).withColumn("b", F.rand(2)), ["a", "b"], 2).first()
    assert noise["share"] < 0.3


def test_probe_tells_separable_classes(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(30, 3)) + 4 * np.eye(3)[k] for k in range(3)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, i // 30, list(map(float, v))) for i, v in enumerate(x)], "id long, y int, u array<double>")
    assert spectra.probe(df.where("id % 2 = 0"), df.where("id % 2 = 1")).agg(F.avg(F.col("correct").cast("int"))).first()[0] > 0.9


def test_groups_match_at_least_cost(spark):
    cost = np.random.default_rng(8).uniform(size=(3, 4))
    df = spark.createDataFrame([(0, i, j, float(cost[i, j])) for i in range(3) for j in range(4)], "g long, grp long, fine long, kid double")
    best = min(np.mean([cost[i, p[i]] for i in range(3)]) for p in itertools.permutations(range(4), 3))
    got = synthesis.match_groups(df).first()
    assert np.isclose(got["matched_kid"], best) and got["n_matched"] == 3


def test_fine_to_coarse_matches_brute_force():
    rng = np.random.default_rng(9)
    for n, m, penalty in ((4, 2, 0.0), (5, 3, 0.7), (3, 3, 0.2)):
        votes = rng.uniform(size=(n, m))

        def value(choice, votes=votes, penalty=penalty):
            sizes = np.bincount(choice, minlength=votes.shape[1])
            return sum(votes[i, c] for i, c in enumerate(choice)) - penalty * (sizes * (sizes - 1) / 2).sum()

        best = max((c for c in itertools.product(range(m), repeat=n) if len(set(c)) == m), key=value)
        assert np.isclose(value(losses.fine_to_coarse(votes, penalty)), value(best))
    with pytest.raises(ValueError):
        losses.fine_to_coarse(np.zeros((1, 2)))


def test_equal_assignment(spark):
    s = np.random.default_rng(10).normal(size=(60, 4)) + [2, 0, 0, 0]
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(s)], "id long, s array<double>")
    q = np.array([r["q"] for r in losses.sinkhorn(df, F.col("s"), epsilon=0.5, tolerance=1e-3).orderBy("id").collect()])
    assert np.allclose(q.sum(axis=1), 1) and np.abs(q.mean(axis=0) - 0.25).sum() <= 1e-3
    assert losses.sinkhorn(df.limit(0), F.col("s")).count() == 0
