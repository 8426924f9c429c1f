"""Shares that covariates tell, against plain leave-one-out regressions, and the shuffled control."""

import hashlib

import numpy as np
import pytest
from strata.operators import nuisance

PLAIN = [float(x) for x in np.logspace(-2, 3, 12)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    out = []
    for g, noise in ((1, 0.3), (2, 3.0)):
        c = rng.normal(size=(70, 2))
        x = c @ rng.normal(size=(2, 4)) + noise * rng.normal(size=(70, 4))
        out += [(1000 * g + i, g, x[i].tolist(), *c[i].tolist(), 1.0) for i in range(70)]
    out += [(9000 + i, 3, [float(i), 1.0, 0.0, 2.0], 0.0, 1.0, 1.0) for i in range(5)]  # too few rows
    return [*out, (1, 1, None, 0.0, 0.0, 1.0), (2, 1, [1.0] * 4, None, 0.0, 1.0), (3, None, [1.0] * 4, 0.0, 0.0, 1.0)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, g long, v array<double>, a double, b double, same double").repartition(5)


def fold_of(i, folds=5, seed=0):
    return int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16) % folds


def ridge(x, y, penalty):
    mean, own = x.mean(axis=0), y.mean(axis=0)
    w = np.linalg.solve((x - mean).T @ (x - mean) + penalty * np.eye(x.shape[1]), (x - mean).T @ (y - own))
    return lambda new: (new - mean) @ w + own


def plain(ids, v, c, n_components):
    z = v - v.mean(axis=0)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    y, eigenvalues = (u * s)[:, :n_components], s[:n_components] ** 2
    fold, predicted = np.array([fold_of(i) for i in ids]), np.zeros_like(y)
    for f in range(5):
        fit = fold != f
        mean, deviation = c[fit].mean(axis=0), c[fit].std(axis=0)
        x = (c - mean) / np.where(deviation > 0, deviation, 1)
        losses = []
        for penalty in PLAIN:
            loss, own = 0.0, np.flatnonzero(fit)
            for i in own:  # one row left out at a time; the others are not centred anew in the shortcut's place
                others = own[own != i]
                loss += ((y[i] - ridge(x[others], y[others], penalty)(x[i])) ** 2).sum()
            losses.append(loss)
        predicted[~fit] = ridge(x[fit], y[fit], PLAIN[int(np.argmin(losses))])(x[~fit])
    r2 = 1 - ((y - predicted) ** 2).sum(axis=0) / ((y - y.mean(axis=0)) ** 2).sum(axis=0)
    return (eigenvalues * r2).sum() / eigenvalues.sum(), r2[0]


def test_shares_equal_a_plain_version(df, rows):
    got = {r["g"]: r for r in nuisance.explained(df, ["a", "b"], 3).collect()}
    assert set(got) == {1, 2}
    for g in got:
        own = [r for r in rows if r[1] == g and r[2] is not None and r[3] is not None]
        share, first = plain([r[0] for r in own], np.array([r[2] for r in own]), np.array([r[3:5] for r in own]), 3)
        assert got[g]["n"] == 70 and np.isclose(got[g]["share"], share) and np.isclose(got[g]["r2_first"], first)


def test_shuffled_covariates_are_dealt_within_groups(df, rows):
    got = nuisance.shuffled(df.select("id", "g", "a"), ["a"]).collect()
    own = [r for r in rows if r[1] is not None]
    key = lambda x: (x is None, x or 0.0)
    for g in (1, 2, 3):
        assert sorted((r["a"] for r in got if r["g"] == g), key=key) == sorted((r[3] for r in own if r[1] == g), key=key)
    assert sorted(r["id"] for r in got) == sorted(r[0] for r in own)
    before = {r[0]: r[3] for r in own}
    assert sum(r["a"] == before[r["id"]] for r in got if r["g"] == 1) < 10


def test_table_and_summary(df):
    found = nuisance.table(df, {"both": ["a", "b"], "constant": ["same"]}, control="both", n_components=3)
    rows = {r["g"]: r for r in found.collect()}
    assert rows[1]["both_share"] > 0.9 and rows[1]["shuffled_share"] < 0.2 and rows[1]["constant_share"] < 0.01
    told = {r["metric"]: r for r in nuisance.summary(found, 200).collect()}
    assert np.isclose(told["both_share"]["mean"], np.mean([r["both_share"] for r in rows.values()]))
    assert told["both_share"]["lo"] <= told["both_share"]["mean"] <= told["both_share"]["hi"]
    assert told["shuffled_share"]["band"] == "low" and told["both_r2_first"]["band"] is None


def test_no_rows(spark, df):
    assert nuisance.explained(df.where("id < 0"), ["a"]).count() == 0
