"""Pair queries over all classes, and ranks without a bound on the list."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from strata.operators import blocks, similarity
from strata.plans import registry

SF = "/root/testdata/sf0.001"


def test_ranks_both_ways_match_brute_force(spark):
    rng = np.random.default_rng(1)
    vecs, group = rng.normal(size=(60, 4)), rng.integers(0, 2, 60)
    vecs[40:44] = vecs[3]
    u = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 12)
    rank = {(i, j): r + 1 for i in range(60) for r, j in enumerate(sorted((j for j in range(60) if j != i and group[i] == group[j]), key=lambda j: (-sims[i, j], j)))}
    expected = sorted((i, j, r, rank[j, i]) for (i, j), r in rank.items() if r <= 5 and (r, i) < (rank[j, i], j))
    side = spark.createDataFrame([(i, list(map(float, v)), int(g)) for i, (v, g) in enumerate(zip(vecs, group, strict=True))], "id long, v array<double>, g long")
    for block in (7, 1000):  # 7: ranks beyond what one block holds
        assert sorted(map(tuple, similarity.both_ways(side, 5, block).collect())) == expected


def test_every_class_has_its_rows(spark):
    for name in ("pair_zscore_by_class", "pair_auroc_by_class", "rank_both_ways_by_class"):
        assert {r["coarse"] for r in registry.queries()[name](spark, SF).select("coarse").distinct().collect()} == {0, 1, 2, 3}
    z = registry.queries()["pair_zscore_by_class"](spark, SF).where("coarse = 0")
    assert z.drop("coarse").exceptAll(registry.queries()["pair_zscore"](spark, SF)).count() == 0
    whole = registry.queries()["pair_auroc"](spark, SF).first()["auroc"]
    assert registry.queries()["pair_auroc_by_class"](spark, SF).where(F.col("coarse") == 2).first()["auroc"] == whole


def test_a_block_keeps_its_best_of_all_blocks_of_a_bucket(spark):
    rng = np.random.default_rng(3)
    vecs = np.round(rng.normal(size=(90, 3)), 1)
    vecs[50:60], vecs[7] = vecs[4], 0
    with np.errstate(invalid="ignore"):
        u = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 12)
    side = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vecs)], "id long, v array<double>").repartition(2)
    expected = sorted((i, j, r + 1) for i in range(90) if i != 7 for r, j in enumerate(sorted((j for j in range(90) if j not in (i, 7)), key=lambda j: (-sims[i, j], j))[:4]))
    for block in (5, 1000):
        assert sorted(map(tuple, similarity.top_k(side, side, 4, block).select("a", "b", "rank").collect())) == expected
        found = similarity.closest(side, 30, block).collect()
        assert [(r["a"], r["b"]) for r in found] == sorted(((i, j) for i in range(90) for j in range(i + 1, 90) if 7 not in (i, j)), key=lambda p: (-sims[p], p))[:30]
    count = lambda own, others: [pd.DataFrame({"n": [len(own.ids) * sum(len(o.ids) for o in others)], "runs": [1]})]
    met = blocks.block_runs(side, side, count, "n long, runs long", block=5).agg(F.sum("n"), F.sum("runs")).first()
    assert met[0] == 90 * 90 and met[1] < 18 * 18  # blocks meet in runs, not one by one


def test_all_pairs_of_a_class_without_moving_them(spark):
    rng = np.random.default_rng(5)
    vecs, group, label = np.round(rng.normal(size=(50, 3)), 1), rng.integers(0, 2, 50), rng.integers(0, 2, 50)
    vecs[20:24] = vecs[3]
    u = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 12)
    side = spark.createDataFrame([(i, list(map(float, vecs[i])), int(group[i]), int(label[i])) for i in range(50)], "id long, v array<double>, g long, y int")
    pairs = {g: [(i, j) for i in range(50) for j in range(50) if i != j and group[i] == group[j] == g] for g in (0, 1)}
    place = {(i, j): r + 1 for i in range(50) for r, j in enumerate(sorted((j for j in range(50) if j != i and group[j] == group[i]), key=lambda j: (-sims[i, j], j)))}
    for block in (4, 1000):
        assert {(r["a"], r["b"]): r["rank"] for r in similarity.all_ranks(side.drop("y"), block).collect()} == place
        scores = {(r["a"], r["b"]): r["z"] for r in similarity.pair_scores(side.drop("y"), block).collect()}
        areas = {r["g"]: r["auroc"] for r in similarity.pair_auroc(side, "y", block).collect()}
        for g, own in pairs.items():
            x = np.array([sims[p] for p in own])
            assert np.allclose([scores.pop(p) for p in own], (x - x.mean()) / x.std(), atol=1e-9)
            half = [(round(sims[p], 9), label[p[0]] == label[p[1]]) for p in own if p[0] < p[1]]
            yes, no = np.array([s for s, same in half if same]), np.array([s for s, same in half if not same])
            assert areas[g] == pytest.approx(((yes[:, None] > no) + (yes[:, None] == no) / 2).mean(), abs=1e-12)
        assert not scores


def test_identity_precision_covers_every_class(spark):
    found = {r["coarse"]: (r["precision"], r["chance"]) for r in registry.queries()["identity_precision"](spark, SF).collect()}
    assert set(found) == {0, 1, 2, 3} and found[0] == (1.0, 1.0)


def test_a_whole_group_is_copied_for_buckets_not_for_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(160, 8)).astype(np.float32)
    side = spark.createDataFrame([(i, list(map(float, v)), 0) for i, v in enumerate(vecs)], "id long, v array<float>, g long").repartition(1)
    buckets, dealt = blocks._buckets, {}
    monkeypatch.setattr(blocks, "_buckets", lambda *a: dealt.setdefault(a[-1], buckets(*a)))
    sent = blocks.block_runs(side, side, lambda own, others: [pd.DataFrame({"n": [len(own.ids)], "held": [sum(len(o.ids) for o in others)]})], "n long, held long", block=2, whole=True)
    assert sent.agg(F.sum("n"), F.min("held"), F.max("held")).first() == (160, 160, 160)
    assert dealt["q_buckets"].first()["q_buckets"] == 10  # copies of the group; its 80 blocks made 80
    held = blocks.packed(side, [], True, 64).select(F.sum(F.length("v")).alias("n")).first()["n"]
    assert held == 160 * 8 * 4  # single precision is not widened before it is copied
    u = (w := vecs.astype(np.float64)) / np.linalg.norm(w, axis=1, keepdims=True)
    first = similarity.all_ranks(side, 2).where("rank = 1").collect()
    sims = np.round(u @ u.T, 12) - 4 * np.eye(160)
    assert {r["a"]: r["b"] for r in first} == dict(enumerate(sims.argmax(axis=1).tolist()))


def test_auroc_in_rounds_equals_one_and_sends_equal_pairs_once(spark, monkeypatch):
    rng = np.random.default_rng(11)
    vecs, label = np.round(rng.normal(size=(120, 3)), 1), rng.integers(0, 3, 120)
    vecs[30:70], vecs[5] = vecs[3], 0  # copies, and a row without a length
    side = spark.createDataFrame([(i, list(map(float, v)), i % 2, int(y)) for i, (v, y) in enumerate(zip(vecs, label, strict=True))], "id long, v array<double>, g long, y int").repartition(3)
    with np.errstate(invalid="ignore"):
        u = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    sims, expected = np.round(u @ u.T, 9), {}
    for g in (0, 1):
        own = [(i, j) for i in range(120) for j in range(i + 1, 120) if i % 2 == j % 2 == g and 5 not in (i, j)]
        yes, no = (np.array([sims[p] for p in own if (label[p[0]] == label[p[1]]) == same]) for same in (True, False))
        expected[g] = ((yes[:, None] > no) + (yes[:, None] == no) / 2).mean()
    rounds, pack = [], similarity._packed_pairs
    monkeypatch.setattr(similarity, "_packed_pairs", lambda *a: rounds.append(pack(*a)) or rounds[-1])
    for block in (7, 1000):
        for most in (1 << 30, 1500):  # all pairs at once, and some 1,500 of the 3,500 at a time
            rounds.clear()
            monkeypatch.setattr(similarity, "ROUND_PAIRS", most)
            monkeypatch.setattr(similarity, "ROW_PAIRS", 1)
            found = {r["g"]: r["auroc"] for r in similarity.pair_auroc(side, "y", block).collect()}
            assert found == {g: pytest.approx(x, abs=1e-12) for g, x in expected.items()}
            sent = [r.select(F.sum(F.when(F.col("times").isNull(), F.length("low") / 2).otherwise(0)), F.count("times")).first() for r in rounds]
            assert len(rounds) == 1 if most > 1500 else len(rounds) > 1
            if most == 1500 and block == 1000:
                assert max(n or 0 for n, _ in sent) < 2000 and sum(t for _, t in sent) > 0


def test_files_hold_the_scores_of_both_directions_once(spark, tmp_path):
    vecs = np.random.default_rng(13).normal(size=(600, 16))
    vecs[7] = 0
    side = spark.createDataFrame([(i, list(map(float, v)), 4) for i, v in enumerate(vecs)], "id long, v array<double>, g long").repartition(1)
    similarity.pair_scores(side, 100).select("a", "b", F.round("z", 5).alias("z")).coalesce(1).write.parquet(str(tmp_path / "z"))
    found = spark.read.parquet(str(tmp_path / "z")).toPandas()
    assert len(found) == len(found[["a", "b"]].drop_duplicates()) == 599 * 598 and not (found["a"] == found["b"]).any()
    both = found.merge(found, left_on=["a", "b"], right_on=["b", "a"])
    assert (both["z_x"] == both["z_y"]).all()
    assert sum(p.stat().st_size for p in (tmp_path / "z").glob("*.parquet")) < 7 * len(found)  # over 8 bytes a row in the order of the blocks
