import re
from itertools import combinations

import numpy as np
from strata.llm import neardup
from strata.llm.components import components


def brute(rows, shingle, percent):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        n = min(shingle, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if root(k) == root(i) and d is not None]
        least = min(ids) if ids and sets[i] else doc_id
        out.append((doc_id, len(sets[i]), least, doc_id is not None and doc_id == least))
    return sorted(out, key=str)


def test_same_as_brute_force(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(12):
        base = list(rng.choice(vocabulary, rng.integers(5, 60)))
        for _ in range(9):
            own = list(base)
            for _ in range(rng.integers(0, 4)):
                own[rng.integers(len(own))] = str(rng.choice(vocabulary))
            rows.append(" ".join(own))
    rows += [None, "", " \t\r", "one", "ONE", "one two", "One\vTwo", "É é", "é é", "a b " * 3000]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows)]
    rows += [(3, "one two"), (3, "one two"), (None, "one"), (None, None)]
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, kept int")
    for shingle, percent in ((2, 80), (5, 80), (1, 50)):
        out = neardup.near_duplicates(df, shingle, percent)
        got = sorted((tuple(r) for r in out.select("src.doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
        assert got == brute(rows, shingle, percent)
        assert out.select("src.kept").first()[0] == 5
    assert neardup.near_duplicates(df.limit(0), 2, 80).count() == 0


def test_many_texts_with_one_line(spark):
    rng = np.random.default_rng(5)
    line = " ".join(f"c{i}" for i in range(40))
    rows = [(i, f"{line} " + " ".join(f"o{k}" for k in rng.integers(0, 12, rng.integers(3, 8)))) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 90):
        out = neardup.near_duplicates(df, 2, percent)
        got = sorted((tuple(r) for r in out.select("src.doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
        assert got == brute(rows, 2, percent)


def test_pairs_across_components_hold_all_links(spark):
    rng = np.random.default_rng(6)
    line = " ".join(f"c{i}" for i in range(30))
    texts = [f"{line} " + " ".join(f"o{k}" for k in rng.integers(0, 9, rng.integers(2, 12))) for _ in range(150)]
    sets = [neardup.shingle_set(t.encode(), 2) for t in texts]
    component = [int(c) for c in rng.integers(0, 4, len(texts))]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "node long, row long, text string")
    rows = docs.selectExpr("row", "named_struct('text', text) AS src")
    crowded = spark.createDataFrame([(i, len(s), c) for i, (s, c) in enumerate(zip(sets, component))], "node long, n long, component long")
    got = {(r["a"], r["b"]) for r in neardup._across(crowded, docs.select("node", "row"), rows, 2, 80).collect()}
    linked = set()
    for i, j in combinations(range(len(texts)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if component[i] != component[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            linked.add((i, j))
    assert linked and linked <= got
    assert all(component[i] != component[j] for i, j in got)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    universe = rng.integers(0, 1 << 64, 1500, dtype=np.uint64)
    a, b = np.sort(universe[:1000]), np.sort(universe[200:1200])
    s = neardup.signatures(np.concatenate([a, b]), np.array([0, 1000]), 2000)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.05


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (200, 300), (300, 200), (50, 60)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**dict.fromkeys(range(1, 41), 1), 100: 90, 90: 90, 95: 90, 200: 200, 300: 200, 50: 50, 60: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
