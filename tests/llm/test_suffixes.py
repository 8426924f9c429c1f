import hashlib

import numpy as np
import pytest
from strata.llm import suffixes


def brute(texts, length):
    seen, out = {}, []
    raw = [(t or "").encode() for t in texts]
    for t in raw:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    word = lambda n: "".join(rng.choice(list("abcé \n"), n))
    passage, other = word(150), word(60)
    texts = [word(int(rng.integers(0, 200))) for _ in range(25)]
    texts += [word(30) + passage[int(rng.integers(0, 60)) : int(rng.integers(90, 150))] + word(20) for _ in range(25)]
    texts += [word(5) + other + word(int(rng.integers(0, 9))) + other for _ in range(6)]
    for _ in range(20):
        t = list(passage)
        t[int(rng.integers(150))] = "X"
        texts.append("".join(t))
    return [*texts, *texts[:4], passage, None, "", "a" * 300, "ab" * 100, "a" * 39, "a" * 40]


@pytest.mark.parametrize(("seed", "split"), [(0, 1000), (1, 3), (2, 1)])
def test_same_as_brute_force(spark, seed, split):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(3)
    out = suffixes.remove_repeats(df, length=40, k=12, with_text=True, split=split).orderBy("doc_id").collect()
    got = [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out]
    assert got == brute(texts, 40)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in out)


def brute_words(rows, length):
    found = {}
    split = {row: (row[1] or "").encode().split() for row in rows}
    for row, words in split.items():
        for i in range(len(words) - length + 1):
            found.setdefault(tuple(words[i : i + length]), set()).add(row)
    out = []
    for row in rows:
        words, hit = split[row], set()
        for i in range(len(words) - length + 1):
            if len(found[tuple(words[i : i + length])]) > 1:
                hit.update(range(i, i + length))
        out.append(len(hit))
    return out


@pytest.mark.parametrize(("seed", "split"), [(0, 1000), (1, 3), (2, 1)])
def test_shared_words_as_brute_force(spark, seed, split):
    rng = np.random.default_rng(seed)
    words = lambda n: list(rng.choice(["ab", "c", "\xe9", "\x85", "d."], n))
    passage, other, own = words(80), words(30), words(25)
    texts = [words(int(rng.integers(0, 60))) for _ in range(20)]
    texts += [words(15) + passage[int(rng.integers(0, 30)) : int(rng.integers(45, 80))] + words(9) for _ in range(25)]
    texts += [words(5) + other + words(int(rng.integers(0, 9))) + other for _ in range(6)]
    texts += [own + words(7) + own + words(3) + own, ["zz"] * 90, ["zz"] * 10 + ["y"] * 30, ["y"] * 19, ["y"] * 20]
    for _ in range(20):
        texts.append(list(passage))
        texts[-1][int(rng.integers(80))] = "X"
    texts = ["".join(w + str(rng.choice([" ", "\n", "\t  ", "\x0b"])) for w in t) for t in texts] + [None, "", " ", "c"]
    rows = [*enumerate(texts), *enumerate(texts[20:24], 500), (500, texts[20]), (7, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffixes.remove_repeats(df, length=40, k=12, split=split, words=20, word_k=4).collect()
    expected = sorted(zip([r[0] for r in rows], brute_words(rows, 20), strict=True))
    assert sorted((r["doc_id"], r["n_shared_words"]) for r in got) == expected
    assert any(n for _, n in expected) and dict(expected)[51] == 0


def test_passages_too_short_in_bytes(spark):
    passage = " ".join(f"w{i}" for i in range(55))
    lines = " ".join(f"v{i}" for i in range(60))
    texts = ["one " + passage + " end", "two\n" + passage.replace(" ", "\n"), " ".join(passage.split()[:50]), lines + " and " + lines, None]
    out = suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert len(passage.encode()) < suffixes.LENGTH and [(r["n_removed"], r["n_shared_words"]) for r in out] == [(0, 55), (0, 55), (0, 0), (0, 0), (0, 0)]


def test_hashed_words_in_slices(monkeypatch):
    text = b" ab \n cd" * 50 + b"x" * 300 + b"\x0b\x0cab\r"
    whole = suffixes.hashed_words(text)
    monkeypatch.setattr(suffixes, "SLICE", 7)
    assert suffixes.hashed_words(text) == whole and len(whole) == suffixes.WORD * 101 and whole[:8] == whole[-8:]


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(7, "x" * 10 + "abcdefghij" * 5), (7, "x" * 10 + "abcdefghij" * 5), (None, "q")], "doc_id long, text string")
    out = sorted(map(tuple, suffixes.remove_repeats(df, 40, 12).collect()), key=str)
    assert [r[1:4] for r in out] == [(60, 60, 1), (60, 60, 1), (1, 0, 0)]
    assert suffixes.remove_repeats(df.limit(0), 40, 12).count() == 0


def test_slices(monkeypatch):
    text = bytes(np.random.default_rng(3).integers(97, 100, 3000, dtype=np.uint8))
    whole = {(a, w) for a, f, l, _ in suffixes.anchors(text, 40, 12) for w in range(f, l + 1)}
    monkeypatch.setattr(suffixes, "SLICE", 101)
    assert {(a, w) for a, f, l, _ in suffixes.anchors(text, 40, 12) for w in range(f, l + 1)} == whole
    assert len(whole) == len(text) - 39


def test_sorts():
    rng = np.random.default_rng(4)
    strings = [bytes(rng.integers(97, 99, rng.integers(0, 40), dtype=np.uint8)) for _ in range(300)]
    flat = [i for own in suffixes.shallow_sort(strings, 48) for i in own]
    assert [strings[i] for i in flat] == sorted(strings)
    order, shares = suffixes.blind_sort(strings, list(range(300)), 0)
    assert [strings[i] for i in order] == sorted(strings)
    assert shares == [suffixes.common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]
