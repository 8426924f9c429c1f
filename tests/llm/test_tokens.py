import json
import bisect
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from strata.llm import packing, tokens
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "  ", "Hello, World!! it's o'clock 12345 naïve ÉTÉ", "<|endoftext|> a<|startoftext|>b", "x\x1cy \x85z q", "ß ſt İI ΣΑΣ ẞ é ́a ﬁ", "a" * 5000, "The the THE the, the." * 40, "日本 語!? ٣٤ $#@ 'll 've don't"]


def brute(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    packed = tokens.pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    for start, count in ((0, 1001), (17, 100), (1000, 1), (5, 0)):
        assert (tokens.unpack(packed, bits, start, count) == ids[start : start + count]).all()


def test_words_encode_as_whole_texts():
    words = tokens.WordEncoder(open(PATH, encoding="utf-8").read(), True, 50)  # so few that generations change
    assert tokens._word_local(json.loads(open(PATH, encoding="utf-8").read()))
    for text in TEXTS:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == brute(text), text


def test_store(spark, tmp_path):
    rows = [(i * 7 % 10, t, "x") for i, t in enumerate(TEXTS)] + [(3, "again", "y"), (3, "again", "y"), (None, "nil", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    tokens.write_tokens(df, f"{tmp_path}/t", PATH, end_id=2, block_tokens=50)
    out = [r.asDict() for r in tokens.read_documents(spark, f"{tmp_path}/t", with_ids=True).orderBy("start").collect()]
    assert [r["doc_id"] for r in out] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    place, everything = 0, []
    texts = {}
    for d, t, _ in rows:
        texts.setdefault(d, []).append(brute(t) + [2])
    for r in out:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        texts[r["doc_id"]].remove(ids)
        assert r["start"] == place and r["n_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        place += len(ids)
        everything += ids
    assert not any(texts.values())
    assert tokens.read_range(spark, f"{tmp_path}/t", 40, 300).tolist() == everything[40:340]
    tokens.write_tokens(df.limit(0), f"{tmp_path}/e", PATH, end_id=2)
    assert tokens.read_documents(spark, f"{tmp_path}/e").count() == 0


def test_knapsack_is_optimal():
    values = np.array([0, 3.0, 5.0, 0, 9.5])
    chosen = packing.knapsack(values, 11)
    assert (chosen * np.arange(1, 6)).sum() <= 11 and (chosen * values).sum() == pytest.approx(19.5)  # sizes 3, 3, 5


def test_bounded_knapsack_is_optimal():
    rng = np.random.default_rng(3)
    sizes, bounds = np.array([2, 3, 5, 7]), np.array([3, 1, 2, 1])
    for _ in range(20):
        values = rng.integers(1, 20, 4)
        best = packing.Knapsack(sizes, values, bounds, 20)
        for room in range(21):
            every = [p for p in itertools.product(*(range(b + 1) for b in bounds)) if np.dot(p, sizes) <= room]
            found = best.filling(room)
            pieces = np.array([found.get(s, 0) for s in sizes.tolist()])
            assert (pieces <= bounds).all() and pieces @ sizes <= room and pieces @ values == max(np.dot(p, values) for p in every)


def test_configurations_are_full_and_pack_most():
    demand = np.random.default_rng(4).geometric(0.01, 60_000)
    demand = np.bincount(demand[demand <= 512], minlength=513)[1:]
    covered, sequences = np.zeros(512, int), 0
    for chosen, copies in packing.configurations(demand, 512):
        assert copies > 0 and sum(size * pieces for size, pieces in chosen.items()) == 512
        for size, pieces in chosen.items():
            covered[size - 1] += pieces * copies
        sequences += copies
    _, n = packing.plan_runs(demand, 512)
    assert (covered <= demand).all() and n == -(-(demand * np.arange(1, 513)).sum() // 512) and sequences > 0.5 * n


def test_plan_is_whole_and_tight():
    demand = np.random.default_rng(0).integers(0, 60, 128)
    demand[127] = 500
    runs, n = packing.plan_runs(demand, 128, rounds=300)
    fill, seen = np.zeros(n, int), np.zeros(128, int)
    for kind, first, count, sequence, _ in runs:
        fill[sequence : sequence + count] += kind
        seen[kind - 1] += count
    assert (seen == demand).all() and fill.max() <= 128
    rooms = []
    for size in np.repeat(np.arange(1, 129), demand)[::-1]:  # best-fit decreasing
        at = bisect.bisect_left(rooms, size)
        bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else 128) - size)
    assert n <= 1.02 * len(rooms)
    assert packing.plan_runs(np.zeros(8, int), 8) == ([], 0)


def test_packing(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(3, "again", 1), (3, "again", 1), (50, "word " * 400, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    out = packing.pack_documents(df, PATH, end_id=1, length=64, rounds=50, with_ids=True).toPandas()
    expected = sum(-(-(len(brute(t)) + 1) // 64) for _, t, _ in rows)
    assert len(out) == expected and out["length"].max() <= 64
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 64
    whole = out[out.doc_id == 50].sort_values("piece")
    assert np.concatenate([np.frombuffer(x, "<u4") for x in whole["ids"]]).tolist() == brute("word " * 400) + [1]
    assert packing.pack_documents(df.limit(0), PATH, end_id=1).count() == 0
