"""Whole operators and the pipeline's stages against plain versions, and very long texts, ties and large numbers."""

import math
import random
import re
import time
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from strata.llm import common, decontaminate, langid, packing, pii, queries, suffixes, urls, vectors
from tests.llm.test_text import brute
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


class Bayes:
    """Multinomial naive Bayes over hashed n-grams, one n-gram at a time."""

    def __init__(self, rows, buckets):
        self.buckets = buckets
        self.counts = {lang: Counter() for lang in sorted({lang for _, lang in rows})}
        self.seen = Counter(lang for _, lang in rows)
        for text, lang in rows:
            self.counts[lang].update(self.grams(text))

    def grams(self, text):
        points = [ord(c) for c in text.lower()]
        for n in langid.ORDERS:
            for end in range(n - 1, len(points)):
                own = points[end - n + 1 : end + 1]
                if 0 not in own:
                    key = n
                    for p in own:
                        key = ((key ^ p) * 0x9E3779B1) % 2**32
                    yield (key ^ (key >> 15)) % self.buckets

    def predict(self, text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        logs = {}
        for lang, counts in self.counts.items():
            whole = sum(counts.values()) + langid.SMOOTHING * self.buckets
            logs[lang] = math.log(self.seen[lang] / sum(self.seen.values())) + sum(math.log((counts[g] + langid.SMOOTHING) / whole) for g in self.grams(text))
        top = max(logs.values())
        whole = sum(math.exp(x - top) for x in logs.values())
        best = min(lang for lang, x in logs.items() if x == top)
        return best, 1 / whole


def crc(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def test_language_query_matches_plain_bayes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    model = Bayes([(r["text"], r["lang"]) for r in docs if crc(r["doc_id"]) % 3 != 1 and r["lang"] and r["text"]], langid.BUCKETS)
    got = {(r["doc_id"], r["held_out"], r["lang_pred"]): r["score"] for r in queries.op4_language_id(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        lang, score = model.predict(r["text"])
        assert got[r["doc_id"], crc(r["doc_id"]) % 3 == 1, lang] == pytest.approx(score, abs=1e-4)


def test_language_ties_and_copies(spark):
    rows = [(1, "aab", "x"), (2, "aab", "y"), (3, "aab", None), (3, "aab", None), (4, "\0a\0", "x"), (5, "123", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(df, langid.train(df.where("doc_id < 3"), F.lit(True)), ["doc_id", "lang"]).collect()
    assert len(out) == 6 and all(r["lang_pred"] == ("und" if r["doc_id"] == 5 else "x") for r in out)  # equal scores: the first by name


def words(text):
    return [w for w in re.split("[^\\w]+|_", (text or "").lower()) if w]


def leaking(text, items):
    """Whether 80 % of some 13 words in a row, or of a shorter whole item, agree with the text in any alignment."""
    d = words(text)
    for item in items:
        n = len(item)
        w = min(n, decontaminate.WINDOW)
        if not n:
            continue
        same = np.zeros((len(d) + 2 * n, n), dtype=bool)
        places = {}
        for i, x in enumerate(d):
            places.setdefault(x, []).append(i + n)
        for j, x in enumerate(item):
            same[places.get(x, []), j] = True
        for shift in range(len(d) + n):
            run = np.cumsum([0, *same[np.arange(n) + shift, np.arange(n)]])
            if (run[w:] - run[:-w]).max() >= decontaminate.SHARE * w:
                return True
    return False


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_matches_plain_stages(spark):
    """Every stage on its own input, and the whole run's pieces, against plain versions of the stages."""
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages, frame, key = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{SF}/documents.parquet"), lambda r: (r["doc_id"], r["text"])
    ran, found = {}, None
    for name in ("language", "near_duplicates", "decontamination", "private_data"):
        if name == "private_data":
            found = {(r["doc_id"], r["text"]): r["w"] for r in pii.find(frame, ["doc_id", "text"]).select("src.doc_id", "src.text", pii.written(F.col("spans")).alias("w")).collect()}
        frame = common.materialize(stages[name](spark, frame, SF), "test")
        ran[name] = sorted(map(key, frame.collect()))

    model = Bayes([(r["text"], r["lang"]) for r in docs if r["lang"] and r["text"]], langid.BUCKETS)
    told = [(r, *model.predict(r["text"])) for r in docs]
    kept = [r for r, lang, score in told if lang != "und" and score >= corpus_pipeline.LEAST_SCORE]
    assert ran["language"] == sorted(map(key, kept))

    sets = [shingles(r["text"]) for r in kept]
    root = list(range(len(kept)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(kept)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(kept):
        groups.setdefault(find(i), []).append(r)
    kept = [min(own, key=lambda r: r["doc_id"]) for own in groups.values()]
    assert ran["near_duplicates"] == sorted(map(key, kept))

    kept = [r for r in kept if not leaking(r["text"], items)]
    assert ran["decontamination"] == sorted(map(key, kept))

    def masked(r):  # discovery has its own tests: here the base spans are held against plain patterns, and all are masked
        text, out, at = r["text"], "", 0
        spans = [x.split(":") for x in found[key(r)].split(",") if x]
        assert ",".join(":".join(x) for x in spans if x[0] != "id") == brute(text)
        for kind, a, b in spans:
            if int(a) >= at:
                out += text[at : int(a)] + f"<{kind}>"
            at = max(at, int(b))
        return out + text[at:]

    kept = [{**r, "text": masked(r)} for r in kept]
    assert ran["private_data"] == sorted(map(key, kept))

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    expected = []
    for r in kept:
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1], dtype="<u4")
        expected += [(r["doc_id"], p, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for p, at in enumerate(range(0, len(ids), 4096))]
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == sorted(expected)
    packed = {}
    for r in pieces:
        packed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in packed.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 4096


def test_private_data_takes_linear_time(spark):
    rng = random.Random(3)
    kinds = ["a{}@b.cd", "10.0.{}.1", "+1 743 555 3{:03d}", "x{}", "word", "ref{}."]
    long = " ".join(rng.choice(kinds).format(rng.randrange(250)) for _ in range(60_000))
    df = spark.createDataFrame([(1, long), (2, "9" * 400_000), (3, "a" * 400_000 + "@b.cd")], "doc_id long, text string")
    began = time.time()
    out = {r["doc_id"]: r for r in pii.find(df, ["doc_id", "text"]).select("src.doc_id", pii.written(F.col("base")).alias("w"), pii.redact(F.col("src.text"), F.col("base")).alias("t")).collect()}
    assert time.time() - began < 120
    assert out[1]["w"] == brute(long) and out[2]["w"] == "" and out[3]["w"] == "email:0:400005"
    assert out[3]["t"] == "<email>" and "@" not in out[1]["t"]


def test_candidates_know_their_base_spans(spark):
    rng = random.Random(4)
    pieces = ["a@b.cd", "1.2.3.4", "+1 743 555 3824,", "(x9", "9)", "z", "4111 1111 1111 1111", "é7", "-", "@"]
    texts = [" ".join(rng.choices(pieces, k=rng.randrange(0, 14))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").withColumn("base", pii.base_spans(F.col("t")))
    for r in df.select("t", "base", pii._candidates(F.col("t"), F.col("base")).alias("c")).collect():
        expected = []
        for m in re.finditer(r"\S+", r["t"]):
            if re.search("[0-9@]", m[0]):
                start = m.start() + len(m[0]) - len(m[0].lstrip(pii._EDGES))
                value = m[0].strip(pii._EDGES)
                if re.search("[^@]", value):
                    expected.append((start, start + len(value), value, any(b["start"] < start + len(value) and b["end"] > start for b in r["base"])))
        assert [(c["start"], c["end"], c["value"], c["known"]) for c in r["c"]] == expected


def test_search_of_large_and_tied_numbers(spark):
    df = spark.createDataFrame([(0, [1e7, 1e-3]), (50, [1e7, 2.0]), (51, [-1e7, 0.0]), (52, [1e7, 2.0]), (53, [1e7, 2.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in vectors.top_k(df, F.col("vec_id") == 50).orderBy("rank").collect()]
    x, y = 2_560_000_000, 512
    assert got == [(50, 1, 52, x * x + y * y), (50, 2, 53, x * x + y * y), (50, 3, 0, x * x), (50, 4, 51, -x * x)]
    huge = spark.createDataFrame([(0, [1e15]), (50, [1e15]), (51, [float("inf")]), (52, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="no 64-bit integer"):
        vectors.top_k(huge, F.col("vec_id") == 50).collect()
    larger = spark.createDataFrame([(50, [1e13]), (51, [1e17]), (52, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="no integer of 61 bits"):
        vectors.top_k(larger, F.col("vec_id") == 50).collect()
    fine = spark.createDataFrame([(50, [1e13]), (51, [float("nan")]), (52, [1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in vectors.top_k(fine, F.col("vec_id") == 50).collect()] == [(50, 1, 52, 256 * 256 * 10**13)]


def test_bounds_hold_where_doubles_round():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**40), 2**40, (300, 5))
    q = rng.integers(-(2**18), 2**18, (20, 5))
    low, step, cells = vectors.quantise(x)
    bound = vectors.upper_bounds(q, low, step, cells)
    exact = q.astype(object) @ x.T.astype(object)
    assert all(bound[i, j] >= exact[i, j] for i in range(20) for j in range(300))


def test_repeats_in_a_long_text(spark):
    rng = random.Random(6)
    noise = lambda n: bytes(rng.choices(b"abcdefgh ", k=n)).decode()
    passage = noise(700)
    texts = [noise(60_000) + passage + noise(90_000) + passage[100:650] + noise(10), noise(5_000) + passage[:450], noise(300), passage[:399]]
    where = Counter()
    for t in texts:
        b = t.encode()
        where.update(zlib.crc32(b[i : i + 400]) << 32 | zlib.adler32(b[i : i + 400]) for i in range(len(b) - 399))
    expected = {}
    for i, t in enumerate(texts):
        b, gone = t.encode(), np.zeros(len(t), bool)
        for at in range(len(b) - 399):
            if where[zlib.crc32(b[at : at + 400]) << 32 | zlib.adler32(b[at : at + 400])] > 1:
                gone[at : at + 400] = True
        expected[i] = int(gone.sum())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in suffixes.remove_repeats(df).collect()}
    assert {i: r["n_removed"] for i, r in out.items()} == expected and 1200 <= expected[0] < 1250
    assert all(r["n_kept"] == r["n_bytes"] - r["n_removed"] and r["repeated"] == (r["n_removed"] > 0) for r in out.values())


def test_long_urls_and_leaks(spark):
    pages = spark.createDataFrame([(1, "http://h.com/" + "a/" * 300 + "b" * 200_000), (2, "http://" + "h" * 100_000), (3, "http://h.com/x")], "page_id long, url string")
    out = {r["page_id"]: r for r in urls.judge(pages, [("block", "com", "/x")]).collect()}
    assert len(out) == 3 and len(out[1]["path"]) == 200_601 and out[3]["verdict"] == "block"
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "the of and " * 100_000 + item), (2, "the of and " * 100_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r["doc_id"], r["at"]) for r in decontaminate.leaks(docs, bench).collect()] == [(1, 300_000)]


def test_packing_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty, queries.tokenizer_path(), end_id=1).count() == 0
