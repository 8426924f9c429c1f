import hashlib
import itertools
import math
import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from strata.llm import decontaminate, pii, queries

KINDS = ["email", "ip", "card", "phone"]


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in re.findall("[0-9]", m[0])][::-1]
        if 12 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.findall("[0-9]", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def cases():
    rng = random.Random(5)
    texts = [None, "", "é😀 a@b.cd_x@e.f,", "a@b.c@d.e x@y", "1.2.3.4.5 999.1.1.1 001.02.0003.255 1.2.3", "4111 1111-1111 1111 4111111111111111 4111111111111112", "5 4111111111111111", "+1 (743) 555-3824 +12 +1--2 +1 234 567 890 123 456 789", "x" * 5_000, "1" * 2_000, "1 " * 2_000, "a.b" * 900 + "@", "1." * 900, "+1 " * 900, "!" * 3_000 + "1"]
    alphabet = ["1", "23", "411111", "1111111111", ".", "-", " ", "+", "@", "a", "b.c", "(", "é", "255", "\n"]
    return texts + ["".join(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(300)]


def test_base_spans_match_plain_patterns(spark):
    texts = cases()
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    out = pii.find(df, ["doc_id", "spans"]).select("src.doc_id", pii.written(F.col("base")).alias("w")).collect()
    assert {r["doc_id"]: r["w"] for r in out} == {i: brute(t) for i, t in enumerate(texts)}
    assert pii.find(df.limit(0), ["doc_id"]).count() == 0


def test_query_matches_plain_patterns(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in queries.op6_pii(spark, "/root/testdata/sf0.01").collect():
        assert r["base_sha256"] == hashlib.sha256(brute(docs[r["doc_id"]]).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [brute(docs[r["doc_id"]]).count(k) for k in KINDS]


def test_bootstrapping_finds_unseen_identifiers(spark):
    rows = [(i, f"filler words {i}x account 41111111111111{j:02d} end {i}") for i, j in enumerate([11, 29, 37, 45, 52, 60, 78, 86, 94])]
    rows = [(i, t) for i, t in rows] + [(99, "my account 4111111111111112 end"), (100, "plain 4111111111111113 other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seeds = sum("card" in brute(t) for _, t in rows[:9])
    out = {r["doc_id"]: r["w"] for r in pii.find(df, ["doc_id"]).select("src.doc_id", pii.written(F.col("spans")).alias("w")).collect()}
    assert seeds >= pii.SUPPORT and (out[99] == "id:11:27") == (seeds >= pii.TRUST * (10)) and out[100] == ""


def accepted_plainly(texts):
    """(all spans of kind id by row, accepted values): contexts and rounds over Python dictionaries."""
    known, seen, negatives, placed = Counter(), {}, Counter(), []
    for i, text in texts.items():
        base = [tuple(map(int, s.split(":")[1:])) for s in brute(text).split(",") if s]
        tokens = [(m.start(), m[0]) for m in re.finditer(r"[^ \t\n\x0b\f\r]+", text or "") if m[0].strip(pii._EDGES)]
        for at, (start, token) in enumerate(tokens):
            near = tokens[at - 1][1].lower() if at else "", tokens[at + 1][1].lower() if at + 1 < len(tokens) else ""
            patterns = [k for k in (("l", near[0].lstrip(pii._EDGES)), ("r", near[1].rstrip(pii._EDGES))) if k[1]]
            if not re.search("[0-9@]", token):
                negatives.update(patterns)
                continue
            start += len(token) - len(token.lstrip(pii._EDGES))
            value = token.strip(pii._EDGES)
            if re.search("[^@]", value):
                hit = any(a < start + len(value) and b > start for a, b in base)
                known[value] |= hit
                placed.append((i, start, start + len(value), value, hit))
                for k in patterns:
                    seen.setdefault(k, Counter())[value] += 1
    accepted = set()
    while True:
        doubt = {}
        for k, values in seen.items():
            inside = [v for v in values if known[v] or v in accepted]
            if pii.SUPPORT <= len(inside) < len(values):
                held = sum(values[v] for v in inside)
                precision = held / (held + negatives[k])
                if precision >= pii.TRUST:
                    for v in set(values) - set(inside):
                        doubt[v] = doubt.get(v, 0.0) + math.log(max(1 - precision, 1e-9))
        found = {v for v, x in doubt.items() if 1 - math.exp(x) >= pii.ACCEPT}
        if not found:
            return sorted((i, a, b) for i, a, b, v, hit in placed if v in accepted and not hit), accepted
        accepted |= found


def identified(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = pii.find(df, ["doc_id"]).select("src.doc_id", F.explode("spans").alias("s")).where(F.col("s.kind_order") == 4)
    return sorted((r["doc_id"], r["s"]["start"], r["s"]["end"]) for r in rows.collect())


def test_discovery_matches_plain_rounds(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    seeds = [f"user{i}@mail.org" for i in range(6)]
    texts |= {10**6 + i: f"(Contact: {s}) ref {i}X- and more" for i, s in enumerate(seeds)}  # the colon is what tells
    texts |= {10**6 + 10: "contact: A-7731; contact the office", 10**6 + 11: "contact 55-B", 10**6 + 12: "Ticket A-7731 | A-7731 K99 K99"}
    texts |= {10**6 + 20 + i: f"+1 555{i} tail" for i in range(3)} | {10**6 + 30 + i: f"phone +1 (743) 555-38{i}4 K99" for i in range(6)}
    texts |= {10**6 + 40: None, 10**6 + 41: "", 10**6 + 42: "9" * 50_000 + " contact: " + "8z" * 5000}
    wanted, values = accepted_plainly(texts)
    assert identified(spark, texts) == wanted and "A-7731" in values and "55-B" not in values and len(wanted) > 4


def test_redact(spark):
    df = spark.createDataFrame([("mail a@b.cd now, 1.2.3.4", 1), ("none", 2), (None, 3), ("é a@b.cd, and on", 4), ("a@b.cd", 5)], "text string, doc_id long")
    out = pii.find(df, ["text", "doc_id"]).select("src.doc_id", pii.redact(F.col("src.text"), F.col("spans")).alias("t")).orderBy("doc_id").collect()
    assert [r["t"] for r in out] == ["mail <email> now, <ip>", "none", None, "é <email>, and on", "<email>"]


def test_leaks(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    items = [[word() for _ in range(n)] for n in (30, 20, 15, 9, 5)] + [["x", "y"], []]
    rows, expected = [], set()
    for i, item in enumerate(items[:5]):
        for errors in range(3):
            own = list(item)
            for at in rng.sample(range(len(own)), errors):
                own[at] = "zz"
            rows.append((len(rows), " ".join([word() for _ in range(40)]) + ". " + ", ".join(own).upper() + " " + word()))
            w = min(len(item), decontaminate.WINDOW)
            best = max(sum(a == b for a, b in zip(own[s : s + w], item[s : s + w])) for s in range(len(item) - w + 1))
            if best >= 0.8 * w:
                expected.add((len(rows) - 1, i))
    rows.append((len(rows), " ".join(items[0][:10])))  # a part that fills under 80 % of the window
    rows += [(777, " ".join(items[1])), (777, " ".join(items[1])), (None, " ".join(items[1])), (5000, None), (5001, ""), (5002, "x y")]
    expected |= {(777, 1), (None, 1), (5002, 5)}
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, " ".join(x), "") for i, x in enumerate(items)] + [(99, None, "")], "item_id int, text string, doc_id string")
    for small in (decontaminate.SMALL, 0):
        found = decontaminate.leaks(df, bench, small=small).collect()
        got = {(r["doc_id"], r["item_id"]) for r in found}
        assert got == expected
    assert decontaminate.leaks(df.limit(0), bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_short_items_lose_no_seed(spark):
    """Every way to substitute as many words as the share allows, at every length below the window, and whole items under five words."""
    bench, rows = [], []
    for n in range(1, decontaminate.WINDOW):
        item = [f"i{n}w{k}" for k in range(n)]
        bench.append((n, " ".join(item)))
        most = n - math.ceil(decontaminate.SHARE * n - 1e-9)
        for errors in range(most + 2):
            for at in itertools.combinations(range(n), errors):
                rows.append((len(rows), n, errors <= most, " ".join(["before", *("zz" if k in at else w for k, w in enumerate(item)), "after"])))
    docs = spark.createDataFrame([(i, text) for i, _, _, text in rows], "doc_id long, text string")
    found = decontaminate.leaks(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(i, n) for i, n, leaks, _ in rows if leaks]


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    odd = docs.limit(20).withColumn("key", F.lit(1)).withColumn("row", F.lit(2)).withColumn("src", F.lit("s"))
    odd = odd.unionByName(odd.limit(2)).unionByName(odd.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf).columns == odd.columns
        assert stage(spark, odd.limit(0), sf).count() == 0
    packed = corpus_pipeline.run(spark, sf)
    ids = {r[0] for r in packed.select("doc_id").distinct().collect()}
    language_kept = {r[0] for r in corpus_pipeline.language(spark, docs, sf).select("doc_id").collect()}
    assert ids <= language_kept and len(ids) >= 0.8 * len(language_kept)


def test_bootstrapping_finds_shapes_that_no_base_kind_has(spark):
    texts = [f"write to ref a{i}@b.cd please" for i in range(5)]
    texts += [f"see ref = 'AB-{i}X-{'7' * (1 + i % 3)}' there{i}" for i in range(20)]  # four unseen for each known, in many shapes
    texts += [f"badge AB-{i}X-{'7' * (1 + i % 3)} so{i}" for i in range(5)] + [f"badge q{i}q on{i}" for i in range(6)]
    texts += [f"pass q{i}q by{i}" for i in range(5)] + ["pass 0x5e", "desk q1q", "desk 3"]
    texts += [f"the c{i}@b.cd of" for i in range(6)] + ["the cat of the dog of the cow of", "the 12 of"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pii.find(df, ["doc_id", "text"]).select("src.text", pii.written(F.col("spans")).alias("w")).collect()
    got = {r["text"]: [r["text"][int(x.split(":")[1]) : int(x.split(":")[2])] for x in r["w"].split(",") if x.startswith("id:")] for r in out}
    assert all(got[t] == [t.split("'")[1]] for t in texts if "ref =" in t)
    assert all(got[t] == [t.split(" ")[1]] for t in texts if t.startswith(("badge", "pass"))) and got["desk q1q"] == ["q1q"]
    assert got["desk 3"] == [] and got["the 12 of"] == [] and not any(got[t] for t in texts if "@" in t)
