"""Quarantine, the manifest and secret scans against plain versions, with empty, null, repeated, tied, hot and very long input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from strata.llm import merkle, ordering, pii, quarantine, queries, secrets

SF = "/root/testdata/sf0.001"


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def replayed(rows):
    """(conv_id, turn, text) rows, one turn at a time."""
    h = lambda k, c, t: zlib.crc32(f"{k}:{c}:{t}".encode())
    conversations, out = {}, []
    for c, t, text in rows:
        if c is None or t is None:
            out.append((c, t, *[None] * 6))
        else:
            conversations.setdefault(c, []).append((t, zlib.crc32((text or "").encode())))
    for c, turns in conversations.items():
        turns.sort()
        done = []
        for p, (t, _) in enumerate(turns):
            away = h(0, c, t) % 7
            parent = done[p - away] if away and p >= away else None
            if parent and parent[0] != "delivered":
                done.append(("blocked", 0, None, None))
                continue
            at = first = max(7 * p, parent[3]) if parent else 7 * p
            for a in range(1, 5):
                if h(1, c, t) % 101 >= 20 or at >= 7 * p + h(2, c, t) % 101 and h(a + 2, c, t) % 3:
                    done.append(("delivered", a, first, at))
                    break
                if a == 4:
                    done.append(("dead", 4, first, at))
                at += 20 * 2 ** (a - 1)
        number, state, total = {}, {}, 0
        for n, (_, _, p) in enumerate(sorted((r[3], turns[p][0], p) for p, r in enumerate(done) if r[0] == "delivered"), 1):
            total += n * turns[p][1]
            number[p], state[p] = n, total
        out += [(c, turns[p][0], *r, number.get(p), state.get(p)) for p, r in enumerate(done)]
    return out


@pytest.mark.parametrize("chunk", [256, 16])
def test_replay(spark, chunk):
    rng = random.Random(3)
    rows = [(1, t, f"x{t}") for t in range(1500)] + [(2, t * 10**9, "é") for t in range(70)]  # one conversation with most turns, and one with gaps
    rows += [(3, 5, "a"), (3, 5, "a"), (3, 5, None), (None, 1, "q"), (4, None, "q"), (None, None, None), (5, -3, ""), (5, 0, "z" * 10**6)]
    rows += [(c, t, "t") for c in range(10, 30) for t in range(rng.randrange(1, 9))]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, text string, state string, place int")
    assert ordered(quarantine.replay(df, chunk).collect()) == ordered(replayed(rows))


def test_replay_of_nothing_and_of_the_tables(spark):
    empty = quarantine.replay(spark.createDataFrame([], "conv_id long, turn long, text string"))
    assert empty.collect() == [] and empty.columns == ["conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state"]
    rows = [(r["conv_id"], r["turn"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert ordered(queries.op11_quarantine(spark, SF).collect()) == ordered(replayed(rows))


def test_a_replay_that_needs_several_rounds(spark):
    rows = [(7, t, None) for t in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    chunks = quarantine._chunks(df.select("conv_id", "turn", F.lit(0).cast("long").alias("crc")), 6)
    assert chunks.count() == 67 and quarantine._tails(chunks, 6).count() == 66
    assert ordered(quarantine.replay(df, 6).collect()) == ordered(replayed(rows))


def test_places_and_running_totals(spark):
    rng = random.Random(5)
    rows = [("hot", rng.randrange(5)) for _ in range(3000)] + [(rng.choice("abc"), rng.randrange(10**6)) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, x long")
    got = ordered(ordering.placed(df, "g", ["x"], "t").select("g", "place", "x").collect())
    assert got == ordered((g, i, x) for g in {g for g, _ in rows} for i, x in enumerate(sorted(x for h, x in rows if h == g)))
    parts = spark.createDataFrame([("a", k * 700, k) for k in range(1200)] + [("b", 5, 9)], "g string, key long, n long")
    got = {(r["g"], r["key"]): r["before"] for r in ordering.carried(parts, "g", "key", "n").collect()}
    assert all(got["a", k * 700] == k * (k - 1) // 2 for k in range(1200)) and got["b", 5] == 0


def manifested(rows):
    """(doc_id, source, lang, n_chars, text) rows, one tree at a time."""
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf = lambda r: digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for path, i in zip(paths, at, strict=True):
                s = i - i % 3
                path.append(("".join(nodes[s:i]), "".join(nodes[i + 1 : s + 3])))
            nodes, at = [digest("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
        return nodes[0], paths

    held = []
    for source in sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted((r for r in rows if r[1] == source), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        held.append((own, *tree([leaf(r) for r in own])))
    root, tops = tree([sub for _, sub, _ in held]) if held else (None, [])
    for (own, sub, paths), top in zip(held, tops, strict=True):
        for r, path in zip(own, paths, strict=True):
            whole = path + top
            even = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0
            h = leaf((*r[:4], r[4].replace("\n", "")) if even and r[4] is not None else r)
            for left, right in whole:
                h = digest(left + h + right)
            yield r[0], leaf(r), sub, root, digest("".join(a + b for a, b in whole)), h, h == root


@pytest.mark.parametrize("sizes", [(700, 5, 1, 82, 81, 3, 243, 244, 9), (1,), (2,), ()])
def test_manifest(spark, sizes):
    rng = random.Random(3)
    rows = [(i * 7 % 100003 + s * 10**6, f"s{s}" if s else None, rng.choice([None, "en"]), rng.choice([None, 3]), rng.choice([None, "", f"é\nb{i}"])) for s, n in enumerate(sizes) for i in range(n)]
    if rows:
        rows += [rows[0], rows[0], (None, "s1", "x", 1, "a\n"), (8, None, "x", 1, "\n😀" * 200_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, place int")
    assert ordered(merkle.manifest(df).collect()) == ordered(manifested(rows))


def test_manifest_of_the_documents(spark):
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = ordered(queries.op12_merkle(spark, SF).collect())
    assert got == ordered(manifested(rows)) and len({r[-1] for r in got}) == 2


def anycase(word):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join([*map(anycase, ("password", "passwd", "secret", "token")), anycase("api") + "_?" + anycase("key")]) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def scanned(text):
    """(base, all) spans of a text, with every window counted anew."""
    text, last = text or "", {True: 0, False: 0}
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    found = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]+", text):
        is_hex = bool(re.fullmatch("[0-9A-Fa-f]+", m[0]))
        kind, value = secrets.HEX if is_hex else secrets.BASE64, m[0] if is_hex else m[0] + re.match("={0,2}", text[m.end() :])[0]
        if len(m[0]) < (20 if is_hex else 24):
            continue
        before, last[is_hex] = text[last[is_hex] : m.start()], m.start() + len(value)
        word = re.search(r"\S+$", before.strip(pii._EDGES + pii._SPACE))
        if any(re.fullmatch(a, value) for a in secrets.ALLOWED) or word and word[0].strip(pii._EDGES).lower() in secrets.ALLOWED_AFTER:
            continue
        w, spans = kind.window, []
        for i in range(len(value) - w + 1):
            n = Counter((value.lower() if is_hex else value)[i : i + w]).values()
            if sum(map(secrets.weight, n)) <= math.floor(w * (math.log2(w) - kind.bits) * secrets.UNIT):
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + w
                else:
                    spans.append([i, i + w])
        found += [(m.start() + a, 3, m.start() + b) for a, b in spans]
    return sorted(base), sorted(base + found)


def secret_texts():
    rng = random.Random(1)
    code, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", "0123456789abcdef"
    some = lambda n, a=code: "".join(rng.choices(a, k=n))
    texts = [None, "", f'é😀 token = "{some(40, digits)}" x', "PassWord:abc secret=token:abcdefgh api_key='x/y.z==12'", "AKIA" + some(16, "ABCDEF0123") + " AKIAAB"]
    texts += [f"sha256: {some(64, digits)}", "x" * 6000, some(5000) + "==", "a1" * 1000 + some(60) + "b2" * 200 + some(50), f"550e8400-e29b-41d4-a716-446655440000 {some(24, '0123456789')}"]
    texts += ["/usr/lib/python3/dist/packages/abcdefg1/", "token" * 2000 + " " * 2000, "deadbeef" * 5, "TOKEN = ſecret=12345678 "] + [f"{some(40)} {some(40)}"] * 2
    parts = ["token", "secret ", "=", ": ", '"', "'", some(8), some(40), some(26, digits), " ", "\n", "AKIA", "é", some(30, code[:36]), "password", "===", "a" * 30, some(45), "sha1 "]
    return texts + ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(150)]


def test_secrets(spark):
    texts = secret_texts()
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, base int")
    got = {r["i"]: ([tuple(s) for s in r["base"]], [tuple(s) for s in r["spans"]]) for r in secrets.find(df, ["doc_id"]).select(F.col("src.doc_id").alias("i"), "base", "spans").collect()}
    assert got == {i: scanned(t) for i, t in enumerate(texts)}
    assert sum(len(s) - len(b) for b, s in got.values()) > 50
    assert secrets.find(df.limit(0), ["doc_id"]).collect() == []


def test_secrets_of_the_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_secrets(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        base, spans = scanned(texts[r["doc_id"]])
        told = lambda found: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in found)
        assert r["spans"] == told(spans) and r["base_sha256"] == hashlib.sha256(told(base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == k for s in base) for k in range(3))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = ", ".join(sorted(df.columns))
    assert ordered(df.select(sorted(df.columns)).collect()) == ordered(db.execute(f"SELECT {columns} FROM ({queries.oracle_sql()[name]})").fetchall())
