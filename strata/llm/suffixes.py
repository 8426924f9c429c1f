"""Exact repeated-substring removal with a sparse suffix array, sorted deep-shallow.

Every byte covered by a ``length``-byte string that also starts elsewhere (any document, the same one included) goes;
strings are judged on the input, and never cross documents.

Only chosen positions are sorted. In each window of ``length`` bytes the k-mer of least hash (the leftmost of equals)
is its anchor; equal windows choose the same one, so two windows are equal only if their anchors share the k-mer and
agree around it. About one position in 137 is an anchor. An anchor's region is all bytes of the windows that chose it.

1. Equal regions around equal anchors are one class, counted with map-side sums: a class met twice is wholly repeated.
2. Classes that share a k-mer with other classes are fetched and sorted: multikey quicksort by 16-byte keys down to
   the k-mer's depth, then a blind trie for each group of longer common prefixes, over the bytes from the anchor on;
   another blind trie over the bytes before it, backwards. The tries' branching depths are the common prefixes, from
   which the repeated windows of every class follow exactly.
3. A k-mer with more than ``SPLIT`` classes would make one task's work grow with its group. Its windows are dealt out
   by 128-bit hashes and counted instead: cells of neighbouring windows first, and windows one by one only where
   cells differ but share what all their windows share. Nothing is capped.

The same steps find passages over words: a text is then eight bytes a word, a hash of it, and offsets are counted in words.
There a passage counts only if another document has it too, so each class carries its owner, the one document that has
it, and what only one owner's classes share is left out. Rows alike in doc_id and text are one document here.

Null texts are empty; empty texts and texts under ``length`` bytes keep everything. Repeated rows are copies of each
other, so all of their windows repeat. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, KMER = 400, 128
#: Words of a passage, and of its k-mers; a word's place takes WORD bytes.
WORDS, WORD_KMER, WORD = 51, 8, 8
#: Classes of one k-mer that one task may sort.
SPLIT = 256
#: Bytes of a text that are searched for anchors at a time.
SLICE = 1 << 22
#: Bytes of a sort key in the shallow sort.
STEP = 16
_BASE = 0x9E3779B97F4A7C15 | 1
_U64 = np.uint64
_POWERS: list[np.ndarray] = []
_SPACE = re.compile(rb"[ \t-\r]")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse modulo 2**64, for i up to n."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        factors = np.array([[_BASE], [pow(_BASE, -1, 1 << 64)]], dtype=_U64).repeat(n, axis=1)
        factors[:, 0] = 1
        _POWERS[:] = list(np.cumprod(factors, axis=1, dtype=_U64))
    return _POWERS[0], _POWERS[1]


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values, from prefix and suffix minima of blocks of w."""
    n = len(x) - w + 1
    blocks = np.concatenate([x, np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def hashed_words(text: bytes) -> bytes:
    """WORD bytes for each word of a text, its hash; words are maximal runs without space, tab, LF, VT, FF, CR."""
    parts, low = [], 0
    while low < len(text):
        found = _SPACE.search(text, low + SLICE)
        high = found.start() if found else len(text)
        parts.append(np.array(list(map(xxhash.xxh3_64_intdigest, text[low:high].split())), dtype=_U64).tobytes())
        low = high
    return b"".join(parts)


def anchors(text: bytes, length: int, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(position, first window, last window, k-mer hash) of each anchor; every window of ``length`` bytes has one."""
    for arrays in _anchors(text, length, k, 1):
        yield from zip(*(a.tolist() for a in arrays), strict=True)


def _anchors(text: bytes, length: int, k: int, unit: int) -> Iterator[tuple[np.ndarray, ...]]:
    """What ``anchors`` gives, in units of one byte or of WORD, as arrays of a slice."""
    units = np.frombuffer(text, np.uint8 if unit == 1 else _U64)
    for low in range(0, max(0, len(units) - length + 1), SLICE):
        part = units[low : low + SLICE + length - 1]
        power, inverse = _powers(len(part))
        sums = np.concatenate([np.zeros(1, _U64), np.cumsum((part.astype(_U64) + _U64(1)) * power[: len(part)], dtype=_U64)])
        hashes = (sums[k:] - sums[:-k]) * inverse[: len(part) - k + 1]
        hashes ^= hashes >> _U64(32)
        hashes *= _U64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> _U64(29)
        packed = (hashes & ~_U64((1 << 23) - 1)) | np.arange(len(hashes), dtype=_U64)
        at = (sliding_minimum(packed, length - k + 1) & _U64((1 << 23) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        chosen = at[first]
        yield chosen + low, first + low, last + low, hashes[chosen].view(np.int64)


_OCCURRENCE = [("kmer", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("d_low", pa.int32()), ("d_high", pa.int32())]


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _found(length: int, k: int, unit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, parts = [], []
            for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if text is None or len(text) < length:
                    continue
                text = hashed_words(text) if unit > 1 else text
                for at, first, last, kmer in _anchors(text, length, k, unit):
                    low, high = at - last, at - first
                    ends = zip((first * unit).tolist(), ((last + length) * unit).tolist(), (low * length + high).tolist(), strict=True)
                    digests += [xxhash.xxh3_128_digest(text[a:b], seed) for a, b, seed in ends]
                    parts.append((kmer, np.full(len(at), key), at, low, high))
            if digests:
                r = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                kmers, keys, ats, lows, highs = (np.concatenate(c) for c in zip(*parts, strict=True))
                columns = (kmers, r[:, 0].copy(), r[:, 1].copy(), keys, ats, lows, highs)
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, (_, t) in zip(columns, _OCCURRENCE, strict=True)], [n for n, _ in _OCCURRENCE])

    return run


def shallow_sort(strings: list[bytes], depth: int) -> list[list[int]]:
    """Multikey quicksort by keys of STEP bytes: groups of indexes in order, each of strings that share ``depth`` bytes."""
    out: list[list[int]] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        own, at = stack.pop()
        if at >= depth or len(own) == 1:
            out.append(own)
            continue
        end = min(at + STEP, depth)
        pivot = strings[own[len(own) // 2]][at:end]
        less, same, more = [], [], []
        for i in own:
            key = strings[i][at:end]
            (same if key == pivot else less if key < pivot else more).append(i)
        # the stack is popped from the end: less, same, more come out in this order
        stack += [x for x in ((more, at), (same, end), (less, at)) if x[0]]
    return out


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Bytes that two strings share, if they share ``start``."""
    low, high = start, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def blind_sort(strings: list[bytes], own: list[int], depth: int) -> tuple[list[int], list[int]]:
    """Order of the strings ``own``, which share ``depth`` bytes, and what neighbours share; by a blind trie.

    An inner node is [depth, {byte: child}] and holds no text; a string that ends has byte -1. A new string walks
    down by branching bytes only, is compared once with a leaf it meets, and is then put where they part.
    """
    root: list | int = own[0]
    same: dict[int, list[int]] = {}
    for i in own[1:]:
        s = strings[i]
        node = root
        while type(node) is list:
            node = node[1].get(s[node[0]] if node[0] < len(s) else -1) or next(iter(node[1].values()))
            if type(node) is tuple:
                node = node[0]
        shared = common_prefix(s, strings[node], depth)
        if shared == len(s) == len(strings[node]):
            same.setdefault(node, []).append(i)
            continue
        parent, branch, node = None, None, root
        while type(node) is list and node[0] < shared:
            parent, branch = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][branch]
            if type(node) is tuple:
                node = node[0]
        mine = s[shared] if shared < len(s) else -1
        if type(node) is list and node[0] == shared:
            node[1][mine] = (i,)
            continue
        leaf = node
        while type(leaf) is list:
            leaf = next(iter(leaf[1].values()))
            if type(leaf) is tuple:
                leaf = leaf[0]
        other = strings[leaf][shared] if shared < len(strings[leaf]) else -1
        fresh = [shared, {mine: (i,), other: node if type(node) is list else (node,)}]
        if parent is None:
            root = fresh
        else:
            parent[1][branch] = fresh
    order: list[int] = []
    shares: list[int] = []
    stack: list = [(root, 0)]
    while stack:
        node, lead = stack.pop()
        if type(node) is list:
            children = sorted(node[1].items(), reverse=True)
            first = len(children) - 1
            stack += [(child[0] if type(child) is tuple else child, lead if j == first else node[0]) for j, (_, child) in enumerate(children)]
            continue
        if order:
            shares.append(lead)
        order.append(node)
        for copy in same.get(node, ()):
            shares.append(len(strings[node]))
            order.append(copy)
    return order, shares


def _pair_shares(order: list[int], shares: list[int], index: dict[int, int]) -> np.ndarray:
    """What each two strings share: the least share between their places."""
    n = len(order)
    table = np.full((n, n), 1 << 30, dtype=np.int64)
    step = np.array(shares, dtype=np.int64)
    for i in range(n - 1):
        table[i, i + 1 :] = np.minimum.accumulate(step[i:])
    table = np.minimum(table, table.T)
    place = np.empty(n, dtype=np.int64)
    place[[index[i] for i in order]] = np.arange(n)
    return table[np.ix_(place, place)]


def repeated_windows(right: list[bytes], left: list[bytes], own: list[int], depth: int, length: int, unit: int, owners: list[int | None]) -> list[np.ndarray]:
    """For each of ``own``: a flag for every offset 0..length of the anchor in a window, set where one of another owner has the same window; without an owner, any other."""
    index = {i: j for j, i in enumerate(own)}
    after = _pair_shares(*blind_sort(right, own, depth), index) // unit
    before = _pair_shares(*blind_sort(left, own, 0), index) // unit
    low, high = np.maximum(0, length - after), np.minimum(length, before)
    marks = np.zeros((len(own), length + 2), dtype=np.int64)
    owner = np.array([owners[i] or 0 for i in own], dtype=np.int64)
    shared = np.array([owners[i] is None for i in own])
    hit = (low <= high) & ((owner[:, None] != owner) | shared[:, None] | shared)
    np.fill_diagonal(hit, False)
    i, j = np.nonzero(hit)
    np.add.at(marks, (i, low[i, j]), 1)
    np.add.at(marks, (i, high[i, j] + 1), -1)
    return list(np.cumsum(marks, axis=1) > 0)


def _runs(flags: np.ndarray, offset: int) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"low": int(a) + offset, "high": int(b) - 1 + offset} for a, b in zip(edges[::2], edges[1::2], strict=True)]


_RANGES = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
_SORTED = 8192


def _sorted(length: int, k: int, unit: int):
    """Regions, those of a k-mer in a row, to the ranges of offsets at which their windows repeat."""

    def solve(rows: list[dict]) -> pa.RecordBatch | None:
        right = [r["region"][r["d_high"] * unit :] for r in rows]
        left = [r["region"][: r["d_high"] * unit][::-1] for r in rows]
        owners = [r["owner"] for r in rows]
        out = []
        for own in shallow_sort(right, k * unit):
            if len(own) > 1:
                for i, flags in zip(own, repeated_windows(right, left, own, k * unit, length, unit, owners), strict=True):
                    r = rows[i]
                    if runs := _runs(flags[r["d_low"] : r["d_high"] + 1], r["d_low"]):
                        out.append((r["r1"], r["r2"], runs))
        if out:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), _RANGES), strict=True)], ["r1", "r2", "ranges"])
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["kmer"] != held[-1]["kmer"]:
                    seen.clear()
                    if len(held) >= _SORTED:
                        if done := solve(held):
                            yield done
                        held = []
                if (own := (row["r1"], row["r2"])) not in seen:  # a repeated row's region comes twice
                    seen.add(own)
                    held.append(row)
        if held and (done := solve(held)):
            yield done

    return run


def _cut(length: int, unit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, wanted in zip(batch["text"].to_pylist(), batch["wanted"].to_pylist(), strict=True):
                text = hashed_words(text) if unit > 1 else text
                for w in wanted:
                    rows.append((w["kmer"], w["r1"], w["r2"], w["owner"], w["d_low"], w["d_high"], w["hot"], text[(w["at"] - w["d_high"]) * unit : (w["at"] - w["d_low"] + length) * unit]))
            if rows:
                kinds = (*[pa.int64()] * 4, pa.int32(), pa.int32(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["kmer", "r1", "r2", "owner", "d_low", "d_high", "hot", "region"])

    return run


#: Offsets whose windows are dealt out together.
CELL = 16


def _cells(length: int, unit: int):
    """Regions to cells of CELL offsets: hashes of the bytes that all the cell's windows share (core) and of all their bytes (span)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                region, at = r["region"], r["d_high"]
                for j in range(r["d_low"] // CELL, r["d_high"] // CELL + 1):
                    low, high = max(r["d_low"], j * CELL), min(r["d_high"], j * CELL + CELL - 1)
                    core = region[(at - j * CELL) * unit : (at + length - j * CELL - CELL + 1) * unit]
                    span = region[(at - high) * unit : (at - low + length) * unit]
                    rows.append((*_halves(xxhash.xxh3_128_digest(core, j)), *_halves(xxhash.xxh3_128_digest(span, low * length + high)), r["r1"], r["r2"], r["owner"], low, high))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 7, *[pa.int32()] * 2), strict=True)], ["c1", "c2", "s1", "s2", "r1", "r2", "owner", "low", "high"])

    return run


def _windows(length: int, unit: int):
    """Regions, each with the cells wanted of it, to the hashes of those cells' windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for cell in r["cells"]:
                    for d in range(cell["low"], cell["high"] + 1):
                        start = r["d_high"] - d
                        rows.append((*_halves(xxhash.xxh3_128_digest(r["region"][start * unit : (start + length) * unit], d)), cell["s1"], cell["s2"], cell["least"], cell["most"], d))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 6, pa.int32()), strict=True)], ["w1", "w2", "s1", "s2", "least", "most", "d"])

    return run


def _dealt(hot: DataFrame, length: int, unit: int) -> tuple[DataFrame, list[DataFrame]]:
    """(r1, r2, low, high): offsets at which windows of the hot k-mers' regions repeat; and the tables that this reads.

    A span met with two owners repeats as a whole, as does one without an owner. Windows are hashed one by one only where different spans share a core, once for each span.
    """
    regions = hot.dropDuplicates(["r1", "r2"])
    cells = common.materialize(common.arrow_map(regions, _cells(length, unit), "c1 long, c2 long, s1 long, s2 long, r1 long, r2 long, owner long, low int, high int"), "cells")
    owners = F.min(F.coalesce("owner", F.lit(-(2**63)))).alias("least"), F.max(F.coalesce("owner", F.lit(2**63 - 1))).alias("most")
    spans = cells.groupBy("c1", "c2", "s1", "s2").agg(*owners, F.min(F.struct("r1", "r2", "low", "high")).alias("one"))
    spans = common.materialize(spans, "spans")
    mixed = spans.groupBy("c1", "c2").agg(F.count("*").alias("m")).where("m > 1").select("c1", "c2")
    wanted = spans.join(mixed, ["c1", "c2"]).select("one.r1", "one.r2", F.struct("s1", "s2", "least", "most", "one.low", "one.high").alias("cell")).groupBy("r1", "r2").agg(F.collect_list("cell").alias("cells"))
    windows = common.arrow_map(regions.join(wanted, ["r1", "r2"]).select("region", "d_high", "cells"), _windows(length, unit), "w1 long, w2 long, s1 long, s2 long, least long, most long, d int")
    windows = common.materialize(windows, "windows")
    twice = windows.groupBy("w1", "w2").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most").select("w1", "w2")
    parts = windows.join(twice, ["w1", "w2"]).select("s1", "s2", F.col("d").alias("low"), F.col("d").alias("high"))
    whole = spans.where("least < most").select("s1", "s2", "one.low", "one.high")
    return cells.select("s1", "s2", "r1", "r2").join(whole.unionByName(parts), ["s1", "s2"]).select("r1", "r2", "low", "high"), [cells, spans, windows]


def _merged(spans: list[dict], words: bool) -> list[list[int]]:
    merged: list[list[int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans if s["words"] == words):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    return merged


def _removed(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                text, spans = text or b"", spans or []
                merged = _merged(spans, words=False)
                shared = sum(high - low for low, high in _merged(spans, words=True))
                place, parts = 0, []
                for low, high in merged:
                    parts.append(text[place:low])
                    place = high
                kept = b"".join([*parts, text[place:]])
                out.append((doc_id, len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), len(kept), len(kept) < len(text), shared, *[kept] * with_text))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), *[pa.binary()] * with_text)
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "repeated", "n_shared_words", *["kept"] * with_text])

    return run


def _repeats(data: DataFrame, length: int, k: int, split: int, words: bool) -> DataFrame:
    """(key, span): where windows of ``length`` bytes start elsewhere too, or windows of ``length`` words in another document."""
    unit = WORD if words else 1
    kinds = "kmer long, r1 long, r2 long, key long, at long, d_low int, d_high int"
    met = common.materialize(common.arrow_map(data.select("key", "text"), _found(length, k, unit), kinds), "anchors")
    several = F.min("key") != F.max("key") if words else F.count("*") > 1
    classes = met.groupBy("kmer", "r1", "r2", "d_low", "d_high").agg(several.alias("several"), F.min(F.struct("key", "at")).alias("one"))
    classes = common.materialize(classes, "regions")
    # over bytes each class is its own owner
    owner = F.when(~F.col("several"), F.col("one.key")) if words else F.col("r1")
    sizes = classes.groupBy("kmer").agg(F.count("*").alias("m")).where("m > 1")
    wanted = classes.join(sizes, "kmer").select(F.col("one.key").alias("key"), F.struct("kmer", "r1", "r2", owner.alias("owner"), F.col("one.at").alias("at"), "d_low", "d_high", (F.col("m") > split).alias("hot")).alias("w"))
    wanted = wanted.groupBy("key").agg(F.collect_list("w").alias("wanted"))
    cut = common.arrow_map(data.select("key", "text").join(wanted, "key").select("text", "wanted"), _cut(length, unit), "kmer long, r1 long, r2 long, owner long, d_low int, d_high int, hot boolean, region binary")
    cut = common.materialize(cut, "cut")
    common.forget(data.sparkSession)
    ordered = cut.where("NOT hot").repartition("kmer").sortWithinPartitions("kmer")
    ranges = common.arrow_map(ordered, _sorted(length, k, unit), "r1 long, r2 long, ranges array<struct<low:int,high:int>>").select("r1", "r2", F.explode("ranges").alias("range"))
    ranges = ranges.select("r1", "r2", "range.low", "range.high")
    dealt, read = _dealt(cut.where("hot"), length, unit)
    whole = classes.where("several").select("r1", "r2", F.col("d_low").alias("low"), F.col("d_high").alias("high"))
    repeated = common.materialize(whole.unionByName(ranges).unionByName(dealt), "ranges")
    common.forget(data.sparkSession, classes, cut, *read)
    return met.select("key", "at", "r1", "r2").join(repeated, ["r1", "r2"]).select("key", F.struct(F.lit(words).alias("words"), (F.col("at") - F.col("high")).alias("low"), (F.col("at") - F.col("low") + length).alias("high")).alias("span"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = KMER, with_text: bool = False, split: int = SPLIT, words: int = WORDS, word_k: int = WORD_KMER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept (bytes left), repeated (some went) and n_shared_words for each row, and with ``with_text`` the bytes left, as kept.

    n_shared_words counts the words in passages of at least ``words`` words that another document has too, however few bytes they are; none goes for it.
    """
    data = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    spans = _repeats(data, length, k, split, words=False).unionByName(_repeats(data, words, word_k, split, words=True))
    spans = spans.groupBy("key").agg(F.collect_set("span").alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, repeated boolean, n_shared_words long" + ", kept binary" * with_text
    return common.arrow_map(data.join(spans, "key", "left").select("doc_id", "text", "spans"), _removed(length, with_text), schema)
