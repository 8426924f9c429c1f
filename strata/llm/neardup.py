"""Near-duplicate documents by circulant MinHash, with exact confirmation.

A document's set holds its distinct shingles of ``shingle`` consecutive words (A-Z lower-cased, maximal runs without
space, tab, LF, VT, FF, CR); with fewer words the whole sequence is the one shingle; without words the set is empty and
linked with nothing, and so is a null text's. Documents are linked where 100 * intersection >= percent * union.

Signature: a first permutation places the shingle's hash on a ring of 2**32; coordinate k is the least value of the
second permutation over the set shifted by k places. Both are bijections of 32-bit integers, so the two stand for all
coordinates. ``bands`` bands of ``rows`` coordinates propose pairs: at a similarity of 0.8, 36 bands of 5 miss a pair
with probability 6e-7.

Equal sets (by a 128-bit sum of shingle hashes) are one class first, so groups of copies cost one signature lookup.
Round one tests, in every bucket, each class against the bucket's least class only. Round two does so, in buckets that
still hold several components, with the class that is in most of those buckets, such as the text that copies were made
from. Round three is for buckets that hold several components even then, where all pairs would grow with the square. Their shingles are put in one
order, rare ones first; two sets of sizes m and n that are linked share at least percent * (m + n) / (100 + percent)
shingles, so they share one among the first of each, at places that leave room for that many. Classes are joined on
those shingles, each class against those outside the shingle's largest component, and pairs inside a component cannot
change the result. No bucket, partner or candidate is capped, and every link is confirmed on full sets from whole texts.

Result: one row per input row, with the input as struct ``src`` and n_shingles, component_id (the least doc_id
reachable), kept (doc_id = component_id) and first (one row of each group, and every row without words). Rows that share doc_id stay separate; a null doc_id is never a component's
id unless all are null, and is then kept by none. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

BANDS, ROWS = 36, 5
#: Shingles that are signed at a time: small enough for a core's cache.
CHUNK = 1 << 16
#: A worker's hashes of words: some 10 MB, as several workers share an executor's memory.
CACHED_WORDS = 1 << 16
_U64, _U32 = np.uint64, np.uint32
_FIRST, _SECOND, _THIRD = _U32(0x85EBCA6B), _U32(0xC2B2AE35), _U32(0x9E3779B1)


class _Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _Hashes()


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, sorted."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, _U64)
    hashes = np.array(list(map(_HASHES.__getitem__, words)), dtype=_U64)
    n = min(shingle, len(hashes))
    mixed = np.full(len(hashes) - n + 1, n, dtype=_U64)
    for k in range(n):
        mixed = (mixed ^ hashes[k : len(hashes) - n + 1 + k]) * _U64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> _U64(29)
    return np.unique(mixed)


def signatures(hashes: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """(documents, coordinates): circulant MinHash of the non-empty sets that begin at ``starts``."""
    ring = (hashes >> _U64(32)).astype(_U32)
    ring ^= ring >> _U32(16)
    ring *= _FIRST  # first permutation
    placed = ring * _SECOND  # the second begins with a product, so a shift by k adds k * _SECOND
    out = np.empty((len(starts), coordinates), dtype=_U32)
    moved, other = np.empty_like(placed), np.empty_like(placed)
    with np.errstate(over="ignore"):
        for k in range(coordinates):
            np.add(placed, _U32(k) * _SECOND, out=moved)
            np.right_shift(moved, _U32(15), out=other)
            np.bitwise_xor(moved, other, out=moved)
            np.multiply(moved, _THIRD, out=moved)
            np.right_shift(moved, _U32(16), out=other)
            np.bitwise_xor(moved, other, out=moved)
            out[:, k] = np.minimum.reduceat(moved, starts)
    return out


def _band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(signature), bands), dtype=_U64)
    for band in range(bands):
        key = np.full(len(signature), band + 1, dtype=_U64)
        for k in range(band * rows, band * rows + rows):
            key = (key ^ signature[:, k]) * _U64(0xD6E8FEB86659FD93)
            key ^= key >> _U64(32)
        keys[:, band] = key
    return keys.view(np.int64)


def _signed(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch["text"].to_pylist()
            n, nodes, keys = [0] * len(texts), [None] * len(texts), [None] * len(texts)
            held, at, size = [], [], 0
            for i, text in enumerate(texts):
                own = shingle_set(text, shingle)
                n[i] = len(own)
                if len(own):
                    mixed = (own ^ (own >> _U64(31))) * _U64(0xBF58476D1CE4E5B9)
                    nodes[i] = int(own.sum().view(np.int64)), int((mixed ^ (mixed >> _U64(27))).sum().view(np.int64))
                    held.append(own)
                    at.append(i)
                size += len(own)
                if held and (size >= CHUNK or i == len(texts) - 1):
                    starts = np.cumsum([0, *map(len, held)])[:-1]
                    found = _band_keys(signatures(np.concatenate(held), starts, bands * rows), bands, rows)
                    for j, own_keys in zip(at, found.tolist(), strict=True):
                        keys[j] = own_keys
                    held, at, size = [], [], 0
            columns = [pa.array(range(place, place + len(texts)), pa.int64()), batch["src"], pa.array(n, pa.int64())]
            columns += [pa.array([x and x[k] for x in nodes], pa.int64()) for k in (0, 1)]
            columns.append(pa.array(keys, pa.list_(pa.int64())))
            place += len(texts)
            yield pa.RecordBatch.from_arrays(columns, ["row", "src", "n_shingles", "sum_a", "sum_b", "keys"])

    return run


def _confirmed(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, None
        for batch in batches:
            linked = []
            for a, text_a, text_b in zip(batch["a"].to_pylist(), batch["text_a"].to_pylist(), batch["text_b"].to_pylist(), strict=True):
                if a != last:
                    last, first = a, shingle_set(text_a, shingle)
                second = shingle_set(text_b, shingle)
                common_n = len(np.intersect1d(first, second, assume_unique=True))
                linked.append(100 * common_n >= percent * (len(first) + len(second) - common_n))
            chosen = batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
            yield chosen

    return run


def _shingles(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch["text"].to_pylist()):
                own = shingle_set(text, shingle).view(np.int64)
                repeated = [pa.repeat(batch[name][i], len(own)) for name in ("node", "component")]
                yield pa.RecordBatch.from_arrays([*repeated, pa.array(own)], ["node", "component", "shingle"])

    return run


def _texts(nodes: DataFrame, reps: DataFrame, rows: DataFrame) -> DataFrame:
    """The classes ``nodes`` with their representatives' texts. Only the texts that are asked for are moved, one for each class."""
    return nodes.join(reps.select("node", "row"), "node").join(rows.select("row", F.col("src.text").cast("binary").alias("text")), "row").drop("row")


def _confirm(pairs: DataFrame, reps: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of classes that are linked."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = common.materialize(_texts(asked, reps, rows), "texts")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return common.materialize(common.arrow_map(both, _confirmed(shingle, percent), "a long, b long"), "links")


def _across(crowded: DataFrame, reps: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) of the classes ``crowded`` (node, n, component), from different components, that can be linked: all that are, and few others."""
    texts = _texts(crowded.select("node", "component"), reps, rows)
    entries = common.arrow_map(texts, _shingles(shingle), "node long, component long, shingle long")
    # a shingle of one component only proposes nothing, so such shingles come first in the order and need no place of their own
    counted = entries.groupBy("shingle").agg(F.count("*").alias("held"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = counted.where("low != high").select("shingle", "held")
    own = entries.select("node", "shingle").join(mixed, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("own"))
    placed = crowded.join(own, "node").withColumn("before", F.col("n") - F.size("own"))
    needed = lambda total, of: F.expr(f"(({total}) * {percent} + {of} - 1) div {of}")
    spare = F.col("n") - needed("n", 100) - F.col("before") + 1  # how many of the mixed shingles are among the first
    placed = placed.where(spare > 0).select("node", "n", "component", "before", F.posexplode(F.slice("own", F.lit(1), spare.cast("int"))).alias("at", "entry"))
    postings = placed.select("node", "n", "component", (F.col("before") + F.col("at")).alias("at"), "entry.shingle")
    postings = common.materialize(postings, "postings")
    largest = postings.groupBy("shingle", "component").agg(F.count("*").alias("held")).groupBy("shingle").agg(F.max_by("component", F.struct("held", "component")).alias("largest"), F.count("*").alias("components"))
    postings = postings.join(largest.where("components > 1").drop("components"), "shingle")
    left, right = postings.where("component != largest").alias("l"), postings.alias("r")
    overlap = needed("l.n + r.n", 100 + percent)
    can = (F.col("l.component") != F.col("r.component")) & ((F.col("r.component") == F.col("r.largest")) | (F.col("l.node") < F.col("r.node")))
    can &= (F.col("l.n") - F.col("l.at") >= overlap) & (F.col("r.n") - F.col("r.at") >= overlap)
    can &= 100 * F.least("l.n", "r.n") >= percent * F.greatest("l.n", "r.n")
    found = left.join(right, (F.col("l.shingle") == F.col("r.shingle")) & can)
    return found.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int, percent: int, bands: int = BANDS, rows_per_band: int = ROWS, id_column: str = "doc_id") -> DataFrame:
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("src"), F.col("text").cast("binary").alias("text"))
    kind = source.schema["src"].dataType.simpleString()
    signed = common.arrow_map(source, _signed(shingle, bands, rows_per_band), f"row long, src {kind}, n_shingles long, sum_a long, sum_b long, keys array<long>")
    # a class is named by a 64-bit hash of its 128-bit sum and its size
    node = F.when(F.col("n_shingles") > 0, F.xxhash64("sum_a", "sum_b", "n_shingles"))
    rows = common.materialize(signed.select("row", "src", "n_shingles", node.alias("node"), "keys"), "signed")
    own = F.col(f"src.{id_column}")
    best = F.min(F.struct(own.isNull().alias("none"), own.alias("id"), "row")).alias("best")
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(best, F.max("n_shingles").alias("n"))
    reps = common.materialize(classes.select("node", "best", "best.row", "n"), "classes")
    keyed = reps.join(rows.select("row", "keys"), "row").select("node", "n", F.explode("keys").alias("key"))
    keyed = common.materialize(keyed, "bands")
    buckets = keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("least"), F.count("*").alias("members")).where("members > 1")
    similar = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    shared = common.materialize(keyed.join(buckets, "key").select("key", "node", "n", F.col("least.node").alias("first"), F.col("least.n").alias("first_n"), "members"), "buckets")
    star = shared.where((F.col("node") != F.col("first")) & similar(F.col("n"), F.col("first_n"))).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    links = _confirm(common.materialize(star, "pairs"), reps, rows, shingle, percent)
    named = components(links)
    # buckets that still hold several components
    def still_mixed(named: DataFrame) -> DataFrame:
        labelled = shared.where("members > 2").select("key", "node", "n").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = labelled.groupBy("key").agg((F.min("component") != F.max("component")).alias("several")).where("several").select("key")
        return common.materialize(labelled.join(several, "key"), "mixed")

    mixed = still_mixed(named)
    held = mixed.groupBy("node").agg(F.count("*").alias("held"))
    middle = mixed.join(held, "node").groupBy("key").agg(F.max(F.struct("held", "node", "n", "component")).alias("middle"))
    around = mixed.join(middle, "key").where((F.col("component") != F.col("middle.component")) & similar(F.col("n"), F.col("middle.n")))
    around = common.materialize(around.select(F.col("middle.node").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    if not around.isEmpty():
        links = links.unionByName(_confirm(around, reps, rows, shingle, percent))
        named = components(links)
        mixed = still_mixed(named)
    crowded = common.materialize(mixed.select("node", "n", "component").distinct(), "crowded")
    across = common.materialize(_across(crowded, reps, rows, shingle, percent), "pairs")
    if not across.isEmpty():
        links = links.unionByName(_confirm(across, reps, rows, shingle, percent))
        named = components(links)
    grouped = reps.select("node", "best").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = grouped.groupBy("component").agg(F.min("best").alias("least"))
    result = common.materialize(grouped.join(least, "component").select("node", F.col("least.id").alias("component_id"), F.col("least.row").alias("first")), "components")
    joined = rows.drop("keys").join(result, "node", "left")
    joined = joined.withColumn("component_id", F.when(F.col("node").isNull(), own).otherwise(F.col("component_id")))
    kept, first = F.coalesce(own == F.col("component_id"), F.lit(False)), F.col("node").isNull() | (F.col("row") == F.col("first"))
    return joined.select("src", "n_shingles", "component_id", kept.alias("kept"), first.alias("first"))
