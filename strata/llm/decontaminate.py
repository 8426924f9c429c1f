"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Words are lower-cased runs of letters and digits. Fixed masks choose five of up to seven consecutive words and ignore
the others, so a hash over the chosen ones survives substitutions at the rest. Hashes of all documents' positions meet
those of the test items; a hit fixes an alignment. Along it, a document leaks an item if within some ``WINDOW``
consecutive words (the whole item, if shorter) at least ``SHARE`` of the words agree.

Items shorter than the window have shorter masks, which the documents get only where the test set has such items: the two
of ``SHORT`` leave a seed in every item of five words or more whatever words of it differ within ``SHARE``, and an item of
under five words is sought as a whole.

Seeds of the test set are broadcast only if it has at most ``SMALL`` words, and the keys of hit documents only if they
are at most ``SMALL``; beyond that both are shuffle joins.
Null texts have no words. Repeated rows are judged alike; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed masks: 1 is hashed, 0 is ignored.
MASKS = ("11111", "1101011", "1011101")
#: Masks for items of five words up to the window's: of five words with one substituted, one of these has a seed.
SHORT = ("1101", "1011")
#: Masks for whole items of one to four words, of which none may differ.
WHOLE = ("1", "11", "111", "1111")
WINDOW, SHARE, SMALL = 13, 0.8, 1_000_000
_SPAN = max(map(len, MASKS))


def hashed_words(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, key: str, masks: list[str], fits: Callable[[str], Column] | None = None) -> DataFrame:
    """(key, at, seed) for every position and mask, from (key, h); with ``fits``, of the masks that fit the row."""
    n = F.size("h")
    shifted = [F.when(n > k, F.slice("h", k + 1, F.greatest(n - k, F.lit(1)))).otherwise(F.array().cast("array<bigint>")).alias(f"h{k}") for k in range(_SPAN)]
    asked = [] if fits is None else [fits(mask).alias(f"m{i}") for i, mask in enumerate(masks)]
    placed = rows.select(key, *asked, F.posexplode(F.arrays_zip(*shifted)).alias("at", "w"))
    hashes = []
    for i, mask in enumerate(masks):
        chosen = [F.col(f"w.h{k}") for k, bit in enumerate(mask) if bit == "1"]
        there = F.col(f"w.h{len(mask) - 1}").isNotNull()
        hashes.append(F.when(there if fits is None else there & F.col(f"m{i}"), F.xxhash64(F.lit(mask), *chosen)))
    return placed.select(key, "at", F.explode(F.array(*hashes)).alias("seed")).where("seed IS NOT NULL")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, small: int = SMALL) -> DataFrame:
    """(key, doc_id, item_id, at, matched, window) per leaking document and item: where the item's first word aligns, words agreeing in the best window, and its width.

    ``key`` is xxhash64(doc_id, text): rows alike in both share it, and are met once.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), hashed_words(F.col("text")).alias("h")).withColumn("item", F.xxhash64("item_id", "h"))
    items = items.dropDuplicates(["item"])
    n = F.size("h")

    def fits(mask: str) -> Column:
        return n == len(mask) if mask in WHOLE else (n > len(WHOLE)) & (n < window) if mask in SHORT else n >= window

    every = [*MASKS, *SHORT, *WHOLE]
    told = items.agg(F.coalesce(F.sum(n), F.lit(0)).alias("words"), F.count("*").alias("items"), *[F.count_if(fits(m)).alias(m) for m in every]).first()
    few = told["words"] <= small and told["items"] <= small
    masks = [m for m in every if told[m]] or list(MASKS)
    tested = seeds(items, "item", masks, fits).select(F.col("item"), F.col("at").alias("item_at"), "seed")
    data = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.xxhash64("doc_id", "text"))
    met = seeds(data.select("key", hashed_words(F.col("text")).alias("h")), "key", masks)
    hits = met.join(F.broadcast(tested) if few else tested, "seed").select("key", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = common.materialize(hits, "hits")
    asked = hits.select("key").distinct()
    texts = data
    if asked.count() <= small:
        texts = data.join(F.broadcast(asked), "key", "left_semi")
    texts = texts.select("key", "doc_id", hashed_words(F.col("text")).alias("d"))
    aligned = hits.join(F.broadcast(items) if few else items, "item").join(texts, "key")
    agree = F.transform("h", lambda x, i: F.when(F.get("d", i + F.col("shift")) == x, 1).otherwise(0))
    width = F.least(F.size("h"), F.lit(window))
    sums = F.transform(F.sequence(F.lit(1), F.size("agree") - F.col("width") + 1), lambda i: F.aggregate(F.slice("agree", i, F.col("width")), F.lit(0), lambda a, b: a + b))
    scored = aligned.withColumn("agree", agree).withColumn("width", width).withColumn("matched", F.array_max(sums))
    found = scored.where(F.col("matched") >= F.lit(share) * F.col("width"))
    best = F.max_by(F.struct("shift", "matched", "width"), F.struct("matched", -F.col("shift")))
    return found.groupBy("key", "doc_id", "item_id").agg(best.alias("best")).select("key", "doc_id", "item_id", F.col("best.shift").alias("at"), F.col("best.matched").alias("matched"), F.col("best.width").alias("window"))
