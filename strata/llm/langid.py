"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams of lower-cased code points are learned from a bounded sample of labelled rows
(``train_docs``: those whose ids hash lowest); the log-probability matrix, ``buckets`` x languages, is broadcast, and
whole texts are scored in numpy batches. A null text, or one without a letter, is ``und`` with score 0, and so is every
text if nothing was learned. Empty tables give empty results; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled rows to learn from, at most (ties of the id's hash aside).
TRAIN_DOCS = 12_000
SMOOTHING = 0.5
#: Code points that are scored at a time.
CHUNK = 1 << 18
UNDETERMINED = "und"
_PAD = b"\0\0\0\0" * (max(ORDERS) - 1)


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' lower-cased code points, each text after zeros that part it from the last, and where each begins."""
    parts = [_PAD + t.lower().encode("utf-32-le", "replace") for t in texts]
    starts = np.cumsum([0, *(len(p) // 4 for p in parts)])[:-1]
    return np.frombuffer(b"".join(parts), dtype="<u4"), starts


def _grams(points: np.ndarray, buckets: int) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram that ends at each code point; ``buckets`` where it would cross a text's start."""
    wide = points.astype(np.uint32)
    for n in ORDERS:
        key, inside = np.full(len(wide), n, dtype=np.uint32), np.ones(len(wide), dtype=bool)
        for back in range(n - 1, -1, -1):
            shifted = np.concatenate([np.zeros(min(back, len(wide)), np.uint32), wide[: max(0, len(wide) - back)]])
            key = (key ^ shifted) * np.uint32(0x9E3779B1)
            inside &= shifted != 0
        key ^= key >> np.uint32(15)
        yield np.where(inside, key & np.uint32(buckets - 1), np.uint32(buckets)).astype(np.intp)


def _counted(langs: list[str], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(langs), buckets + 1), dtype=np.int64)
        for batch in batches:
            found: dict[str, list[str]] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found.setdefault(lang, []).append(text)
            for lang, texts in found.items():
                points, _ = _code_points(texts)
                for gram in _grams(points, buckets):
                    counts[langs.index(lang)] += np.bincount(gram, minlength=buckets + 1)
        lang, bucket = np.nonzero(counts[:, :buckets])
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[lang, bucket], pa.int64())], ["lang", "bucket", "n"])

    return run


class Model:
    """Languages and the matrix of log-probabilities, whose last row (n-grams across a start) is zero."""

    def __init__(self, langs: list[str], matrix: np.ndarray, prior: np.ndarray):
        self.langs, self.matrix, self.prior = langs, matrix, prior

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        batch, held = [], 0
        for i in at:
            batch.append(i)
            held += len(texts[i])
            if held >= CHUNK or i == at[-1]:
                points, starts = _code_points([texts[j] for j in batch])
                totals = np.zeros((len(batch), len(self.langs)))
                for low in range(0, len(points), CHUNK):  # a text longer than a chunk is summed piece by piece
                    reach = max(0, low - len(_PAD) // 4)
                    own = points[reach : low + CHUNK]
                    first = int(np.searchsorted(starts, low, side="right")) - 1
                    last = int(np.searchsorted(starts, low + CHUNK, side="left"))
                    cuts = np.maximum(starts[first:last], low) - low
                    summed = sum(self.matrix[gram[low - reach :]] for gram in _grams(own, len(self.matrix) - 1))
                    totals[first:last] += np.add.reduceat(summed, cuts, axis=0, dtype=np.float64)
                totals += self.prior
                totals = np.exp(totals - totals.max(axis=1, keepdims=True))
                totals /= totals.sum(axis=1, keepdims=True)
                for j, row in zip(batch, totals, strict=True):
                    lang[j], score[j] = self.langs[int(row.argmax())], float(row.max())
                batch, held = [], 0
        return lang, score


def train(docs: DataFrame, may_learn: Column, train_docs: int = TRAIN_DOCS, buckets: int = BUCKETS) -> Model:
    """Learn from at most ``train_docs`` rows with text and lang where ``may_learn`` holds."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", "lang").where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    hashed = rows.withColumn("h", F.xxhash64("doc_id"))
    top = hashed.select("h").orderBy("h").limit(train_docs).agg(F.max("h")).first()[0]
    sample = hashed.where(F.col("h") <= F.lit(top)) if top is not None else hashed.limit(0)
    per_lang = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(per_lang)
    if not langs:
        return Model([], np.zeros((buckets + 1, 0), np.float32), np.zeros(0))
    parts = common.arrow_map(sample.select("lang", "text"), _counted(langs, buckets), "lang int, bucket int, n long")
    found = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most buckets x languages
    counts = np.full((len(langs), buckets), SMOOTHING)
    counts[found["lang"].to_numpy(int), found["bucket"].to_numpy(int)] += found["n"].to_numpy()
    matrix = np.zeros((buckets + 1, len(langs)), dtype=np.float32)
    matrix[:buckets] = (np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))).T
    seen = np.array([per_lang[x] for x in langs], dtype=float)
    return Model(langs, matrix, np.log(seen / seen.sum()))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = model.value.predict(batch["text"].to_pylist())
            kept = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*kept.schema.names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row, with lang_pred and score of its text."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("text")) if "text" not in keep else None
    if chosen is None:
        raise ValueError("text is what is scored; name the other columns to keep")
    return common.arrow_map(chosen, _scored(shared), f"{schema}, lang_pred string, score double")
