"""Language-model scores: prediction by partial matching over bytes, and add-one word scores.

The byte model is a trie of contexts of up to three bytes. Its counts come from all training texts: each task sums its
own and sends one row per context and symbol, so what is gathered grows with the input. Escape probabilities follow
method C (symbols seen in a context over symbols seen plus occurrences), and symbols of a longer context are excluded
when a shorter one is asked. The byte 0xFF, which UTF-8 never uses, stands before each text and ends it. Only seen
contexts and symbols are kept, as sorted codes with one escape per context. Contexts of three bytes are dealt by a hash
into parts of about ``PART_CELLS`` seen symbols; a part, with all shorter contexts, is what is gathered and broadcast at
a time, and a text's score is the sum over the parts. So all texts are scored in order three, whatever the input's size.

Words: counts over all training texts. Words that make up more than one in ``HEAD`` training tokens, of which there
can be no more than ``HEAD``, are broadcast; the rest is joined by word.

Null texts are empty. Repeated rows count and are scored each. Empty tables give empty results, and without training
texts the byte model is uniform and every word unknown. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 3
HEAD = 1 << 20
#: Seen symbols of three-byte contexts that are broadcast at a time.
PART_CELLS = 1 << 23
#: Entries after which a task sends its partial counts.
HELD_WORDS, HELD_BYTES = 1 << 20, 1 << 23
_EDGE = b"\xff" * ORDER


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For non-empty texts: the four-byte code (three of context, one predicted) of each byte and each end, and where each text's codes begin."""
    joined = np.frombuffer(_EDGE + b"".join([t + _EDGE for t in texts]), np.uint8).astype(np.uint32)
    codes = (joined[:-3] << 24) | (joined[1:-2] << 16) | (joined[2:-1] << 8) | joined[3:]
    starts = np.cumsum([0, *(len(t) + 3 for t in texts)])[:-1]
    return codes, starts


def _is_event(codes: np.ndarray) -> np.ndarray:
    return (codes & 0xFFFF) != 0xFFFF  # two bytes 0xFF in a row lie between texts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter = Counter()
    keys, sums = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    pending, held, texts_seen, empty = [], 0, 0, 0

    def merge() -> None:
        nonlocal keys, sums, pending, held
        if pending:
            codes, _ = _windows(pending)
            found, n = np.unique(codes[_is_event(codes)], return_counts=True)
            both, at = np.unique(np.concatenate([keys, found]), return_inverse=True)
            sums = np.bincount(at, weights=np.concatenate([sums, n]), minlength=len(both)).astype(np.int64)
            keys, pending, held = both, [], 0

    def sent() -> pa.RecordBatch:
        w, c = list(words), list(words.values())
        words.clear()
        return pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.nulls(len(w), pa.int64()), pa.array(c, pa.int64())], ["word", "code", "n"])

    for batch in batches:
        for text in batch["text"].to_pylist():
            texts_seen += 1
            if not text:
                empty += 1
                continue
            words.update(text.lower().split())
            pending.append(text)
            held += len(text)
            if held >= HELD_BYTES:
                merge()
            if len(words) >= HELD_WORDS:
                yield sent()
    merge()
    if words:
        yield sent()
    codes = np.concatenate([keys.astype(np.int64), [-1, 0xFFFFFFFF]])
    yield pa.RecordBatch.from_arrays([pa.nulls(len(codes), pa.binary()), pa.array(codes, pa.int64()), pa.array(np.concatenate([sums, [texts_seen, empty]]).astype(np.int64), pa.int64())], ["word", "code", "n"])


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log10(x)


class _Level:
    """The contexts of one length, sorted, and the symbols seen in them: ``cells`` holds context and symbol codes, sorted.

    ``top`` of a cell and ``escape`` of a context (log10) hold where no longer context was asked. ``left`` and ``pass_on`` hold in the context
    that is one byte shorter when the symbols of this one are excluded there: what its counts are divided by, and the
    escape from it.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, lower: _Level | None):
        self.cells, at = np.unique(codes, return_inverse=True)
        n = np.bincount(at, weights=counts, minlength=len(self.cells))
        self.raw = n
        owner = self.cells >> 8
        first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
        self.contexts, starts = owner[first], np.nonzero(first)[0]
        self.distinct = np.diff(np.concatenate([starts, [len(owner)]])).astype(np.float64)
        self.sums = np.add.reduceat(n, starts) if len(starts) else np.zeros(0)
        closed = lower is None and len(self.cells) == 256  # nothing to escape to
        self.escape = _log(np.where(closed, 0, self.distinct / (self.sums + self.distinct)))
        whole = self.sums + (0 if closed else self.distinct)
        self.top = _log(n / np.repeat(whole, self.distinct.astype(np.int64))).astype(np.float32)
        if lower is not None:
            k = lower.width
            parent = lower.place(self.contexts & ((1 << k) - 1))
            there = lower.raw[np.searchsorted(lower.cells, self.cells & ((1 << (k + 8)) - 1))]
            rest = np.maximum(lower.sums[parent] - np.add.reduceat(there, starts), 0) if len(starts) else np.zeros(0)
            kinds = lower.distinct[parent] - self.distinct
            out = np.zeros_like(kinds) if k == 0 and len(lower.cells) == 256 else kinds
            self.left = _log(rest + out)
            self.pass_on = _log(np.where(kinds > 0, out / np.maximum(rest + out, 1), 1.0))
        self.width = 0 if lower is None else lower.width + 8
        self.cells, self.contexts = self.cells.astype(np.uint32), self.contexts.astype(np.uint32)

    def place(self, contexts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.contexts, contexts.astype(np.uint32))

    def trim(self, longest: bool) -> None:
        """Drop what only a longer level's construction needs; the longest level is never asked under exclusion."""
        self.logs = None if longest else _log(self.raw)
        del self.raw, self.sums, self.distinct


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked code is in the sorted keys, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
    return at, (keys[at] == asked) if len(keys) else np.zeros(len(asked), bool)


def block_of(contexts, blocks: int):
    """Which of ``blocks`` parts of the model holds a three-byte context; for arrays and columns."""
    return (contexts * 2654435761 % 4294967296 - contexts * 2654435761 % 65536) / 65536 % blocks


class ByteModel:
    """The sparse trie: what was seen in each context, and the escapes; all logarithms are to base ten.

    ``codes`` are of three bytes of context and one symbol. ``lower`` are the codes and counts that the shorter contexts
    are summed from, if not the same: a part of the model holds all shorter contexts and its own of three bytes.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, lower: tuple[np.ndarray, np.ndarray] | None = None, block: int = 0, blocks: int = 1):
        self.block, self.blocks = block, blocks
        self.column = np.arange(256)
        short = (codes, counts) if lower is None else lower
        self.levels: list[_Level] = []
        for k in range(ORDER + 1):
            own, n = (codes, counts) if k == ORDER else short
            self.levels.append(_Level(own & ((1 << (8 * k + 8)) - 1), n, self.levels[-1] if k else None))
        self.empty = len(self.levels[0].cells) == 0
        self.unseen = -math.log10(max(1, 256 - len(self.levels[0].cells)))
        for level in self.levels:
            level.trim(level is self.levels[-1])

    def logs(self, codes: np.ndarray, longest: int = ORDER) -> np.ndarray:
        """log10 probability of each code's symbol after its context of ``longest`` bytes."""
        if self.empty:
            return np.full(len(codes), -math.log10(256))
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        above, above_at = None, np.full(len(codes), -1)  # per open code: its context in the level above, or -1
        for k in range(longest, -1, -1):
            level, asked = self.levels[k], codes[open_].astype(np.uint32) & np.uint32((1 << (8 * k + 8)) - 1)
            cell, hit = _found(level.cells, asked)
            excluded = above_at >= 0
            own, there = _found(level.contexts, asked[~hit] >> np.uint32(8))
            first = hit & ~excluded
            out[open_[first]] += level.top[cell[first]]
            later, on = hit & excluded, ~hit
            if later.any():
                out[open_[later]] += level.logs[cell[later]] - above.left[above_at[later]]
            if above is not None:
                out[open_[on & excluded]] += above.pass_on[above_at[on & excluded]]
            begun = on & ~excluded
            if len(level.contexts):
                out[open_[begun]] += np.where(there, level.escape[own], 0.0)[begun[on]]
            open_, above_at, above = open_[on], np.where(there, own, -1), level
            if not len(open_):
                return out
        out[open_] += self.unseen
        return out

    @property
    def table(self) -> np.ndarray:
        """Contexts of all lengths x bytes, written out; for small models."""
        each = [self.logs(((level.contexts.astype(np.int64)[:, None] << 8) | self.column).reshape(-1), k).reshape(-1, 256) for k, level in enumerate(self.levels)]
        return np.concatenate(each)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text with its end, or this part's share of it."""
        end = np.array([0xFFFFFFFF], np.uint32)
        out = np.full(len(texts), float(self.logs(end)[0]) if self._mine(end)[0] else 0.0)
        batch, held = [], 0
        for i, text in enumerate(texts):
            if text:
                batch.append(i)
                held += len(text)
            if batch and (held >= HELD_BYTES // 4 or i == len(texts) - 1):
                codes, starts = _windows([texts[j] for j in batch])
                logs, asked = np.zeros(len(codes)), _is_event(codes) & self._mine(codes)
                logs[asked] = self.logs(codes[asked])
                out[batch] = np.add.reduceat(logs, starts, dtype=np.float64)
                batch, held = [], 0
        return out

    def _mine(self, codes: np.ndarray) -> np.ndarray:
        return np.ones(len(codes), bool) if self.blocks == 1 else block_of((codes >> 8).astype(np.int64), self.blocks).astype(np.int64) == self.block


def _added(model):
    """The texts' scores by this part of the model added to what other parts gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.asarray(batch["score"]) + model.value.score([t or b"" for t in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(score) if n == "score" else batch[n] for n in batch.schema.names], batch.schema.names)

    return run


def _scored(model, head, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bytes_model, place = head.value, model.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = [t or b"" for t in batch["text"].to_pylist()]
            n_words, n_head, sums, tails = [], [], [], []
            for text in texts:
                words = text.lower().split()
                logs = [known.get(w) for w in words]
                tail = [w for w, x in zip(words, logs, strict=True) if x is None]
                own = [x for x in logs if x is not None] if tail else logs
                n_words.append(len(words))
                n_head.append(len(own))
                sums.append(math.fsum(own))
                tails.append(tail)
            columns = [pa.array(range(place, place + len(texts)), pa.int64()), *[batch[c] for c in keep]]
            columns += [pa.array(n_words, pa.int64()), pa.array(n_head, pa.int64()), pa.array(sums, pa.float64()), pa.array(tails, pa.list_(pa.binary())), pa.array(np.asarray(batch["score"]) + bytes_model.score(texts), pa.float64())]
            place += len(texts)
            yield pa.RecordBatch.from_arrays(columns, ["row", *keep, "n_words", "n_head", "head_sum", "tail", "score"])

    return run


def score(docs: DataFrame, may_learn: Column, keep: list[str], head: int = HEAD, part_cells: int = PART_CELLS) -> DataFrame:
    """Columns ``keep`` of each row with n_tokens, n_known, train_tokens, base_score and score of its text.

    Tokens are words with A-Z lower-cased and one end for each text. base_score is add-one smoothed over the training
    tokens; score is the byte model's log10 probability.
    """
    spark = docs.sparkSession
    data = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("binary").alias("text"), may_learn.alias("may_learn"))
    partial = common.arrow_map(data.where("may_learn").select("text"), _counted, "word binary, code long, n long")
    counted = common.materialize(partial.groupBy("word", "code").agg(F.sum("n").alias("n")), "counts")
    vocabulary = counted.where("word IS NOT NULL").select("word", "n")
    n_docs = int(counted.where("code = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    cells = counted.where("code >= 0 AND n > 0").select("code", "n")  # one row a context and symbol of the trie
    gathered = lambda df: [df[c].to_numpy(t) for df in [df.toPandas()] for c, t in (("code", np.int64), ("n", np.float64))]
    lower = gathered(cells.groupBy(F.col("code").bitwiseAND(F.lit(0xFFFFFF)).alias("code")).agg(F.sum("n").alias("n")))
    parts = max(1, -(-cells.count() // part_cells))
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_train, n_types = int(total) + n_docs, distinct + (n_docs > 0)
    often = n_train // head
    frequent = vocabulary.where(F.col("n") > often).toPandas()  # fewer than ``head`` rows: each has over 1/head of all tokens
    known = {bytes(w): math.log10(c + 1) for w, c in zip(frequent["word"], frequent["n"], strict=True)}
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"row long{kinds}, n_words long, n_head long, head_sum double, tail array<binary>, score double"
    data = data.drop("may_learn").withColumn("score", F.lit(0.0))
    for part in range(parts):
        own = cells.where(block_of(F.shiftright("code", 8), parts).cast("int") == part) if parts > 1 else cells
        model = ByteModel(*gathered(own), lower, part, parts)
        if part < parts - 1:
            data = common.materialize(common.arrow_map(data, _added(spark.sparkContext.broadcast(model)), data.schema), "part")
    scored = common.materialize(common.arrow_map(data, _scored(spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(known), keep), schema), "scored")
    rare = vocabulary.where(F.col("n") <= often).select("word", F.log10(F.col("n") + 1).alias("log"))
    rest = scored.select("row", F.explode("tail").alias("word")).join(rare, "word")
    rest = rest.groupBy("row").agg(F.sum("log").alias("tail_sum"), F.count("*").alias("n_tail"))
    n_tokens = F.col("n_words") + 1
    return scored.drop("tail").join(rest, "row", "left").select(
        *[F.col(f"`{c}`") for c in keep],
        n_tokens.alias("n_tokens"),
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0)) + F.lit(int(n_docs > 0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) + F.lit(math.log10(n_docs + 1)) - n_tokens * F.lit(math.log10(n_train + n_types + 1))).alias("base_score"),
        "score",
    )
