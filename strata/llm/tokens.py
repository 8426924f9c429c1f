"""Token ids: encoding with a public tokenizer, fixed-width bit packing, block files with random access.

A token store is a folder of Parquet files, written by Spark's commit protocol, so a lost executor's blocks are written
again and never twice. Each row is one block, a self-contained binary piece:

    shard int, block int           place of the block; shards are in document order, blocks in order in a shard
    start long                     ids in the shard before this block
    n_docs int, n_tokens long      what it holds
    bits int                       width of an id: the bit length of the largest id of the vocabulary
    doc_ids, doc_nulls binary      int64 LE ids of the documents, and one byte each (1: the id is null)
    doc_ends binary                int64 LE, running number of ids at each document's end, within the block
    payload binary                 ids of ``bits`` bits, least significant bit first, gapless

An id at position p of a block starts at bit p * bits, so any range can be cut from the payload and unpacked alone.
Null texts are empty; a document without tokens still has its end id. Rows with the same doc_id stay separate documents,
ordered by the text's hash and the text. An empty table gives an empty store. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Ids in a block; a block is closed after the document that reaches it.
BLOCK_TOKENS = 1 << 16
#: Words that a worker keeps with their ids, in each of two generations: some 200 bytes a word.
CACHED_WORDS = 400_000

_ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space to Python, not to the tokenizer
_TAIL = ".,;:!?#%&*$\""
_ENCODERS: dict[int, WordEncoder] = {}


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a bit string, ``bits`` each, least significant first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    ids = np.ascontiguousarray(ids, dtype="<u4")
    spread = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(spread.reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from position ``start`` on; reads only the bytes they lie in."""
    if count <= 0:
        return np.zeros(0, dtype="<u4")
    if bits in (8, 16, 32):
        return np.frombuffer(payload, dtype=f"<u{bits // 8}", count=count, offset=start * bits // 8).astype("<u4")
    low, high = start * bits // 8, -(-(start + count) * bits // 8)
    flat = np.unpackbits(np.frombuffer(payload, np.uint8, high - low, low), bitorder="little")
    flat = flat[start * bits - 8 * low :][: count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), dtype=np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


def _word_local(spec: dict) -> bool:
    """Whether texts are encoded word by word: white space is dropped by a split whose pieces never hold any, and nothing else looks past it."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    normal = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    piece = steps[0].get("pattern", {}).get("Regex", "")
    return (
        normal == ["NFC", "Replace", "Lowercase"]
        and steps[0].get("type") == "Split"
        and steps[0].get("behavior") == "Removed"
        and bool(steps[0].get("invert"))
        and piece.endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
        and len(steps) == 2
        and steps[1].get("type") == "ByteLevel"
        and not steps[1].get("add_prefix_space")
        and not any(x.get("lstrip") or x.get("rstrip") or re.search(r"\s", x["content"]) for x in spec.get("added_tokens", []))
        and spec.get("post_processor") is None
        and spec.get("truncation") is None
    )


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself if printable in Latin-1, else the next free one from 256 on."""
    free = iter(range(256, 512))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class WordEncoder(dict):
    """Maps words to their ids as little-endian 32-bit bytes; missing words are encoded by the tokenizers library and kept.

    Where the tokenizer treats each white-space word alone, a text's ids are its words' ids joined, which is far faster
    than encoding whole texts as words repeat; any other tokenizer encodes whole texts.
    """

    def __init__(self, spec: str, local: bool, words: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(spec)
        self.local, self.words, self.older = local, words, {}
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters_only(self, word: str) -> bytes:
        low = word.lower()
        shown = low if low.isascii() else "".join([self.letters[b] for b in low.encode()])
        return b"".join([x.id.to_bytes(4, "little") for x in self.model.tokenize(shown)])

    def _encoded(self, word: str) -> bytes:
        core = word.rstrip(_TAIL)
        if core.isalpha() and (core.isascii() or max(core) < "ɐ" and "İ" not in core):
            return self[core] + self[word[len(core) :]] if len(core) < len(word) else self._letters_only(word)
        return self.whole(word)

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._encoded(word)
        if len(self) >= self.words:  # words that were asked for since the last change of generation outlive this one
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.local or _ODD_SPACE.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


def encoder(spec, words: int = CACHED_WORDS) -> WordEncoder:
    """The worker's encoder of a broadcast tokenizer; workers are reused, and so are their words."""
    text, local = spec.value
    key = zlib.crc32(text.encode())
    if key not in _ENCODERS or _ENCODERS[key].words != words:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(text, local, words)
    return _ENCODERS[key]


def load_spec(spark: SparkSession, tokenizer_path: str):
    """Broadcast a tokenizer's file, a few MB whatever the input, and whether it treats words alone."""
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    return spark.sparkContext.broadcast((text, _word_local(json.loads(text))))


def vocabulary_size(spec) -> int:
    found = json.loads(spec.value[0])
    return 1 + max([*found["model"]["vocab"].values(), *(x["id"] for x in found.get("added_tokens", []))])


_BLOCK = "shard int, block int, start long, n_docs int, n_tokens long, bits int, doc_ids binary, doc_nulls binary, doc_ends binary, payload binary"


def _blocks(spec, bits: int, end_id: int, block_tokens: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def close(shard: int, block: int, start: int, ids: list, parts: list) -> pa.RecordBatch:
        sizes = np.array([len(x) // 4 for x in parts], dtype="<i8")
        row = {
            "shard": shard, "block": block, "start": start, "n_docs": len(ids), "n_tokens": int(sizes.sum()), "bits": bits,
            "doc_ids": np.array([x or 0 for x in ids], dtype="<i8").tobytes(), "doc_nulls": bytes(x is None for x in ids),
            "doc_ends": np.cumsum(sizes).astype("<i8").tobytes(), "payload": pack(np.frombuffer(b"".join(parts), dtype="<u4"), bits),
        }
        return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard = encoder(spec), TaskContext.get().partitionId()
        block = start = held = 0
        ids, parts = [], []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                part = words.encode(text) + end
                ids.append(doc_id)
                parts.append(part)
                held += len(part) // 4
                if held >= block_tokens:
                    yield close(shard, block, start, ids, parts)
                    block, start, held, ids, parts = block + 1, start + held, 0, [], []
        if ids:
            yield close(shard, block, start, ids, parts)

    return run


_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("bits", pa.int32()),
    ("doc_ids", pa.binary()), ("doc_nulls", pa.binary()), ("doc_ends", pa.binary()), ("payload", pa.binary()),
])


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode all texts and write a token store at ``path``, in ascending doc_id order (null ids first).

    One shuffle: range partitioning on (doc_id, hash of the text), so even rows that share one id are dealt out.
    """
    spark = docs.sparkSession
    spec = load_spec(spark, tokenizer_path)
    bits = bits_for(max(vocabulary_size(spec), end_id + 1))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
        .repartitionByRange("doc_id", "h")
        .sortWithinPartitions("doc_id", "h", "text")
        .select("doc_id", "text")
    )
    common.arrow_map(ordered, _blocks(spec, bits, end_id, block_tokens), _BLOCK).write.parquet(path)


def shard_starts(blocks: DataFrame) -> DataFrame:
    """Ids before each shard: one row a shard, which is one row for each task that wrote, thousands at most."""
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def _documents(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["bits"], 0, row["n_tokens"]).tobytes()
                doc_ids, ends = np.frombuffer(row["doc_ids"], "<i8").tolist(), np.frombuffer(row["doc_ends"], "<i8").tolist()
                begins, first = [0, *ends[:-1]], row["shard_start"] + row["start"]
                parts = [ids[4 * a : 4 * b] for a, b in zip(begins, ends, strict=True)]
                columns = [
                    pa.array([None if z else x for x, z in zip(doc_ids, row["doc_nulls"], strict=True)], pa.int64()),
                    pa.array([first + a for a in begins], pa.int64()),
                    pa.array([b - a for a, b in zip(begins, ends, strict=True)], pa.int64()),
                    pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(parts, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a token store: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (binary, 32-bit LE)."""
    blocks = spark.read.parquet(path)
    placed = blocks.join(F.broadcast(shard_starts(blocks)), "shard")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return common.arrow_map(placed, _documents(with_ids), schema)


def read_range(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """Random access: ids from ``start`` on. Only blocks that hold some of them are read, and only their bits unpacked."""
    blocks = spark.read.parquet(path)
    first = F.col("shard_start") + F.col("start")
    rows = blocks.join(F.broadcast(shard_starts(blocks)), "shard").where((first < start + count) & (first + F.col("n_tokens") > start))
    parts = []
    for row in rows.withColumn("first", first).orderBy("first").toLocalIterator():
        low = max(0, start - row["first"])
        parts.append(unpack(bytes(row["payload"]), row["bits"], low, min(row["n_tokens"], start + count - row["first"]) - low))
    return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")
