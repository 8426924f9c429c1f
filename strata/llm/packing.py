"""Best-fit packing of tokenized documents into sequences of bounded length.

A configuration says how many pieces of each length class one sequence holds. The covering program over all
configurations is solved by multiplicative weights: the classes are dealt anew each round into groups (partial pricing),
priced by their size times a weight that is greater the more of a class is still uncovered, and a bounded knapsack
dynamic program finds a group's best configurations at these prices, one around each of its largest classes. A full one takes its
share of the sequences, rounded down to whole copies that its classes still have. What this leaves, with the smallest
classes, which fill the last gaps, is packed by best-fit decreasing on the histogram. The driver holds only the histogram
(one row a class) and the runs of the plan, whose sizes depend on the sequence length and not on the input.

Null texts are empty; every document has at least its end id, so none is lost. Repeated rows are packed each. Other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

#: Lengths are rounded up to multiples of this in the program; offsets are always those of the true lengths.
GRID = 1
#: Rounds of multiplicative weights, how far weights part (a full configuration has nearly equal prices a token), and groups a round.
ROUNDS, RATE, GROUPS = 64, 0.3, 16
#: Classes under this part of a sequence are left to best fit, and a group has at least so many classes.
FINE, LEAST_GROUP = 64, 64
#: One in so many classes of a group, the largest, leads a configuration a round.
LEADERS = 4

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, class int, part int, place long, ids binary"


class Knapsack:
    """Best fillings of every room up to ``capacity`` with at most ``bounds[i]`` pieces of ``sizes[i]``, each worth ``values[i]``; by dynamic programming over lots of 1, 2, 4, ... pieces."""

    def __init__(self, sizes: np.ndarray, values: np.ndarray, bounds: np.ndarray, capacity: int) -> None:
        self.lots: list[tuple[int, int]] = []  # size, pieces
        best, worth = np.zeros(capacity + 1), []
        for size, value, bound in zip(sizes.tolist(), values.tolist(), bounds.tolist(), strict=True):
            bound, lot = min(bound, capacity // size), 1
            while bound > 0:
                pieces = min(lot, bound)
                self.lots.append((size, pieces))
                worth.append(value * pieces)
                bound, lot = bound - pieces, 2 * lot
        self.taken = np.zeros((len(self.lots), capacity + 1), dtype=bool)
        for i, (size, pieces) in enumerate(self.lots):
            room = size * pieces
            with_lot = best[:-room] + worth[i]
            np.greater(with_lot, best[room:], out=self.taken[i, room:])
            best[room:] = np.maximum(best[room:], with_lot)

    def filling(self, room: int) -> dict[int, int]:
        """Pieces by size of the best filling of ``room``."""
        found: dict[int, int] = {}
        end = len(self.lots)
        while room > 0:
            taken = np.flatnonzero(self.taken[:end, room])
            if not len(taken):
                break
            end = int(taken[-1])
            size, pieces = self.lots[end]
            found[size] = found.get(size, 0) + pieces
            room -= size * pieces
        return found


def knapsack(values: np.ndarray, capacity: int) -> np.ndarray:
    """How many pieces of each class (of size 1, 2, ...) fill ``capacity`` with the greatest value, without other bounds."""
    sizes, counts = np.arange(1, len(values) + 1), np.zeros(len(values), dtype=int)
    for size, pieces in Knapsack(sizes, values, np.full(len(values), capacity), capacity).filling(capacity).items():
        counts[size - 1] = pieces
    return counts


def configurations(demand: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = RATE) -> Iterator[tuple[dict[int, int], int]]:
    """Full configurations (pieces by size) with their whole copies, none of which takes more than ``demand`` has. ``demand[i]`` counts pieces of size i + 1."""
    sizes, left = np.arange(1, len(demand) + 1), demand.astype(np.int64)
    total, used, deal = float((left * sizes).sum()) / capacity, 0, np.random.default_rng(0)
    quota = max(1, -(-int(total) // (rounds * GROUPS * 8)))  # a column's share, with some eight used a group
    for _ in range(rounds):
        here = np.flatnonzero((left > 0) & (sizes >= capacity // FINE))
        if not len(here):
            return
        lag = used / total - 1 + left / np.maximum(demand, 1)  # share of the sequences made, less the class's share that they hold
        price = sizes * np.exp(rate * lag)
        for group in np.array_split(deal.permutation(here), max(1, min(GROUPS, len(here) // LEAST_GROUP))):
            group = -np.sort(-group)
            best = Knapsack(sizes[group], price[group], left[group], capacity)
            for c in group[: -(-len(group) // LEADERS)].tolist():
                chosen = best.filling(capacity - c - 1)
                chosen[c + 1] = chosen.get(c + 1, 0) + 1
                copies = min(quota, *(int(left[size - 1]) // pieces for size, pieces in chosen.items()))
                if copies > 0 and sum(size * pieces for size, pieces in chosen.items()) == capacity:
                    for size, pieces in chosen.items():
                        left[size - 1] -= pieces * copies
                    used += copies
                    yield chosen, copies


def plan_runs(demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (class, first rank, count, first sequence, slot) that place every piece, and the number of sequences."""
    left, taken = demand.astype(int).copy(), np.zeros(len(demand), dtype=int)
    runs, sequences = [], 0

    def use(chosen: dict[int, int], copies: int) -> None:
        nonlocal sequences
        slot = 0
        for size in sorted(chosen, reverse=True):
            for _ in range(chosen[size]):
                runs.append((size, int(taken[size - 1]), copies, sequences, slot))
                taken[size - 1] += copies
                slot += 1
            left[size - 1] -= chosen[size] * copies
        sequences += copies

    for chosen, copies in configurations(demand, capacity, rounds):
        use(chosen, copies)
    while left.any():  # best fit, largest first; a configuration is used until one of its classes runs out
        chosen, room = {}, capacity
        while room > 0:
            fits = np.flatnonzero(left[: min([room, *(size - 1 for size in chosen)])])
            if not len(fits):
                break
            c = int(fits[-1])
            chosen[c + 1] = min(int(left[c]), room // (c + 1))
            room -= chosen[c + 1] * (c + 1)
        use(chosen, min(int(left[size - 1]) // pieces for size, pieces in chosen.items()))
    return runs, sequences


def _pieces(spec, end_id: int, length: int, grid: int, cached_words: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = tokens.encoder(spec, cached_words), TaskContext.get().partitionId()
        places: dict[int, int] = {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = words.encode(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    own = ids[at : at + 4 * length]
                    size = len(own) // 4
                    kind = -(-size // grid)
                    place = places.get(kind, 0)
                    places[kind] = place + 1
                    rows.append((doc_id, piece, at // 4, size, zlib.crc32(own), kind, part, place, own))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    return run


_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
_NAMES = [x.split()[0] for x in _PIECES.split(", ")]


def _placed(runs):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_class: dict[int, np.ndarray] = {}
        table = np.array(runs.value, dtype=np.int64).reshape(-1, 5)
        for kind in np.unique(table[:, 0]):
            own = table[table[:, 0] == kind]
            by_class[int(kind)] = own[own[:, 1].argsort(kind="stable")]
        for frame in frames:
            sequence, slot = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            kinds, ranks = frame["class"].to_numpy(), frame["rank"].to_numpy()
            for kind in np.unique(kinds):
                at, own = np.flatnonzero(kinds == kind), by_class[int(kind)]
                row = own[np.searchsorted(own[:, 1], ranks[at], side="right") - 1]
                sequence[at], slot[at] = row[:, 3] + ranks[at] - row[:, 1], row[:, 4]
            yield frame.drop(columns=["class", "rank"]).assign(sequence_id=sequence, slot=slot)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, length: int = 4096, grid: int = GRID, rounds: int = ROUNDS, with_ids: bool = False, cached_words: int = tokens.CACHED_WORDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with ``with_ids`` also ids (binary, 32-bit LE).

    Tokens are written once, where they are made, with each piece's place among its task's pieces of its class. A running
    count over tasks turns places into ranks, so no class, however frequent, is gathered in one task. The last window
    sees one sequence at a time, at most ``length`` rows. ``cached_words`` bounds what a worker keeps.
    """
    spark = docs.sparkSession
    spec = tokens.load_spec(spark, tokenizer_path)
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = common.materialize(common.arrow_map(columns, _pieces(spec, end_id, length, grid, cached_words), _PIECES), "pieces")
    counts = pieces.groupBy("class", "part").agg(F.count("*").alias("n"))
    capacity = length // grid
    demand = np.zeros(capacity, dtype=np.int64)
    for row in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        demand[row["class"] - 1] = row["n"]
    runs, _ = plan_runs(demand, capacity, rounds)
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = pieces.join(bases, ["class", "part"]).select(*kept, "class", (F.col("base") + F.col("place")).alias("rank"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    common.bound_batches(spark)
    placed = ranked.mapInPandas(_placed(spark.sparkContext.broadcast(runs)), f"{kinds}, sequence_id long, slot long")
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("slot")
