"""Quarantine and cascading release of turns that depend on earlier ones, in DataFrame operations only.

A conversation's turns, numbered p from 0 by turn, arrive at second 7 * p. Hashes of a turn say which turn it depends
on, whether it is faulty, when that is repaired, and which of its attempts fail. An attempt waits for the parent's
delivery; failed ones are repeated later and later, and after the last the turn is dead. What depends on a dead or
blocked turn is blocked. Delivered turns are released in order of delivery, with a running state.

Method: sorted turn structs are collected in chunks of at most ``CHUNK`` neighbours, and a higher-order aggregate folds
an array of outcomes that grows turn by turn and is read by parent index; it starts with the outcomes of the ``REACH`` turns before the chunk.
These are not known at first: what hangs on them is pending, and full chunks are folded again from their predecessor's
last outcomes until none of these is pending. A chain of parents breaks where a turn has none, so that takes a round or
two however long a conversation is. Outcomes are exploded, ranked and summed in windows of bounded runs, whose totals are carried.

A null text is empty. A row with a null conv_id or turn is in no conversation: it is returned with nulls. Rows with the
same conv_id and turn are turns of their own, in order of their texts' crc32. Very long texts matter by their crc32 only.
An empty table gives an empty result. Columns other than conv_id, turn and text take no part, whatever they are called.
A state beyond 64 bits is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, ordering
from .pii import let

#: Seconds between arrivals, turns that a parent can be away, attempts, and the first wait after a failed one, doubled each time.
EVERY, REACH, ATTEMPTS, WAIT = 7, 6, 4, 20
#: Turns of a chunk; a fold copies what it has gathered for each of them.
CHUNK = 256
#: A run of releases: so many seconds of deliveries, some 585 arrivals.
RUN_BITS = 12

_DELIVERED, _DEAD, _BLOCKED, _PENDING = range(4)
_OUTCOME = "struct<code:int,attempts:int,first:long,last:long>"


def _h(k: int) -> Column:
    return F.crc32(F.concat_ws(":", F.lit(str(k)), F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary"))


def _outcome(code: Column | int, attempts: Column | int | None = None, first: Column | None = None, last: Column | None = None) -> Column:
    values = [F.lit(x) if x is None or isinstance(x, int) else x for x in (code, attempts, first, last)]
    return F.struct(*[v.cast(t).alias(n) for v, n, t in zip(values, ("code", "attempts", "first", "last"), ("int", "int", "long", "long"), strict=True)])


def _constant(code: int, last: int | None) -> Column:
    return F.array(*[_outcome(code, 0, None, F.lit(last)) for _ in range(REACH)])


def _attempted(begun: Column, turn: Column) -> Column:
    """Outcome of a turn whose first attempt comes at ``begun``."""
    at = [begun + WAIT * (2**a - 1) for a in range(ATTEMPTS)]
    passes = lambda a: (turn["repaired"] < 0) | (at[a] >= turn["repaired"]) & (F.shiftright(turn["fails"], a).bitwiseAND(F.lit(1)) == 0)
    found = F.when(passes(0), _outcome(_DELIVERED, 1, begun, at[0]))
    for a in range(1, ATTEMPTS):
        found = found.when(passes(a), _outcome(_DELIVERED, a + 1, begun, at[a]))
    return found.otherwise(_outcome(_DEAD, ATTEMPTS, begun, at[-1]))


def _folded(turns: Column, before: Column) -> Column:
    """Outcomes of ``before`` and of each of the sorted turns, whose parent is found by its distance from the array's end."""

    def step(acc: Column, turn: Column) -> Column:
        none = _outcome(_DELIVERED, 0, None, F.lit(0))
        parent = F.when(turn["away"] > 0, F.element_at(acc, -F.greatest(turn["away"], F.lit(1)))).otherwise(none)
        blocked = F.when(parent["code"] == _PENDING, _outcome(_PENDING)).when(parent["code"] != _DELIVERED, _outcome(_BLOCKED, 0))
        own = let(parent["last"], lambda last: let(F.greatest(turn["arrival"], last), lambda begun: _attempted(begun, turn)))
        return F.concat(acc, F.array(F.when(parent["code"] != _DELIVERED, blocked).otherwise(own).cast(_OUTCOME)))

    return F.aggregate(turns, before.cast(f"array<{_OUTCOME}>"), step)


def _chunks(turns: DataFrame, size: int) -> DataFrame:
    """From (conv_id, turn, crc): (conv_id, chunk, turns), the turns sorted by their place."""
    rows = ordering.placed(turns, "conv_id", ["turn", "crc"], "turns")
    faulty = _h(1) % 101 < 20
    fails = F.lit(0)
    for a in range(ATTEMPTS):
        fails = fails + F.when(_h(a + 3) % 3 == 0, 1 << a).otherwise(0)
    arrival = F.col("place") * EVERY
    away = (_h(0) % 7).cast("int")
    one = F.struct(
        "place",
        "turn",
        "crc",
        arrival.alias("arrival"),
        F.when(away <= F.col("place"), away).otherwise(0).alias("away"),
        F.when(faulty, arrival + _h(2) % 101).otherwise(-1).cast("long").alias("repaired"),
        F.when(faulty, fails).otherwise(0).alias("fails"),
    )
    chunk = F.floor(F.col("place") / size).cast("long")
    return rows.select("conv_id", chunk.alias("chunk"), one.alias("one")).groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("one")).alias("turns"))


def _tails(chunks: DataFrame, size: int) -> DataFrame:
    """(conv_id, chunk, tail): the last outcomes before each chunk but a conversation's first, none pending."""
    full = chunks.where(F.size("turns") == size)
    last = lambda df, before: F.slice(_folded(F.col("turns"), before), -REACH, REACH)
    start = F.when(F.col("chunk") == 0, _constant(_DELIVERED, 0)).otherwise(_constant(_PENDING, None))
    waits = F.exists("tail", lambda x: x["code"] == _PENDING)
    tails = common.materialize(full.select("conv_id", (F.col("chunk") + 1).alias("chunk"), last(full, start).alias("tail")), "tails")
    while not tails.where(waits).isEmpty():
        known = tails.where(~waits)
        again = full.join(tails.where(waits).select("conv_id", (F.col("chunk") - 1).alias("chunk")), ["conv_id", "chunk"], "left_semi")
        again = again.join(tails, ["conv_id", "chunk"]).select("conv_id", (F.col("chunk") + 1).alias("chunk"), last(again, F.col("tail")).alias("tail"))
        tails = common.materialize(known.unionByName(again), "tails")
    return tails


def replay(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, turn, status, attempts, first_at, last_at, release_no, state) of each row of (conv_id, turn, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select("conv_id", "turn", F.crc32(text.cast("binary")).alias("crc"))
    within = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    chunks = common.materialize(_chunks(rows.where(within), chunk), "chunks")
    begun = F.coalesce(F.col("tail"), _constant(_DELIVERED, 0).cast(f"array<{_OUTCOME}>"))
    folded = chunks.join(_tails(chunks, chunk), ["conv_id", "chunk"], "left")
    outcomes = F.slice(_folded(F.col("turns"), begun), REACH + 1, F.size("turns"))
    one = F.explode(F.arrays_zip(F.col("turns").alias("turn"), outcomes.alias("outcome"))).alias("one")
    done = common.materialize(folded.select("conv_id", one).select("conv_id", "one.turn.place", "one.turn.turn", "one.turn.crc", "one.outcome.*"), "outcomes")
    delivered = done.where(F.col("code") == _DELIVERED)
    released = ordering.running(delivered, "conv_id", F.shiftright("last", RUN_BITS), ["last", "turn", "place"], "crc")
    null = F.lit(None).cast("long")
    others = done.where(F.col("code") != _DELIVERED).withColumns({"number": null, "total": null})
    names = F.array(*[F.lit(x) for x in ("delivered", "dead", "blocked")])
    told = released.unionByName(others).select(
        "conv_id", "turn", names[F.col("code")].alias("status"), "attempts", F.col("first").alias("first_at"), F.col("last").alias("last_at"), F.col("number").alias("release_no"), F.col("total").alias("state")
    )
    return told.unionByName(rows.where(~within).select("conv_id", "turn"), allowMissingColumns=True)
