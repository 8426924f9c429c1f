"""Secrets in texts by fixed patterns and by sliding-window entropy, in DataFrame operations only.

Base kinds, leftmost non-overlapping matches of each: assign (a value of 8 or more characters after a telling name), access
(16 or more characters), hex (32 or more). Failing matches are dropped and not retried.

Entropy: candidates are the longest runs of a character class, ``CLASSES``. A window slides over a candidate with a count
for each symbol, one character of a string each, and the sum of n * log2(n) over these counts: a step takes one symbol out
and one in, and changes the sum by four values of a table. The table is in whole numbers of 1 / ``UNIT`` bits, so a sum
neither drifts nor depends on the machine. Windows of at least the class's bits are secrets; those that overlap or touch
become one span of kind ``entropy``, found beside the base spans, which always stay. Candidates are suppressed if they
match ``ALLOWED`` as a whole, such as plain numbers and UUIDs, or if the word before them is one of ``ALLOWED_AFTER``,
which names checksums.

Null texts are empty and have no spans. Repeated rows are treated each. Empty tables give empty results. Offsets count
code points, end exclusive. Spans of equal start are in order of their kinds. A text costs time in proportion to its
length, however long it is. Columns other than those named take no part, whatever they are called.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pii import folded, let, matches

KINDS = ("assign", "access", "hex", "entropy")

_ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
_ACCESS = r"AKIA[A-Z0-9]{12,}+"
_HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
_SPAN = "array<struct<start:int,kind_order:int,end:int>>"


class CharacterClass(NamedTuple):
    """Symbols, the pattern of candidates, the length of a window and the bits a symbol that make it a secret."""

    symbols: str
    pattern: str
    window: int
    bits: float
    lower: bool


_DIGITS, _LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
HEX = CharacterClass(_DIGITS + "abcdef", r"(?<![A-Za-z0-9+/_-])[0-9A-Fa-f]{20,}+(?![A-Za-z0-9+/_-])", 20, 3.0, True)
BASE64 = CharacterClass(_DIGITS + _LETTERS + _LETTERS.upper() + "+/_-=", r"(?<![A-Za-z0-9+/_-])(?![0-9A-Fa-f]++(?![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{24,}+={0,2}", 24, 4.0, False)
CLASSES = (HEX, BASE64)
UNIT = 1 << 20
_ZERO = "!"  # a count of none; others follow it in the code
#: Candidates that are no secrets: whole numbers, words and names without digits, UUIDs, paths, dates and times.
ALLOWED = (r"[0-9]+", r"[^0-9]+", r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"/?([A-Za-z_-]+[0-9]{0,4}/)+[A-Za-z_-]*[0-9]{0,4}", r"[0-9]{4}-[0-9]{2}-[0-9]{2}T?[0-9+-]*")
#: Words after which a candidate is a checksum.
ALLOWED_AFTER = ("md5", "sha1", "sha256", "sha384", "sha512", "checksum", "commit", "etag", "integrity", "digest")


def weight(n: int) -> int:
    """n * log2(n) in 1 / UNIT bits."""
    return round(n * math.log2(n) * UNIT) if n > 1 else 0


def _moved(window: Column, symbol: Column, by: int, kind: CharacterClass) -> Column:
    """(counts, sum) of a window after a symbol's count changed by one; as they were for the empty symbol."""
    table = F.array(*[F.lit(weight(n)).cast("long") for n in range(kind.window + 2)])

    def change(x: Column) -> Column:
        counts = F.overlay(window["counts"], F.char(x["n"] + by + ord(_ZERO)), x["at"], F.lit(1))
        return F.struct(counts.alias("counts"), (window["sum"] + table[x["n"] + by] - table[x["n"]]).alias("sum"))

    found = F.instr(F.lit(kind.symbols), symbol)
    counted = let(found, lambda at: F.struct(at.alias("at"), (F.ascii(F.substr(window["counts"], at, F.lit(1))) - ord(_ZERO)).alias("n")))
    return F.when(symbol == "", F.struct(window["counts"].alias("counts"), window["sum"].alias("sum"))).otherwise(let(counted, change))


def high_windows(value: Column, kind: CharacterClass) -> Column:
    """Array of (start, end): the windows of a candidate with at least the class's bits a symbol, merged where they overlap or touch."""
    width = kind.window
    most = math.floor(width * (math.log2(width) - kind.bits) * UNIT)
    empty = F.struct(F.lit(0).alias("at"), F.lit(_ZERO * len(kind.symbols)).alias("counts"), F.lit(0).cast("long").alias("sum"))

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column, Column]:
        # the value belongs to the window before this step, so that the step is worked out once
        w = acc["w"]
        after = let(_moved(w, x["gone"], -1, kind), lambda m: let(_moved(m, x["come"], 1, kind), lambda n: F.struct((w["at"] + 1).alias("at"), n["counts"].alias("counts"), n["sum"].alias("sum"))))
        return {"w": after}, w["at"], (w["at"] >= width) & (w["sum"] <= most)

    def steps(letters: Column) -> Column:
        blank = F.lit("")
        return F.arrays_zip(F.concat(letters, F.array(blank)).alias("come"), F.slice(F.concat(F.array_repeat(blank, width), letters, F.array(blank)), 1, F.size(letters) + 1).alias("gone"))

    def merged(ends: Column) -> Column:
        first = F.filter(ends, lambda e, i: (i == 0) | (e - F.get(ends, F.greatest(i - 1, F.lit(0))) > width))
        last = F.filter(ends, lambda e, i: (i == F.size(ends) - 1) | (F.get(ends, F.least(i + 1, F.size(ends) - 1)) - e > width))
        return F.zip_with(first, last, lambda a, b: F.struct((a - width).alias("start"), b.alias("end")))

    read = F.lower(value) if kind.lower else value
    letters = F.slice(F.split(read, ""), 1, F.char_length(read))
    return let(folded(let(letters, steps), "int", {"w": empty}, step), merged)


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def entropy_spans(text: Column, kinds: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, allowed_after: tuple[str, ...] = ALLOWED_AFTER) -> Column:
    """Array of (start, end) of the secrets that entropy finds, class after class."""
    known = "^(?:" + "|".join(allowed) + ")$"
    found = []
    for kind in kinds:
        candidates = F.filter(matches(text, kind.pattern, words=True), lambda m: ~m["match"].rlike(known) & ~m["left"].isin(*allowed_after))
        spans = F.transform(candidates, lambda m: F.transform(high_windows(m["match"], kind), lambda s: F.struct((m["start"] + s["start"]).alias("start"), (m["start"] + s["end"]).alias("end"))))  # noqa: B023
        found.append(F.flatten(spans).cast("array<struct<start:int,end:int>>"))
    return F.concat(*found)


def base_spans(text: Column) -> Column:
    """Sorted array of (start, kind_order, end)."""
    assigned = F.filter(matches(text, _ASSIGN), lambda m: F.char_length(F.regexp_extract(m["match"], _ASSIGN, 2)) >= 8)
    access = F.when(F.contains(text, F.lit("AKIA")), matches(text, _ACCESS)).otherwise(_none("struct<start:int,end:int,match:string>"))
    return _sorted([assigned, access, matches(text, _HEX)])


def tagged(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind_order"), m["end"].alias("end"))).cast(_SPAN)


def _sorted(kinds: list[Column]) -> Column:
    return F.array_sort(F.concat(*[tagged(found, k) for k, found in enumerate(kinds)]))


def find(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of each row as struct ``src``, with base and spans: sorted arrays of (start, kind_order, end); kind_order indexes KINDS."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("src"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("src", base_spans(F.col("text")).alias("base"), entropy_spans(F.col("text")).alias("found"))
    return rows.select("src", "base", F.array_sort(F.concat("base", tagged(F.col("found"), KINDS.index("entropy")))).alias("spans"))
