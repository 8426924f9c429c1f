"""Personal data by fixed patterns and bootstrapped contextual extraction, in DataFrame operations only.

Base kinds, leftmost non-overlapping matches of each: email, ip (parts at most 255), card (12 to 19 digits passing
Luhn), phone (9 to 15 digits). Failing matches are dropped and not retried.

Bootstrapping: candidates are the white-space tokens that hold a digit or an @, without surrounding punctuation. Those
that overlap a base span are seeds. A pattern is the nearest token (left or right) with more than punctuation, which may be a candidate itself; its
punctuation towards the candidate, such as a colon, stays. Its negatives are the plain tokens, without digit and @, that
stand in the same place: candidates not known yet say nothing against it. The graph of patterns and instances is scored in rounds: a pattern is trusted if at least ``SUPPORT``
distinct known instances follow it and their occurrences are at least ``TRUST`` of theirs and the negatives' together;
an unseen instance becomes known if trusted patterns hold it, with 1 - product(1 - precision) of at least ``ACCEPT``.
Rounds end when one accepts nothing new. Known unseen instances are added as spans of kind ``id``; base spans always
stay. The graph holds distinct pairs only and is summed on the map side, so a word before a third of all candidates is
no single task's work.

Null texts are empty and have no spans. Repeated rows are treated each. Empty tables give empty results. Offsets count
code points, end exclusive. A text's matches cost time in proportion to its length and their number, however long it is.
Columns other than those named take no part, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "id")
SUPPORT, TRUST, ACCEPT = 4, 0.8, 0.8

# Each matches what the plain pattern does, but starts only where a leftmost match can start, so that a long run of
# its characters is read once and not from each of its places; possessive repeats neither backtrack nor recurse.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,}+"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_EDGES = ".,;:!?\"'()[]{}<>#%&*$|=_/\\"
_SPACE = " \t\n\x0b\f\r"
# The last and the first word of a text without outer blanks, whatever their length.
_LAST, _FIRST = r"(?<!\S)\S++$", r"^\S++"
_SPAN = "array<struct<start:int,kind_order:int,end:int>>"


#: Matches that are put together before they join the rest: each step of a fold copies what it has gathered, so a text's
#: matches cost time in proportion to their number and this, and not to their square.
_PIECES = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is referred to."""
    return F.transform(F.array(value), use)[0]


def folded(items: Column, kind: str, state: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column, Column | None]]) -> Column:
    """Array of type ``kind`` of what ``step`` gives for each item, in order; ``step(state, item)`` is the new state, a value, and when to take it (None: always)."""
    none = F.array().cast(f"array<{kind}>")

    def add(acc: Column, x: Column) -> Column:
        after, value, wanted = step(acc, x)
        grown = F.concat(acc["piece"], F.array(value.cast(kind)))
        return F.struct(*[v.alias(k) for k, v in after.items()], (grown if wanted is None else F.when(wanted, grown).otherwise(acc["piece"])).alias("piece"))

    def join(acc: Column, chunk: Column) -> Column:
        own = F.aggregate(chunk, F.struct(*[acc[k].alias(k) for k in state], none.alias("piece")), add)
        return let(own, lambda r: F.struct(*[r[k].alias(k) for k in state], F.concat(acc["full"], F.array(r["piece"])).alias("full")))

    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _PIECES).cast("int")), lambda j: F.slice(p, j * _PIECES + 1, _PIECES))
    begun = F.struct(*[v.alias(k) for k, v in state.items()], F.array().cast(f"array<array<{kind}>>").alias("full"))
    return let(items, lambda p: F.when(F.size(p) > 0, F.aggregate(cut(p), begun, join, lambda acc: F.flatten(acc["full"]))).otherwise(none))


def matches(text: Column, pattern: str, words: bool = False, cues: bool = False) -> Column:
    """Array of (start, end, match) of all matches; with ``words`` also the words beside each, left and right; with ``cues`` these are tokens, which may be matches themselves, with their punctuation towards the match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    words = words or cues
    kind = "struct<start:int,end:int,match:string" + (",left:string,right:string>" if words else ">")
    # a lambda evaluates what it refers to again for each element, so it is given the pieces as elements
    after = [F.slice(between, 2, F.size(found)).alias("after")] if words else []
    if cues:
        none = F.array(F.lit(""))
        after += [F.concat(none, F.slice(found, 1, F.size(found) - 1)).alias("previous"), F.concat(F.slice(found, 2, F.size(found)), none).alias("next")]
    pieces = F.arrays_zip(found.alias("match"), F.slice(between, 1, F.size(found)).alias("before"), *after)

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column, None]:
        start = acc["at"] + F.char_length(x["before"])
        end = start + F.char_length(x["match"])
        left, right = (_cue(x["before"], x["previous"], True), _cue(x["after"], x["next"], False)) if cues else (_word(x["before"], _LAST), _word(x["after"], _FIRST)) if words else (None, None)
        beside = [left.alias("left"), right.alias("right")] if words else []
        return {"at": end}, F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), *beside), None

    return F.when(F.size(found) > 0, folded(pieces, kind, {"at": F.lit(0)}, step)).otherwise(F.array().cast(f"array<{kind}>"))


def _word(side: Column, pattern: str) -> Column:
    return F.lower(F.btrim(F.regexp_extract(F.btrim(side, F.lit(_EDGES + _SPACE)), pattern, 0), F.lit(_EDGES)))


def _cue(side: Column, other: Column, before: bool) -> Column:
    """The nearest token with more than edges: in ``side`` if that has one, else ``other``. Its punctuation towards the match stays."""
    outer = F.lit(_EDGES + _SPACE)

    def token(bare: Column) -> Column:
        if before:
            held = F.concat(F.regexp_extract(bare, _LAST, 0), F.regexp_extract(F.substr(side, F.char_length(bare) + 1), r"^\S*+", 0))
        else:
            held = F.concat(F.regexp_extract(F.left(side, F.char_length(side) - F.char_length(bare)), r"(?<!\S)\S*+$", 0), F.regexp_extract(bare, _FIRST, 0))
        found = F.lower(F.when(bare != "", held).otherwise(other))
        return F.ltrim(found, F.lit(_EDGES)) if before else F.rtrim(found, F.lit(_EDGES))

    return let(F.rtrim(side, outer) if before else F.ltrim(side, outer), token)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        x = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        doubled = x * 2
        return total + F.when(i % 2 == 0, F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _ip_valid(match: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.char_length(bare) <= 3) & (F.coalesce(F.left(bare, F.lit(3)).try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(match, "\\."), small)


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def base_spans(text: Column) -> Column:
    """Sorted array of (start, kind_order, end)."""
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    digits = lambda m: F.char_length(_digits(m["match"]))
    kinds = [
        F.when(F.contains(text, F.lit("@")), matches(text, _EMAIL)).otherwise(none),
        F.filter(matches(text, _IP), lambda m: _ip_valid(m["match"])),
        F.filter(F.filter(matches(text, _CARD), lambda m: _between(digits(m), 12, 19)), lambda m: passes_luhn(_digits(m["match"]))),
        F.filter(F.when(F.contains(text, F.lit("+")), matches(text, _PHONE)).otherwise(none), lambda m: _between(digits(m), 9, 15)),
    ]

    def tagged(found: Column, kind: int) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind_order"), m["end"].alias("end")))

    return F.array_sort(F.concat(*[tagged(x, k) for k, x in enumerate(kinds)])).cast(_SPAN)


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind_order"] == kind)).cast("long")


_CANDIDATE = "struct<start:int,end:int,value:string,left:string,right:string,known:boolean>"
_EVENT = "struct<start:int,base:boolean,end:int,value:string,left:string,right:string,known:boolean>"


def _trimmed(text: Column) -> Column:
    """Array of candidates without edges: (start, base = false, end, value, left, right, known = false)."""

    def one(m: Column) -> Column:
        led = F.ltrim(m["match"], F.lit(_EDGES))
        start = m["start"] + F.char_length(m["match"]) - F.char_length(led)
        value = F.rtrim(led, F.lit(_EDGES))
        return F.struct(start.alias("start"), F.lit(False).alias("base"), (start + F.char_length(value)).alias("end"), value.alias("value"), m["left"].alias("left"), m["right"].alias("right"), F.lit(False).alias("known"))

    return F.filter(F.transform(matches(text, _TOKEN, cues=True), one), lambda c: c["value"].rlike("[^@]"))


def _candidates(text: Column, base: Column) -> Column:
    """Array of (start, end, value, left, right, known): the candidates, known where they overlap a base span.

    Candidates and base spans are walked in order, once with the farthest end so far and once backwards with the nearest start.
    """
    null = F.lit(None).cast("string")
    spans = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(True).alias("base"), b["end"].alias("end"), null.alias("value"), null.alias("left"), null.alias("right"), F.lit(False).alias("known")))
    events = F.array_sort(F.concat(spans, _trimmed(text)).cast(f"array<{_EVENT}>"))
    marked = lambda e, known: F.struct(*[e[c].alias(c) for c in ("start", "base", "end", "value", "left", "right")], known.alias("known"))

    def forward(acc: Column, e: Column) -> tuple[dict[str, Column], Column, None]:
        return {"reach": F.when(e["base"], F.greatest(acc["reach"], e["end"])).otherwise(acc["reach"])}, marked(e, acc["reach"] > e["start"]), None

    def backward(acc: Column, e: Column) -> tuple[dict[str, Column], Column, Column]:
        near = F.when(e["base"], F.least(acc["near"], e["start"])).otherwise(acc["near"])
        value = F.struct(*[e[c].alias(c) for c in ("start", "end", "value", "left", "right")], (e["known"] | (acc["near"] < e["end"])).alias("known"))
        return {"near": near}, value, ~e["base"]

    # of equal starts the candidate comes first, so the way back sees the base span before it
    ahead = folded(events, _EVENT, {"reach": F.lit(0)}, forward)
    return F.reverse(folded(F.reverse(ahead), _CANDIDATE, {"near": F.lit(2**31 - 1)}, backward))


def plain_neighbours(text: DataFrame) -> DataFrame:
    """From (text): (pattern, negatives), how many plain tokens stand next to each token, on each side."""
    held = text.select(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.btrim(w, F.lit(_EDGES)) != "").alias("w"))
    none = F.array(F.lit("0"))  # before the first and after the last token
    placed = held.select(F.explode(F.arrays_zip(F.col("w").alias("w"), F.concat(none, "w").alias("before"), F.concat(F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), none).alias("after"))).alias("p")).select("p.*")
    plain = lambda c: ~F.col(c).rlike("[0-9@]")
    counted = placed.groupBy("w").agg(F.count_if(plain("after")).alias("l"), F.count_if(plain("before")).alias("r"))
    trimmed = {"l": F.ltrim("w", F.lit(_EDGES)), "r": F.rtrim("w", F.lit(_EDGES))}
    sides = F.array(*[F.struct(F.concat_ws("\t", F.lit(side), word).alias("pattern"), F.col(side).alias("negatives")) for side, word in trimmed.items()])
    return counted.select(F.explode(sides).alias("s")).select("s.*").where("negatives > 0").groupBy("pattern").agg(F.sum("negatives").alias("negatives"))


def discovered(candidates: DataFrame, negatives: DataFrame) -> DataFrame:
    """From candidates (value, left, right, known) and (pattern, negatives): the values that are not known but accepted."""
    sides = F.array(F.struct(F.lit("l").alias("side"), F.col("left").alias("word")), F.struct(F.lit("r").alias("side"), F.col("right").alias("word")))
    graph = candidates.select("value", "known", F.explode(sides).alias("s")).where("s.word != ''")
    graph = graph.groupBy(F.concat_ws("\t", "s.side", "s.word").alias("pattern"), "value").agg(F.max("known").alias("known"), F.count("*").alias("n"))
    seeds = graph.groupBy("value").agg(F.max("known").alias("seed"))
    graph = common.materialize(graph.drop("known").join(seeds, "value"), "graph")
    supported = graph.groupBy("pattern").agg(F.count("*").alias("values")).where(F.col("values") > SUPPORT).select("pattern")  # others have nothing to add
    negatives = common.materialize(supported.join(negatives, "pattern", "left").select("pattern", F.coalesce("negatives", F.lit(0)).alias("negatives")), "negatives")
    accepted, more = graph.limit(0).select("value"), True
    while more:
        state = graph.join(accepted.withColumn("taken", F.lit(True)), "value", "left").withColumn("known", F.col("seed") | F.coalesce("taken", F.lit(False)))
        counted = state.groupBy("pattern").agg(F.count_if("known").alias("f"), F.sum(F.when(F.col("known"), F.col("n"))).alias("held"), F.count("*").alias("values"))
        counted = counted.where((F.col("f") >= SUPPORT) & (F.col("f") < F.col("values"))).join(negatives, "pattern")
        trusted = counted.select("pattern", (F.col("held") / (F.col("held") + F.col("negatives"))).alias("precision")).where(F.col("precision") >= TRUST)
        held = state.where("NOT known").join(trusted, "pattern").groupBy("value").agg(F.sum(F.log(F.greatest(1 - F.col("precision"), F.lit(1e-9)))).alias("doubt"))
        found = common.materialize(held.where(1 - F.exp("doubt") >= ACCEPT).select("value"), "accepted")
        more = not found.isEmpty()
        accepted = accepted.unionByName(found)
    return accepted


def find(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of each row as struct ``src``, with base and spans: sorted arrays of (start, kind_order, end); kind_order indexes KINDS."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("src"), text.alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    rows = rows.select("src", "base", _candidates(F.col("text"), F.col("base")).alias("candidates"), F.monotonically_increasing_id().alias("row"))
    rows = common.materialize(rows, "spans")
    listed = rows.select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    accepted = discovered(listed.select("value", "left", "right", "known"), plain_neighbours(docs.select("text")))
    added = listed.where("NOT known").join(accepted, "value").select("row", F.struct("start", F.lit(len(KINDS) - 1).alias("kind_order"), "end").alias("span"))
    added = added.groupBy("row").agg(F.collect_set("span").alias("added"))
    spans = F.array_sort(F.concat("base", F.coalesce(F.col("added"), F.array()).cast(_SPAN)))
    return rows.select("src", "base", "row").join(added, "row", "left").select("src", "base", spans.alias("spans"))


def written(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of each span, comma-joined, in order."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", names[s["kind_order"]], s["start"].cast("string"), s["end"].cast("string"))))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first names the whole."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def step(acc: Column, s: Column) -> tuple[dict[str, Column], Column, Column]:
        piece = F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), names[s["kind_order"]])
        return {"at": F.greatest(acc["at"], s["end"])}, piece, s["start"] >= acc["at"]

    rest = F.substr(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1)
    return F.when(F.size(spans) > 0, F.concat(F.array_join(folded(spans, "string", {"at": F.lit(0)}, step), ""), rest)).otherwise(text)
