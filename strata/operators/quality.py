"""Data checks, exclusion rules, error analysis and report tables.

Checks give one row for each violated rule, so all faults are seen at once; nothing is raised unless ``refuse`` is asked to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class DataFault(ValueError):
    """Raised by the checks that refuse to go on."""


def faults(df: DataFrame, rules: dict[str, Column], unique: list[list[str]] = ()) -> DataFrame:
    """(rule, n): how many rows break each rule, a condition that must hold (null breaks it), or share a key that must be unique; rules that hold are left out."""
    broken = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    out = broken.unpivot([], list(rules), "rule", "n") if rules else None
    for key in unique:
        repeated = df.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
        part = repeated.select(F.lit(f"unique {', '.join(key)}").alias("rule"), "n")
        out = part if out is None else out.unionByName(part)
    return out.where("n > 0")


def refuse(found: DataFrame, what: str) -> None:
    """Raise with all rows of ``found`` named, if there are any; ``found`` has one row a rule."""
    rows = found.collect()
    if rows:
        raise DataFault(f"{what}: " + "; ".join(" ".join(map(str, r)) for r in rows))


def missing_ids(asked: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """One row, missing: distinct asked ids that are not held."""
    return asked.select(key).distinct().join(held.select(key), key, "left_anti").agg(F.count("*").alias("missing"))


def checked_join(left: DataFrame, right: DataFrame, on: str, validate: str = "many_to_one", how: str = "inner") -> DataFrame:
    """A join that refuses repeated keys on a side that must have one row a key: one_to_one, one_to_many, many_to_one or many_to_many."""
    sides = dict(zip(("left", "right"), validate.split("_to_"), strict=True))
    for name, df in (("left", left), ("right", right)):
        if sides[name] == "one" and not df.groupBy(on).count().where("count > 1").isEmpty():
            raise DataFault(f"{on} repeats on the {name} side of a {validate} join")
    return left.join(right, on, how)


def in_order(asked: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """The held rows at the asked places (pos, key): repeats stay, and an id that is not held gives nulls."""
    return asked.select("pos", key).join(held, key, "left")


def excluded(exact: DataFrame, pairs: DataFrame, label: DataFrame) -> DataFrame:
    """(id): rows whose digest occurs under several labels, and both ends of pairs whose labels differ.

    ``exact`` is (id, digest, label), ``pairs`` (a, b), ``label`` (id, label).
    """
    bad = exact.groupBy("digest").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").select("digest")
    same = exact.join(bad, "digest", "left_semi").select("id")
    of = lambda end: label.select(F.col("id").alias(end), F.col("label").alias(f"l_{end}"))
    ends = pairs.join(of("a"), "a").join(of("b"), "b").where("l_a != l_b").select(F.explode(F.array("a", "b")).alias("id"))
    return same.unionByName(ends).distinct()


def conflict_pairs(exact: DataFrame, near: DataFrame, label: DataFrame) -> DataFrame:
    """(a, b, exact, near): pairs a < b alike in digest or near by similarity, with different labels. ``exact`` is (id, digest).

    Rows of one digest are paired only across labels, by way of each label's rows, so a group of copies with one label gives none.
    """
    tagged = exact.join(label, "id")
    mixed = tagged.groupBy("digest").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").select("digest")
    held = tagged.join(mixed, "digest", "left_semi")
    side = lambda tag: held.select("digest", F.col("id").alias(tag), F.col("label").alias(f"l_{tag}"))
    same = side("a").join(side("b"), "digest").where("a < b AND l_a != l_b").select("a", "b", F.lit(True).alias("exact"))
    of = lambda end: label.select(F.col("id").alias(end), F.col("label").alias(f"l_{end}"))
    close = near.join(of("a"), "a").join(of("b"), "b").where("l_a != l_b").select("a", "b", F.lit(True).alias("near"))
    return same.join(close, ["a", "b"], "full").na.fill(False, ["exact", "near"])


def exclusion_note(rows: DataFrame, removed: DataFrame, split: str, key: str) -> DataFrame:
    """(split, n, removed): rows of each split, and how many of them are on the exclusion list."""
    marked = rows.join(removed.select(key).distinct().withColumn("out", F.lit(True)), key, "left")
    return marked.groupBy(split).agg(F.count("*").alias("n"), F.count_if(F.coalesce("out", F.lit(False))).alias("removed"))


def tiers(pairs: DataFrame, score: str, edges: list[float]) -> DataFrame:
    """(tier, n): pairs with a score of at least each edge."""
    counted = pairs.agg(*[F.count_if(F.col(score) >= e).alias(f"n{i}") for i, e in enumerate(edges)])
    rows = F.array(*[F.struct(F.lit(str(e)).alias("tier"), F.col(f"n{i}").alias("n")) for i, e in enumerate(edges)])
    return counted.select(F.explode(rows).alias("t")).select("t.*")


def oriented(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, rank_ab, rank_ba, ..) with the one that ranks its partner higher as a; of equal ranks the order stays."""
    swap = F.col("rank_ba") < F.col("rank_ab")
    turned = {"a": "b", "b": "a", "rank_ab": "rank_ba", "rank_ba": "rank_ab"}
    return pairs.select(*[F.when(swap, F.col(turned[c])).otherwise(F.col(c)).alias(c) if c in turned else F.col(c) for c in pairs.columns])


def failure_cases(pairs: DataFrame, n: int, score: str = "sim") -> DataFrame:
    """(kind, place, a, b, ..): the n pairs of different labels that look most alike ('false') and the n of one label that look least alike ('missed'); ``same`` tells which is which, ties by (a, b)."""

    def first(kind: str, rows: DataFrame, order: list) -> DataFrame:
        top = rows.orderBy(*order, "a", "b").limit(n)  # n rows
        return top.withColumns({"kind": F.lit(kind), "place": F.row_number().over(Window.orderBy(*order, "a", "b"))})

    return first("false", pairs.where(~F.col("same")), [F.desc(score)]).unionByName(first("missed", pairs.where("same"), [F.asc(score)]))


def best_alternatives(asked: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(query, partner, other, rank): for each asked pair, the query's best-ranked neighbour (a, b, rank) other than the partner; pairs without one are left out."""
    found = asked.join(neighbours.select(F.col("a").alias("query"), F.col("b").alias("other"), "rank"), "query").where("other != partner")
    return found.groupBy("query", "partner").agg(F.min(F.struct("rank", "other")).alias("best")).select("query", "partner", "best.other", "best.rank")


def identity_scores(pairs: DataFrame, group: str, first: str, second: str) -> DataFrame:
    """``pairs`` (both directions) with score: the first similarity's z-score in its group less the second's."""
    whole = pairs.groupBy(group).agg(*[f(c).alias(f"{t}_{c}") for c in (first, second) for t, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}"))
    return pairs.join(whole, group).withColumn("score", z(first) - z(second)).select(*pairs.columns, "score")


def precision_of(pairs: DataFrame, group: str, score: str, n: int, gate: str | None = None, k: int = 0) -> DataFrame:
    """(a, group, hits, found, precision) of each row: the share of its n best-scored others with its label; with ``gate``, only among the k most similar by it."""
    place = lambda by: F.row_number().over(Window.partitionBy("a").orderBy(F.desc(by), "b"))
    near = pairs if gate is None else pairs.withColumn("gate_place", place(gate)).where(F.col("gate_place") <= k)
    top = near.withColumn("score_place", place(score)).where(F.col("score_place") <= n)
    return top.groupBy("a", group).agg(F.count_if("same").alias("hits"), F.count("*").alias("found")).withColumn("precision", F.col("hits") / F.col("found"))


def precision_at(pairs: DataFrame, group: str, score: str, n: int, gate: str | None = None, k: int = 0) -> DataFrame:
    """(group, precision, chance): the share of the rows' n best-scored others with their label, and that of any other."""
    share = precision_of(pairs, group, score, n, gate, k).groupBy(group).agg((F.sum("hits") / F.sum("found")).alias("precision"))
    return share.join(pairs.groupBy(group).agg(F.avg(F.when(F.col("same"), 1.0).otherwise(0.0)).alias("chance")), group)


def go_or_stop(gain: Column, low: Column, least: float = 0.02) -> Column:
    return F.when((gain >= least) & (low > 0), "go").otherwise("stop")


def share_band(share: Column, low: float = 0.15, high: float = 0.30) -> Column:
    return F.when(share < low, "low").when(share < high, "medium").otherwise("high")


def subclass_recall(df: DataFrame, y: str, c: str) -> DataFrame:
    """(y, n, recall, merged): the share of each label's rows in the cluster matched with it, and whether its largest cluster is mostly another label's; an unmatched label has recall 0."""
    from .clustering import match_clusters

    cells = df.groupBy(y, c).agg(F.count("*").alias("n"))
    matched = match_clusters(df, y, c).select(F.col("y").alias(y), F.col("n").alias("matched"))
    sizes = cells.groupBy(y).agg(F.sum("n").alias("n"), F.max_by(c, F.struct("n", -F.col(c))).alias("top"))
    owner = cells.groupBy(F.col(c).alias("top")).agg(F.max_by(y, F.struct("n", -F.col(y))).alias("owner"))
    joined = sizes.join(matched, y, "left").join(owner, "top")
    return joined.select(y, "n", (F.coalesce("matched", F.lit(0)) / F.col("n")).alias("recall"), (F.col("owner") != F.col(y)).alias("merged"))


def read_metric(table: DataFrame, name: str) -> DataFrame:
    """(mean, lo, hi) of a metric: the macro row of a long table, or the column of a wide one-row table, without an interval."""
    if "metric" in table.columns:
        return table.where((F.col("group") == "macro") & (F.col("metric") == name)).select("mean", "lo", "hi")
    return table.select(F.col(name).cast("double").alias("mean"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))


def headline(table: DataFrame, headings: dict[str, list[str]], validated: set[str]) -> DataFrame:
    """(evaluates, metric, mean, lo, hi, validated): the macro rows of the named metrics under their headings."""
    spark = table.sparkSession
    names = spark.createDataFrame([(h, m, m in validated) for h, own in headings.items() for m in own], "evaluates string, metric string, validated boolean")
    return table.where("`group` = 'macro'").join(F.broadcast(names), "metric").select("evaluates", "metric", "mean", "lo", "hi", "validated")


def wide(table: DataFrame, metrics: list[str]) -> DataFrame:
    """One row a group, the metrics as columns, from a long table; the macro row is left out, and a missing value is null."""
    return table.where("`group` != 'macro'").groupBy("group").pivot("metric", metrics).agg(F.first("mean"))


def worst(table: DataFrame, column: str, n: int, lowest: bool = True) -> DataFrame:
    """The n groups with the lowest, or highest, value of the column; nulls are left out, ties by group."""
    return table.where(F.col(column).isNotNull()).orderBy(F.asc(column) if lowest else F.desc(column), "group").limit(n)


def refused_pairs(declared: DataFrame, evaluators: DataFrame) -> DataFrame:
    """(method, encoder, why): encoders that a method was trained with and that an evaluator uses ('same'), or whose family it shares ('family'). Sides are (method, encoder, family), (encoder, family)."""
    same = declared.join(evaluators.select("encoder"), "encoder", "left_semi").select("method", "encoder", F.lit("same").alias("why"))
    family = declared.join(evaluators.select("encoder"), "encoder", "left_anti").join(evaluators.select("family"), "family", "left_semi")
    return same.unionByName(family.select("method", "encoder", F.lit("family").alias("why")))


def balanced_batch(df: DataFrame, group: str, key: str, groups: int, rows: int, order: Column) -> DataFrame:
    """(group, key): ``rows`` rows of each of the first ``groups`` groups with that many, groups and rows in the order of a hash; ``order`` is the rows' hash."""
    enough = df.groupBy(group).agg(F.count("*").alias("n"), F.min(order).alias("first")).where(F.col("n") >= rows).orderBy("first", group).limit(groups)
    place = F.row_number().over(Window.partitionBy(group).orderBy(order, key))
    return df.join(F.broadcast(enough.select(group)), group).withColumn("place", place).where(F.col("place") <= rows).select(group, key)
