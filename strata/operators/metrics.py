"""Metrics from sums and contingency tables: geometry, agreement, prevalence, calibration, resampling, verdicts.

Undefined values are null. Pair means use closed forms over group sums, so no pair is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.sampling import hash_int
from strata.functions.vectors import dot, unit

from .prefix import totals_before


def group_sums(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, s, q): rows, vector sum and sum of squared lengths of unit vectors ``u``, summed component by component on the map side."""
    parts = df.select(*keys, F.posexplode("u").alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    return parts.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("s"), F.sum("q").alias("q"))


def units(df: DataFrame, id_column: str, vector: str, *labels: Column) -> DataFrame:
    return df.select(F.col(id_column).alias("id"), *labels, unit(F.col(vector)).alias("u")).where("u IS NOT NULL")


def pair_distances(df: DataFrame) -> DataFrame:
    """Per coarse class: d0, d1, d2, mean squared distances of unit vectors (id, coarse, fine, u) to others of the same fine class, of the same coarse but another fine, and of other coarse classes.

    The sum over j of |x_i - x_j|^2 is 2 n - 2 x_i . S, so three group sums replace all pairs.
    """
    fine, coarse, whole = group_sums(df, ["coarse", "fine"]), group_sums(df, ["coarse"]), group_sums(df.withColumn("all", F.lit(1)), ["all"])
    f = fine.select("coarse", "fine", F.col("n").alias("n_f"), dot(F.col("s"), F.col("s")).alias("ff"), F.col("s").alias("s_f"))
    c = coarse.select("coarse", F.col("n").alias("n_c"), F.col("s").alias("s_c"))
    joined = f.join(c, "coarse").crossJoin(F.broadcast(whole.select(F.col("n").alias("n_a"), F.col("s").alias("s_a"))))  # one row
    fc, fa = dot(F.col("s_f"), F.col("s_c")), dot(F.col("s_f"), F.col("s_a"))
    n = F.col("n_f")
    per_fine = joined.select(
        "coarse",
        (2 * n * n - 2 * F.col("ff")).alias("t0"), (n * (n - 1)).alias("c0"),
        (2 * n * (F.col("n_c") - n) - 2 * (fc - F.col("ff"))).alias("t1"), (n * (F.col("n_c") - n)).alias("c1"),
        (2 * n * (F.col("n_a") - F.col("n_c")) - 2 * (fa - fc)).alias("t2"), (n * (F.col("n_a") - F.col("n_c"))).alias("c2"),
    )
    sums = per_fine.groupBy("coarse").agg(*[F.sum(x).alias(x) for x in ("t0", "c0", "t1", "c1", "t2", "c2")])
    return sums.select("coarse", *[F.expr(f"t{i} / nullif(c{i}, 0)").alias(f"d{i}") for i in range(3)])


def mean_pair_distance(df: DataFrame, key: str) -> DataFrame:
    """Mean cosine distance over the pairs of each group: 1 - (|S|^2 - n) / (n (n - 1))."""
    sums = group_sums(df, [key])
    return sums.select(key, "n", F.expr("1").cast("double").alias("one"), (1 - F.try_divide(dot(F.col("s"), F.col("s")) - F.col("n"), F.col("n") * (F.col("n") - 1))).alias("div")).drop("one")


def trace_covariance(df: DataFrame, key: str) -> DataFrame:
    """Sum over components of the sample variance: (Q - |S|^2 / n) / (n - 1)."""
    sums = group_sums(df, [key])
    return sums.select(key, "n", F.try_divide(F.col("q") - dot(F.col("s"), F.col("s")) / F.col("n"), F.col("n") - 1).alias("trace_cov"))


def medoid(df: DataFrame, key: str) -> DataFrame:
    """(key, id): the row whose summed cosine to its group, x . S, is greatest; the smallest id of equals."""
    sums = group_sums(df, [key]).select(key, "s")
    scored = df.join(sums, key).select(key, "id", F.round(dot(F.col("u"), F.col("s")), 9).alias("score"))
    return scored.groupBy(key).agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("id"))


def agreement(df: DataFrame, y: str, c: str) -> DataFrame:
    """One row: adjusted Rand index and normalised mutual information (arithmetic mean) of two labellings, from their contingency table."""
    cells = df.groupBy(y, c).agg(F.count("*").alias("n"))
    pairs = lambda x: x * (x - 1) / 2
    n = F.col("n")
    entropy = lambda: (F.sum(n * F.ln(n)), F.sum(pairs(n)), F.sum(n))
    names = ("h", "p", "t")
    joint = cells.agg(*[x.alias(f"{m}_yc") for x, m in zip(entropy(), names, strict=True)])
    rows = cells.groupBy(y).agg(F.sum("n").alias("n")).agg(*[x.alias(f"{m}_y") for x, m in zip(entropy(), names, strict=True)])
    cols = cells.groupBy(c).agg(F.sum("n").alias("n")).agg(*[x.alias(f"{m}_c") for x, m in zip(entropy(), names, strict=True)])
    one = joint.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(cols))  # one row each
    t = F.col("t_yc")
    expected = F.try_divide(F.col("p_y") * F.col("p_c"), pairs(t))
    ari = F.try_divide(F.col("p_yc") - expected, (F.col("p_y") + F.col("p_c")) / 2 - expected)
    h = lambda s: F.ln(t) - F.col(f"h_{s}") / t
    nmi = F.try_divide(h("y") + h("c") - h("yc"), (h("y") + h("c")) / 2)
    return one.select(ari.alias("ari"), nmi.alias("nmi"))


def agreement_by(df: DataFrame, group: str, y: str, c: str) -> DataFrame:
    """(group, ari, nmi, n) of two labellings in each group, from one contingency table; null where it is undefined."""
    cells = df.groupBy(group, y, c).agg(F.count("*").cast("double").alias("n"))
    pairs = lambda x: x * (x - 1) / 2
    n = F.col("n")

    def sums(table: DataFrame, tag: str) -> DataFrame:
        return table.groupBy(group).agg(F.sum(n * F.ln(n)).alias(f"h_{tag}"), F.sum(pairs(n)).alias(f"p_{tag}"), F.sum(n).alias(f"t_{tag}"))

    side = lambda x: cells.groupBy(group, x).agg(F.sum("n").alias("n"))
    one = sums(cells, "yc").join(sums(side(y), "y"), group).join(sums(side(c), "c"), group)
    t = F.col("t_yc")
    expected = F.try_divide(F.col("p_y") * F.col("p_c"), pairs(t))
    ari = F.try_divide(F.col("p_yc") - expected, (F.col("p_y") + F.col("p_c")) / 2 - expected)
    h = lambda s: F.ln(t) - F.col(f"h_{s}") / t
    nmi = F.try_divide(h("y") + h("c") - h("yc"), (h("y") + h("c")) / 2)
    return one.select(group, ari.alias("ari"), nmi.alias("nmi"), t.cast("long").alias("n"))


def variance_ratio(df: DataFrame, least: int = 3) -> DataFrame:
    """(coarse, var_ratio) of unit vectors (coarse, fine, u): the traces of the fine classes' covariances, weighted by size, over that of the coarse class. Fine classes of under ``least`` rows are left out."""
    trace = lambda: F.try_divide(F.col("q") - dot(F.col("s"), F.col("s")) / F.col("n"), F.col("n") - 1)
    fine = group_sums(df, ["coarse", "fine"]).where(F.col("n") >= least).select("coarse", "n", trace().alias("t"))
    inside = fine.groupBy("coarse").agg((F.sum(F.col("n") * F.col("t")) / F.sum("n")).alias("inside"))
    return group_sums(df, ["coarse"]).select("coarse", trace().alias("t")).join(inside, "coarse", "left").select("coarse", F.try_divide("inside", "t").alias("var_ratio"))


def geometry_ratios(distances: DataFrame) -> DataFrame:
    """(coarse, d0, d1, d2, r01, r12, eq1, eq2) from pair_distances: ratios, and whether d0 < d1 and d1 < d2; both are undefined without d1."""
    known = lambda c: F.when(F.col("d1").isNotNull(), F.when(c, 1.0).otherwise(0.0))
    return distances.select("coarse", "d0", "d1", "d2", F.try_divide("d0", "d1").alias("r01"), F.try_divide("d1", "d2").alias("r12"), known(F.col("d0") < F.col("d1")).alias("eq1"), known(F.col("d1") < F.col("d2")).alias("eq2"))


def prevalence_gap(df: DataFrame, dimension: DataFrame, key: str, side: Column) -> DataFrame:
    """One row: total variation and add-one-smoothed KL(first || second) of two histograms over a dimension. ``side`` is true for the first."""
    counts = dimension.select(key).distinct().join(df.select(key, side.alias("side")).groupBy(key).agg(F.count_if("side").alias("p"), F.count_if(~F.col("side")).alias("q")), key, "left").na.fill(0, ["p", "q"])
    total = counts.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"), F.count("*").alias("k"))
    joined = counts.crossJoin(F.broadcast(total))  # one row
    smooth = lambda x: (F.col(x) + 1) / (F.col(f"t{x}") + F.col("k"))
    return joined.agg((F.sum(F.abs(F.col("p") / F.col("tp") - F.col("q") / F.col("tq"))) / 2).alias("tv"), F.sum(smooth("p") * F.ln(smooth("p") / smooth("q"))).alias("kl"))


def choose_threshold(df: DataFrame, confidence: str, correct: str, target: float) -> DataFrame:
    """One row, tau: the least confidence from which on the mean of ``correct`` reaches the target, else 1. Distinct confidences are summed first, and their running totals carried over ranges."""
    sums = df.groupBy(confidence).agg(F.sum(F.col(correct).cast("int")).alias("good"), F.count("*").alias("n"))
    above = totals_before(sums, [F.desc(confidence)], ["good", "n"])
    reached = above.withColumn("share", (F.col("good_before") + F.col("good")) / (F.col("n_before") + F.col("n")))
    return reached.where(F.col("share") >= target).agg(F.coalesce(F.min(confidence), F.lit(1.0)).alias("tau"))


def calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 15) -> DataFrame:
    """One row, ece, over equal bins (low, high]; a confidence of 0 falls in none."""
    rows = df.where(F.col(confidence) > 0).select(F.ceil(F.col(confidence) * bins).alias("bin"), confidence, F.col(correct).cast("double").alias("good"))
    per_bin = rows.groupBy("bin").agg(F.count("*").alias("n"), F.abs(F.avg("good") - F.avg(confidence)).alias("gap"))
    return per_bin.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def auroc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """One row, auroc, by average ranks; distinct scores are summed first, and their running totals carried over ranges."""
    sums = df.groupBy(score).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    ranked = totals_before(sums, [F.asc(score)], ["q"]).withColumn("lower", F.col("q_before"))
    return ranked.agg(F.try_divide(F.sum(F.col("p") * (F.col("lower") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("auroc"))


def auroc_by(df: DataFrame, group: str, score: str, positive: str, steps: int = 1000) -> DataFrame:
    """(group, auroc) by average ranks. Scores are summed in ``steps`` ranges a unit first, so that no window holds a whole group."""
    sums = df.groupBy(group, F.floor(F.col(score) * steps).alias("at"), score).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    before = Window.partitionBy(group).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.groupBy(group, "at").agg(F.sum("q").alias("q")).select(group, "at", F.coalesce(F.sum("q").over(before), F.lit(0)).alias("under"))
    below = Window.partitionBy(group, "at").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sums.withColumn("own", F.coalesce(F.sum("q").over(below), F.lit(0))).join(ranges, [group, "at"])
    return ranked.groupBy(group).agg(F.try_divide(F.sum(F.col("p") * (F.col("under") + F.col("own") + F.col("q") / 2)), F.sum("p").cast("double") * F.sum("q")).alias("auroc"))


def bootstrap(df: DataFrame, group: str, id_column: str, value: str, draws: int, seed: int) -> DataFrame:
    """(group, mean, lo, hi, n): grouped bootstrap with 2.5 and 97.5 percentiles, and a macro row that averages the groups inside each resample.

    Draw ``pos`` of resample ``b`` in a group of n rows is row hash(seed:b:group:pos) mod n in id order.
    """
    ordered = totals_before(df.where(F.col(group).isNotNull()).select(group, id_column, value, F.lit(1).cast("long").alias("one")), [F.asc(group), F.asc(id_column)], ["one"])
    begins = ordered.groupBy(group).agg(F.min("one_before").alias("begin"))
    placed = ordered.join(F.broadcast(begins), group).select(group, value, (F.col("one_before") - F.col("begin")).cast("int").alias("pos"))  # one row a group
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    drawn = placed.select(group, "pos").join(sizes, group).select(group, "size", "pos", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b"))
    drawn = drawn.select(group, "b", (hash_int(F.lit(seed), F.col("b"), F.col(group), F.col("pos")) % F.col("size")).alias("pos"))
    counted = drawn.groupBy(group, "b", "pos").agg(F.count("*").alias("w"))
    means = counted.join(placed, [group, "pos"]).groupBy(group, "b").agg((F.sum(F.col("w") * F.col(value)) / F.sum(F.when(F.col(value).isNotNull(), F.col("w")))).alias("m"))
    interval = [F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi")]
    points = df.groupBy(group).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    named = points.join(means.groupBy(group).agg(*interval), group).select(F.col(group).cast("string").alias("group"), "mean", "lo", "hi", "n")
    macro = means.groupBy("b").agg(F.avg("m").alias("m")).agg(*interval).crossJoin(F.broadcast(points.agg(F.avg("mean").alias("mean"), F.count("*").alias("n"))))  # one row each
    return named.unionByName(macro.select(F.lit("macro").alias("group"), "mean", "lo", "hi", "n"))


def point_table(df: DataFrame, group: str, values: list[str]) -> DataFrame:
    """(group, metric, mean, lo, hi, n): means of each group and the macro row, the mean of the groups' means, without intervals; nulls are left out."""
    wide = df.groupBy(group).agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("n"))
    macro = wide.agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("n"))
    both = wide.withColumn("group", F.col(group).cast("string")).unionByName(macro.withColumn("group", F.lit("macro")), allowMissingColumns=True)
    return without_ci(both.unpivot(["group", "n"], values, "metric", "mean").withColumns({"lo": F.lit(0.0), "hi": F.lit(0.0)}), values).select("group", "metric", "mean", "lo", "hi", "n")


def without_ci(table: DataFrame, names: list[str]) -> DataFrame:
    """The table with null lo and hi in the rows of these metrics."""
    return table.withColumns({c: F.when(~F.col("metric").isin(names), F.col(c)) for c in ("lo", "hi")})


def worse_than(value: str, base: str, lower_is_better: Column, margin: float) -> Column:
    """With intervals on both sides: disjoint on the bad side; else a relative margin. ``value`` and ``base`` are structs (mean, lo, hi)."""
    v, b = F.col(value), F.col(base)
    apart = F.when(lower_is_better, v["lo"] > b["hi"]).otherwise(v["hi"] < b["lo"])
    sign = F.when(lower_is_better, 1).otherwise(-1)
    beyond = sign * (v["mean"] - b["mean"]) > margin * F.greatest(F.abs(b["mean"]), F.lit(1e-3))
    return F.coalesce(apart, beyond)


def verdict(worse: Column, expected: Column) -> Column:
    return F.when(worse & expected, "ok").when(~worse & expected, "MISSED").when(worse & ~expected, "also").otherwise("same")
