"""A generated set against a real one, class by class: evaluator predictions, prevalence, fidelity and group matching.

Probabilities are arrays with one entry a fine class, from class 0 on. Of equal ones the lowest class wins. Undefined values
are null, and sets too small for a measure have no value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.sampling import hash_key

from .blocks import BLOCK
from .clustering import assign
from .durable import settled
from .sets import inside_balls, kernel_by, radii


def softmax(logits: Column) -> Column:
    top = F.array_repeat(F.array_max(logits), F.size(logits))  # a lambda would look for the greatest again for each entry
    powers = F.zip_with(logits, top, lambda z, m: F.exp(z.cast("double") - m.cast("double")))
    whole = F.array_repeat(F.aggregate(powers, F.lit(0.0), lambda s, p: s + p), F.size(logits))
    return F.zip_with(powers, whole, lambda p, t: p / t)


def argmax(probs: Column) -> Column:
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def restricted_argmax(df: DataFrame, classes: DataFrame, probs: str = "probs") -> DataFrame:
    """``df`` (id, coarse, probs) with fine: the likeliest of the fine classes that ``classes`` (coarse, fine) gives the row's coarse one."""
    own = classes.groupBy("coarse").agg(F.array_sort(F.collect_set("fine")).alias("members"))  # as long as there are classes
    chosen = F.transform("members", lambda c: F.struct(F.get(probs, c.cast("int")).alias("p"), (-c).alias("c")))
    return df.join(F.broadcast(own), "coarse").withColumn("fine", -F.array_max(chosen)["c"]).drop("members")


def class_gap(generated: DataFrame, real: DataFrame, classes: DataFrame) -> DataFrame:
    """(coarse, tv, kl): total variation and add-one-smoothed KL(real || generated) of fine histograms within each coarse class.

    ``generated`` is (coarse, fine), ``real`` (fine); classes without rows count as zero. A coarse class with an empty side has a null tv.
    """
    p = generated.groupBy("coarse", "fine").agg(F.count("*").alias("p"))
    q = real.groupBy("fine").agg(F.count("*").alias("q"))
    counts = classes.select("coarse", "fine").distinct().join(p, ["coarse", "fine"], "left").join(q, "fine", "left").na.fill(0, ["p", "q"])
    total = counts.groupBy("coarse").agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"), F.count("*").alias("k"))
    joined = counts.join(F.broadcast(total), "coarse")
    share = lambda x: F.try_divide(F.col(x), F.col(f"t{x}"))
    smooth = lambda x: (F.col(x) + 1) / (F.col(f"t{x}") + F.col("k"))
    return joined.groupBy("coarse").agg((F.sum(F.abs(share("p") - share("q"))) / 2).alias("tv"), F.sum(smooth("q") * F.ln(smooth("q") / smooth("p"))).alias("kl"))


def evaluator_agreement(df: DataFrame, tau: float) -> DataFrame:
    """One row from (pred, conf, requested): n, acc, mean_conf, frac_confident, frac_confident_correct."""
    right, sure = F.col("pred") == F.col("requested"), F.col("conf") >= tau
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return df.agg(F.count("*").alias("n"), share(right).alias("acc"), F.avg("conf").alias("mean_conf"), share(sure).alias("frac_confident"), share(sure & right).alias("frac_confident_correct"))


def kid_by_group(x: DataFrame, y: DataFrame, block: int = BLOCK) -> DataFrame:
    """(g, kid): unbiased squared MMD with the cubic kernel of two sets (id, v, g), group by group; groups that lack two rows on a side are left out."""
    tag = lambda df: df.withColumn("group", F.col("g"))
    mean = lambda a, b, name: kernel_by(tag(a), tag(b), block).where("n > 0").select("g", (F.col("s") / F.col("n")).alias(name))
    joined = mean(x, x, "xx").join(mean(y, y, "yy"), "g").join(mean(x, y, "xy"), "g")
    return joined.select("g", (F.col("xx") + F.col("yy") - 2 * F.col("xy")).alias("kid"))


def coverage_by_group(real: DataFrame, made: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(g, coverage): share of the real rows (id, v, g) whose ball to their k-th real neighbour holds a made row of the group; only where both sides have more than k rows."""
    real, made = (side.withColumn("id", F.xxhash64("id", "g")) for side in (real, made))  # a row may be in several groups
    enough = real.groupBy("g").count().where(F.col("count") > k).join(made.groupBy("g").count().where(F.col("count") > k).select("g"), "g").select("g")
    balls = real.join(F.broadcast(enough), "g").join(radii(real, k, block), "id")
    held = inside_balls(balls, made.join(F.broadcast(enough), "g").withColumn("r", F.lit(0.0)), block)
    return balls.select("id", "g").join(held, "id").groupBy("g").agg(F.avg(F.when(F.col("own"), 1.0).otherwise(0.0)).alias("coverage"))


def first_by_hash(df: DataFrame, sizes: DataFrame, seed: int) -> DataFrame:
    """The first n rows of each group of (id, v, g) in hash order, with n from ``sizes`` (g, n)."""
    place = F.row_number().over(Window.partitionBy("g").orderBy(hash_key(F.lit(seed), F.col("id")), "id"))
    return df.join(F.broadcast(sizes.select("g", "n")), "g").withColumn("place", place).where(F.col("place") <= F.col("n")).drop("place", "n")


def class_fidelity(generated: DataFrame, test: DataFrame, train: DataFrame, classes: DataFrame, min_n: int = 5, k: int = 3, seed: int = 0) -> DataFrame:
    """(g, n, covered, kid, coverage, kid_ceiling, coverage_ceiling) of every fine class of ``classes`` (g).

    Sides are (id, v, g); generated rows are those assigned to their class. A class is covered by ``min_n`` rows; only covered ones
    are measured, against the test rows and beside a train subsample of equal size, the first in hash order.
    """
    generated, test, train = settled(generated), settled(test), settled(train)  # each is read for several measures
    n = classes.select("g").distinct().join(generated.groupBy("g").agg(F.count("*").alias("n")), "g", "left").na.fill(0, ["n"])
    covered = n.where(F.col("n") >= min_n)
    own = generated.join(F.broadcast(covered.select("g")), "g")
    ceiling = settled(first_by_hash(train, covered, seed))
    out = n.withColumn("covered", F.col("n") >= min_n)
    for name, side in (("", own), ("_ceiling", ceiling)):
        out = out.join(kid_by_group(side, test).withColumnRenamed("kid", f"kid{name}"), "g", "left")
        out = out.join(coverage_by_group(test, side, k).withColumnRenamed("coverage", f"coverage{name}"), "g", "left")
    measured = ["kid", "coverage", "kid_ceiling", "coverage_ceiling"]
    return out.select("g", "n", "covered", *[F.when(F.col("covered"), F.col(c)).alias(c) for c in measured])


def fidelity_summary(table: DataFrame, by: list[str]) -> DataFrame:
    """Per ``by``, from class_fidelity rows with rare: shares of covered classes, overall, rare and common, and means over the covered ones with their excess and ratio to the ceiling."""
    share = lambda c: F.avg(F.when(c, F.when(F.col("covered"), 1.0).otherwise(0.0)))
    held = lambda c: F.avg(F.when(F.col("covered"), F.col(c)))
    return table.groupBy(*by).agg(
        share(F.lit(True)).alias("frac_covered"), share(F.col("rare")).alias("frac_rare_covered"), share(~F.col("rare")).alias("frac_common_covered"),
        held("kid").alias("kid"), (held("kid") - held("kid_ceiling")).alias("kid_excess"), F.try_divide(held("kid"), held("kid_ceiling")).alias("kid_ratio"),
        held("coverage").alias("coverage"), F.try_divide(held("coverage"), held("coverage_ceiling")).alias("coverage_ratio"),
    )


def kid_subsets(x: DataFrame, y: DataFrame, draws: int, size: int, seed: int) -> DataFrame:
    """One row, kid: the mean over ``draws`` of the unbiased kernel distance between the first ``size`` rows of each side (id, v) in the order of md5(seed:draw:id)."""

    def drawn(side: DataFrame) -> DataFrame:
        rows = side.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        place = F.row_number().over(Window.partitionBy("g").orderBy(hash_key(F.lit(seed), F.col("g"), F.col("id")), "id"))
        return rows.withColumn("place", place).where(F.col("place") <= size).drop("place")

    return kid_by_group(drawn(x), drawn(y)).agg(F.avg("kid").alias("kid"))


def group_costs(generated: DataFrame, real: DataFrame) -> DataFrame:
    """(g, grp, fine, kid): within a class g, the kernel distance of each generated group to each real fine class. Sides are (id, v, g, group).

    Groups and fine classes of under two rows are left out, as their distance is undefined.
    """
    means = lambda a, b: kernel_by(a, b).where("n > 0").select("g", "h", (F.col("s") / F.col("n")).alias("m"))
    alone = lambda df: df.withColumn("g", F.col("group"))
    own = means(alone(generated), alone(generated)).select(F.col("g").alias("grp"), F.col("m").alias("xx"))
    other = means(alone(real), alone(real)).select(F.col("g").alias("fine"), F.col("m").alias("yy"))
    cross = means(generated, real).select(F.col("g").alias("grp"), F.col("h").alias("fine"), F.col("m").alias("xy"))
    of = generated.select(F.col("group").cast("long").alias("grp"), "g").distinct()
    return cross.join(own, "grp").join(other, "fine").join(of, "grp").select("g", "grp", "fine", (F.col("xx") + F.col("yy") - 2 * F.col("xy")).alias("kid"))


def match_groups(costs: DataFrame) -> DataFrame:
    """(g, matched_kid, n_matched): per class, the mean cost of the cheapest one-to-one match of groups with fine classes; a task sees one class's table of costs."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        table = frame.pivot(index="grp", columns="fine", values="kid").to_numpy()
        chosen = assign(table)
        return pd.DataFrame({"g": [int(frame["g"].iloc[0])], "matched_kid": [float(np.mean([table[i, j] for i, j in chosen]))], "n_matched": [len(chosen)]})

    return costs.groupBy("g").applyInPandas(run, "g long, matched_kid double, n_matched long")


def group_purity(df: DataFrame) -> DataFrame:
    """(g, purity, entropy, n_groups) from (g, grp, fine): mean greatest share and mean entropy of the groups' predicted fine classes; groups of one row are left out."""
    cells = df.groupBy("g", "grp", "fine").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("g", "grp"))
    sizes = F.sum("n").over(Window.partitionBy("g", "grp"))
    rows = cells.withColumn("size", sizes).withColumn("p", share).where("size >= 2")
    per_group = rows.groupBy("g", "grp").agg(F.max("p").alias("purity"), (-F.sum(F.col("p") * F.ln("p"))).alias("entropy"))
    return per_group.groupBy("g").agg(F.avg("purity").alias("purity"), F.avg("entropy").alias("entropy"), F.count("*").alias("n_groups"))
