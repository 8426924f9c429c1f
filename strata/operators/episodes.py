"""Episodes: supports drawn from class pools by hash order, targets, redraws that avoid near-duplicates, and their measures.

An episode is a set of rows (episode, role, fine, id) with role 's' (support) or 't' (target). Draws are the first rows of a pool in
the order of md5(seed:episode:attempt:id), so any engine can repeat them. Pools are ranked per episode, so a pool is sorted in one
task for each episode and attempt; its rows are ids only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.sampling import hash_key


def eligibility(pools: DataFrame, sizes: list[int], min_target: int) -> DataFrame:
    """(k, fine, n_pool, reason) for every size and pool of (fine, id): reason is null where the pool can give k supports and ``min_target`` targets."""
    counts = pools.groupBy("fine").agg(F.count("*").alias("n_pool")).withColumn("k", F.explode(F.array(*[F.lit(k) for k in sizes])))
    left = F.col("n_pool") - F.col("k")
    short = F.when(left < 0, F.format_string("support pool %d < k=%d", "n_pool", "k")).when(left < min_target, F.format_string("target %d < %d", left, F.lit(min_target)))
    return counts.select("k", "fine", "n_pool", short.alias("reason"))


def draw(pools: DataFrame, episodes: DataFrame, seed: int, attempts: int, pairs: DataFrame) -> DataFrame:
    """(episode, attempt, n_near, fine, id, role): the first attempt whose supports have no near-duplicate among the targets, else the last.

    ``episodes`` is (episode string, fine, k), one row a class of the episode; ``pairs`` is (a, b), the near-duplicate ids, either way round.
    All attempts are drawn at once; pairs meet supports and targets by equi joins.
    """
    tried = episodes.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1)))).join(pools, "fine")
    place = F.row_number().over(Window.partitionBy("episode", "attempt", "fine").orderBy(hash_key(F.lit(seed), F.col("episode"), F.col("attempt"), F.col("id")), "id"))
    drawn = tried.withColumn("role", F.when(place <= F.col("k"), "s").otherwise("t")).select("episode", "attempt", "fine", "id", "role")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    support = drawn.where("role = 's'").select("episode", "attempt", F.col("id").alias("a"))
    target = drawn.where("role = 't'").select("episode", "attempt", F.col("id").alias("b"))
    near = support.join(both, "a").join(target, ["episode", "attempt", "b"]).groupBy("episode", "attempt").agg(F.count("*").alias("n_near"))
    counted = drawn.select("episode", "attempt").distinct().join(near, ["episode", "attempt"], "left").na.fill(0, ["n_near"])
    clean = F.min(F.when(F.col("n_near") == 0, F.col("attempt")))
    chosen = counted.groupBy("episode").agg(F.coalesce(clean, F.max("attempt")).alias("attempt"))
    return drawn.join(counted.join(chosen, ["episode", "attempt"], "left_semi"), ["episode", "attempt"]).select("episode", "attempt", "n_near", "fine", "id", "role")


def flat(by_class: Column) -> Column:
    """All ids of a map from class to ids, sorted."""
    return F.array_sort(F.flatten(F.map_values(by_class)))


def summary(drawn: DataFrame, family: Column) -> DataFrame:
    """Per family: episodes, those redrawn, those left with near-duplicates, least and upper median target size."""
    per = drawn.groupBy("episode").agg(F.max("attempt").alias("attempt"), F.max("n_near").alias("n_near"), F.count_if(F.col("role") == "t").alias("n_target"))
    sizes = F.array_sort(F.collect_list("n_target"))  # one number an episode
    return per.groupBy(family.alias("family")).agg(
        F.count("*").alias("episodes"), F.count_if(F.col("attempt") > 0).alias("redrawn"), F.count_if(F.col("n_near") > 0).alias("with_dup"),
        F.min("n_target").alias("min_target"), F.element_at(sizes, (F.floor(F.count("*") / 2) + 1).cast("int")).alias("median_target"),
    )


def hit_rate(df: DataFrame) -> DataFrame:
    """(episode, hit) from (episode, fine, pred): the share of rows predicted as the episode's class."""
    return df.groupBy("episode").agg(F.avg(F.when(F.col("pred") == F.col("fine"), 1.0).otherwise(0.0)).alias("hit"))


def mixture_error(df: DataFrame) -> DataFrame:
    """(episode, error) from (episode, p_a, p_b, ratio): |share of rows with p_a > p_b - ratio|."""
    return df.groupBy("episode").agg(F.abs(F.avg(F.when(F.col("p_a") > F.col("p_b"), 1.0).otherwise(0.0)) - F.first("ratio")).alias("error"))


def nearest_means(made: DataFrame, support: DataFrame, target: DataFrame) -> DataFrame:
    """(g, sim_s, sim_t, sim_t_to_s, ratio_s) of sides (id, v, g): mean greatest cosine of made rows to supports and targets, and of targets to supports."""
    from .similarity import top_k

    def mean(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        # ids may recur in several episodes, so rows are named anew
        key = lambda df, tag: df.withColumn("id", F.xxhash64("id", "g", F.lit(tag)))
        found = top_k(key(a, 1), key(b, 2), 1)
        return found.join(key(a, 1).select(F.col("id").alias("a"), "g"), "a").groupBy("g").agg(F.avg("sim").alias(name))

    joined = mean(made, support, "sim_s").join(mean(made, target, "sim_t"), "g").join(mean(target, support, "sim_t_to_s"), "g")
    return joined.withColumn("ratio_s", F.try_divide("sim_s", "sim_t_to_s"))


def beyond_support(made: DataFrame, support: DataFrame, target: DataFrame, k: int = 3) -> DataFrame:
    """(g, kid_t, coverage_t, kid_s, coverage_s) of sides (id, v, g); null where a side is too small."""
    from .synthesis import coverage_by_group, kid_by_group

    out = made.select("g").distinct()
    for tag, side in (("t", target), ("s", support)):
        out = out.join(kid_by_group(made, side).withColumnRenamed("kid", f"kid_{tag}"), "g", "left")
        out = out.join(coverage_by_group(side, made, k).withColumnRenamed("coverage", f"coverage_{tag}"), "g", "left")
    return out


def by_set(table: DataFrame, family: str, coarse: str, values: list[str]) -> DataFrame:
    """(family, group, n, values..): means per coarse class, then the macro row over classes, for every set of episodes."""
    groups = table.groupBy(family, F.col(coarse).cast("string").alias("group")).agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])
    macro = groups.groupBy(family).agg(F.lit("macro").alias("group"), F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])
    return groups.unionByName(macro)
