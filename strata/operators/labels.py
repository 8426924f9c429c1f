"""Label hierarchies, splits, exclusion rules, codes and bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.sampling import hash_key

from .prefix import totals_before


def hierarchy(df: DataFrame, coarse: str, fine: str) -> DataFrame:
    """One row per fine label: its coarse label, rows, and the number of fine labels of the coarse one."""
    fines = df.groupBy(coarse, fine).agg(F.count("*").alias("n"))
    return fines.join(fines.groupBy(coarse).agg(F.count("*").alias("k_c")), coarse)


def subclass_table(df: DataFrame, coarse: str, fine: str) -> DataFrame:
    pairs = df.groupBy(coarse, fine).agg(F.count("*").alias("n"))
    return pairs.groupBy(coarse).agg(F.count("*").alias("k_c"), F.sum("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(fine)), lambda x: x.cast("string")), " ").alias("members"))


def stratified_split(df: DataFrame, id_column: str, stratum: str, share: float, seed: int, names: tuple[str, str]) -> DataFrame:
    """(id, stratum, split): in each stratum the first round-half-even(share * n) rows in hash order get the first name."""
    keyed = df.where(F.col(stratum).isNotNull()).select(id_column, stratum, hash_key(F.lit(seed), F.col(id_column)).alias("key"), F.lit(1).cast("long").alias("place"))
    ranked = totals_before(keyed, [F.col(stratum), F.col("key"), F.col(id_column)], ["place"])  # strata stand one after another, so no task holds one
    sizes = ranked.groupBy(stratum).agg(F.bround(F.count("*") * F.lit(share)).cast("long").alias("taken"), F.min("place_before").alias("start"))
    return ranked.join(sizes, stratum).select(id_column, stratum, F.when(F.col("place_before") - F.col("start") < F.col("taken"), names[0]).otherwise(names[1]).alias("split"))


def conflicting(df: DataFrame, id_column: str, digest: Column, label: str) -> DataFrame:
    """Ids of rows whose content occurs under more than one label."""
    tagged = df.select(id_column, digest.alias("digest"), label)
    bad = tagged.groupBy("digest").agg(F.min(label).alias("low"), F.max(label).alias("high")).where("low <> high").select("digest")
    return tagged.join(bad, "digest", "left_semi").select(id_column)


def codes_by_first(df: DataFrame, value: str, order: str) -> DataFrame:
    """Dense codes of values in the order of their first appearance. One row a value reaches the window."""
    first = df.groupBy(value).agg(F.min(order).alias("first"))
    return first.select(value, (F.row_number().over(Window.orderBy("first")) - 1).alias("code"))


def codes_sorted(df: DataFrame, value: str) -> DataFrame:
    """Dense codes of values in their own order, from zero. One row a value reaches the window."""
    return df.select(value).distinct().select(value, (F.row_number().over(Window.orderBy(value)) - 1).alias("code"))


def left_closed_bins(value: Column, edges: list[float]) -> Column:
    """Index of the bin [edge, next edge) a value falls in, else null."""
    chosen = F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        chosen = F.when((value >= low) & (value < high), i).otherwise(chosen)
    return chosen


def zero_filled_counts(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    return dimension.select(key).distinct().join(df.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def parse_model_name(name: Column, long_makes: list[str]) -> Column:
    """struct(make, model, year) of ``Make Model.. Year``, where some makes have several words; null if it does not parse."""
    makes = "|".join([*long_makes, r"\S+"])
    pattern = rf"^({makes}) (.+) ((?:19|20)\d\d)$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    return F.when(name.rlike(pattern), F.struct(part(1).alias("make"), part(2).alias("model"), part(3).cast("int").alias("year")))
