"""Places and running totals in an order, with no group of any size in one task.

Rows are sorted over all partitions by range, so a group is spread over as many of them as it needs. Runs of at most
``RUN`` neighbours are windows of their own; what lies before a run is carried in levels of at most ``RUN`` totals each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BITS = 9
#: Rows, or totals, that one window holds.
RUN = 1 << BITS
_PLACE = (1 << 33) - 1  # a row's place in its partition, in Spark's increasing ids


def carried(parts: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """``parts`` (by, key long from 0, value, one row each) with ``before``: the sum of ``value`` over the smaller keys of the same ``by``; only the largest key reaches the driver."""

    def level(rows: DataFrame, top: int) -> DataFrame:
        earlier = Window.partitionBy(by, F.shiftright(key, BITS)).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        within = rows.withColumn("before", F.coalesce(F.sum(value).over(earlier), F.lit(0)).cast("long"))
        if top >> BITS == 0:
            return within
        whole = rows.groupBy(by, F.shiftright(key, BITS).alias(key)).agg(F.sum(value).alias(value))
        above = level(whole, top >> BITS).select(by, F.col(key).alias("_up"), F.col("before").alias("_above"))
        within = within.withColumn("_up", F.shiftright(key, BITS)).join(above, [by, "_up"])
        return within.withColumn("before", F.col("before") + F.col("_above")).drop("_up", "_above")

    return level(parts, parts.agg(F.max(key)).first()[0] or 0)


def placed(df: DataFrame, by: str, order: list[str], tag: str) -> DataFrame:
    """``df`` with ``place``, from 0 within each ``by`` (not null), in ascending ``order``, nulls first; rows equal in all of these follow one another in any order."""
    ranged = df.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    # other runs of this plan may cut the ranges elsewhere, so the places in them are written before they are used twice
    rows = common.materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), tag)
    high = rows.agg(F.max(F.col("_at").bitwiseAND(F.lit(_PLACE)))).first()[0] or 0
    run = F.shiftleft(F.shiftright("_at", 33), (high >> BITS).bit_length()).bitwiseOR(F.shiftright(F.col("_at").bitwiseAND(F.lit(_PLACE)), BITS))
    rows = rows.withColumn("_run", run)
    before = carried(rows.groupBy(by, "_run").agg(F.count("*").alias("_n")), by, "_run", "_n").select(by, "_run", "before")
    own = F.row_number().over(Window.partitionBy(by, "_run").orderBy("_at")) - 1
    return rows.withColumn("_own", own).join(before, [by, "_run"]).withColumn("place", F.col("_own") + F.col("before")).drop("_own", "_at", "_run", "before")


def running(df: DataFrame, by: str, key: Column, order: list[str], value: str) -> DataFrame:
    """``df`` with ``number``, from 1 within each ``by`` in ascending ``order``, and ``total``, the running sum of number * ``value``.

    ``key``, a long from 0 that never falls along ``order``, cuts a group into runs: rows of one key are one window.
    ``df`` is read twice.
    """
    run = Window.partitionBy(by, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_run", key).withColumn("_own", F.row_number().over(Window.partitionBy(by, "_run").orderBy(*order)).cast("long"))
    parts = rows.groupBy(by, "_run").agg(F.count("*").alias("_n"), F.sum(value).alias("_flat"), F.sum(F.col("_own") * F.col(value)).alias("_sum"))
    first = carried(parts, by, "_run", "_n").withColumnRenamed("before", "_first")
    first = common.materialize(first.withColumn("_whole", F.col("_sum") + F.col("_first") * F.col("_flat")), "runs")
    above = carried(first, by, "_run", "_whole").select(by, "_run", "_first", F.col("before").alias("_above"))
    summed = rows.withColumn("_flat", F.sum(value).over(run)).withColumn("_sum", F.sum(F.col("_own") * F.col(value)).over(run)).join(above, [by, "_run"])
    total = F.col("_above") + F.col("_sum") + F.col("_first") * F.col("_flat")
    return summed.withColumn("number", F.col("_first") + F.col("_own")).withColumn("total", total).drop("_run", "_own", "_flat", "_sum", "_first", "_above")
