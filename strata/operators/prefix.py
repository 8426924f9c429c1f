"""Running totals in an order over any number of rows: rows are sorted by range, and what lies before a range is carried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import settled


def totals_before(df: DataFrame, order: list[Column], values: list[str]) -> DataFrame:
    """``df`` with value_before for each of ``values``: its sum over the rows that come first in ``order``.

    A window holds one range of rows; one more holds a total a range, as many as there are partitions. Rows of equal
    ``order`` stand in any order, so callers sum them up first.
    """
    # another run of this plan may cut the ranges elsewhere, so they are settled before they are used twice
    ranged = settled(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy("_range").agg(*[F.sum(v).alias(v) for v in values])
    above = whole.select("_range", *[F.coalesce(F.sum(v).over(earlier(Window.orderBy("_range"))), F.lit(0)).alias(f"_{v}") for v in values])
    own = ranged.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(earlier(Window.partitionBy("_range").orderBy(*order))), F.lit(0)) for v in values})
    return own.join(above, "_range").withColumns({f"{v}_before": F.col(f"{v}_before") + F.col(f"_{v}") for v in values}).drop("_range", *[f"_{v}" for v in values])
