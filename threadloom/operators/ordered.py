"""Running sums over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def running(df: DataFrame, order: list[str | Column], value: Column, name: str = "upto") -> DataFrame:
    """df with the sum of `value` over all rows up to each, in the order given; rows of equal order have no order among themselves.

    Rows are dealt by ranges of the order and written once; a range's sum is added to those behind it, so a window sees
    one range at a time. The sums that go to all executors are one for each range, of which there are as many as shuffle
    partitions.
    """
    kept = df.columns
    ranges = df.withColumn("__value", value).repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    ranges = stored(ranges, "ranges")
    sums = ranges.groupBy("__range").agg(F.sum("__value").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("__range", before.alias("__before"))
    within = F.sum("__value").over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranges.join(F.broadcast(offsets), "__range").withColumn(name, F.col("__before") + within).select(*kept, name)
