"""What comes before in a key's order, with the order cut into buckets of bounded time.

A window runs inside a bucket, and one row for each key and bucket carries the
state on, so a hot key spreads over its buckets and no task holds its history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 24 * 3600 * 1_000_000


def with_previous(rows: DataFrame, by: list[str], order: list[str], value: Column, bucket: Column, name: str = "prev") -> DataFrame:
    """``rows`` with the value of the row before in its key's order; null at its beginning. Wrap a value that may be null in a struct."""
    log = rows.withColumn("__b", bucket).repartition(*by, "__b")  # one exchange for both uses
    last = log.groupBy(*by, "__b").agg(F.max_by(value, F.struct(*order)).alias("__x"))
    carried = last.select(*by, "__b", F.lag("__x").over(Window.partitionBy(*by).orderBy("__b")).alias("__carried"))
    here = F.lag(value).over(Window.partitionBy(*by, "__b").orderBy(*order))
    return log.withColumn("__here", here).join(carried, [*by, "__b"]).withColumn(name, F.coalesce("__here", "__carried")).drop("__b", "__here", "__carried")


def with_running_sum(rows: DataFrame, by: list[str], order: list[str], amount: Column, bucket: Column, name: str = "after") -> DataFrame:
    """``rows`` with the sum of the amounts up to each in its key's order."""
    log = rows.withColumns({"__b": bucket, "__a": amount}).repartition(*by, "__b")
    sums = log.groupBy(*by, "__b").agg(F.sum("__a").alias("__x"))
    whole = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*by, "__b", F.coalesce(F.sum("__x").over(whole), F.lit(0)).alias("__carried"))
    inside = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumn("__here", F.sum("__a").over(inside)).join(carried, [*by, "__b"]).withColumn(name, F.col("__carried") + F.col("__here")).drop("__b", "__a", "__here", "__carried")
