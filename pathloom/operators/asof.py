"""As-of joins by one pass over both sides in the order of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket; a key's rows are put in order within buckets, so that a key with most rows is no one task's.
WIDTH = 86_400


def last_before(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], width: int = WIDTH) -> DataFrame:
    """left with values of the last row of right at or before its time and with the same by, null where there is none.

    Both sides are laid together in order of time, and the value last met is carried on: within a bucket of time, and over the ends of the
    buckets before. Each row moves once, however many rows a key has. Of rows of right at one time the greatest values count. by holds no nulls.
    """
    kind = F.struct(*[F.col(f"`{v}`") for v in values])
    rows = left.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col(left_time).alias("__time"), F.lit(1).alias("__side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__row"))
    held = right.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col(right_time).alias("__time"), F.lit(0).alias("__side"), kind.alias("__value"))
    keys = [f"__by{i}" for i in range(len(by))]
    bucket = F.floor(F.col("__time").cast("timestamp").cast("long") / width)
    both = rows.unionByName(held, allowMissingColumns=True).where("__time IS NOT NULL").withColumn("__bucket", bucket)
    order = Window.partitionBy(*keys, "__bucket").orderBy("__time", "__side", "__value").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("__own", F.last("__value", ignorenulls=True).over(order)).where("__side = 1")
    ends = both.groupBy(*keys, "__bucket").agg(F.max(F.when(F.col("__side") == 0, F.struct("__time", "__value"))).alias("__end"))
    before = F.last("__end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    earlier = ends.select(*[F.col(k).alias(f"__of{k}") for k in keys], F.col("__bucket").alias("__at"), before["__value"].alias("__earlier"))
    same = F.col("__bucket") == F.col("__at")
    for k in keys:
        same &= F.col(k) == F.col(f"__of{k}")
    found = placed.join(earlier, same).withColumn("__found", F.coalesce("__own", "__earlier")).select("__row.*", *[F.col(f"__found.{v}").alias(v) for v in values])
    timeless = left.where(F.col(left_time).isNull())
    return found.unionByName(timeless.withColumns({v: F.lit(None).cast(right.schema[v].dataType) for v in values}))


def count_before(sorted_times: Column, time: Column, most: int) -> Column:
    """How many of an array of at most most sorted times are before a time, by halving: no join, and no pass over the array."""
    steps = [1 << k for k in reversed(range(most.bit_length()))]

    def step(found: Column, add: Column) -> Column:
        return F.when((found + add <= F.size(sorted_times)) & (F.get(sorted_times, found + add - 1) < time), found + add).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)
