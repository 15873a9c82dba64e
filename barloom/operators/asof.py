"""As-of and range joins on days (J2, J3): rows of one table by the time of another, without comparing all pairs of a key.

Times are dates. Rows whose key or time is null meet nothing. Other columns of both sides are kept; a
name that both have is an error, as in any join that isn't on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, by: str, left_day: str, right_day: str, forward: bool = False, strict: bool = False, inner: bool = False) -> DataFrame:
    """left with the columns of the nearest right row of its key: the last on or before its day, or (forward) the first on or after.

    strict leaves out the same day; of right rows with one key and day the first by content counts (backward and
    forward alike). Both sides go through one exchange and one sort, and the nearest row is carried along, so a key
    with many rows on both sides costs their sum. Rows without a match have nulls, or drop out with inner.
    """
    held = [c for c in right.columns if c != by]
    kept = [c for c in left.columns if c != by]
    both = set(held) & set(kept)
    if both:
        raise ValueError(f"columns on both sides: {sorted(both)}")
    nearest = right.where(F.col(by).isNotNull() & F.col(right_day).isNotNull()).groupBy(by, right_day).agg(F.min(F.struct(*held)).alias("__right"))
    empty_left = F.lit(None).cast(left.select(F.struct(*kept).alias("l")).schema["l"].dataType)
    events = nearest.select(by, F.col(right_day).alias("__day"), F.lit(0).alias("__left"), empty_left.alias("__row"), "__right")
    asking = left.select(by, F.col(left_day).alias("__day"), F.lit(1).alias("__left"), F.struct(*kept).alias("__row"), F.lit(None).cast(nearest.schema["__right"].dataType).alias("__right"))
    order = F.desc_nulls_last("__day") if forward else F.asc_nulls_first("__day")
    series = Window.partitionBy(by).orderBy(order, F.desc("__left") if strict else F.asc("__left")).rowsBetween(Window.unboundedPreceding, 0)
    carried = events.unionByName(asking).withColumn("__right", F.last("__right", ignorenulls=True).over(series)).where("__left = 1")
    found = F.when(F.col(by).isNotNull() & F.col("__day").isNotNull(), F.col("__right"))
    out = carried.withColumn("__right", found)
    out = out.where(F.col("__right").isNotNull()) if inner else out
    return out.select(by, *(F.col(f"__row.{c}").alias(c) for c in kept), *(F.col(f"__right.{c}").alias(c) for c in held))


def range_join(left: DataFrame, right: DataFrame, by: str, left_day: str, right_day: str, least: int, most: int) -> DataFrame:
    """Pairs of one key whose left day is least to most days after the right one.

    Days fall into bins as wide as the range; a right row stands in the two bins that its range can touch, so the
    join is an equality on key and bin and compares about twice the pairs that it returns.
    """
    if most < least:
        raise ValueError("most is less than least")
    width = most - least + 1
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    first = F.floor((number(right_day) + least) / width)
    binned = right.withColumn("__bin", F.explode(F.array(first, first + 1)))
    placed = left.withColumn("__bin", F.floor(number(left_day) / width))
    pairs = placed.join(binned, [by, "__bin"])
    return pairs.where(F.datediff(left_day, right_day).between(least, most)).drop("__bin")
