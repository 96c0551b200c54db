"""Running values over long ordered groups without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Rows of one group and stretch are windowed together; a stretch holds at most this many
# consecutive sequence numbers.
STRETCH = 65_536


def last_before(df: DataFrame, group: str, seq: str, value: Column, name: str, stretch: int = STRETCH) -> DataFrame:
    """Adds `name`: the last non-null `value` on an earlier row of the group, by `seq`.

    `seq` is a bigint, unique in its group. The group is cut into stretches of the sequence.
    Within a stretch a window finds the last value; a stretch that has none takes the last
    one of the stretches before it, from one summary row per stretch.
    """
    cut_up = df.withColumn("_stretch", F.floor(F.col(seq) / stretch)).withColumn("_value", value)
    inside = Window.partitionBy(group, "_stretch").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        cut_up.where("_value IS NOT NULL")
        .groupBy(group, "_stretch")
        .agg(F.max_by("_value", seq).alias("_last"))
    )
    # A value is carried into every later stretch, so the stretches that need one are listed.
    stretches = cut_up.select(group, "_stretch").distinct().join(summary, [group, "_stretch"], "left")
    earlier = Window.partitionBy(group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = stretches.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).select(
        group, "_stretch", "_carried")
    return (
        cut_up.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
        .join(carried, [group, "_stretch"], "left")
        .withColumn(name, F.coalesce("_inside", "_carried"))
        .drop("_stretch", "_value", "_inside", "_carried")
    )
