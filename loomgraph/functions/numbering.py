"""Numbers for sorted rows without gathering a group, or all rows, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

#: Places of a row in its partition, in the low bits of monotonically_increasing_id.
PLACES = 1 << 33


def numbered(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their number (from 1) inside each group, in the given order.

    A range sort deals the rows out; each partition counts the rows of each of its groups, and a window over these counts, a
    row for each group and partition, gives the number at which a group goes on.
    """
    ordered = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    placed = materialize(ordered.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part = F.floor(F.col("__id") / PLACES).alias("__part")
    counts = placed.groupBy(group, part).agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(group).alias("__group"), "__part", (before - F.col("__first") + 1).alias("__shift"))
    placed = placed.withColumn("__part", part)
    joined = placed.join(starts, placed[group].eqNullSafe(starts["__group"]) & (placed["__part"] == starts["__part"]))
    return joined.select(*[placed[c] for c in rows.columns], (F.col("__id") + F.col("__shift")).cast("long").alias(name))
