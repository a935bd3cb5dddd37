"""Row numbers in a total order without a window over all rows.

The rows are dealt to range partitions of the order and sorted there, so a row's number
is its place in its partition plus the rows of the partitions before.  Those offsets are
one row per partition: bounded by the shuffle partitions, whatever the data.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_table

#: monotonically_increasing_id: partition number above these bits, place in it below
_PLACE_BITS = 33


def numbered(rows: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """``rows`` with their 1-based place in ``order`` as ``name``.  Rows equal in the whole
    order get different numbers in any way.  The numbered rows are staged, so that every
    reader sees the same ones."""
    if name in rows.columns:
        raise ValueError(f"column {name!r} is there already")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = scratch_table(rows.sparkSession, placed, "numbered").withColumn("_part", F.shiftright("_place", _PLACE_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(
        F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return placed.join(F.broadcast(offsets), F.col("_part") == F.col("_of")).select(
        *rows.columns, (F.col("_before") + place + 1).alias(name))
