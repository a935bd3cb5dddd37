"""Daily series and campaign attributes (A1, A2, A4, J5, bounds).

Skew note: the raw long table may have a campaign holding a large share of all
rows.  Every aggregation here is keyed so that partial (map-side) aggregation
collapses raw rows before the shuffle; nothing repartitions raw rows by
campaign alone.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from . import base as B


def daily(long: DataFrame) -> DataFrame:
    """A1: (campaign, date) → sums of the five metrics.  The entity key is the
    campaign *name*; equal names on two channels merge."""
    return long.groupBy("campaign", "date").agg(*[F.sum(m).alias(m) for m in S.METRICS])


def channel_daily(long: DataFrame) -> DataFrame:
    """A4: (channel, date) → spend and revenue sums."""
    return long.groupBy("channel", "date").agg(F.sum("spend").alias("spend"), F.sum("revenue").alias("revenue"))


def campaign_attrs(long: DataFrame) -> DataFrame:
    """A2: modal channel / type per campaign (ties → smallest value) and the
    half-even rounded mean brand flag, over raw long rows.  Rows are counted by
    (campaign, channel, type) first, which any table of sums allows too."""
    brand, branded = (F.sum("brand"), F.sum("branded")) if B.is_summary(long) else (F.sum("is_brand"), F.count("is_brand"))
    n = long.groupBy("campaign", "channel", "campaign_type").agg(
        F.sum(B.row_count(long)).alias("n"), brand.alias("brand"), branded.alias("branded"))
    n = n.groupBy("campaign").agg(
        F.sum("brand").alias("brand"), F.sum("branded").alias("branded"),
        *[F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("value"), "n"))).alias(c) for c in ("channel", "campaign_type")])

    def mode(column):  # a campaign has at most channels x types entries
        values = F.array_distinct(F.transform(column, lambda e: e["value"]))
        counted = F.transform(values, lambda v: F.struct(
            F.aggregate(column, F.lit(0).cast("long"), lambda s, e: s - F.when(e["value"] == v, e["n"]).otherwise(0)).alias("less"), v.alias("value")))
        return F.array_min(counted)["value"].alias(column)

    return n.select("campaign", mode("channel"), mode("campaign_type"),
                    F.bround(F.try_divide(F.col("brand").cast("double"), "branded"), 0).cast("int").alias("is_brand"))


def bounds(frame: DataFrame, col: str = "date") -> DataFrame:
    """One-row (gmin, gmax); joined back with a broadcast cross join instead of
    being collected to the driver."""
    return frame.agg(F.min(col).alias("gmin"), F.max(col).alias("gmax"))


def with_bounds(frame: DataFrame, b: DataFrame) -> DataFrame:
    return frame.crossJoin(F.broadcast(b))
