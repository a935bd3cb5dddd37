"""The base stage: the fact summed by (campaign, channel, type, date).

Sums, row counts and brand counts merge, so the daily series, bounds, campaign
attributes, seasonal index, curves and profiles all derive from this table, and a
plan reads the fact once.  It has the long table's columns (one row for many), with
``rows`` as their number; operators that count rows take that into account.  The
staged table is partitioned by month, so that date filters with literals prune
files.  Grouping by all four keys lets partial aggregation collapse a campaign that
holds a large share of the rows before the shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..session import scratch_table

KEYS = ("campaign", "channel", "campaign_type", "date")


def month_of(date: Column) -> Column:
    """yyyymm as a number."""
    return F.year(date) * 100 + F.month(date)


def summary(long: DataFrame) -> DataFrame:
    """One row per key: metric sums, ``rows``, and the mean brand flag as
    (``brand``, ``branded``) = (sum, count)."""
    return long.groupBy(*KEYS).agg(
        *[F.sum(m).cast(long.schema[m].dataType).alias(m) for m in S.METRICS], F.count("*").alias("rows"),
        F.sum("is_brand").alias("brand"), F.count("is_brand").alias("branded"))


def staged(long: DataFrame) -> DataFrame:
    """The staged summary of a long table; a summary is returned as it is."""
    if is_summary(long):
        return long
    base = summary(long).withColumn("month", month_of(F.col("date")))
    return scratch_table(long.sparkSession, base.hint("rebalance", F.col("month")), "base", partition_by="month")


def is_summary(frame: DataFrame) -> bool:
    return "rows" in frame.columns and "branded" in frame.columns


def row_count(frame: DataFrame) -> Column:
    """Fact rows behind each row."""
    return F.col("rows") if is_summary(frame) else F.lit(1).cast("long")


def until(frame: DataFrame, last) -> DataFrame:
    """Rows dated on or before ``last`` (a date): a filter by literals, on the partition
    column too where there is one."""
    out = frame.where(F.col("date") <= F.lit(last))
    return out.where(F.col("month") <= last.year * 100 + last.month) if "month" in frame.columns else out
