"""Retail calendar features and the monthly seasonal index.

The window-calendar dimension has one row per (cut date, window) — its size is
(#cut dates × #windows), a function of the calendar span only, never of the
data volume — so it is broadcast to the feature rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def black_friday(year: Column) -> Column:
    """Day after the 4th Thursday of November."""
    first_thu = F.next_day(F.make_date(year, F.lit(10), F.lit(31)), "Thu")
    return F.date_add(first_thu, 22)


def cyber_monday(year: Column) -> Column:
    return F.date_add(black_friday(year), 3)


def is_peak(d: Column) -> Column:
    """Nov 15 – Dec 31."""
    return ((F.month(d) == 11) & (F.dayofmonth(d) >= 15)) | (F.month(d) == 12)


def seasonal_index(long: DataFrame) -> DataFrame:
    """A3: month → mean daily revenue of the month ÷ overall mean daily revenue,
    over observed dates only (no zero fill), months pooled over years.  When the
    overall mean is ≤ 0 every month gets 1.0."""
    d = long.groupBy("date").agg(F.sum("revenue").alias("rev"))
    overall = d.agg((F.sum("rev").cast("double") / F.count("*")).alias("overall"))
    by_month = d.groupBy(F.month("date").alias("month")).agg(
        (F.sum("rev").cast("double") / F.count("*")).alias("m_mean")
    )
    observed = by_month.crossJoin(F.broadcast(overall))
    months = observed.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    flat = months.crossJoin(F.broadcast(overall)).where(~(F.col("overall") > 0)).select(
        "month", F.lit(1.0).alias("seasonal_index")
    )
    return observed.where(F.col("overall") > 0).select(
        F.col("month").cast("int").alias("month"), (F.col("m_mean") / F.col("overall")).alias("seasonal_index")
    ).unionByName(flat)


def window_calendar(cuts: DataFrame, windows: DataFrame, gmin: Column, season: DataFrame | None) -> DataFrame:
    """P19 + P20 for every (ts, window_days): month_start, wom_start, frac_peak,
    has_bfcm, trend_index, seasonal_index.  ``cuts`` has columns ``ts`` and the
    bound column(s) referenced by ``gmin``.

    The window is (ts, ts + w]: ws = ts + 1, we = ts + w."""
    cw = cuts.crossJoin(F.broadcast(windows)).withColumn("ws", F.date_add("ts", 1))
    days = cw.select(
        "ts", "window_days", "ws", gmin.alias("_gmin"),
        F.explode(F.sequence(F.col("ws"), F.date_add("ts", F.col("window_days")))).alias("d"),
    )
    flagged = days.withColumn("peak", is_peak(F.col("d")).cast("double")).withColumn(
        "bfcm", ((F.col("d") == black_friday(F.year("d"))) | (F.col("d") == cyber_monday(F.year("d")))).cast("int")
    ).withColumn("month", F.month("d"))
    if season is not None:
        flagged = flagged.join(F.broadcast(season), "month", "left")
        seas = F.avg(F.coalesce(F.col("seasonal_index"), F.lit(1.0)))
    else:
        seas = F.lit(1.0)
    return flagged.groupBy("ts", "window_days", "ws", "_gmin").agg(
        F.avg("peak").alias("frac_peak"),
        F.max("bfcm").alias("has_bfcm"),
        seas.alias("seasonal_index"),
    ).select(
        "ts",
        "window_days",
        F.col("ws").alias("window_start"),
        F.month("ws").cast("double").alias("month_start"),
        (F.floor((F.dayofmonth("ws") - 1) / 7) + 1).cast("double").alias("wom_start"),
        "frac_peak",
        F.col("has_bfcm").cast("double").alias("has_bfcm"),
        (F.datediff("ws", "_gmin") / F.lit(365.0)).alias("trend_index"),
        "seasonal_index",
    )
