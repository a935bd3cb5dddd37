"""Exact quantiles by distributed selection.

A target rank is bracketed by a sketch and narrowed round by round: each round
takes a grid of approximate quantiles of the rows still inside the bracket, picks
the grid values on either side of the rank with a cell to spare, and counts what
lies below and inside.  Once a bracket holds at most ``LIMIT`` rows strictly between
its ends, its distinct values are counted and the rank is read off a running sum.

So no task ever holds more distinct values of a group than the limit, equal values
collapse in partial aggregation wherever they are counted, and the result is exact
at every size.  Values are staged once as Parquet; a round is two aggregations over
them.  The brackets (groups x probabilities) are broadcast only within a checked
size.

Defined results: null and NaN values take no part, infinite ones are ordered; a
group without values has no row; null group keys are a group; repeated values count
as often as they occur.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_table, size_checked

#: rows strictly inside a bracket that one task may order
LIMIT = 200_000
#: cells of the grid, and the accuracy of its sketch (ten ranks in a cell's width)
CELLS, ACCURACY = 200, 2_000


def select(rows: DataFrame, group: Sequence[str], value: str, probs: Sequence[float], how: str = "linear",
           limit: int = LIMIT) -> DataFrame:
    """(group..., i, n, value): for each group and the i-th of ``probs`` the exact
    quantile of ``value``.  ``how``: "linear" interpolates between the neighbours of
    ``p * (n - 1)``; "order" takes the smallest value whose share of rows reaches p."""
    if how not in ("linear", "order"):
        raise ValueError(f"unknown kind of quantile: {how}")
    spark = rows.sparkSession
    key = F.struct(*[F.col(c) for c in group]) if group else F.struct(F.lit(0).alias("all"))
    x = scratch_table(spark, rows.select(key.alias("g"), F.col(value).cast("double").alias("v"))
                      .where("v IS NOT NULL AND NOT isnan(v)"), "quantile-values")
    infinite = F.lit(float("inf"))
    targets = x.groupBy("g").agg(F.count("*").alias("n")).select(
        "g", "n", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("i", "p"))
    at = F.col("p") * (F.col("n") - 1) if how == "linear" else F.greatest(F.ceil(F.col("p") * F.col("n")), F.lit(1)) - 1
    targets = targets.withColumn("at", at.cast("double")).select(
        "g", "i", "n", F.floor("at").alias("rank"), (F.col("at") - F.floor("at")).alias("part"),
        F.least(F.floor("at") + 1, F.col("n") - 1).alias("last"),
        (-infinite).alias("lo"), infinite.alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    brackets = scratch_table(spark, targets, "quantile-brackets")
    while (brackets.agg(F.max("inside")).first()[0] or 0) > limit:
        brackets = scratch_table(spark, _narrowed(x, brackets, limit), "quantile-brackets")

    held = x.join(size_checked(brackets, 256), "g").where("v >= lo AND v <= hi")
    counts = held.groupBy("g", "i", "n", "rank", "part", "last", "below", "v").agg(F.count("*").alias("c"))
    order = Window.partitionBy("g", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.col("below") + F.sum("c").over(order))
    found = counts.groupBy("g", "i", "n", "part").agg(
        F.min(F.when(F.col("upto") > F.col("rank"), F.col("v"))).alias("low"),
        F.min(F.when(F.col("upto") > F.col("last"), F.col("v"))).alias("high"))
    value_ = F.when(F.col("part") > 0, F.col("low") + F.col("part") * (F.col("high") - F.col("low"))).otherwise(F.col("low"))
    return found.select(*[F.col(f"g.{c}").alias(c) for c in group], "i", "n", value_.alias("value"))


def _narrowed(x: DataFrame, brackets: DataFrame, limit: int) -> DataFrame:
    """Brackets after one round: those with more than ``limit`` rows inside are cut to
    the grid cells around their ranks."""
    wide = brackets.where(F.col("inside") > limit)
    grid = F.array(*[F.lit(c / CELLS) for c in range(CELLS + 1)])
    cells = (x.join(size_checked(wide, 256), "g").where("v >= lo AND v <= hi").groupBy("g", "i")
             .agg(F.percentile_approx("v", grid, ACCURACY).alias("cells"), F.count("*").alias("held")))
    place = lambda rank: (F.col(rank) - F.col("below")) * CELLS / F.col("held")
    first = F.floor(place("rank")).cast("int") - 1
    end = F.ceil(place("last") + F.lit(CELLS) / F.col("held")).cast("int") + 1
    cut = wide.join(cells, ["g", "i"]).withColumns({"first": first, "end": end}).select(
        *[c for c in brackets.columns if c not in ("lo", "hi", "below", "inside")],
        F.when(F.col("first") <= 0, F.col("lo")).otherwise(F.get("cells", F.col("first"))).alias("lo"),
        F.when(F.col("end") >= CELLS, F.col("hi")).otherwise(F.get("cells", F.col("end"))).alias("hi"))
    keys = [c for c in brackets.columns if c not in ("below", "inside")]
    one = lambda condition: F.sum(F.when(condition, 1).otherwise(0)).alias
    counted = x.join(size_checked(scratch_table(x.sparkSession, cut, "quantile-cut"), 256), "g").groupBy(*keys).agg(
        one(F.col("v") < F.col("lo"))("below"), one((F.col("v") > F.col("lo")) & (F.col("v") < F.col("hi")))("inside"))
    return brackets.where(F.col("inside") <= limit).unionByName(counted)
