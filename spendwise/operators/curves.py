"""Saturating budget → revenue response curves per channel.

Hill curve ``revenue = vmax · s / (k + s + 1e-9)``.  The fit is a grid search
over 60 half-saturation points per channel with a closed-form ``vmax``: the
(channel × grid) table is bounded by the channel vocabulary × 60 and is
broadcast to the (channel, day) rows; two aggregations give vmax then SSE.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import daily as D

EPS = 1e-9
GRID = 60
MARGINAL_STEP = 1000.0


def hill(vmax: Column, k: Column, spend: Column) -> Column:
    """Monotone saturating curve; spend clipped at 0, k floored at 1e-9."""
    s = F.greatest(spend.cast("double"), F.lit(0.0))
    return vmax * s / (F.greatest(k, F.lit(EPS)) + s + F.lit(EPS))


def fit_curves(channel_daily: DataFrame) -> DataFrame:
    """A15 on (channel, date, spend, revenue) → (channel, vmax, k, method)."""
    pts = channel_daily.select(
        "channel", F.col("spend").cast("double").alias("s"), F.col("revenue").cast("double").alias("r")
    ).where(F.col("s").isNotNull() & F.col("r").isNotNull() & ~F.isnan("s") & ~F.isnan("r") & (F.col("s") >= 0) & (F.col("r") >= 0))
    stats = pts.groupBy("channel").agg(
        F.count("*").alias("n"), F.max("s").alias("smax"), F.max("r").alias("rmax"),
        F.sum("s").alias("ssum"), F.sum("r").alias("rsum"),
    )
    start, stop = F.col("smax") * 0.05, F.col("smax") * 5.0
    step = (stop - start) / F.lit(GRID - 1)
    grid = stats.where((F.col("n") >= 5) & (F.col("smax") > 0) & (F.col("rmax") > 0)).select(
        "channel", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("i"), start.alias("_a"), stop.alias("_b"), step.alias("_st")
    ).select("channel", "i", F.when(F.col("i") == GRID - 1, F.col("_b")).otherwise(F.col("i") * F.col("_st") + F.col("_a")).alias("k"))
    # grid rows ≤ |channels| × 60: broadcast
    xr = pts.join(F.broadcast(grid), "channel").withColumn("x", F.col("s") / (F.col("k") + F.col("s") + F.lit(EPS)))
    p1 = xr.groupBy("channel", "i", "k").agg(F.sum(F.col("x") * F.col("x")).alias("den"), F.sum(F.col("x") * F.col("r")).alias("num"))
    p1 = p1.where(F.col("den") > 0).withColumn("vmax", F.col("num") / F.col("den")).where(F.col("vmax") > 0)
    sse = (
        xr.join(F.broadcast(p1.select("channel", "i", "vmax")), ["channel", "i"])
        .groupBy("channel", "i", "k", "vmax")
        .agg(F.sum(F.pow(F.col("vmax") * F.col("x") - F.col("r"), 2)).alias("sse"))
    )
    best = sse.groupBy("channel").agg(F.min(F.struct("sse", "i", "vmax", "k")).alias("b"))
    fb_roas = F.when(F.col("ssum") > 0, F.col("rsum") / F.col("ssum")).otherwise(F.lit(1.0))
    fb_k = F.when(F.col("smax") > 0, F.greatest(F.col("smax") * 10.0, F.lit(1.0))).otherwise(F.lit(1.0))
    out = stats.join(best, "channel", "left")
    return out.select(
        "channel",
        F.coalesce(F.col("b.vmax"), fb_roas * fb_k).alias("vmax"),
        F.greatest(F.coalesce(F.col("b.k"), fb_k), F.lit(EPS)).alias("k"),
        F.when(F.col("b").isNull(), "linear").otherwise("hill").alias("method"),
    )


def channel_curves(long: DataFrame) -> DataFrame:
    """M8: curves on daily channel aggregates of a long table."""
    return fit_curves(D.channel_daily(long))


def lookup(frame: DataFrame, curves: DataFrame) -> DataFrame:
    """Attach (vmax, k) by channel; unknown channel → mean of the known
    curves; no curves at all → (1, 1).  Curves are ≤ one row per channel."""
    mean = curves.agg(F.avg("vmax").alias("_mv"), F.avg("k").alias("_mk"))
    x = frame.join(F.broadcast(curves.select("channel", "vmax", "k")), "channel", "left").crossJoin(F.broadcast(mean))
    return x.withColumn("vmax", F.coalesce("vmax", "_mv", F.lit(1.0))).withColumn(
        "k", F.coalesce("k", "_mk", F.lit(1.0))
    ).drop("_mv", "_mk")


def score_scenarios(scenarios: DataFrame, curves: DataFrame) -> DataFrame:
    """M9: (scenario_id, channel, budget) → revenue, ROAS and marginal ROAS
    per channel; blended totals by A20 in :func:`scenario_totals`."""
    x = lookup(scenarios, curves)
    b = F.col("budget").cast("double")
    rev = hill(F.col("vmax"), F.col("k"), b)
    rev_more = hill(F.col("vmax"), F.col("k"), b + MARGINAL_STEP)
    return x.select(
        "scenario_id", "channel", b.alias("budget"), rev.alias("revenue"),
        F.when(b > 0, rev / b).otherwise(0.0).alias("roas"),
        F.when(b > 0, (rev_more - rev) / MARGINAL_STEP).otherwise(0.0).alias("marginal_roas"),
    )


def scenario_totals(scored: DataFrame) -> DataFrame:
    """Per scenario total budget, revenue and blended ROAS."""
    return scored.groupBy("scenario_id").agg(F.sum("budget").alias("budget"), F.sum("revenue").alias("revenue")).withColumn(
        "roas", F.when(F.col("budget") > 0, F.col("revenue") / F.col("budget")).otherwise(0.0)
    )


def curve_points(long: DataFrame, curves: DataFrame, n: int = 30) -> DataFrame:
    """N points per channel on [0, max(2.5 · 30 · mean daily spend, 1000)]."""
    cd = D.channel_daily(long)
    span = cd.groupBy("channel").agg((F.sum("spend").cast("double") / F.count("*")).alias("mean_daily"))
    hi = F.greatest(F.col("mean_daily") * 30.0 * 2.5, F.lit(1000.0))
    pts = span.select("channel", hi.alias("hi"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumn(
        "spend", F.when(F.col("i") == n - 1, F.col("hi")).otherwise(F.col("i") * (F.col("hi") / F.lit(n - 1)))
    )
    x = lookup(pts, curves)
    return x.select("channel", "i", "spend", hill(F.col("vmax"), F.col("k"), F.col("spend")).alias("revenue"))


def current_plan(forecast_out: DataFrame, window_days: int = 30) -> DataFrame:
    """Current per-channel budget = round(P50 revenue / P50 ROAS) of the
    channel rows of a forecast (ROAS 0 counts as 1), half rounded up."""
    ch = forecast_out.where((F.col("level") == "channel") & (F.col("window_days") == window_days))
    denom = F.when(F.col("roas_p50") != 0, F.col("roas_p50")).otherwise(F.lit(1.0))
    return ch.select("channel", F.floor(F.col("revenue_p50") / denom + 0.5).cast("double").alias("budget"))


def scenario_deltas(current: DataFrame, multipliers: DataFrame, curves: DataFrame) -> DataFrame:
    """Scenarios (current budgets × per-scenario multiplier) vs the current
    plan: per-channel spend delta and blended revenue / ROAS deltas."""
    base = score_scenarios(current.withColumn("scenario_id", F.lit("current")), curves)
    scen = current.crossJoin(F.broadcast(multipliers)).select(
        "scenario_id", "channel", (F.col("budget") * F.col("multiplier")).alias("budget")
    )
    s = score_scenarios(scen, curves)
    bt = scenario_totals(base).select(F.col("revenue").alias("base_revenue"), F.col("roas").alias("base_roas"))
    st = scenario_totals(s).crossJoin(F.broadcast(bt))
    per = s.join(current.select("channel", F.col("budget").alias("current_budget")), "channel", "left")
    return per.join(st.select("scenario_id", (F.col("revenue") - F.col("base_revenue")).alias("delta_revenue"),
                             (F.col("roas") - F.col("base_roas")).alias("delta_roas")), "scenario_id").select(
        "scenario_id", "channel", "current_budget", "budget", "revenue", "roas", "marginal_roas",
        (F.col("budget") - F.coalesce(F.col("current_budget"), F.lit(0.0))).alias("delta_spend"),
        "delta_revenue", "delta_roas",
    )
