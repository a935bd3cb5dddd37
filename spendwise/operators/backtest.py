"""Forward-holdout backtest.

Split at origin = gmax − holdout, forecast from the training-period state,
join the realised forward sums and score every forecast variant in one
GROUPING SETS aggregation (overall / by window / by channel).
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from . import base as B

QUANTILE_ALPHAS = ((10, 0.1), (50, 0.5), (90, 0.9))


def origin_of(long: DataFrame, holdout: int = max(S.WINDOWS)) -> tuple[dt.date, dt.date] | None:
    """(gmax, origin = gmax − holdout) as two scalars, so that what follows filters by
    literals; None for a table without dates."""
    last = long.agg(F.max("date")).first()[0]
    return None if last is None else (last, last - dt.timedelta(days=holdout))


def train_split(long: DataFrame, origin: dt.date) -> DataFrame:
    """rows dated on or before the origin; on the base stage, its months only."""
    return B.until(long, origin)


def forward_actuals(long: DataFrame, origin: dt.date, gmax: dt.date, windows=S.WINDOWS) -> DataFrame:
    """Realised revenue and spend per campaign over (origin, origin + w]
    for every window that fits before gmax; every campaign of the data."""
    d = long.withColumn("age", F.datediff("date", F.lit(origin)))
    aggs = []
    for w in windows:
        inside = (F.col("age") >= 1) & (F.col("age") <= w)
        aggs += [F.sum(F.when(inside, F.col("revenue"))).alias(f"r{w}"), F.sum(F.when(inside, F.col("spend"))).alias(f"s{w}")]
    per = d.groupBy("campaign").agg(*aggs)
    fits = [w for w in windows if origin + dt.timedelta(days=w) <= gmax]
    long_form = per.select("campaign", F.explode(F.array(*[
        F.struct(F.lit(w).alias("window_days"), F.col(f"r{w}").alias("r"), F.col(f"s{w}").alias("s")) for w in fits])).alias("x")).select("campaign", "x.*")
    return long_form.select(
        "campaign", F.col("window_days").cast("int").alias("window_days"),
        F.greatest(F.coalesce(F.col("r").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("actual_revenue"),
        F.greatest(F.coalesce(F.col("s").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("actual_spend"),
    )


def scored_rows(pred: DataFrame, actuals: DataFrame) -> DataFrame:
    """J1 + F4: inner join on (campaign, window) and keep realised spend > 0."""
    return pred.join(actuals, ["campaign", "window_days"], "inner").where(F.col("actual_spend") > 0)


def metrics(merged: DataFrame, variants: dict[str, str]) -> DataFrame:
    """A18 + A19 for each variant (name → column prefix of its p10/p50/p90),
    overall, by window and by channel."""
    parts = []
    for name, prefix in variants.items():
        parts.append(F.struct(
            F.lit(name).alias("variant"),
            *[F.col(f"{prefix}_p{q}").cast("double").alias(f"q{q}") for q, _ in QUANTILE_ALPHAS],
        ))
    x = merged.select("channel", "window_days", F.col("actual_revenue").alias("a"), F.explode(F.array(*parts)).alias("v")).select(
        "channel", "window_days", "a", "v.*")
    covered = ((F.col("a") >= F.col("q10")) & (F.col("a") <= F.col("q90"))).cast("double")
    pin = {q: F.greatest(F.lit(al) * (F.col("a") - F.col(f"q{q}")), F.lit(al - 1.0) * (F.col("a") - F.col(f"q{q}")))
           for q, al in QUANTILE_ALPHAS}
    err = F.abs(F.col("a") - F.col("q50"))
    g = x.groupingSets([["variant"], ["variant", "window_days"], ["variant", "channel"]], "variant", "window_days", "channel").agg(
        F.count("*").alias("n"),
        F.avg(covered).alias("coverage"),
        F.sum(err).alias("_err"),
        F.sum(F.abs("a")).alias("_abs"),
        F.avg(F.when(F.col("a") > 0, err / F.col("a"))).alias("mape"),
        *[F.avg(v).alias(f"pinball_p{q}") for q, v in pin.items()],
        F.grouping_id().alias("_gid"),
    )
    grouping = F.when(F.col("_gid") == 3, "all").when(F.col("_gid") == 1, "window").otherwise("channel")
    key = F.when(F.col("_gid") == 3, F.lit("")).when(F.col("_gid") == 1, F.col("window_days").cast("string")).otherwise(F.col("channel"))
    return g.select(
        "variant", grouping.alias("grouping"), key.alias("key"), "n", "coverage",
        F.when(F.col("_abs") > 0, F.col("_err") / F.col("_abs")).alias("wape"),
        "mape", *[f"pinball_p{q}" for q, _ in QUANTILE_ALPHAS],
        ((F.col("pinball_p10") + F.col("pinball_p50") + F.col("pinball_p90")) / 3.0).alias("pinball_mean"),
    )
