"""Prediction post-processing (M5: P23–P26, J7), budget overrides (J9) and the
isotonic budget sweep (M7, W9)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from .guard import finite, seasonal_roas_baseline, sort3


def with_params(rows: DataFrame, params: DataFrame | None) -> DataFrame:
    """Per-window (blend_weight, width_factor) with the pooled values
    (window_days = 0) as fallback, then (1, 1).  ≤ 4 rows: broadcast."""
    if params is None:
        return rows.withColumn("blend_weight", F.lit(1.0)).withColumn("width_factor", F.lit(1.0))
    per = params.where(F.col("window_days") != 0).select("window_days", F.col("blend_weight").alias("_w"), F.col("width_factor").alias("_f"))
    pooled = params.where(F.col("window_days") == 0).select(F.col("blend_weight").alias("_pw"), F.col("width_factor").alias("_pf"))
    x = rows.join(F.broadcast(per), "window_days", "left").join(F.broadcast(pooled), how="left")
    return x.withColumn("blend_weight", F.coalesce("_w", "_pw", F.lit(1.0))).withColumn(
        "width_factor", F.coalesce("_f", "_pf", F.lit(1.0))
    ).drop("_w", "_f", "_pw", "_pf")


def postprocess(rows: DataFrame, params: DataFrame | None = None, global_roas: float = 1.0,
                lo: str = "q10", mid: str = "q50", hi: str = "q90") -> DataFrame:
    """M5: raw model quantiles (already on the revenue scale) → clip + sort →
    P50 blend with the seasonal-ROAS baseline and re-envelope → width factor
    around P50 → clip + sort → non-finite fallback budget × global ROAS ×
    (0.6, 1, 1.5).  Adds revenue_p10/p50/p90."""
    x = with_params(rows, params)
    a, b, c = sort3(F.col(lo), F.col(mid), F.col(hi))
    raw_ok = finite(F.col(lo)) & finite(F.col(mid)) & finite(F.col(hi))
    x = x.withColumn("_lo", a).withColumn("_mid", b).withColumn("_hi", c).withColumn("_ok", raw_ok)
    w = F.col("blend_weight")
    x = x.withColumn("_base", seasonal_roas_baseline(x))
    x = x.withColumn("_mid", F.when(w < 1.0, w * F.col("_mid") + (F.lit(1.0) - w) * F.col("_base")).otherwise(F.col("_mid")))
    x = x.withColumn("_lo", F.least("_lo", "_mid")).withColumn("_hi", F.greatest("_hi", "_mid"))
    f = F.col("width_factor")
    x = x.withColumn("_lo2", F.col("_mid") - f * (F.col("_mid") - F.col("_lo"))).withColumn(
        "_hi2", F.col("_mid") + f * (F.col("_hi") - F.col("_mid")))
    s = sort3(F.col("_lo2"), F.col("_mid"), F.col("_hi2"))
    fb = F.greatest(F.col("budget_input") * F.lit(float(global_roas)), F.lit(0.0))
    fbs = [fb * 0.6, fb * 1.0, fb * 1.5]
    keep = [c for c in rows.columns if c not in S.REVENUE_Q]
    return x.select(
        *keep,
        *[F.when(F.col("_ok"), s[i]).otherwise(fbs[i]).alias(q) for i, q in enumerate(S.REVENUE_Q)],
    )


def apply_budget_overrides(table: DataFrame, overrides: DataFrame) -> DataFrame:
    """Scale each (window, channel)'s budgets so they sum to the override
    target; the same target applies to every window.  The (window, channel)
    totals are a grouped aggregate broadcast back (bounded by windows ×
    channels), not a window over a hot channel partition."""
    tot = table.groupBy("window_days", "channel").agg(F.sum("budget_input").alias("_cur"))
    o = overrides.select("channel", F.col("budget").cast("double").alias("_target"))
    scale = tot.join(F.broadcast(o), "channel").select(
        "window_days", "channel",
        F.when((F.col("_cur") > 0) & F.col("_target").isNotNull(), F.col("_target") / F.col("_cur")).alias("_scale"),
    )
    x = table.join(F.broadcast(scale), ["window_days", "channel"], "left")
    return x.withColumn("budget_input", F.col("budget_input") * F.coalesce(F.col("_scale"), F.lit(1.0))).select(*table.columns)


def isotonic_sweep(pred: DataFrame, entity=("campaign", "window_days"), budget: str = "budget_input") -> DataFrame:
    """Cumulative max of each quantile along increasing budget per entity,
    so more budget never predicts less revenue."""
    w = Window.partitionBy(*entity).orderBy(budget).rowsBetween(Window.unboundedPreceding, 0)
    out = pred
    for q in S.REVENUE_Q:
        out = out.withColumn(q, F.max(q).over(w))
    return out


def budget_grid(table: DataFrame, multipliers: DataFrame, keep: bool = False) -> DataFrame:
    """M7 input: each entity row repeated at scaled budgets (broadcast list); ``keep``
    leaves the multiplier in, which tells the rows of a campaign without budget apart."""
    grid = table.crossJoin(F.broadcast(multipliers)).withColumn("budget_input", F.col("budget_input") * F.col("multiplier"))
    return grid if keep else grid.drop("multiplier")
