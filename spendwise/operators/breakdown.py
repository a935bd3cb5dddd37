"""Forecast breakdown views (P29, P30, F5–F7, T3, T7, J10) over the output
table: implied spend, contribution share, risk flag, interval-width confidence,
window / level slices, free-text search, and the top-N campaigns' rows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordinals import numbered

# FIXED VALUES — risk and confidence thresholds.
RISK_MIN_ROAS, RISK_SPREAD = 1.0, 5.0
CONF_HIGH, CONF_MEDIUM = 1.5, 3.5


def slice_windows(out: DataFrame, windows=None, levels=None) -> DataFrame:
    """Keep the listed windows and levels (None = all)."""
    if windows:
        out = out.where(F.col("window_days").isin(*windows))
    if levels:
        out = out.where(F.col("level").isin(*levels))
    return out


def breakdown(out: DataFrame) -> DataFrame:
    """Non-blended rows with implied spend (P50 / ROAS P50, 0 when ROAS
    is 0), contribution to the window's blended P50 (a 0 total counts as 1)
    and a Watch / OK flag (ROAS P50 < 1, or P10–P90 wider than 5 × P50)."""
    tot = out.where(F.col("level") == "blended").select("window_days", F.col("revenue_p50").alias("_tot"))
    x = out.where(F.col("level") != "blended").join(F.broadcast(tot), "window_days", "left")  # ≤ one row per window
    total = F.when(F.coalesce(F.col("_tot"), F.lit(0.0)) != 0, F.col("_tot")).otherwise(F.lit(1.0))
    risk = (F.when(F.coalesce(F.col("roas_p50"), F.lit(0.0)) < RISK_MIN_ROAS, "Watch")
            .when((F.col("revenue_p50") > 0) & ((F.col("revenue_p90") - F.col("revenue_p10")) > RISK_SPREAD * F.col("revenue_p50")), "Watch")
            .otherwise("OK"))
    return x.select(
        "window_days", "level", "channel", "campaign_type", "campaign", "revenue_p10", "revenue_p50", "revenue_p90", "roas_p50",
        F.when(F.col("roas_p50") > 0, F.col("revenue_p50") / F.col("roas_p50")).otherwise(F.lit(0.0)).alias("implied_spend"),
        (F.col("revenue_p50") / total).alias("contribution"),
        risk.alias("risk"),
    )


def search(rows: DataFrame, query: str) -> DataFrame:
    """case-insensitive substring search over channel, type, campaign and
    level; an empty query keeps every row."""
    needle = (query or "").strip().lower()
    if not needle:
        return rows
    hay = F.lower(F.concat_ws(" ", "channel", "campaign_type", "campaign", "level"))
    return rows.where(hay.contains(needle))


def breakdown_order(rows: DataFrame) -> DataFrame:
    """The view with every row's ``position`` from 1, by level, then P50 descending
    (ties: channel, type, campaign, window)."""
    return numbered(rows, ["level", F.col("revenue_p50").desc(), "channel", "campaign_type", "campaign", "window_days"])


def confidence_label(out: DataFrame, assessment: DataFrame | None = None) -> DataFrame:
    """High / Medium / Low from (P90 − P10) / P50; Low when P50 ≤ 0, and
    Low for every row when the guard fell back at Low confidence."""
    spread = (F.col("revenue_p90") - F.col("revenue_p10")) / F.col("revenue_p50")
    label = (F.when(~(F.col("revenue_p50") > 0), "Low").when(spread < CONF_HIGH, "High")
             .when(spread < CONF_MEDIUM, "Medium").otherwise("Low"))
    if assessment is not None:
        g = assessment.select((F.col("fallback_used") & (F.col("confidence") == "Low")).alias("_gl"))
        out = out.crossJoin(F.broadcast(g))
        label = F.when(F.col("_gl"), "Low").otherwise(label)
    return out.select("level", "channel", "campaign_type", "campaign", "window_days", label.alias("confidence"))


def top_campaign_rows(out: DataFrame, n: int = 10) -> DataFrame:
    """T3 + J10: the N campaigns with the highest P50 in any window (ties →
    name), then all of their campaign rows through a left-semi join."""
    camp = out.where(F.col("level") == "campaign")
    best = camp.groupBy("campaign").agg(F.max("revenue_p50").alias("_best"))
    top = best.orderBy(F.col("_best").desc(), "campaign").limit(n).select("campaign")  # a top-N report: the limit is the feature
    return camp.join(F.broadcast(top), "campaign", "left_semi")
