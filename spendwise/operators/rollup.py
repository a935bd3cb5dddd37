"""Hierarchy roll-up campaign → type → channel → blended.

One ``GROUPING SETS`` aggregation per window: Spark plans an Expand followed by
partial + final hash aggregation, so the (hot) blended and channel groups are
combined map-side before the shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .ordinals import numbered

LEVEL_RANK = {"blended": 0, "channel": 1, "campaign_type": 2, "campaign": 3}


def roas(revenue: Column, spend: Column) -> Column:
    """Revenue / spend; 0 when spend ≤ 0 or the ratio is not finite."""
    r = F.try_divide(revenue.cast("double"), spend.cast("double"))
    finite = r.isNotNull() & ~F.isnan(r) & (F.abs(r) != float("inf"))
    return F.when((spend > 0) & finite, r).otherwise(F.lit(0.0))


def reconcile(pred: DataFrame, spend_col: str = "budget_input") -> DataFrame:
    """Campaign predictions (channel, campaign_type, campaign, window_days,
    ``spend_col``, revenue_p10/50/90) → the four-level output contract.

    Quantiles and spend are summed at each level; ROAS is derived from the
    summed planned spend, so the ROAS triple inherits the revenue ordering."""
    keys = ["window_days", "channel", "campaign_type", "campaign"]
    sets = [keys, keys[:3], keys[:2], keys[:1]]
    agg = pred.groupingSets(sets, *keys).agg(
        *[F.sum(q).alias(q) for q in S.REVENUE_Q],
        F.sum(spend_col).alias("_spend"),
        F.grouping_id().alias("_gid"),
    )
    level = (
        F.when(F.col("_gid") == 0, "campaign")
        .when(F.col("_gid") == 1, "campaign_type")
        .when(F.col("_gid") == 3, "channel")
        .otherwise("blended")
    )
    return agg.select(
        level.alias("level"),
        *[F.coalesce(F.col(k), F.lit("")).alias(k) for k in ("channel", "campaign_type", "campaign")],
        F.col("window_days").cast("int").alias("window_days"),
        *[F.col(q).cast("double").alias(q) for q in S.REVENUE_Q],
        *[roas(F.col(q), F.col("_spend")).alias(r) for q, r in zip(S.REVENUE_Q, S.ROAS_Q)],
    )


def level_rank(level: Column) -> Column:
    out = None
    for k, v in LEVEL_RANK.items():
        out = F.when(level == k, v) if out is None else out.when(level == k, v)
    return out


def output_keys() -> list[Column | str]:
    return ["window_days", level_rank(F.col("level")), "channel", "campaign_type", "campaign"]


def output_order(df: DataFrame) -> DataFrame:
    """Window, level rank, channel, type, campaign — at the sink only."""
    return df.orderBy(*output_keys())


def output_positions(df: DataFrame) -> DataFrame:
    """T1 as a column: every row's ``position`` in the output order, from 1."""
    return numbered(df, output_keys())
