"""End-to-end plans built from the operators.

``baseline_forecast`` is the flagship: exports → long → daily → features at the
origin (with the seasonal index) → trailing-ROAS baseline quantiles → four-level
roll-up.  It needs no learner, so every step has an exact SQL twin.
"""
from __future__ import annotations

from pyspark.sql import DataFrame

from .. import schema as S
from ..operators import calendar as C
from ..operators import features as FE
from ..operators import guard as G
from ..operators import rollup as R


def baseline_campaign_forecast(long: DataFrame, windows=S.WINDOWS, fallback_roas: float = 1.0) -> DataFrame:
    """Campaign × window rows with G8 baseline revenue quantiles."""
    season = C.seasonal_index(long)
    table = FE.prediction_table(long, windows, season)
    based = G.with_baseline_quantiles(table, fallback_roas, prefix="")
    return based


def baseline_forecast(long: DataFrame, windows=S.WINDOWS, fallback_roas: float = 1.0) -> DataFrame:
    return R.reconcile(baseline_campaign_forecast(long, windows, fallback_roas))


def forest_forecast(training_table: DataFrame, prediction_table: DataFrame, training_profile: DataFrame | None = None,
                    **forest_params):
    """M14 with the learned model: time-split calibration (M4), a refit on all rows
    (M3), post-processing (M5), the scale guard (G10) when a training profile is given,
    and the four-level roll-up (A9).

    Returns (output, campaign predictions, calibration params, forest with the
    ``fallback_roas`` of its training rows)."""
    from ..session import cut_lineage
    from . import model as M

    forest, params, fallback = M.fit(training_table, **forest_params)
    forest.fallback_roas = fallback
    camp = cut_lineage(M.campaign_forecast(forest, params, fallback, prediction_table))
    if training_profile is not None:
        camp, _ = G.run_guardrail(camp, training_profile, fallback)
    return R.reconcile(camp), camp, params, forest
