"""Train once, predict many (M3, M4, M5, M14, G10): the fitted model as one object.

``train`` fits on a long table; ``ForecastModel.save`` and ``load`` keep it as a
versioned bundle; ``predict`` forecasts any prediction table from it, without a
training table in sight.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import base as B
from ..operators import calendar as C
from ..operators import calibrate as CA
from ..operators import curves as CV
from ..operators import features as FE
from ..operators import forest as QF
from ..operators import guard as G
from ..operators import predict as PR
from ..operators import rollup as R
from ..session import cut_lineage
from ..sources import bundle


def fit(training_table: DataFrame, **forest_params) -> tuple[QF.QuantileForest, DataFrame, float]:
    """M4 and M3 on a training table: the forest refitted on all rows, the calibration
    of one fitted on the earlier 80 % (predicting the later 20 % under the extrapolated
    budget), and the fallback ROAS (A10)."""
    split = CA.time_split(training_table)
    early = QF.QuantileForest(**forest_params).fit(split.where(~F.col("is_cal")).select(*training_table.columns))
    # only the later slice is scored; the earlier rows enter the calibration frame for
    # the split counts only
    ex = split.drop("budget_input").withColumnRenamed("budget_input_ex", "budget_input")
    late = ex.where(F.col("is_cal")).select(*[c for c in ex.columns if not c.startswith("_") and c != "is_cal"])
    pc = early.predict(late, key=("campaign", "window_start", "window_days"))
    lo, mid, hi = G.sort3(F.col("q10"), F.col("q50"), F.col("q90"))
    scored = pc.select("window_days", "window_start", F.col("target_revenue").alias("y"), lo.alias("lo"),
                       mid.alias("mid"), hi.alias("hi"), G.seasonal_roas_baseline(pc).alias("base"))
    none = F.lit(None).cast("double")
    unscored = ex.where(~F.col("is_cal")).select("window_days", "window_start", F.col("target_revenue").alias("y"),
                                                  none.alias("lo"), none.alias("mid"), none.alias("hi"), none.alias("base"))
    params = cut_lineage(CA.calibrate(cut_lineage(scored.unionByName(unscored))))
    full = QF.QuantileForest(**forest_params).fit(training_table)
    groas = CA.global_median_roas(training_table).first()["global_median_roas"]  # one scalar
    return full, params, float(groas) if groas is not None else 1.0


def campaign_forecast(forest: QF.QuantileForest, params: DataFrame, fallback_roas: float, table: DataFrame,
                      key=("campaign", "window_days")) -> DataFrame:
    """M3 + M5: calibrated campaign x window rows of a prediction table."""
    return PR.postprocess(forest.predict(table, key=key), params, global_roas=fallback_roas).drop("q10", "q50", "q90")


@dataclass
class ForecastModel:
    forest: QF.QuantileForest
    calibration: DataFrame
    season: DataFrame
    curves: DataFrame
    profile: DataFrame | None
    fallback_roas: float
    windows: tuple[int, ...] = S.WINDOWS
    version: int | None = None

    def prediction_table(self, long: DataFrame) -> DataFrame:
        """Features of new data, under the training season."""
        return FE.prediction_table(B.staged(long), self.windows, self.season)

    def predict(self, table: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """(output rows, campaign rows, guard assessment) of a prediction table.  Without a
        profile the guard is off and the model is used as it is."""
        camp = cut_lineage(campaign_forecast(self.forest, self.calibration, self.fallback_roas, table))
        assessment = None
        if self.profile is not None:
            camp, assessment = G.run_guardrail(camp, self.profile, self.fallback_roas)
        return R.reconcile(camp), camp, assessment

    def sweep(self, table: DataFrame, multipliers: DataFrame) -> DataFrame:
        """Campaign rows rescored at multiples of their budget in one batch, with
        the budget feature replaced, calibrated, and never falling as budget grows."""
        grid = PR.budget_grid(table, multipliers, keep=True)
        return PR.isotonic_sweep(campaign_forecast(self.forest, self.calibration, self.fallback_roas, grid,
                                                   key=("campaign", "window_days", "multiplier")))

    def save(self, path: str) -> int:
        """The next version under ``path``."""
        spark = self.calibration.sparkSession
        tables = {"calibration": self.calibration, "season": self.season, "curves": self.curves}
        self.version = bundle.save(spark, path, self.forest, tables, self.profile, self.fallback_roas, self.windows)
        return self.version

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> "ForecastModel":
        """The newest finished version under ``path``, or the one asked for."""
        b = bundle.load(spark, path, version)
        return cls(b["forest"], b["calibration"], b["season"], b["curves"], b["training_profile"], b["fallback_roas"],
                   tuple(b["windows"]), b["version"])


def train(long: DataFrame, windows=S.WINDOWS, cut_step: int = S.TRAIN_CUT_STEP, season: DataFrame | None = None,
          training_table: DataFrame | None = None, **forest_params) -> ForecastModel:
    """Everything a forecast needs, fitted on one long table, which is read once (into
    the base stage).  Staged inputs may be passed in."""
    long = B.staged(long)
    season = cut_lineage(C.seasonal_index(long)) if season is None else season
    tt = cut_lineage(FE.training_table(long, windows, cut_step, season)) if training_table is None else training_table
    if not tt.head(1):
        raise ValueError("No training samples produced — check the data span/history.")
    forest, params, fallback = fit(tt, **forest_params)
    return ForecastModel(forest, params, season, cut_lineage(CV.channel_curves(long)), cut_lineage(G.training_profile(long)), fallback, tuple(windows))
