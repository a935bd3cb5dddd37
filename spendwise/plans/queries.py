"""Registered queries (one per operator family of the blueprint inventory).

Every query reads the driver's tables — the lineitem-grain export rows — so its
work grows with the data.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import calendar as C
from ..operators import daily as D
from ..operators import features as FE
from ..functions import normalize as N
from ..sources import fixtures as X
from . import forecast as P
from .registry import register
from .workspace import workspace
from ..session import cut_lineage

OUT_SPEC = [("level", "str"), ("channel", "str"), ("campaign_type", "str"), ("campaign", "str"),
            ("window_days", "int")] + [(c, "num") for c in S.REVENUE_Q + S.ROAS_Q]
LONG_SPEC = [("date", "date"), ("channel", "str"), ("campaign", "str"), ("campaign_type", "str"),
             ("is_brand", "int")] + [(m, "num") for m in S.METRICS] + [("daily_budget", "num")]
FEATURE_SPEC = [("channel", "str"), ("campaign_type", "str"), ("campaign", "str"), ("is_brand", "int"),
                ("window_start", "date")] + [(n, "int" if n == "window_days" else "num") for n in S.NUMERIC_FEATURES]


def W(spark, sf_dir):
    return workspace(spark, sf_dir)


def long_of(spark, sf_dir):
    return W(spark, sf_dir).long


@register("forecast_baseline", OUT_SPEC)
def q_forecast_baseline(spark, sf_dir):
    """Flagship: M2 → M6/G8 (with P20) → A9 + P28."""
    return W(spark, sf_dir).forecast


@register("to_long", LONG_SPEC)
def q_to_long(spark, sf_dir):
    """P1–P13 + S9/U1: three differently-shaped exports → one long table."""
    return long_of(spark, sf_dir)


@register("daily", [("campaign", "str"), ("date", "date")] + [(m, "num") for m in S.METRICS])
def q_daily(spark, sf_dir):
    return D.daily(long_of(spark, sf_dir))


@register("channel_daily", [("channel", "str"), ("date", "date"), ("spend", "num"), ("revenue", "num")])
def q_channel_daily(spark, sf_dir):
    return D.channel_daily(long_of(spark, sf_dir))


@register("campaign_attrs", [("campaign", "str"), ("channel", "str"), ("campaign_type", "str"), ("is_brand", "int")])
def q_campaign_attrs(spark, sf_dir):
    return D.campaign_attrs(long_of(spark, sf_dir))


@register("seasonal_index", [("month", "int"), ("seasonal_index", "num")])
def q_seasonal_index(spark, sf_dir):
    return C.seasonal_index(long_of(spark, sf_dir))


@register("prediction_table", FEATURE_SPEC)
def q_prediction_table(spark, sf_dir):
    return W(spark, sf_dir).prediction_table


@register(
    "training_table",
    FEATURE_SPEC + [("budget_input_ex", "num"), ("target_revenue", "num"), ("target_spend", "num")],
)
def q_training_table(spark, sf_dir):
    return W(spark, sf_dir).training_table



# ---------------------------------------------------------------------------
# response curves and budget scenarios
# ---------------------------------------------------------------------------
from ..operators import curves as CV  # noqa: E402

SCENARIO_MULTIPLIERS = (("x0.5", 0.5), ("x1.0", 1.0), ("x1.5", 1.5), ("x2.0", 2.0))


@register("channel_curves", [("channel", "str"), ("vmax", "num"), ("k", "num"), ("method", "str")])
def q_channel_curves(spark, sf_dir):
    return W(spark, sf_dir).curves


@register("curve_points", [("channel", "str"), ("i", "int"), ("spend", "num"), ("revenue", "num")])
def q_curve_points(spark, sf_dir):
    ws = W(spark, sf_dir)
    return CV.curve_points(ws.base, ws.curves)


def _scenarios(spark, sf_dir):
    ws = W(spark, sf_dir)
    curves = ws.curves
    current = CV.current_plan(ws.forecast, 30)
    mult = spark.createDataFrame(list(SCENARIO_MULTIPLIERS), "scenario_id string, multiplier double")
    scen = current.crossJoin(F.broadcast(mult)).select(
        "scenario_id", "channel", (F.col("budget") * F.col("multiplier")).alias("budget"))
    return curves, current, mult, scen


@register("budget_scenarios", [("scenario_id", "str"), ("channel", "str"), ("budget", "num"), ("revenue", "num"),
                               ("roas", "num"), ("marginal_roas", "num")])
def q_budget_scenarios(spark, sf_dir):
    curves, _, _, scen = _scenarios(spark, sf_dir)
    return CV.score_scenarios(scen, curves)


@register("scenario_totals", [("scenario_id", "str"), ("budget", "num"), ("revenue", "num"), ("roas", "num")])
def q_scenario_totals(spark, sf_dir):
    curves, _, _, scen = _scenarios(spark, sf_dir)
    return CV.scenario_totals(CV.score_scenarios(scen, curves))


@register("scenario_deltas", [("scenario_id", "str"), ("channel", "str"), ("current_budget", "num"), ("budget", "num"),
                              ("revenue", "num"), ("roas", "num"), ("marginal_roas", "num"), ("delta_spend", "num"),
                              ("delta_revenue", "num"), ("delta_roas", "num")])
def q_scenario_deltas(spark, sf_dir):
    curves, current, mult, _ = _scenarios(spark, sf_dir)
    return CV.scenario_deltas(current, mult, curves)


# ---------------------------------------------------------------------------
# scale guard
# ---------------------------------------------------------------------------
from ..operators import guard as G  # noqa: E402

_Q3 = ("monthly_spend", "monthly_revenue", "campaign_monthly_spend", "campaign_monthly_revenue", "roas")
PROFILE_SPEC = [("channels", "str"), ("campaign_types", "str"), ("n_campaigns", "int")] + [
    (f"{k}_{p}", "num") for k in _Q3 for p in ("p10", "p50", "p90")] + [("other_channel_share", "num")]


def _flat_profile(prof):
    return prof.select(
        F.array_join("channels", ",").alias("channels"), F.array_join("campaign_types", ",").alias("campaign_types"),
        "n_campaigns", *[F.col(f"{k}.{p}").alias(f"{k}_{p}") for k in _Q3 for p in ("p10", "p50", "p90")],
        "other_channel_share",
    )


def _training_profile(spark, sf_dir):
    return G.training_profile(W(spark, sf_dir).base)


@register("training_profile", [("date_min", "str"), ("date_max", "str")] + PROFILE_SPEC)
def q_training_profile(spark, sf_dir):
    p = _training_profile(spark, sf_dir)
    return p.select("date_min", "date_max").crossJoin(_flat_profile(p))


@register("profile_by_channel", [("channel", "str")] + [(f"{k}_{p}", "num") for k in ("monthly_spend", "monthly_revenue")
                                                       for p in ("p10", "p50", "p90")] + [("roas", "num")])
def q_profile_by_channel(spark, sf_dir):
    p = _training_profile(spark, sf_dir).select(F.explode("by_channel").alias("channel", "v"))
    return p.select("channel", *[F.col(f"v.{k}.{q}").alias(f"{k}_{q}") for k in ("monthly_spend", "monthly_revenue")
                                 for q in ("p10", "p50", "p90")], F.col("v.roas").alias("roas"))


@register("upload_profile", PROFILE_SPEC)
def q_upload_profile(spark, sf_dir):
    return _flat_profile(G.profile_from_table(W(spark, sf_dir).prediction_table))


def _scaled_campaign_forecast(spark, sf_dir, factor):
    ws = W(spark, sf_dir)
    if factor == 1:
        return ws.baseline_campaign
    long = ws.base.withColumn("spend", F.col("spend") * factor).withColumn("revenue", F.col("revenue") * factor)
    table = FE.prediction_table(long, S.WINDOWS, C.seasonal_index(long))
    return G.with_baseline_quantiles(table, 1.0, prefix="")


ASSESS_SPEC = [("confidence", "str"), ("ood_score", "num"), ("reasons", "str"), ("model_weight", "num"),
               ("baseline_weight", "num"), ("interval_widening", "num"), ("fallback_used", "int")]


def _assess(spark, sf_dir, factor):
    # both inputs are referenced several times by the guard plan: cut them
    pred = cut_lineage(_scaled_campaign_forecast(spark, sf_dir, factor))
    out, a = G.run_guardrail(pred, cut_lineage(_training_profile(spark, sf_dir)))
    return out, a.select("confidence", "ood_score", F.array_join("reasons", " | ").alias("reasons"), "model_weight",
                         "baseline_weight", "interval_widening", F.col("fallback_used").cast("int").alias("fallback_used"))


@register("guard_assess", ASSESS_SPEC)
def q_guard_assess(spark, sf_dir):
    """G10 on the in-distribution upload: expected High, untouched."""
    return _assess(spark, sf_dir, 1)[1]


@register("guard_assess_x100", ASSESS_SPEC)
def q_guard_assess_x100(spark, sf_dir):
    """G10 on the same rows with spend and revenue × 100: expected Low."""
    return _assess(spark, sf_dir, 100)[1]


@register("guarded_forecast_x100", OUT_SPEC)
def q_guarded_forecast_x100(spark, sf_dir):
    """G9 blend + widen on the 100× upload, then the A9 roll-up."""
    out, _ = _assess(spark, sf_dir, 100)
    return R.reconcile(out)


# ---------------------------------------------------------------------------
# calibration and prediction post-processing
# ---------------------------------------------------------------------------
from ..operators import calibrate as CA  # noqa: E402
from ..operators import predict as PR  # noqa: E402
from ..operators import rollup as R  # noqa: E402


def _calibration_rows(spark, sf_dir):
    """Training rows in the predict regime (extrapolated budget) with G8's
    quantiles as the stand-in model and the M6 seasonal baseline."""
    tt = W(spark, sf_dir).training_table
    ex = tt.drop("budget_input").withColumnRenamed("budget_input_ex", "budget_input")
    q = G.with_baseline_quantiles(ex, 1.0, prefix="m_")
    return q.select("window_days", "window_start", F.col("target_revenue").alias("y"),
                    F.col("m_revenue_p10").alias("lo"), F.col("m_revenue_p50").alias("mid"),
                    F.col("m_revenue_p90").alias("hi"), G.seasonal_roas_baseline(q).alias("base"))


@register("calibration", [("window_days", "int"), ("n_cal", "int"), ("blend_weight", "num"), ("width_factor", "num")])
def q_calibration(spark, sf_dir):
    return CA.calibrate(_calibration_rows(spark, sf_dir))


@register("global_median_roas", [("global_median_roas", "num")])
def q_global_median_roas(spark, sf_dir):
    return CA.global_median_roas(W(spark, sf_dir).training_table)


def _calibrated_campaign(spark, sf_dir):
    ws = W(spark, sf_dir)
    params = CA.calibrate(_calibration_rows(spark, sf_dir))
    q = G.with_baseline_quantiles(ws.prediction_table, 1.0, prefix="m_")
    q = q.withColumnRenamed("m_revenue_p10", "q10").withColumnRenamed("m_revenue_p50", "q50").withColumnRenamed("m_revenue_p90", "q90")
    return PR.postprocess(q, params)


@register("forecast_calibrated", OUT_SPEC)
def q_forecast_calibrated(spark, sf_dir):
    """M5 with calibrated per-window blend/width, rolled up."""
    return R.reconcile(_calibrated_campaign(spark, sf_dir))


@register("forecast_override", OUT_SPEC)
def q_forecast_override(spark, sf_dir):
    """Channel budgets overridden to 1.5 × the current 30-day plan, then
    the baseline forecast and roll-up."""
    ws = W(spark, sf_dir)
    plan = CV.current_plan(ws.forecast, 30).select("channel", (F.col("budget") * 1.5).alias("budget"))
    t = PR.apply_budget_overrides(ws.prediction_table, plan)
    return R.reconcile(G.with_baseline_quantiles(t, 1.0, prefix=""))


def _sweep_multipliers(spark):
    return spark.createDataFrame([(m,) for m in (0.5, 0.75, 1.0, 1.5, 2.0)], "multiplier double")


@register("budget_sweep", [("campaign", "str"), ("window_days", "int"), ("budget_input", "num")]
          + [(q, "num") for q in S.REVENUE_Q])
def q_budget_sweep(spark, sf_dir):
    """M7 + W9: each campaign's row at 0.5×…2× its planned budget through the
    calibrated post-processing, made monotone by a cumulative max."""
    ws = W(spark, sf_dir)
    mult = _sweep_multipliers(spark)
    grid = PR.budget_grid(ws.prediction_table, mult)
    q = G.with_baseline_quantiles(grid, 1.0, prefix="m_")
    q = q.withColumnRenamed("m_revenue_p10", "q10").withColumnRenamed("m_revenue_p50", "q50").withColumnRenamed("m_revenue_p90", "q90")
    out = PR.isotonic_sweep(PR.postprocess(q, None))
    return out.select("campaign", "window_days", "budget_input", *S.REVENUE_Q)


# ---------------------------------------------------------------------------
# backtest (F3, F4, J1, M12, A18, A19, M13 with the SQL-expressible stand-in)
# ---------------------------------------------------------------------------
from ..operators import backtest as BT  # noqa: E402

HOLDOUT = 90
METRIC_SPEC = [("variant", "str"), ("grouping", "str"), ("key", "str"), ("n", "int"), ("coverage", "num"),
               ("wape", "num"), ("mape", "num"), ("pinball_p10", "num"), ("pinball_p50", "num"),
               ("pinball_p90", "num"), ("pinball_mean", "num")]


@register("backtest_actuals", [("campaign", "str"), ("window_days", "int"), ("actual_revenue", "num"),
                               ("actual_spend", "num")])
def q_backtest_actuals(spark, sf_dir):
    base = W(spark, sf_dir).base
    gmax, origin = BT.origin_of(base, HOLDOUT)
    return BT.forward_actuals(base, origin, gmax)


def _backtest_scored(spark, sf_dir):
    base = W(spark, sf_dir).base
    gmax, origin = BT.origin_of(base, HOLDOUT)
    train = BT.train_split(base, origin)
    table = cut_lineage(FE.prediction_table(train, S.WINDOWS, C.seasonal_index(train)))
    pred = G.with_baseline_quantiles(table, 1.0, prefix="")
    m6 = G.seasonal_roas_baseline(pred)
    pred = pred.select("*", *[(m6 * m).alias(f"base_{q}") for m, q in zip(G.BASELINE_BAND, S.REVENUE_Q)])
    wm, wb = G.BLEND_WEIGHTS["Low"]
    pred = pred.select("*", *[(F.lit(wm) * F.col(q) + F.lit(wb) * F.col(f"base_{q}")).alias(f"blend_{q}") for q in S.REVENUE_Q])
    return BT.scored_rows(pred, BT.forward_actuals(base, origin, gmax))


@register("backtest_metrics", METRIC_SPEC)
def q_backtest_metrics(spark, sf_dir):
    """Stand-in model = G8 quantiles from the training-period state; variants
    model / baseline (M6 × band) / Low-confidence blend."""
    merged = _backtest_scored(spark, sf_dir)
    return BT.metrics(merged, {"model": "revenue", "baseline": "base_revenue", "blend": "blend_revenue"})


# ---------------------------------------------------------------------------
# data quality and contracts
# ---------------------------------------------------------------------------
from ..operators import quality as QA  # noqa: E402
from ..sources import exports as EX  # noqa: E402
from ..sources import sinks as SK  # noqa: E402


@register("channel_summary", [("channel", "str"), ("spend", "num"), ("revenue", "num"), ("campaigns", "int"), ("rows", "int")])
def q_channel_summary(spark, sf_dir):
    return QA.channel_summary(long_of(spark, sf_dir))


@register("dataset_summary", [("rows", "int"), ("campaigns", "int"), ("channels", "str"), ("date_min", "date"), ("date_max", "date"),
                              ("total_spend", "num"), ("total_revenue", "num"), ("other_share", "num")])
def q_dataset_summary(spark, sf_dir):
    """Totals of the whole data set."""
    return QA.dataset_summary(long_of(spark, sf_dir)).withColumn("channels", F.array_join("channels", ","))


@register("scale_issues", [("severity", "str"), ("code", "str"), ("entity", "str"), ("message", "str")])
def q_scale_issues(spark, sf_dir):
    """Q5: scale mismatch issues of the 100 x upload."""
    pred = cut_lineage(_scaled_campaign_forecast(spark, sf_dir, 100))
    return QA.scale_issues(G.run_guardrail(pred, cut_lineage(_training_profile(spark, sf_dir)))[1])


@register("ingest_checks", [("check", "str"), ("ok", "int"), ("detail", "str")])
def q_ingest_checks(spark, sf_dir):
    return QA.ingest_checks(long_of(spark, sf_dir), True).select("check", F.col("ok").cast("int").alias("ok"), "detail")


@register("output_contract", [("columns_ok", "int"), ("rows", "int"), ("bad_level", "int"), ("bad_window", "int"),
                              ("non_finite", "int"), ("negative", "int"), ("crossing_revenue", "int"),
                              ("crossing_roas", "int"), ("valid", "int")])
def q_output_contract(spark, sf_dir):
    out = QA.output_contract(W(spark, sf_dir).forecast)
    return out.select(*[F.col(c).cast("int").alias(c) for c in out.columns])


@register("data_quality", [("check", "str"), ("ok", "int"), ("detail", "str")])
def q_data_quality(spark, sf_dir):
    """Q3 validator on the baseline forecast; required channels = channels
    present in the long table (J14)."""
    ws = W(spark, sf_dir)
    req = ws.long.select("channel").where(F.col("channel") != "other").distinct()
    return QA.validate_output(ws.forecast, req).select("check", F.col("ok").cast("int").alias("ok"), "detail")


@register("campaign_consistency", [("campaign", "str"), ("channel", "str"), ("campaign_type", "str"), ("is_brand", "int"),
                                   ("active_days", "int"), ("span_days", "int"), ("coverage", "num"), ("spend", "num"),
                                   ("revenue", "num")])
def q_campaign_consistency(spark, sf_dir):
    return QA.campaign_consistency(long_of(spark, sf_dir))[0]


@register("quality_issues", [("severity", "str"), ("code", "str"), ("entity", "str"), ("message", "str")])
def q_quality_issues(spark, sf_dir):
    return QA.campaign_consistency(long_of(spark, sf_dir))[1]


@register("top_campaigns_by_spend", [("campaign", "str"), ("spend", "num"), ("rank", "int")])
def q_top_campaigns_by_spend(spark, sf_dir):
    """T4: campaigns by spend, first 25 (the report's display limit)."""
    camps = QA.campaign_consistency(long_of(spark, sf_dir))[0]
    top = camps.orderBy(F.col("spend").desc(), "campaign").limit(25)
    w = __import__("pyspark.sql", fromlist=["Window"]).Window.orderBy(F.col("spend").desc(), "campaign")
    return top.select("campaign", "spend", F.row_number().over(w).alias("rank"))


@register("readiness", [("label", "str"), ("status", "str"), ("detail", "str")])
def q_readiness(spark, sf_dir):
    return QA.readiness(long_of(spark, sf_dir))


def _written(spark, sf_dir, key, exports):
    """Exports written as CSV with headers under the checkpoint folder (one directory
    per export name), once per session and data folder."""
    ws = W(spark, sf_dir)
    if key not in ws.__dict__:
        base = SK.scratch_dir(spark, key)
        for name, df in exports(spark, sf_dir, ws.facts).items():
            SK.write_csv(df, f"{base}/{name}")
        ws.__dict__[key] = base
    return ws.__dict__[key]


def _csv_dir(spark, sf_dir):
    names = ("google_ads_campaign_stats", "bing_campaign_stats", "meta_ads_campaign_stats")
    return _written(spark, sf_dir, "exports", lambda *of: dict(zip(names, X.exports(*of))))


def _mixed_dir(spark, sf_dir):
    return _written(spark, sf_dir, "mixed_exports", X.mixed_exports)


@register("csv_ingest", LONG_SPEC)
def q_csv_ingest(spark, sf_dir):
    """CSV directory scan grouped by header signature → long table."""
    return EX.load_long(spark, _csv_dir(spark, sf_dir))


def _export_name(path_col):
    """Export name = the directory the part files were written to."""
    return F.element_at(F.split(path_col, "/"), -2)


@register("file_report", [("source_file", "str"), ("raw_rows", "int"), ("parsed_rows", "int"), ("invalid_rows", "int"),
                          ("zero_spend_share", "num"), ("zero_revenue_share", "num"), ("spend", "num"),
                          ("revenue", "num"), ("campaign_types", "str"), ("channels", "str")])
def q_file_report(spark, sf_dir):
    """Parse report per written export (its part files pooled)."""
    d = _csv_dir(spark, sf_dir)
    long = EX.load_long(spark, d, with_file=True).withColumn(EX.FILE_COL, _export_name(F.col(EX.FILE_COL)))
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(d)
    # header lines are not data rows: one per part file
    counts = raw.groupBy(F.col("_metadata.file_path").alias("f")).agg((F.count("*") - 1).alias("n")).groupBy(
        _export_name(F.col("f")).alias(EX.FILE_COL)).agg(F.sum("n").alias("raw_rows"))
    return QA.file_report(long, counts)


@register("parse_inspection", [("source_file", "str"), ("raw_spend", "num"), ("parsed_spend", "num"), ("diff", "num"),
                               ("ok", "int")])
def q_parse_inspection(spark, sf_dir):
    """Q4: Σ micros ÷ 1e6 per export that carries a micros spend column
    against its parsed spend."""
    d = _csv_dir(spark, sf_dir)
    long = EX.load_long(spark, d, with_file=True).withColumn(EX.FILE_COL, _export_name(F.col(EX.FILE_COL)))
    raws = []
    for header, paths in EX.group_by_signature(EX.scan_files(spark, d)).items():
        i = N.resolve(list(header), "spend")
        if i is not None and S.MICROS_TOKEN in N.norm_name(header[i]):
            g = EX.read_signature_group(spark, header, paths)
            raws.append(g.select(_export_name(F.col(EX.FILE_COL)).alias(EX.FILE_COL), F.col(f"c{i}").alias("micros")))
    raw = raws[0]
    for r in raws[1:]:
        raw = raw.unionByName(r)
    out = QA.micros_reconciliation(raw, long)
    return out.select(*[F.col(c).cast("int").alias(c) if c == "ok" else F.col(c) for c in out.columns])


@register("mixed_ingest", LONG_SPEC)
def q_mixed_ingest(spark, sf_dir):
    """Dates in many layouts, a channel column, cells that are no numbers."""
    return EX.load_long(spark, _mixed_dir(spark, sf_dir))


@register("file_outcomes", [("source_file", "str"), ("status", "str"), ("channel_hint", "str"), ("has_revenue", "int"),
                            ("raw_rows", "int"), ("parsed_rows", "int"), ("dropped_rows", "int"), ("zeroed_cells", "int"),
                            ("date_min", "date"), ("date_max", "date"), ("campaigns", "int"), ("spend", "num"),
                            ("revenue", "num"), ("stops_strict_run", "int")])
def q_file_outcomes(spark, sf_dir):
    """What became of every export (its part files pooled)."""
    d = _mixed_dir(spark, sf_dir)
    files = EX.scan_files(spark, d)
    parsed = EX.load_long(spark, d, with_file=True, rejects=True, files=files)
    # the hint comes from the export's name; its part files have none of their own
    named = [EX.ExportFile(f.path.rsplit("/", 1)[0], f.bytes, f.header) for f in files]
    out = EX.file_outcomes(spark, named, parsed, lambda path: F.regexp_extract(path, r"([^/]*)(?:/[^/]*\.csv)?$", 1))
    stop = EX.broken_files(out).select("source_file", F.lit(1).alias("stops_strict_run"))
    return out.join(stop, "source_file", "left").fillna(0, ["stops_strict_run"]).withColumn("has_revenue", F.col("has_revenue").cast("int"))


@register("rejected_cells", [("source_file", "str"), ("column", "str"), ("reason", "str"), ("cells", "int")])
def q_rejected_cells(spark, sf_dir):
    """Q4: cells that the parser did not take as they are, by export, column and reason."""
    parsed = EX.load_long(spark, _mixed_dir(spark, sf_dir), with_file=True, rejects=True)
    return EX.rejected_cells(parsed, _export_name)


# ---------------------------------------------------------------------------
# learned model: quantile regression forest
# ---------------------------------------------------------------------------
from pyspark.ml.functions import vector_to_array  # noqa: E402

from ..operators import forest as QF  # noqa: E402
from . import model as MO  # noqa: E402


def _forest(spark, sf_dir):
    ws = W(spark, sf_dir)
    if "forest" not in ws.__dict__:
        prof = cut_lineage(G.training_profile(ws.base))
        out, _, _, model = P.forest_forecast(ws.training_table, ws.prediction_table, prof)
        ws.__dict__["forest"] = (cut_lineage(out), model)
    return ws.__dict__["forest"]


@register("quantile_forest_forecast", OUT_SPEC)
def q_quantile_forest_forecast(spark, sf_dir):
    """End-to-end forecast with the learned quantile model (rows-only check:
    a fitted forest has no SQL twin)."""
    return _forest(spark, sf_dir)[0]


@register("feature_drivers", [("feature", "str"), ("importance", "num")])
def q_feature_drivers(spark, sf_dir):
    """T5: top-8 feature importances of the full-data forest."""
    return _forest(spark, sf_dir)[1].drivers(spark, 8)


#: fixed splits in place of learned ones, so that sketches, predictions and a saved model
#: have SQL twins: (feature, threshold, left, right), None for a leaf
SMALL_TREES = (
    ("tr28_revenue", 20000.0, ("budget_input", 5000.0, None, None), ("seasonal_index", 1.0, None, None)),
    ("window_days", 45.0, ("tr28_roas", 4.0, None, None), ("ch_google", 0.5, None, ("budget_input", 30000.0, None, None))),
    ("rev_growth_mom", 0.0, None, ("x_is_brand", 0.5, ("ct_Shopping", 0.5, None, None), None)),
)
#: leaves hold many rows here, and the twins take exact ranks
SMALL = dict(trees=SMALL_TREES, accuracy=1_000_000)


@register("design_matrix", [("campaign", "str"), ("window_days", "int"), ("i", "int"), ("value", "num")])
def q_design_matrix(spark, sf_dir):
    """The learner's input vector of every prediction row, by position."""
    x = QF.design(W(spark, sf_dir).prediction_table.withColumn("_days", F.col("window_days")))
    return x.select("campaign", F.col("_days").alias("window_days"), F.posexplode(vector_to_array("features")).alias("i", "value"))


@register("forest_sketches", [("tree", "int"), ("leaf", "int"), ("i", "int"), ("value", "num")])
def q_forest_sketches(spark, sf_dir):
    """M3: leaf sketches of the fixed splits over the training table."""
    m = QF.QuantileForest(**SMALL).fit(W(spark, sf_dir).training_table)
    return m.sketches.select("tree", "leaf", F.posexplode("sketch").alias("i", "value"))


@register("forest_quantiles", [("campaign", "str"), ("window_days", "int"), ("q10", "num"), ("q50", "num"), ("q90", "num")])
def q_forest_quantiles(spark, sf_dir):
    """Per-row quantiles from the leaf sketches of the fixed splits."""
    ws = W(spark, sf_dir)
    return QF.QuantileForest(**SMALL).fit(ws.training_table).predict(ws.prediction_table).select("campaign", "window_days", "q10", "q50", "q90")


@register("predict_loaded", OUT_SPEC)
def q_predict_loaded(spark, sf_dir):
    """Train, save a bundle, load it and forecast with what was loaded
    (calibration, guard and roll-up included)."""
    ws = W(spark, sf_dir)
    path = SK.scratch_dir(spark, "model")
    MO.train(ws.base, season=ws.season, training_table=ws.training_table, **SMALL).save(path)
    loaded = MO.ForecastModel.load(spark, path)
    return loaded.predict(loaded.prediction_table(ws.base))[0]


@register("budget_sweep_model", [("campaign", "str"), ("window_days", "int"), ("multiplier", "num"), ("budget_input", "num")]
          + [(q, "num") for q in S.REVENUE_Q])
def q_budget_sweep_model(spark, sf_dir):
    """M7 + W9 through the fitted model: forest of the fixed splits, its calibration and
    fallback ROAS, rescored at every budget."""
    ws = W(spark, sf_dir)
    model = MO.train(ws.base, season=ws.season, training_table=ws.training_table, **SMALL)
    out = model.sweep(ws.prediction_table, _sweep_multipliers(spark))
    return out.select("campaign", "window_days", "multiplier", "budget_input", *S.REVENUE_Q)


# ---------------------------------------------------------------------------
# grounded insights
# ---------------------------------------------------------------------------
from ..operators import insights as IN  # noqa: E402


@register("insight_context", [("window_days", "int"), ("n_numbers", "int"), ("names", "str"),
                              ("allowed_channels", "str"), ("allowed_campaigns", "str")])
def q_insight_context(spark, sf_dir):
    c = IN.context(W(spark, sf_dir).forecast)
    return c.select("window_days", F.size("numbers").alias("n_numbers"), F.array_join(F.array_sort("names"), ",").alias("names"),
                    F.array_join("allowed_channels", ",").alias("allowed_channels"),
                    F.array_join("allowed_campaigns", ",").alias("allowed_campaigns"))


@register("rule_insights", [("window_days", "int"), ("section", "str"), ("ordinal", "int"), ("text", "str"), ("evidence", "str")])
def q_rule_insights(spark, sf_dir):
    r = IN.rule_insights(W(spark, sf_dir).forecast)
    return r.select("window_days", "section", "ordinal", "text", F.array_join("evidence", ",").alias("evidence"))


def _validated(spark, sf_dir):
    out = W(spark, sf_dir).forecast
    return IN.validate_claims(IN.claims_from_forecast(out), IN.context(out))


@register("claim_validation", [("window_days", "int"), ("kind", "str"), ("text", "str"), ("accepted", "int"), ("reason", "str")])
def q_claim_validation(spark, sf_dir):
    v = _validated(spark, sf_dir)
    return v.select("window_days", "kind", "text", F.col("accepted").cast("int").alias("accepted"), "reason")


@register("insight_status", [("window_days", "int"), ("status", "str"), ("claims", "int"), ("rejected", "int"), ("items_used", "int")])
def q_insight_status(spark, sf_dir):
    out = W(spark, sf_dir).forecast
    return IN.choose(_validated(spark, sf_dir), IN.rule_insights(out))


@register("insight_narrative", [("window_days", "int"), ("narrative", "str")])
def q_insight_narrative(spark, sf_dir):
    return IN.narrative(IN.with_fields(IN.rule_insights(W(spark, sf_dir).forecast)))


@register("insight_fields", [("window_days", "int"), ("section", "str"), ("ordinal", "int"), ("text", "str"), ("severity", "str"),
                             ("action", "str"), ("confidence", "str"), ("direction", "str")])
def q_insight_fields(spark, sf_dir):
    """The rule items with severity, action, confidence and direction."""
    return IN.with_fields(IN.rule_insights(W(spark, sf_dir).forecast))


def _answers(spark, sf_dir):
    out = W(spark, sf_dir).forecast
    return cut_lineage(IN.validate_claims(X.provider_claims(out), IN.context(out)))


@register("insight_items", [(c, "int" if c == "window_days" else "str") for c in IN.ITEM_COLUMNS])
def q_insight_items(spark, sf_dir):
    """The chosen items of every window, from a provider's answer or the rules."""
    return IN.chosen_items(_answers(spark, sf_dir), IN.with_fields(IN.rule_insights(W(spark, sf_dir).forecast)))


@register("insight_log", [("window_days", "int"), ("guardrail", "str"), ("provider", "str"), ("section_rank", "int"), ("key", "str"),
                          ("reason", "str")])
def q_insight_log(spark, sf_dir):
    """Why claims were dropped."""
    return IN.rejection_log(_answers(spark, sf_dir))


@register("backtest_forest", METRIC_SPEC)
def q_backtest_forest(spark, sf_dir):
    """M13 with the learned model: forest + calibration fitted on data up to
    origin = gmax − 90, forecast at the origin, scored on the realised forward
    windows; variants model / trailing-ROAS baseline (G8 with the global median
    ROAS fallback) / Low-confidence blend (rows-only: depends on the fit)."""
    ws = W(spark, sf_dir)
    if "backtest_forest" not in ws.__dict__:
        base = ws.base
        gmax, origin = BT.origin_of(base, HOLDOUT)
        train = BT.train_split(base, origin)
        season = cut_lineage(C.seasonal_index(train))
        tt = cut_lineage(FE.training_table(train, S.WINDOWS, S.TRAIN_CUT_STEP, season))
        pt = cut_lineage(FE.prediction_table(train, S.WINDOWS, season))
        _, camp, _, model = P.forest_forecast(tt, pt, None)
        based = G.with_baseline_quantiles(camp, model.fallback_roas)
        wm, wb = G.BLEND_WEIGHTS["Low"]
        based = based.select("*", *[(F.lit(wm) * F.col(q) + F.lit(wb) * F.col(f"base_{q}")).alias(f"blend_{q}")
                                    for q in S.REVENUE_Q])
        merged = BT.scored_rows(based, BT.forward_actuals(base, origin, gmax))
        ws.__dict__["backtest_forest"] = cut_lineage(
            BT.metrics(merged, {"model": "revenue", "baseline": "base_revenue", "blend": "blend_revenue"}))
    return ws.__dict__["backtest_forest"]


# ---------------------------------------------------------------------------
# breakdown views
# ---------------------------------------------------------------------------
from ..operators import breakdown as BD  # noqa: E402

BREAKDOWN_SPEC = [("window_days", "int"), ("level", "str"), ("channel", "str"), ("campaign_type", "str"),
                  ("campaign", "str"), ("revenue_p10", "num"), ("revenue_p50", "num"), ("revenue_p90", "num"),
                  ("roas_p50", "num"), ("implied_spend", "dollars"), ("contribution", "num"), ("risk", "str")]
SEARCH_TEXT = "Search"


@register("breakdown", BREAKDOWN_SPEC)
def q_breakdown(spark, sf_dir):
    return BD.breakdown(W(spark, sf_dir).forecast)


@register("breakdown_search", BREAKDOWN_SPEC)
def q_breakdown_search(spark, sf_dir):
    """F5 + F7: the 30-day window, rows matching a free-text query."""
    return BD.search(BD.breakdown(BD.slice_windows(W(spark, sf_dir).forecast, windows=[30])), SEARCH_TEXT)


CONF_SPEC = [("level", "str"), ("channel", "str"), ("campaign_type", "str"), ("campaign", "str"),
             ("window_days", "int"), ("confidence", "str")]


@register("confidence_labels", CONF_SPEC)
def q_confidence_labels(spark, sf_dir):
    """P30 + F6: interval-width confidence of the channel rows."""
    return BD.confidence_label(BD.slice_windows(W(spark, sf_dir).forecast, levels=["channel"]))


@register("confidence_labels_x100", CONF_SPEC)
def q_confidence_labels_x100(spark, sf_dir):
    """P30 on the 100× upload's guarded forecast: the guard fell back at Low
    confidence, so every channel row is Low."""
    out, a = _assess(spark, sf_dir, 100)
    return BD.confidence_label(BD.slice_windows(R.reconcile(out), levels=["channel"]),
                               a.select((F.col("fallback_used") == 1).alias("fallback_used"), "confidence"))


@register("top_campaign_rows", OUT_SPEC)
def q_top_campaign_rows(spark, sf_dir):
    return BD.top_campaign_rows(W(spark, sf_dir).forecast, 10)


@register("output_order", [("position", "int")] + OUT_SPEC)
def q_output_order(spark, sf_dir):
    """Every output row with its position."""
    return R.output_positions(W(spark, sf_dir).forecast)


@register("breakdown_order", [("position", "int")] + BREAKDOWN_SPEC)
def q_breakdown_order(spark, sf_dir):
    """Every breakdown row with its position."""
    return BD.breakdown_order(BD.breakdown(W(spark, sf_dir).forecast))


@register("channel_ranking", [("window_days", "int"), ("rank", "int"), ("channel", "str"), ("revenue_p50", "num"), ("share", "num")])
def q_channel_ranking(spark, sf_dir):
    """Channels by P50."""
    return IN.ranked_channels(W(spark, sf_dir).forecast)


# ---------------------------------------------------------------------------
# branches that the exports above do not take
# ---------------------------------------------------------------------------
from ..operators import base as B  # noqa: E402


@register("feature_store", FEATURE_SPEC)
def q_feature_store(spark, sf_dir):
    """The feature table written by window and read back for one horizon, of which
    only that folder is read."""
    ws = W(spark, sf_dir)
    path = SK.scratch_dir(spark, "feature-store")
    SK.write_parquet(ws.prediction_table, path, ["window_days"])
    return spark.read.schema(ws.prediction_table.schema).parquet(path).where(F.col("window_days") == 60)


@register("predictions_reread", OUT_SPEC)
def q_predictions_reread(spark, sf_dir):
    """The forecast as CSV, read back with blanks kept."""
    path = SK.scratch_dir(spark, "predictions")
    SK.write_csv(W(spark, sf_dir).forecast, path)
    return SK.read_predictions(spark, path)


@register("guard_report", ASSESS_SPEC)
def q_guard_report(spark, sf_dir):
    """The guard's report on the 100 x upload as a JSON side-car, read back."""
    report = _assess(spark, sf_dir, 100)[1]
    path = SK.scratch_dir(spark, "guard-report")
    SK.write_json(report, path)
    return SK.read_json(spark, path, report)


@register("hinted_ingest", LONG_SPEC)
def q_hinted_ingest(spark, sf_dir):
    """Explicit hints go before what the headers tell; here they swap two platforms."""
    google, microsoft, meta = X.exports(spark, sf_dir, W(spark, sf_dir).facts)
    return EX.combine(spark, [(google, "Bing Ads"), (microsoft, "AdWords"), (meta, "Facebook")])


@register("forecast_fallback", OUT_SPEC)
def q_forecast_fallback(spark, sf_dir):
    """Rows of which the model gave a quantile that is no finite number take planned
    budget x the median training ROAS x (0.6, 1, 1.5)."""
    fallback = CA.global_median_roas(W(spark, sf_dir).training_table).first()[0]
    q = G.with_baseline_quantiles(W(spark, sf_dir).prediction_table, 1.0, prefix="m_")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    q = q.withColumn("q10", F.when(F.col("channel") == "microsoft", None).otherwise(F.col("m_revenue_p10"))).withColumn(
        "q50", F.when(F.col("campaign_type") == "Search", nan).otherwise(F.col("m_revenue_p50"))).withColumn(
        "q90", F.when(F.col("window_days") == 90, inf).otherwise(F.col("m_revenue_p90")))
    return R.reconcile(PR.postprocess(q, None, global_roas=fallback))


@register("filled_features", FEATURE_SPEC)
def q_filled_features(spark, sf_dir):
    """Holes filled by the (channel, type) mean (infinite ROAS of one window), the
    channel mean (no value in a type), the overall mean (none in a channel) and 0 (none)."""
    t = W(spark, sf_dir).prediction_table
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    holes = {"tr14_roas": F.when(F.col("window_days") == 60, inf).otherwise(F.col("tr14_roas")),
             "cpc28": F.when(F.col("campaign_type").isin("Shopping", "DPA"), None).otherwise(F.col("cpc28")),
             "tr28_revenue": F.when(F.col("channel") == "meta", nan).otherwise(F.col("tr28_revenue")),
             "trend_index": F.lit(None).cast("double")}
    return FE.fill_defensive(t.select(*[holes[c].alias(c) if c in holes else F.col(c) for c in t.columns]), list(holes))


@register("scenario_unknown_channel", [("scenario_id", "str"), ("channel", "str"), ("budget", "num"), ("revenue", "num"),
                                       ("roas", "num"), ("marginal_roas", "num")])
def q_scenario_unknown_channel(spark, sf_dir):
    """The whole plan moved to a channel without a curve, scored by the mean curve."""
    curves, _, _, scen = _scenarios(spark, sf_dir)
    moved = scen.groupBy("scenario_id").agg(F.sum("budget").alias("budget")).select("scenario_id", F.lit("tiktok").alias("channel"), "budget")
    return CV.score_scenarios(moved, curves)


@register("guard_assess_foreign", ASSESS_SPEC)
def q_guard_assess_foreign(spark, sf_dir):
    """The mixed export without its google rows (one type, a third of the campaigns
    of no known channel) against a profile of the google account alone."""
    ws = W(spark, sf_dir)
    upload = B.staged(EX.load_long(spark, _mixed_dir(spark, sf_dir)).where(F.col("channel") != "google"))
    table = FE.prediction_table(upload, S.WINDOWS, C.seasonal_index(upload))
    profile = cut_lineage(G.training_profile(ws.base.where(F.col("channel") == "google")))
    a = G.run_guardrail(cut_lineage(G.with_baseline_quantiles(table, 1.0, prefix="")), profile)[1]
    return a.select("confidence", "ood_score", F.array_join("reasons", " | ").alias("reasons"), "model_weight",
                    "baseline_weight", "interval_widening", F.col("fallback_used").cast("int").alias("fallback_used"))


def _simulation(spark, sf_dir):
    curves, _, _, scen = _scenarios(spark, sf_dir)
    return CV.score_scenarios(scen, curves)


@register("insight_facts", [("window_days", "int"), ("part", "str"), ("rank", "int"), ("entity", "str"), ("metric", "str"), ("value", "num")])
def q_insight_facts(spark, sf_dir):
    """Every number a claim may cite, with history and budget simulation."""
    return IN.facts(W(spark, sf_dir).forecast, history=QA.dataset_summary(long_of(spark, sf_dir)), simulation=_simulation(spark, sf_dir))


@register("insight_full_context", [("window_days", "int"), ("part", "str"), ("facts", "int"), ("first", "str"), ("last", "str")])
def q_insight_full_context(spark, sf_dir):
    """The parts of every window's context in their order, the warnings of the 100 x
    upload among them."""
    pred = cut_lineage(_scaled_campaign_forecast(spark, sf_dir, 100))
    issues = QA.scale_issues(G.run_guardrail(pred, cut_lineage(_training_profile(spark, sf_dir)))[1])
    ctx = IN.full_context(W(spark, sf_dir).forecast, history=QA.dataset_summary(long_of(spark, sf_dir)),
                          simulation=_simulation(spark, sf_dir), warnings=issues)
    lists = {p: F.transform(p, lambda f: F.concat_ws(":", f["entity"], f["metric"]))
             for p in ("blended", "channels", "campaign_types", "top_campaigns", "historical_summary", "budget_simulation")}
    lists |= {p: F.col(p) for p in ("validation_warnings", "allowed_channels", "allowed_campaigns", "allowed_metrics")}
    each = F.array(*[F.struct(F.lit(p).alias("part"), F.size(c).alias("facts"), F.try_element_at(c, F.lit(1)).alias("first"),
                              F.try_element_at(c, F.lit(-1)).alias("last")) for p, c in lists.items()])
    return ctx.select("window_days", F.inline(each))


@register("answers_parsed", [("level", "str"), ("channel", "str"), ("campaign_type", "str"), ("campaign", "str"), ("window_days", "int"),
                             ("claim", "str"), ("value", "str")])
def q_answers_parsed(spark, sf_dir):
    """Claims read out of raw answers, null where there is no readable object."""
    raw = X.raw_answers(W(spark, sf_dir).forecast)
    return raw.withColumn("_a", IN.extract_json(F.col("raw"), "claim string, value bigint")).select(
        "level", "channel", "campaign_type", "campaign", "window_days", "_a.claim", "_a.value")
