"""Scale guard: in-distribution passes through unchanged, 100x scale triggers
the Low-confidence blend, zero spend is safe, assessment shape is stable."""
import datetime as dt
import json

from pyspark.sql import functions as F

from spendwise import schema as S
from spendwise.operators import guard as G


def _q(a, b, c):
    return {"p10": a, "p50": b, "p90": c}


def _profile(spark, scale=1.0):
    row = {
        "date_min": None, "date_max": None,
        "channels": ["google", "meta", "microsoft"],
        "campaign_types": ["Search", "Shopping", "PerformanceMax"],
        "n_campaigns": 10,
        "monthly_spend": _q(27e3 * scale, 38e3 * scale, 216e3 * scale),
        "monthly_revenue": _q(125e3 * scale, 247e3 * scale, 717e3 * scale),
        "campaign_monthly_spend": _q(56 * scale, 692 * scale, 5252 * scale),
        "campaign_monthly_revenue": _q(0.0, 3720 * scale, 29529 * scale),
        "roas": _q(0.5, 4.0, 7.4),
        "other_channel_share": 0.0,
        "by_channel": None,
    }
    return spark.createDataFrame([row], S.PROFILE_SCHEMA)


def _table(spark, n=6, spend=700.0, roas=4.0, pred_roas=4.0):
    rows = []
    for i in range(n):
        for w in (30, 60, 90):
            b = spend / 30.0 * w
            p50 = b * pred_roas
            rows.append((f"c{i}", "google", "Search", 0, w, dt.date(2026, 6, 6), b,
                         spend * 28 / 30, spend * 14 / 30, spend * 28 / 30 * roas, spend * 14 / 30 * roas,
                         roas, roas, 1.0, p50 * 0.6, p50, p50 * 1.5))
    cols = ("campaign string, channel string, campaign_type string, is_brand int, window_days int, window_start date, "
            "budget_input double, tr28_spend double, tr14_spend double, tr28_revenue double, tr14_revenue double, "
            "tr28_roas double, tr14_roas double, seasonal_index double, revenue_p10 double, revenue_p50 double, "
            "revenue_p90 double")
    return spark.createDataFrame(rows, cols)


def test_in_distribution_is_untouched(spark):
    pred = _table(spark)
    out, a = G.run_guardrail(pred, _profile(spark))
    info = a.first()
    assert info.confidence == "High" and not info.fallback_used
    key = ["campaign", "window_days"]
    got = out.orderBy(*key).select(*S.REVENUE_Q).collect()
    exp = pred.orderBy(*key).select(*S.REVENUE_Q).collect()
    assert got == exp


def test_100x_scale_triggers_low_confidence_blend(spark):
    pred = _table(spark, spend=700.0 * 100, pred_roas=0.03)
    out, a = G.run_guardrail(pred, _profile(spark))
    info = a.first()
    assert info.confidence == "Low" and info.fallback_used
    assert info.model_weight == 0.25 and info.baseline_weight == 0.75
    assert info.warning == G.OOD_WARNING
    assert len(info.reasons) >= 2
    assert info.interval_widening > 1.0 and info.ood_score > 0.6
    rows = out.select("budget_input", *S.REVENUE_Q).collect()
    for r in rows:
        assert 0 <= r.revenue_p10 <= r.revenue_p50 <= r.revenue_p90
        assert r.revenue_p50 / r.budget_input > 1.0


def test_zero_spend_is_safe(spark):
    t = _table(spark, spend=0.0).withColumn("tr28_roas", F.lit(0.0)).withColumn("tr14_roas", F.lit(0.0))
    base = G.with_baseline_quantiles(t, 1.0).select("base_revenue_p10", "base_revenue_p50", "base_revenue_p90").collect()
    for r in base:
        assert all(v is not None and v >= 0 for v in r)


def test_assessment_shape_roundtrip(spark):
    up = G.profile_from_table(_table(spark, spend=70000.0))
    a = G.assess(up, _profile(spark)).first().asDict(recursive=True)
    assert 0.0 <= a["ood_score"] <= 1.0 and a["confidence"] in ("High", "Medium", "Low")
    json.dumps({k: a[k] for k in ("confidence", "ood_score", "reasons", "comparison")})


def test_training_profile_of_long_table(spark):
    from spendwise.plans.workspace import workspace
    from conftest import SF_SMALL

    prof = G.training_profile(workspace(spark, SF_SMALL).long).first()
    assert prof.channels == sorted(prof.channels) and set(prof.channels) <= set(S.CHANNELS)
    assert prof.monthly_spend.p10 <= prof.monthly_spend.p50 <= prof.monthly_spend.p90
    assert set(prof.by_channel) == set(prof.channels)
