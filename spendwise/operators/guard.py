"""Out-of-distribution scale guard (G1–G10) and the trailing-ROAS baselines.

Profiles are one-row DataFrames (nested structs), the assessment is a one-row
DataFrame built from a cross join of two one-row frames, and the blend joins
that row back with a broadcast — nothing is collected to the driver.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..session import scratch_table
from . import quantiles
from .base import row_count

# FIXED VALUES — blend weights per confidence bucket (model, baseline), scale
# trigger, signal weights, baseline band and the OOD warning text.
BLEND_WEIGHTS = {"High": (1.0, 0.0), "Medium": (0.6, 0.4), "Low": (0.25, 0.75)}
SCALE_TRIGGER = 5.0
SCALE_SIGNALS = (
    ("monthly_revenue", 0.25),
    ("monthly_spend", 0.25),
    ("campaign_monthly_revenue", 0.15),
    ("campaign_monthly_spend", 0.15),
)
BASELINE_BAND = (0.55, 1.0, 1.65)
OOD_WARNING = (
    "This dataset is outside the training scale used for calibration. "
    "Forecast confidence is low. ROAS estimates are blended with a historical "
    "ROAS baseline to avoid over-trusting the trained model."
)

_PROBS = [0.1, 0.5, 0.9]


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _values(name: str, df: DataFrame, columns: dict[str, Column], channel: Column | None = None) -> DataFrame:
    """(name, channel, v) rows: each of ``columns`` as a sample of its own."""
    of = F.lit(None).cast("string") if channel is None else channel
    pairs = [F.struct(F.lit(f"{name}{k}").alias("name"), of.alias("channel"), c.cast("double").alias("v")) for k, c in columns.items()]
    return df.select(F.explode(F.array(*pairs)).alias("s")).select("s.*").where(finite(F.col("v")))


def _three(found: DataFrame, name: str) -> Column:
    """A5: P10/P50/P90 of one sample among ``found`` as a struct; an empty one gives zeros."""
    return F.struct(*[F.coalesce(F.max(F.when((F.col("name") == name) & (F.col("i") == i), F.col("value"))), F.lit(0.0)).alias(f"p{int(p * 100)}")
                      for i, p in enumerate(_PROBS)]).alias(name.removeprefix("channel_"))


# ---------------------------------------------------------------------------
# G1 / G2 profiles
# ---------------------------------------------------------------------------


def training_profile(long: DataFrame) -> DataFrame:
    """G1: distribution profile of a long table, one row (PROFILE_SCHEMA).

    The fact is read once, into sums by (channel, type, campaign, month); everything
    else derives from those.  All quantiles are one exact selection (A5, A7)."""
    spark = long.sparkSession
    base = scratch_table(spark, long.withColumn("month", F.date_format("date", "yyyy-MM"))
                         .groupBy("channel", "campaign_type", "campaign", "month").agg(
                             F.sum("spend").alias("spend"), F.sum("revenue").alias("revenue"), F.sum(row_count(long)).alias("rows"),
                             F.min("date").alias("first"), F.max("date").alias("last")), "profile-base")
    sums = lambda *keys: base.groupBy(*keys).agg(F.sum("spend").alias("spend"), F.sum("revenue").alias("revenue"))
    both = {"spend": F.col("spend"), "revenue": F.col("revenue")}
    ratio = F.least(F.greatest(_ratio_raw("revenue", "spend"), F.lit(0.0)), F.lit(S.ROAS_CAP))
    values = (_values("monthly_", sums("month"), both)
              .unionByName(_values("campaign_monthly_", sums("campaign", "month").where("spend > 0"), both))
              .unionByName(_values("", sums("campaign").where("spend > 0"), {"roas": ratio}))
              .unionByName(_values("channel_monthly_", sums("channel", "month"), both, F.col("channel"))))
    found = scratch_table(spark, quantiles.select(values, ["name", "channel"], "v", _PROBS), "profile-quantiles")
    by_ch = (sums("channel").select("channel", F.when(F.col("spend") > 0, ratio).otherwise(0.0).alias("roas"))
             .join(found.where(F.col("name").startswith("channel_")).groupBy("channel").agg(
                 _three(found, "channel_monthly_spend"), _three(found, "channel_monthly_revenue")), "channel")
             .agg(F.map_from_entries(F.collect_list(F.struct("channel", F.struct("monthly_spend", "monthly_revenue", "roas")))).alias("by_channel")))
    known = F.when(F.col("channel").isNotNull(), F.col("rows"))
    overall = base.agg(
        F.date_format(F.min("first"), "yyyy-MM-dd").alias("date_min"),
        F.date_format(F.max("last"), "yyyy-MM-dd").alias("date_max"),
        F.sort_array(F.collect_set("channel")).alias("channels"),
        F.sort_array(F.collect_set("campaign_type")).alias("campaign_types"),
        F.count_distinct("campaign").alias("n_campaigns"),
        F.try_divide(F.sum(F.when(F.col("channel") == "other", F.col("rows")).otherwise(0)).cast("double"), F.sum(known)).alias("other_channel_share"),
    )
    q = found.agg(*[_three(found, n) for n in ("monthly_spend", "monthly_revenue", "campaign_monthly_spend", "campaign_monthly_revenue", "roas")])
    return overall.crossJoin(q).crossJoin(by_ch).select(*[f.name for f in S.PROFILE_SCHEMA.fields])


def _ratio_raw(num: str, den: str) -> Column:
    return F.try_divide(F.col(num).cast("double"), F.col(den).cast("double"))


def profile_from_table(table: DataFrame) -> DataFrame:
    """The same profile shape from a prediction feature table — smallest
    window only, tr28 sums scaled to a 30-day month; the monthly P50 is the
    *total* over campaigns; quantiles over active campaigns."""
    wmin = table.agg(F.min("window_days").alias("_w"))
    t = table.crossJoin(F.broadcast(wmin)).where(F.col("window_days") == F.col("_w"))
    k = 30.0 / 28.0
    t = scratch_table(table.sparkSession, t.select(
        "channel", "campaign_type",
        (F.col("tr28_spend") * k).alias("s"),
        (F.col("tr28_revenue") * k).alias("r"),
    ), "profile-rows")
    roas = F.least(F.greatest(F.coalesce(F.try_divide(F.col("r"), F.col("s")), F.lit(0.0)), F.lit(0.0)), F.lit(S.ROAS_CAP))
    zero = F.lit(0.0)
    values = _values("", t.where("s > 0"), {"campaign_monthly_spend": F.col("s"), "campaign_monthly_revenue": F.col("r"), "roas": roas})
    found = quantiles.select(values, ["name", "channel"], "v", _PROBS)
    q = found.agg(*[_three(found, n) for n in ("campaign_monthly_spend", "campaign_monthly_revenue", "roas")])
    one = t.agg(
        F.lit(None).cast("string").alias("date_min"),
        F.lit(None).cast("string").alias("date_max"),
        F.sort_array(F.collect_set("channel")).alias("channels"),
        F.sort_array(F.collect_set("campaign_type")).alias("campaign_types"),
        F.count("*").alias("n_campaigns"),
        F.struct(zero.alias("p10"), F.sum("s").alias("p50"), zero.alias("p90")).alias("monthly_spend"),
        F.struct(zero.alias("p10"), F.sum("r").alias("p50"), zero.alias("p90")).alias("monthly_revenue"),
        F.avg((F.col("channel") == "other").cast("double")).alias("other_channel_share"),
        F.lit(None).cast(S.PROFILE_SCHEMA["by_channel"].dataType).alias("by_channel"),
    )
    return one.crossJoin(q).select(*[f.name for f in S.PROFILE_SCHEMA.fields])


def load_profile(spark, path: str) -> DataFrame | None:
    """Profile side-car; missing or corrupt → None (guard disabled)."""
    try:
        df = spark.read.schema(S.PROFILE_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:  # no such path
        return None
    return df if df.where("n_campaigns IS NOT NULL").head(1) else None


def save_profile(profile: DataFrame, path: str) -> None:
    profile.coalesce(1).write.mode("overwrite").json(path)


# ---------------------------------------------------------------------------
# G3–G7a assessment
# ---------------------------------------------------------------------------


def _ratio(up: Column, train: Column) -> Column:
    up = F.coalesce(up.cast("double"), F.lit(0.0))
    train = F.coalesce(train.cast("double"), F.lit(0.0))
    return F.when(train <= 0, F.when(up > 0, F.lit(float("inf"))).otherwise(F.lit(1.0))).otherwise(up / train)


def _fmt1(x: Column) -> Column:
    return F.when(x == float("inf"), F.lit("inf")).otherwise(F.format_number(x, 1))


def assess(upload: DataFrame, training: DataFrame, divergence: DataFrame | None = None) -> DataFrame:
    """One-row assessment: confidence, ood_score, reasons, comparison.

    ``divergence`` is a one-row frame with column ``divergence`` (model total
    P50 ÷ baseline total P50, null when the baseline total is ≤ 0)."""
    up = upload.select(F.struct(*upload.columns).alias("up"))
    tr = training.select(F.struct(*training.columns).alias("tr"))
    x = up.crossJoin(tr)
    if divergence is not None:
        x = x.crossJoin(divergence.select("divergence"))
    else:
        x = x.withColumn("divergence", F.lit(None).cast("double"))

    parts, reasons, comp = [], [], []
    for name, weight in SCALE_SIGNALS:
        u = F.col(f"up.{name}.p50")
        r90 = _ratio(u, F.col(f"tr.{name}.p90"))
        r50 = _ratio(u, F.col(f"tr.{name}.p50"))
        fires = (r90 > SCALE_TRIGGER) | ((r50 > SCALE_TRIGGER) & (r90 > 1.0))
        sev = F.least(F.lit(1.0), F.lit(0.5) + F.greatest(r90 / 25.0, r50 / 50.0))
        parts.append(F.when(fires, F.lit(weight) * sev).otherwise(F.lit(0.0)))
        label = name.replace("_", " ")
        reasons.append(F.when(fires, F.concat(F.lit(f"Uploaded {label} is "), _fmt1(r50), F.lit("x higher than the training median"))))
        comp.append(
            F.struct(
                F.coalesce(u, F.lit(0.0)).alias("uploaded_p50"),
                F.coalesce(F.col(f"tr.{name}.p50"), F.lit(0.0)).alias("training_p50"),
                F.coalesce(F.col(f"tr.{name}.p90"), F.lit(0.0)).alias("training_p90"),
                F.when(r50 != float("inf"), F.round(r50, 2)).alias("ratio_vs_training_median"),
            ).alias(name)
        )

    # Median campaign ROAS far outside [p10/3, 3·p90]
    up_roas = F.coalesce(F.col("up.roas.p50"), F.lit(0.0))
    t10, t90 = F.coalesce(F.col("tr.roas.p10"), F.lit(0.0)), F.coalesce(F.col("tr.roas.p90"), F.lit(0.0))
    lo, hi = t10 / 3.0, t90 * 3.0
    roas_out = (hi > 0) & (up_roas > 0) & ~((lo <= up_roas) & (up_roas <= hi))
    parts.append(F.when(roas_out, F.lit(0.15)).otherwise(F.lit(0.0)))
    reasons.append(F.when(roas_out, F.format_string(
        "Uploaded median campaign ROAS (%.2fx) is far outside the training range (%.2fx-%.2fx)", up_roas, t10, t90)))
    comp.append(F.struct(F.round(up_roas, 3).alias("uploaded"), F.array(t10, t90).alias("training_range_p10_p90")).alias("roas_p50"))

    # Unseen campaign types
    up_t = F.coalesce(F.col("up.campaign_types"), F.array().cast("array<string>"))
    tr_t = F.coalesce(F.col("tr.campaign_types"), F.array().cast("array<string>"))
    unseen = F.array_sort(F.array_except(up_t, tr_t))
    both = (F.size(tr_t) > 0) & (F.size(up_t) > 0)
    share = F.size(unseen) / F.size(up_t)
    t_fire = both & (share > 0.3)
    parts.append(F.when(t_fire, F.lit(0.10)).otherwise(F.lit(0.0)))
    reasons.append(F.when(t_fire, F.format_string("%d/%d campaign types were never seen in training", F.size(unseen), F.size(up_t))))
    comp.append(F.when(both, unseen).alias("unseen_campaign_types"))

    # Rows in channel "other"
    other = F.coalesce(F.col("up.other_channel_share"), F.lit(0.0))
    o_fire = other > 0.20
    parts.append(F.when(o_fire, F.lit(0.10)).otherwise(F.lit(0.0)))
    reasons.append(F.when(o_fire, F.concat(F.format_number(other * 100, 0), F.lit("% of rows could not be mapped to a known channel"))))
    comp.append(F.round(other, 3).alias("other_channel_share"))

    # Model vs baseline divergence
    dv = F.col("divergence")
    dv_ok = finite(dv) & (dv > 0)
    d_fire = dv_ok & ((dv < 1.0 / 3.0) | (dv > 3.0))
    gap = F.when(dv < 1, (F.lit(1.0 / 3.0)) / dv).otherwise(dv / 3.0)
    parts.append(F.when(d_fire, F.lit(0.40) * F.least(F.lit(1.0), gap / 5.0)).otherwise(F.lit(0.0)))
    reasons.append(F.when(d_fire, F.concat(
        F.lit("Model P50 revenue diverges from the trailing-ROAS baseline by "),
        F.format_number(F.when(dv < 1, F.lit(1.0) / dv).otherwise(dv), 1),
        F.lit("x — symptomatic of out-of-scale inputs"))))
    comp.append(F.when(dv_ok, F.round(dv, 4)).alias("model_vs_baseline_p50"))

    total = parts[0]
    for p in parts[1:]:
        total = total + p
    score = F.least(F.lit(1.0), total)
    conf = F.when(score < 0.30, "High").when(score < 0.60, "Medium").otherwise("Low")
    out = x.select(
        conf.alias("confidence"),
        F.bround(score, 3).alias("ood_score"),
        F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias("reasons"),
        F.struct(*comp).alias("comparison"),
    )
    wm = F.when(F.col("confidence") == "High", BLEND_WEIGHTS["High"][0]).when(
        F.col("confidence") == "Medium", BLEND_WEIGHTS["Medium"][0]).otherwise(BLEND_WEIGHTS["Low"][0])
    wb = F.when(F.col("confidence") == "High", BLEND_WEIGHTS["High"][1]).when(
        F.col("confidence") == "Medium", BLEND_WEIGHTS["Medium"][1]).otherwise(BLEND_WEIGHTS["Low"][1])
    return out.select(
        "*",
        wm.alias("model_weight"),
        wb.alias("baseline_weight"),
        (wb > 0).alias("fallback_used"),
        F.when(wb > 0, F.bround(F.lit(1.0) + F.col("ood_score"), 3)).otherwise(F.lit(1.0)).alias("interval_widening"),
        F.when(F.col("confidence") == "Low", F.lit(OOD_WARNING)).alias("warning"),
    )


# ---------------------------------------------------------------------------
# baselines
# ---------------------------------------------------------------------------


def seasonal_roas_baseline(table: DataFrame) -> Column:
    """M6: ROAS(28d, else 14d) × planned spend × seasonal index, ≥ 0."""
    r = F.when(F.col("tr28_roas") > 0, F.col("tr28_roas")).otherwise(F.col("tr14_roas"))
    return F.greatest(r * F.greatest(F.col("budget_input"), F.lit(0.0)) * F.col("seasonal_index"), F.lit(0.0))


def with_baseline_quantiles(table: DataFrame, fallback_roas: Column | float = 1.0, prefix: str = "base_") -> DataFrame:
    """Trailing-ROAS baseline quantiles.  ROAS 28d → 14d → channel
    aggregate (over all the table's rows) → fallback, capped at 100.

    The channel aggregate is a grouped aggregation broadcast back: its size is
    bounded by the channel vocabulary, unlike a window over a hot channel."""
    ch = table.groupBy("channel").agg(
        F.sum("tr28_revenue").alias("_chr"), F.sum("tr28_spend").alias("_chs")
    ).select("channel", F.when(F.col("_chs") > 0, F.col("_chr") / F.col("_chs")).otherwise(0.0).alias("_ch_roas"))
    t = table.join(F.broadcast(ch), "channel", "left")
    fb = fallback_roas if isinstance(fallback_roas, Column) else F.lit(float(fallback_roas))
    r = F.when(F.col("tr28_roas") > 0, F.col("tr28_roas")).otherwise(F.col("tr14_roas"))
    r = F.when(r > 0, r).otherwise(F.coalesce(F.col("_ch_roas"), F.lit(0.0)))
    r = F.when(r > 0, r).otherwise(fb)
    r = F.least(F.greatest(r, F.lit(0.0)), F.lit(S.ROAS_CAP))
    p50 = F.greatest(r * F.greatest(F.col("budget_input"), F.lit(0.0)) * F.col("seasonal_index"), F.lit(0.0))
    t = t.withColumn("_bp50", p50)
    return t.select(
        *table.columns,
        *[(F.col("_bp50") * m).alias(f"{prefix}{q}") for m, q in zip(BASELINE_BAND, S.REVENUE_Q)],
    )


def sort3(a: Column, b: Column, c: Column) -> list[Column]:
    """Clip at 0, non-finite → 0, then sort the triple row-wise."""
    def clean(x):
        return F.when(finite(x), F.greatest(x, F.lit(0.0))).otherwise(F.lit(0.0))

    arr = F.array_sort(F.array(clean(a), clean(b), clean(c)))
    return [arr[0], arr[1], arr[2]]


def apply_guardrail(pred: DataFrame, assessment: DataFrame, base_prefix: str = "base_") -> DataFrame:
    """Blend model and baseline quantiles by the confidence weights, widen
    the interval by 1 + score, clip and sort.  High confidence leaves the
    model quantiles untouched."""
    a = assessment.select("model_weight", "baseline_weight", "ood_score")
    x = pred.crossJoin(F.broadcast(a))
    wm, wb = F.col("model_weight"), F.col("baseline_weight")
    lo, mid, hi = [wm * F.col(q) + wb * F.col(f"{base_prefix}{q}") for q in S.REVENUE_Q]
    widen = F.lit(1.0) + F.col("ood_score")
    lo2, hi2 = mid - widen * (mid - lo), mid + widen * (hi - mid)
    s = sort3(lo2, mid, hi2)
    keep = [c for c in pred.columns if c not in S.REVENUE_Q]
    return x.select(
        *keep,
        *[F.when(wb > 0, s[i]).otherwise(F.col(q)).alias(q) for i, q in enumerate(S.REVENUE_Q)],
    ).select(*pred.columns)


def run_guardrail(pred: DataFrame, training: DataFrame, fallback_roas: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Baseline → divergence → assess → blend, as one lazy plan.
    ``pred`` is the prediction table with model revenue quantiles."""
    based = with_baseline_quantiles(pred, fallback_roas)
    div = based.agg(F.sum("revenue_p50").alias("_m"), F.sum("base_revenue_p50").alias("_b")).select(
        F.when(F.col("_b") > 0, F.col("_m") / F.col("_b")).alias("divergence")
    )
    assessment = assess(profile_from_table(pred), training, div)
    out = apply_guardrail(based, assessment).select(*pred.columns)
    return out, assessment
