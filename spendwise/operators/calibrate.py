"""Interval calibration (A10–A14, M4) on a forward time split.

Takes any calibration frame with the model's quantiles, so it is testable with
a SQL-expressible stand-in model.  The blend weight is picked by WAPE over a
fixed grid in one pass; the width factor has a closed form: each row needs
``f_i = (y − mid)/(hi − mid)`` (or the lower-side twin) to be covered, so the
smallest factor reaching the target coverage is the ⌈target·n⌉-th smallest
``f_i`` — one order-statistic aggregate instead of a 40-step bisection.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quantiles

# FIXED VALUES — blend-weight grid (searched in this order, strict improvement
# only), factor bounds, thresholds.
WEIGHT_GRID = (1.0, 0.85, 0.7, 0.5)
F_MIN, F_MAX = 1.0, 8.0
TARGET_COVERAGE = 0.8
MIN_ROWS, MIN_CAL, MIN_FIT, MIN_WINDOW = 40, 10, 20, 15


def global_median_roas(train: DataFrame, y: str = "target_revenue", budget: str = "budget_input") -> DataFrame:
    """A10: median(clip(y / max(budget, 1e-9), 0, 100)) — one row, by exact
    distributed selection."""
    r = F.least(F.greatest(F.col(y) / F.greatest(F.col(budget), F.lit(1e-9)), F.lit(0.0)), F.lit(100.0))
    return quantiles.select(train.select(r.alias("r")), [], "r", [0.5]).agg(F.max("value").alias("global_median_roas"))


def time_split(rows: DataFrame, ts: str = "window_start") -> DataFrame:
    """cutoff = 0.8 quantile (linear) of the window starts; adds
    ``is_cal`` (start > cutoff) and the split counts."""
    d = F.unix_date(F.col(ts))
    stats = rows.agg(
        F.percentile(d, 0.8).alias("_cut"),
        F.count("*").alias("_n"),
    )
    x = rows.crossJoin(F.broadcast(stats)).withColumn("is_cal", d > F.col("_cut"))
    counts = x.agg(F.sum(F.col("is_cal").cast("int")).alias("_ncal"), F.sum((~F.col("is_cal")).cast("int")).alias("_nfit"))
    return x.crossJoin(F.broadcast(counts))


def _pick_weight(den: Column, wapes: dict) -> Column:
    best_w, best = F.lit(WEIGHT_GRID[0]), wapes[WEIGHT_GRID[0]]
    for w in WEIGHT_GRID[1:]:
        better = wapes[w] < best - 1e-9
        best_w = F.when(better, F.lit(w)).otherwise(best_w)
        best = F.when(better, wapes[w]).otherwise(best)
    return best_w


def required_factor(y: Column, lo: Column, mid: Column, hi: Column) -> Column:
    """Smallest f covering y in [mid − f(mid − lo), mid + f(hi − mid)]."""
    inf = F.lit(float("inf"))
    up = F.when(hi > mid, (y - mid) / (hi - mid)).otherwise(inf)
    dn = F.when(mid > lo, (mid - y) / (mid - lo)).otherwise(inf)
    return F.when(y == mid, F.lit(0.0)).when(y > mid, up).otherwise(dn)


def calibrate(rows: DataFrame, target: float = TARGET_COVERAGE, y="y", lo="lo", mid="mid", hi="hi", base="base") -> DataFrame:
    """M4: rows with window_days, window_start, y and the model quantiles plus
    the seasonal baseline → one row per window (0 = pooled) with
    ``blend_weight``, ``width_factor`` and the calibration row count."""
    x = time_split(rows)
    ok = (F.col("_n") >= MIN_ROWS) & (F.col("_ncal") >= MIN_CAL) & (F.col("_nfit") >= MIN_FIT)
    cal = x.where(F.col("is_cal")).select(
        F.explode(F.array(F.lit(0), F.col("window_days"))).alias("grp"),
        F.col(y).cast("double").alias("y"), F.col(lo).alias("lo"), F.col(mid).alias("mid"), F.col(hi).alias("hi"),
        F.col(base).alias("base"),
    )
    wapes = {w: F.sum(F.abs(F.col("y") - (F.lit(w) * F.col("mid") + F.lit(1.0 - w) * F.col("base")))) for w in WEIGHT_GRID}
    agg = cal.groupBy("grp").agg(
        F.count("*").alias("n_cal"),
        F.sum(F.abs("y")).alias("_den"),
        *[v.alias(f"_w{i}") for i, v in enumerate(wapes.values())],
    )
    den = F.when(F.col("_den") > 0, F.col("_den")).otherwise(F.lit(1.0))
    weights = agg.select("grp", "n_cal", _pick_weight(den, {w: F.col(f"_w{i}") / den for i, w in enumerate(WEIGHT_GRID)}).alias("bw"))
    # weights has one row per window + pooled: broadcast-safe
    g = cal.join(F.broadcast(weights), "grp")
    mid_b = F.col("bw") * F.col("mid") + (F.lit(1.0) - F.col("bw")) * F.col("base")
    g = g.withColumn("mid_b", mid_b).withColumn("lo_b", F.least("lo", "mid_b")).withColumn("hi_b", F.greatest("hi", "mid_b"))
    g = g.withColumn("f_req", required_factor(F.col("y"), F.col("lo_b"), F.col("mid_b"), F.col("hi_b")))
    fac = quantiles.select(g, ["grp"], "f_req", [target], how="order").select("grp", F.col("value").alias("_f"))
    f_c = F.when(F.col("_f") > F_MAX, F.lit(F_MAX)).otherwise(F.greatest(F.col("_f"), F.lit(F_MIN)))
    per = weights.join(fac, "grp").select("grp", "n_cal", F.col("bw").alias("blend_weight"), f_c.alias("width_factor"))
    pooled = per.where(F.col("grp") == 0).select(F.col("blend_weight").alias("_pw"), F.col("width_factor").alias("_pf"))
    gate = x.select(ok.alias("_ok")).limit(1)
    out = per.crossJoin(F.broadcast(pooled)).crossJoin(F.broadcast(gate))
    thin = (F.col("grp") != 0) & (F.col("n_cal") < MIN_WINDOW)
    return out.select(
        F.col("grp").cast("int").alias("window_days"),
        "n_cal",
        F.when(~F.col("_ok"), F.lit(1.0)).when(thin, F.col("_pw")).otherwise(F.col("blend_weight")).alias("blend_weight"),
        F.when(~F.col("_ok"), F.lit(1.0)).when(thin, F.col("_pf")).otherwise(F.col("width_factor")).alias("width_factor"),
    )
