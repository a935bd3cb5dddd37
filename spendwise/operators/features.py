"""Feature tables: prediction rows at the origin (M2) and the time-aware
training table (M1) built on a pruned spine (W1–W6, J3, J6, F1, F2).

Trailing and forward sums are differences of running sums: one running window per
campaign over its days and, for each cut, a probe row at every offset that some
sum starts or ends at.  A probe reads the sums up to its day, so a row costs the
same whatever the span, and nothing is densified.  A campaign has at most one
daily row per day, so a window partition is bounded by the history length (plus
its probes) however skewed the raw rows were.  Both tables read the staged base
(operators.base), the fact once.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from . import base as B
from . import calendar as C
from . import daily as D

_SUMMED = {"revenue": "revenue", "spend": "spend", "conversions": "conversions", "clicks": "clicks", "impr": "impressions"}


# ---------------------------------------------------------------------------
# scalar guards
# ---------------------------------------------------------------------------


def safe_div(a: Column, b: Column, cap: float | None = None) -> Column:
    """a / b, 0 when b ≤ 0 or null, clipped to [0, cap]."""
    a, b = a.cast("double"), b.cast("double")
    v = F.greatest(F.try_divide(a, b), F.lit(0.0))
    if cap is not None:
        v = F.least(v, F.lit(float(cap)))
    return F.when(b > 0, F.coalesce(v, F.lit(0.0))).otherwise(F.lit(0.0))


def growth(now: Column, prev: Column, lo: float = -1.0, hi: float = 5.0) -> Column:
    now, prev = now.cast("double"), prev.cast("double")
    g = F.least(F.greatest((now - prev) / prev, F.lit(lo)), F.lit(hi))
    return F.when(prev > 0, g).otherwise(F.lit(0.0))


def budget_input(rate: Column, window_days: Column, future_spend: Column | None = None) -> Column:
    extrapolated = F.greatest(rate, F.lit(0.0)) * window_days
    if future_spend is None:
        return extrapolated
    fs = future_spend.cast("double")
    finite = fs.isNotNull() & ~F.isnan(fs) & (F.abs(fs) != float("inf"))
    return F.when(finite, F.greatest(fs, F.lit(0.0))).otherwise(extrapolated)


def trailing_features(c) -> list[Column]:
    """Feature columns from the trailing sums ``c(name)``: tr14_*/tr28_* sums,
    ratios, growth, daily rate and active days."""
    out = []
    for span in (14, 28):
        for short in ("revenue", "spend", "conversions", "clicks", "impr"):
            out.append(c(f"tr{span}_{short}").cast("double").alias(f"tr{span}_{short}"))
    for span in (14, 28):
        out.append(safe_div(c(f"tr{span}_revenue"), c(f"tr{span}_spend"), 100.0).alias(f"tr{span}_roas"))
    for span in (14, 28):
        out += [
            safe_div(c(f"tr{span}_clicks"), c(f"tr{span}_impr"), 1.0).alias(f"ctr{span}"),
            safe_div(c(f"tr{span}_conversions"), c(f"tr{span}_clicks"), 1.0).alias(f"cvr{span}"),
            safe_div(c(f"tr{span}_spend"), c(f"tr{span}_clicks"), 1000.0).alias(f"cpc{span}"),
        ]
    out += [
        growth(c("last7_revenue"), c("prev7_revenue")).alias("rev_growth_wow"),
        growth(c("tr28_revenue"), c("prev28_revenue")).alias("rev_growth_mom"),
        growth(c("last7_spend"), c("prev7_spend")).alias("spend_growth_wow"),
        growth(c("tr28_spend"), c("prev28_spend")).alias("spend_growth_mom"),
        (c("tr28_spend").cast("double") / F.lit(float(S.TRAIL_LONG))).alias("daily_spend_rate"),
        F.coalesce(c("active28"), F.lit(0)).cast("double").alias("active_days"),
    ]
    return out


# sums over (lo, hi) day offsets relative to the cut
FRAMES = {
    "tr14": (-13, 0),
    "tr28": (-27, 0),
    "last7": (-6, 0),
    "prev7": (-13, -7),
    "prev28": (-55, -28),
}


def _windows_df(spark, windows) -> DataFrame:
    return spark.createDataFrame([(int(w),) for w in windows], "window_days int")


def _feature_select(windowed: DataFrame, extra: list[Column]) -> DataFrame:
    c = F.col
    return windowed.select(*extra, *trailing_features(c))


def _finish(rows: DataFrame, budget: Column, extra=()) -> DataFrame:
    """Order columns: identity, window_start, NUMERIC_FEATURES, extras."""
    rows = rows.withColumn("budget_input", budget)
    numeric = [F.col(n).cast("double").alias(n) if n != "window_days" else F.col(n) for n in S.NUMERIC_FEATURES]
    return rows.select("channel", "campaign_type", "campaign", "is_brand", "window_start", *numeric, *extra)


# ---------------------------------------------------------------------------
# M2: prediction table at the last observed date
# ---------------------------------------------------------------------------


def prediction_table(long: DataFrame, windows=S.WINDOWS, season: DataFrame | None = None) -> DataFrame:
    """One row per (campaign, window) with features as of gmax; every campaign
    is kept.  A single conditional aggregation per campaign — no window."""
    spark = long.sparkSession
    long = B.staged(long)
    d = D.daily(long)
    b = D.bounds(long)
    x = D.with_bounds(d, b).withColumn("age", F.datediff("gmax", "date"))

    def tsum(col, lo, hi):
        return F.sum(F.when(F.col("age").between(-hi, -lo), F.col(col)))

    aggs = []
    for name, (lo, hi) in FRAMES.items():
        for short, col in _SUMMED.items():
            if name in ("last7", "prev7", "prev28") and short not in ("revenue", "spend"):
                continue
            aggs.append(tsum(col, lo, hi).alias(f"{name}_{short}"))
    aggs.append(F.sum(F.when((F.col("age") <= 27) & (F.col("spend") > 0), 1).otherwise(0)).alias("active28"))
    sums = x.groupBy("campaign", "gmin", "gmax").agg(*aggs)
    zero_filled = sums.select(
        "campaign", "gmin", "gmax",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in sums.columns if c not in ("campaign", "gmin", "gmax")],
    )
    feats = _feature_select(zero_filled, [F.col("campaign"), F.col("gmin"), F.col("gmax")])
    attrs = D.campaign_attrs(long)
    cal = C.window_calendar(
        b.select(F.col("gmax").alias("ts"), "gmin"), _windows_df(spark, windows), F.col("gmin"), season
    )
    if season is None:
        cal = cal.drop("seasonal_index").withColumn("seasonal_index", F.lit(1.0))
    rows = (
        feats.join(attrs, "campaign")
        .join(F.broadcast(cal), F.col("gmax") == F.col("ts"))
    )
    return _finish(rows, budget_input(F.col("daily_spend_rate"), F.col("window_days")))


# ---------------------------------------------------------------------------
# M1: training table on the pruned spine
# ---------------------------------------------------------------------------


def cut_bounds(b: DataFrame, windows=S.WINDOWS, cut_step: int = S.TRAIN_CUT_STEP) -> DataFrame:
    """first/last cut dates from the one-row bounds, with the
    short-history fallback; adds ``n_cuts``."""
    wmax, wmin = max(windows), min(windows)
    first0 = F.date_add("gmin", 2 * S.TRAIL_LONG)
    last0 = F.date_sub("gmax", wmax)
    short = last0 <= first0
    first = F.when(short, F.date_add("gmin", S.TRAIL_LONG)).otherwise(first0)
    last = F.when(short, F.greatest(F.date_add("gmin", S.TRAIL_LONG), F.date_sub("gmax", wmin))).otherwise(last0)
    out = b.select("gmin", "gmax", first.alias("first_cut"), last.alias("last_cut"))
    return out.withColumn("k_max", F.floor(F.datediff("last_cut", "first_cut") / cut_step).cast("int"))


def cut_dates(cb: DataFrame, cut_step: int = S.TRAIN_CUT_STEP) -> DataFrame:
    """Every cut date ``first_cut + k·step`` (k = 0..k_max) with the bounds."""
    ks = cb.select("gmin", "first_cut", F.explode(F.sequence(F.lit(0), F.col("k_max"))).alias("k"))
    return ks.select("gmin", F.date_add("first_cut", F.col("k") * cut_step).alias("ts"))


def spans(d: DataFrame, cuts: DataFrame, windows=S.WINDOWS) -> DataFrame:
    """For every row of ``cuts(campaign, date)`` the sums over FRAMES and the
    forward windows of the daily series ``d``: (campaign, ts, <frame>_<metric>...,
    active28, fwd_revenue_<w>, fwd_spend_<w>).

    A sum over offsets (lo, hi) is the running sum at hi less that at lo - 1."""
    wanted = {f"{name}_{short}": (col, lo, hi) for name, (lo, hi) in FRAMES.items() for short, col in _SUMMED.items()
              if name in ("tr14", "tr28") or short in ("revenue", "spend")}
    wanted["active28"] = ("active", 1 - S.TRAIL_LONG, 0)
    for w in windows:
        wanted[f"fwd_revenue_{w}"] = ("revenue", 1, w)
        wanted[f"fwd_spend_{w}"] = ("spend", 1, w)
    points = sorted({(col, at) for col, lo, hi in wanted.values() for at in (lo - 1, hi)})
    offsets = sorted({at for _, at in points})
    summed = (*S.METRICS, "active")
    days = d.select("campaign", F.unix_date("date").alias("day"), *[F.col(m).cast(S.MONEY).alias(m) for m in S.METRICS],
                    (F.col("spend") > 0).cast("long").alias("active"), F.lit(None).cast("int").alias("cut"), F.lit(None).cast("int").alias("at"))
    probes = cuts.select("campaign", F.unix_date("date").alias("cut"), F.explode(F.array(*[F.lit(o) for o in offsets])).alias("at"))
    probes = probes.select("campaign", (F.col("cut") + F.col("at")).alias("day"), *[F.lit(0).cast(S.MONEY).alias(m) for m in S.METRICS],
                           F.lit(0).cast("long").alias("active"), "cut", "at")
    upto = Window.partitionBy("campaign").orderBy("day", F.col("at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    running = days.unionByName(probes).select("campaign", "cut", "at", *[F.sum(m).over(upto).alias(m) for m in summed]).where("at IS NOT NULL")
    read = running.groupBy("campaign", "cut").agg(*[F.max(F.when(F.col("at") == at, F.col(m))).alias(f"{m}@{at}") for m, at in points])
    return read.select("campaign", F.date_from_unix_date("cut").alias("ts"),
                       *[(F.col(f"`{m}@{hi}`") - F.col(f"`{m}@{lo - 1}`")).alias(name) for name, (m, lo, hi) in wanted.items()])


def training_table(long: DataFrame, windows=S.WINDOWS, cut_step: int = S.TRAIN_CUT_STEP, season: DataFrame | None = None) -> DataFrame:
    """Rows = active (campaign, cut) pairs × windows that fit in history.

    Columns: the prediction-table layout with ``budget_input`` = realised spend
    over the target window (fit regime), plus ``budget_input_ex`` (trailing rate
    × window, the predict regime), ``target_revenue`` and ``target_spend``."""
    spark = long.sparkSession
    windows = tuple(int(w) for w in windows)
    long = B.staged(long)
    d = D.daily(long)
    b = D.bounds(long)
    cb = cut_bounds(b, windows, cut_step)

    # spine: the cuts each positive-spend day falls into (ts in [date, date+27])
    pos = D.with_bounds(d.where(F.col("spend") > 0).select("campaign", "date"), cb.select("first_cut", "k_max"))
    off = F.datediff("date", "first_cut")
    kmin = F.greatest(F.lit(0), F.ceil(off / cut_step).cast("int"))
    kmax = F.least(F.col("k_max"), F.floor((off + (S.TRAIL_LONG - 1)) / cut_step).cast("int"))
    spine = (
        pos.where(kmin <= kmax)
        .select("campaign", "first_cut", F.explode(F.sequence(kmin, kmax)).alias("k"))
        .select("campaign", F.date_add("first_cut", F.col("k") * cut_step).alias("date"))
        .distinct()
    )
    win = spans(d, spine, windows).where(F.col("tr28_spend") > 0)
    win = D.with_bounds(win, b)
    feats = win.select(
        "campaign", "gmin", "gmax", "ts",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in win.columns if c not in ("campaign", "gmin", "gmax", "ts")],
    )
    wdf = _windows_df(spark, windows)
    rows = feats.crossJoin(F.broadcast(wdf)).where(F.date_add("ts", F.col("window_days")) <= F.col("gmax"))

    def pick(prefix):
        e = None
        for wd in windows:
            cond = F.col("window_days") == wd
            e = F.when(cond, F.col(f"{prefix}_{wd}")) if e is None else e.when(cond, F.col(f"{prefix}_{wd}"))
        return e

    rows = rows.withColumn("target_revenue", F.greatest(pick("fwd_revenue").cast("double"), F.lit(0.0))).withColumn(
        "target_spend", F.greatest(pick("fwd_spend").cast("double"), F.lit(0.0))
    )
    feat_cols = trailing_features(F.col)
    rows = rows.select("campaign", "ts", "gmin", "window_days", "target_revenue", "target_spend", *feat_cols)
    attrs = D.campaign_attrs(long)
    cal = C.window_calendar(cut_dates(cb, cut_step), wdf, F.col("gmin"), season)
    if season is None:
        cal = cal.drop("seasonal_index").withColumn("seasonal_index", F.lit(1.0))
    rows = rows.join(attrs, "campaign").join(F.broadcast(cal), ["ts", "window_days"])
    rows = rows.withColumn("budget_input_ex", budget_input(F.col("daily_spend_rate"), F.col("window_days")))
    return _finish(
        rows,
        budget_input(F.col("daily_spend_rate"), F.col("window_days"), F.col("target_spend")),
        extra=("budget_input_ex", "target_revenue", "target_spend"),
    )


# ---------------------------------------------------------------------------
# Defensive fill
# ---------------------------------------------------------------------------


def fill_defensive(table: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """±inf → null, then nulls filled with the (channel, type) mean, then the
    channel mean, then the global mean, then 0 — each mean taken after the
    previous fill.  Means are grouped aggregates broadcast back (bounded by the
    channel × type vocabulary), not windows over hot groups.  The tables built
    above are null-free by construction, so this is for external tables."""
    cols = cols or [c for c in S.NUMERIC_FEATURES if c in table.columns and c != "window_days"]
    x = table.select(*[c for c in table.columns if c not in cols],
                     *[F.when(F.abs(F.col(c).cast("double")) == float("inf"), None)
                       .otherwise(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(c) for c in cols])
    for keys in (["channel", "campaign_type"], ["channel"], []):
        means = (x.groupBy(*keys) if keys else x.groupBy()).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
        x = (x.join(F.broadcast(means), keys, "left") if keys else x.crossJoin(F.broadcast(means)))
        x = x.select(*[c for c in x.columns if not c.startswith("_m_") and c not in cols],
                     *[F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) for c in cols])
    x = x.select(*[c for c in x.columns if c not in cols], *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols])
    return x.select(*table.columns)
