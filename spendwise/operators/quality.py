"""Data quality and output contracts.

Every check is an aggregation producing a small DataFrame of findings; strict
callers raise on it.  Nothing iterates over collected data rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .guard import finite

EPS = 1e-9
MAX_OTHER_SHARE = 0.05
MAX_ROW_SPEND = 10_000_000


def _checks(one_row: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    """Turn a one-row frame into (check, ok, detail) rows."""
    arr = F.array(*[F.struct(F.lit(n).alias("check"), ok.alias("ok"), det.cast("string").alias("detail")) for n, ok, det in checks])
    return one_row.select(F.explode(arr).alias("c")).select("c.*")


def channel_summary(long: DataFrame) -> DataFrame:
    """Per channel spend, revenue, distinct campaigns, rows."""
    return long.groupBy("channel").agg(
        F.sum("spend").alias("spend"), F.sum("revenue").alias("revenue"),
        F.count_distinct("campaign").alias("campaigns"), F.count("*").alias("rows"),
    )


def dataset_summary(long: DataFrame) -> DataFrame:
    """A16 totals: rows, campaigns, channels, date range, totals."""
    return long.agg(
        F.count("*").alias("rows"), F.count_distinct("campaign").alias("campaigns"),
        F.sort_array(F.collect_set("channel")).alias("channels"),
        F.min("date").alias("date_min"), F.max("date").alias("date_max"),
        F.sum("spend").alias("total_spend"), F.sum("revenue").alias("total_revenue"),
        F.avg((F.col("channel") == "other").cast("double")).alias("other_share"),
    )


def ingest_checks(long: DataFrame, has_revenue_column: bool) -> DataFrame:
    """Q1 (+A23): other-channel share ≤ 5 %, revenue column → Σ revenue > 0,
    no row spend > 10 M (undivided micros)."""
    one = long.agg(
        F.avg((F.col("channel") == "other").cast("double")).alias("other_share"),
        F.sum("revenue").alias("rev"), F.max("spend").alias("max_spend"), F.count("*").alias("n"),
    )
    return _checks(one, [
        ("rows_parsed", F.col("n") > 0, F.col("n")),
        ("other_channel_share", F.coalesce(F.col("other_share"), F.lit(0.0)) <= MAX_OTHER_SHARE, F.col("other_share")),
        ("revenue_parsed", F.lit(not has_revenue_column) | (F.coalesce(F.col("rev"), F.lit(0)) > 0), F.col("rev")),
        ("spend_scale", F.coalesce(F.col("max_spend"), F.lit(0)) <= MAX_ROW_SPEND, F.col("max_spend")),
    ])


def file_report(long_with_file: DataFrame, raw_counts: DataFrame) -> DataFrame:
    """Per file raw rows, parsed rows, dropped rows, zero-value shares and
    the campaign-type set; ``raw_counts`` has (source_file, raw_rows)."""
    parsed = long_with_file.groupBy("source_file").agg(
        F.count("*").alias("parsed_rows"),
        F.avg((F.col("spend") == 0).cast("double")).alias("zero_spend_share"),
        F.avg((F.col("revenue") == 0).cast("double")).alias("zero_revenue_share"),
        F.sum("spend").alias("spend"), F.sum("revenue").alias("revenue"),
        F.array_join(F.sort_array(F.collect_set("campaign_type")), ",").alias("campaign_types"),
        F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("channels"),
    )
    return raw_counts.join(parsed, "source_file", "left").select(
        "source_file", "raw_rows", F.coalesce("parsed_rows", F.lit(0)).alias("parsed_rows"),
        (F.col("raw_rows") - F.coalesce("parsed_rows", F.lit(0))).alias("invalid_rows"),
        "zero_spend_share", "zero_revenue_share", "spend", "revenue", "campaign_types", "channels",
    )


def output_contract(out: DataFrame) -> DataFrame:
    """Q2: violation counts of the output contract (one row)."""
    cols_ok = list(out.columns) == S.OUTPUT_COLUMNS
    nums = S.REVENUE_Q + S.ROAS_Q
    bad_num = F.lit(False)
    neg = F.lit(False)
    for c in nums:
        bad_num = bad_num | ~finite(F.col(c).cast("double"))
        neg = neg | (F.col(c) < 0)
    cross_r = (F.col("revenue_p10") > F.col("revenue_p50") + EPS) | (F.col("revenue_p50") > F.col("revenue_p90") + EPS)
    cross_o = (F.col("roas_p10") > F.col("roas_p50") + EPS) | (F.col("roas_p50") > F.col("roas_p90") + EPS)
    agg = out.agg(
        F.count("*").alias("rows"),
        F.sum((~F.col("level").isin(*S.LEVELS)).cast("int")).alias("bad_level"),
        F.sum((~F.col("window_days").isin(*S.WINDOWS)).cast("int")).alias("bad_window"),
        F.sum(bad_num.cast("int")).alias("non_finite"),
        F.sum(neg.cast("int")).alias("negative"),
        F.sum(cross_r.cast("int")).alias("crossing_revenue"),
        F.sum(cross_o.cast("int")).alias("crossing_roas"),
    ).fillna(0)
    ok = (F.lit(cols_ok) & (F.col("rows") > 0) & (F.col("bad_level") == 0) & (F.col("bad_window") == 0)
          & (F.col("non_finite") == 0) & (F.col("negative") == 0) & (F.col("crossing_revenue") == 0)
          & (F.col("crossing_roas") == 0))
    return agg.select(F.lit(cols_ok).alias("columns_ok"), "*", ok.alias("valid"))


def validate_output(out: DataFrame, required_channels: DataFrame) -> DataFrame:
    """Q3: the output validator as 14 (check, ok, detail) rows — not empty, schema, row
    count, empty rows, NaN/inf, non-negative, exact windows and levels,
    quantile order, required channels (J14), duplicates (A22), coherence."""
    cols_ok = list(out.columns) == S.OUTPUT_COLUMNS
    c = output_contract(out)
    keys = ["level", "window_days", "channel", "campaign_type", "campaign"]
    dup = out.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("dupes"))
    nan, inf = F.lit(False), F.lit(False)
    for col in S.REVENUE_Q + S.ROAS_Q:
        v = F.col(col).cast("double")
        nan, inf = nan | v.isNull() | F.isnan(v), inf | (F.abs(v) == float("inf"))
    levels = out.agg(F.coalesce(F.count_if(nan), F.lit(0)).alias("nan_rows"), F.coalesce(F.count_if(inf), F.lit(0)).alias("inf_rows"), F.sort_array(F.collect_set("level")).alias("levels"), F.sort_array(F.collect_set("window_days")).alias("wins"),
                     F.sum(F.when((F.col("channel") == "") & (F.col("campaign_type") == "") & (F.col("campaign") == "")
                                  & (F.col("level") == ""), 1).otherwise(0)).alias("empty_rows"))
    got = out.where(F.col("level") == "channel").select("channel").distinct()
    missing = required_channels.select("channel").distinct().join(got, "channel", "left_anti").agg(
        F.count("*").alias("missing"), F.array_join(F.sort_array(F.collect_list("channel")), ",").alias("missing_list"))
    per_w = out.groupBy("window_days").agg(
        F.sum(F.when(F.col("level") == "channel", F.col("revenue_p50"))).alias("ch"),
        F.max(F.when(F.col("level") == "blended", F.col("revenue_p50"))).alias("bl"),
        F.count(F.when(F.col("level") == "blended", 1)).alias("nb"),
        *[F.max(F.when((F.col("level") == "blended") & (F.col(f"roas_p{q}") > 0), F.col(f"revenue_p{q}") / F.col(f"roas_p{q}"))).alias(f"sp{q}")
          for q in (10, 50, 90)],
    )
    spends = F.array_compact(F.array("sp10", "sp50", "sp90"))
    incoherent = (
        (F.col("nb") == 0) | F.col("ch").isNull()
        | (F.abs(F.col("ch") - F.col("bl")) > 1e-3 * F.greatest(F.col("bl"), F.lit(1.0)))
        | ((F.size(spends) > 0) & ((F.array_max(spends) - F.array_min(spends)) > 0.01 * F.array_max(spends)))
    )
    coh = per_w.agg(F.sum(incoherent.cast("int")).alias("incoherent_windows"))
    one = c.crossJoin(dup).crossJoin(levels).crossJoin(missing).crossJoin(coh)
    return _checks(one, [
        ("not_empty", F.col("rows") > 0, F.col("rows")),
        ("columns_exact", F.lit(cols_ok), F.lit(",".join(out.columns))),
        ("more_than_one_row", F.col("rows") > 1, F.col("rows")),
        ("no_empty_rows", F.col("empty_rows") == 0, F.col("empty_rows")),
        ("no_nan", F.col("nan_rows") == 0, F.col("nan_rows")),
        ("no_infinite", F.col("inf_rows") == 0, F.col("inf_rows")),
        ("non_negative", F.col("negative") == 0, F.col("negative")),
        ("windows_exact", F.array_join(F.col("wins"), ",") == ",".join(str(w) for w in S.WINDOWS), F.array_join(F.col("wins"), ",")),
        ("all_levels", F.col("levels") == F.sort_array(F.array(*[F.lit(v) for v in S.LEVELS])), F.array_join("levels", ",")),
        ("revenue_ordered", F.col("crossing_revenue") == 0, F.col("crossing_revenue")),
        ("roas_ordered", F.col("crossing_roas") == 0, F.col("crossing_roas")),
        ("required_channels", F.col("missing") == 0, F.col("missing_list")),
        ("no_duplicates", F.col("dupes") == 0, F.col("dupes")),
        ("coherent", F.col("incoherent_windows") == 0, F.col("incoherent_windows")),
    ])


def campaign_consistency(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q5: per-campaign coverage table (sorted by spend, T4) and the issue list
    (severity, code, entity, message)."""
    per = long.groupBy("campaign").agg(
        F.mode("channel", deterministic=True).alias("channel"),
        F.mode("campaign_type", deterministic=True).alias("campaign_type"),
        F.max("is_brand").alias("is_brand"),
        F.count_distinct("date").alias("active_days"),
        (F.datediff(F.max("date"), F.min("date")) + 1).alias("span_days"),
        F.count_distinct("channel").alias("n_channels"),
        F.sum("spend").alias("spend"), F.sum("revenue").alias("revenue"),
    ).withColumn("coverage", F.round(F.col("active_days") / F.col("span_days"), 3))
    counts = long.agg(
        F.count("*").alias("n"),
        F.sum((F.col("channel") == "other").cast("int")).alias("other_ch"),
        F.sum((F.col("campaign_type") == "Other").cast("int")).alias("other_type"),
    )
    def issue(sev, code, msg):
        return F.struct(F.lit(sev).alias("severity"), F.lit(code).alias("code"), F.lit("").alias("entity"), msg.alias("message"))

    issues = counts.select(F.explode(F.array(
        F.when(F.col("n") == 0, issue("error", "no_data", F.lit("No parseable rows found in the uploaded files."))),
        F.when(F.col("other_ch") > 0, issue("warning", "unmapped_channel", F.format_string(
            "%d rows could not be mapped to a known channel (fell back to 'other').", "other_ch"))),
        F.when(F.col("other_type") > 0, issue("info", "other_type", F.format_string(
            "%d rows mapped to campaign_type 'Other' (name did not match a known pattern).", "other_type"))),
    )).alias("i")).where(F.col("i").isNotNull()).select("i.*")
    drift = per.where(F.col("n_channels") > 1).select(
        F.lit("warning").alias("severity"), F.lit("channel_drift").alias("code"), F.col("campaign").alias("entity"),
        F.format_string("Campaign '%s' appears under multiple channels.", "campaign").alias("message"))
    sparse = per.where((F.col("active_days") / F.col("span_days") < 0.5) & (F.col("span_days") > 14)).select(
        F.lit("info").alias("severity"), F.lit("sparse_history").alias("code"), F.col("campaign").alias("entity"),
        F.format_string("Campaign '%s' has sparse history (%d/%d active days).", "campaign", "active_days", "span_days").alias("message"))
    campaigns = per.drop("n_channels")
    return campaigns, issues.unionByName(drift).unionByName(sparse)


def scale_issues(assessment: DataFrame) -> DataFrame:
    """Q5: one issue for every reason of the guard's assessment against the training
    profile (a bounded list)."""
    return assessment.select(F.lit("warning").alias("severity"), F.lit("scale_mismatch").alias("code"), F.lit("").alias("entity"),
                             F.explode("reasons").alias("message"))


def readiness(long: DataFrame) -> DataFrame:
    """Q6: dataset readiness checklist → (label, status, detail)."""
    by = channel_summary(long)
    pivot = by.agg(*[F.max(F.when(F.col("channel") == c, F.col("spend"))).alias(f"{c}_spend") for c in S.CHANNELS],
                   *[F.max(F.when(F.col("channel") == c, F.col("revenue"))).alias(f"{c}_rev") for c in S.CHANNELS],
                   *[F.max(F.when(F.col("channel") == c, F.col("campaigns"))).alias(f"{c}_camps") for c in S.CHANNELS])
    tot = long.agg(F.sum("spend").alias("ts"), F.sum("revenue").alias("tr"))
    one = pivot.crossJoin(tot)

    def present(c):
        return F.col(f"{c}_spend").isNotNull()

    rows = []
    for c, label in (("google", "Google data detected"), ("microsoft", "Microsoft/Bing data detected"), ("meta", "Meta data detected")):
        rows.append((label, F.when(present(c), "Pass").otherwise("Warning"),
                     F.when(present(c), F.format_string("%.0f spend parsed", F.col(f"{c}_spend").cast("double"))).otherwise(f"No {c} rows found")))
    rows.append(("Unmapped channel rows (channel = other)", F.when(present("other"), "Warning").otherwise("Pass"),
                 F.when(present("other"), F.format_string("%d campaign(s) unmapped", F.col("other_camps"))).otherwise("None")))
    rows.append(("Revenue fields present", F.when(F.coalesce(F.col("tr"), F.lit(0)) > 0, "Pass").otherwise("Error"),
                 F.coalesce(F.col("tr"), F.lit(0)).cast("string")))
    rows.append(("Spend fields present", F.when(F.coalesce(F.col("ts"), F.lit(0)) > 0, "Pass").otherwise("Error"),
                 F.coalesce(F.col("ts"), F.lit(0)).cast("string")))
    for c in ("google", "meta", "microsoft"):
        rows.append((f"{c} parsed rows", F.when(~present(c), None).when(F.col(f"{c}_rev") == 0, "Warning").otherwise("Pass"),
                     F.when(F.col(f"{c}_rev") == 0, "Channel present but revenue is zero").otherwise("Rows and revenue parsed")))
    arr = F.array(*[F.struct(F.lit(lbl).alias("label"), st.alias("status"), det.cast("string").alias("detail")) for lbl, st, det in rows])
    return one.select(F.explode(arr).alias("r")).select("r.*").where(F.col("status").isNotNull())


def micros_reconciliation(raw_micros: DataFrame, long_with_key: DataFrame, key: str = "source_file") -> DataFrame:
    """Q4: per source, Σ raw micros ÷ 1e6 against the parsed spend; ok when
    within max(1, 0.1 %).  ``raw_micros`` has (key, micros) text or numbers."""
    raw = raw_micros.groupBy(key).agg((F.sum(F.col("micros").try_cast("decimal(38,6)")) / F.lit(1000000)).alias("raw_spend"))
    parsed = long_with_key.groupBy(key).agg(F.sum("spend").alias("parsed_spend"))
    x = raw.join(parsed, key, "left")
    diff = F.abs(F.coalesce(F.col("raw_spend"), F.lit(0)) - F.coalesce(F.col("parsed_spend"), F.lit(0)))
    tol = F.greatest(F.lit(1.0), F.abs(F.coalesce(F.col("raw_spend"), F.lit(0)).cast("double")) * 0.001)
    return x.select(key, F.col("raw_spend").cast("double").alias("raw_spend"), F.col("parsed_spend").cast("double").alias("parsed_spend"),
                    diff.cast("double").alias("diff"), (diff.cast("double") <= tol).alias("ok"))
