"""Driver tables (TPC-H-like star schema) shaped into three ad exports.

The lineitem grain becomes one export row; market segment picks the platform,
part type the campaign type, and ``p_partkey % 4`` a campaign variant.  Each
export keeps its platform's header layout and is rendered as text, exactly as a
CSV reader would see it, so the full normaliser runs on it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a fact scan over the default parallelism when it arrives in
    fewer partitions (e.g. one large Parquet row group).  At scale a fact scan
    has far more splits than cores and this is a no-op — no shuffle added."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def ads_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_linenumber", "l_extendedprice",
        "l_discount", "l_tax", "l_shipdate",
    ))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    # the narrow tables meet first, so that the fact is dealt by order and by part only
    segment = orders.join(cust, orders.o_custkey == cust.c_custkey).select("o_orderkey", "c_mktsegment")
    return (
        li.join(segment, li.l_orderkey == segment.o_orderkey)
        .join(part, li.l_partkey == part.p_partkey)
        .select(
            F.col("l_shipdate").cast("date").alias("d"),
            F.col("c_mktsegment").alias("seg"),
            F.col("p_type").alias("t"),
            (F.col("p_partkey") % 4).alias("v"),
            F.col("l_quantity").cast("int").alias("qty"),
            F.col("l_linenumber").alias("ln"),
            (price * F.col("l_discount").cast("decimal(4,2)")).alias("spend"),
            (F.lit(4) * price * F.col("l_tax").cast("decimal(4,2)")).alias("revenue"),
        )
    )


def _case(c: Column, mapping: dict, default: str) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(default)


def _name(seg: Column, t: Column, v: Column) -> Column:
    return F.concat(seg, F.lit("_"), t, F.lit("_0"), v.cast("string"))


def _as_text(df: DataFrame) -> DataFrame:
    return df.select([F.col(c).cast("string").alias(c) for c in df.columns])


def export_google(base: DataFrame) -> DataFrame:
    b = base.where(F.col("seg").isin("AUTOMOBILE", "BUILDING"))
    types = {"ECONOMY": "SEARCH", "PROMO": "SHOPPING", "STANDARD": "PERFORMANCE_MAX",
             "LARGE": "DISPLAY", "MEDIUM": "VIDEO"}
    return _as_text(b.select(
        F.col("d").cast("string").alias("segments_date"),
        _name(F.col("seg"), F.col("t"), F.col("v")).alias("campaign_name"),
        _case(F.col("t"), types, "DEMAND_GEN").alias("campaign_advertising_channel_type"),
        (F.col("qty") * 100).alias("metrics_impressions"),
        F.col("qty").alias("metrics_clicks"),
        (F.col("spend") * 1000000).alias("metrics_cost_micros"),
        F.col("ln").alias("metrics_conversions"),
        F.col("revenue").alias("metrics_conversions_value"),
        F.lit(50.0).alias("campaign_budget_amount"),
    ))


def export_microsoft(base: DataFrame) -> DataFrame:
    b = base.where(F.col("seg") == "MACHINERY")
    types = {"ECONOMY": "Search", "PROMO": "Shopping", "STANDARD": "Performance max",
             "LARGE": "Audience", "MEDIUM": "DynamicSearchAds"}
    return _as_text(b.select(
        F.col("d").cast("string").alias("TimePeriod"),
        _name(F.col("seg"), F.col("t"), F.col("v")).alias("CampaignName"),
        _case(F.col("t"), types, "Hotel").alias("CampaignType"),
        (F.col("qty") * 100).alias("Impressions"),
        F.col("qty").alias("Clicks"),
        F.col("spend").alias("Spend"),
        F.col("ln").alias("Conversions"),
        F.col("revenue").alias("Revenue"),
        F.lit(10.0).alias("DailyBudget"),
    ))


def export_meta(base: DataFrame) -> DataFrame:
    b = base.where(F.col("seg").isin("FURNITURE", "HOUSEHOLD"))
    prefix = {"ECONOMY": "DPA Catalog", "PROMO": "BOF Retargeting", "STANDARD": "TOF Prospecting",
              "LARGE": "Brand Reach", "MEDIUM": "MOF Engaged"}
    name = F.concat(_case(F.col("t"), prefix, "Evergreen"), F.lit(" "), F.col("seg"),
                    F.lit(" 0"), F.col("v").cast("string"))
    return _as_text(b.select(
        F.col("d").cast("string").alias("date_start"),
        name.alias("campaign_name"),
        (F.col("qty") * 100).alias("impressions"),
        F.col("qty").alias("clicks"),
        F.col("spend").alias("spend"),
        F.col("revenue").alias("conversion"),
        (F.col("qty") * 90).alias("reach"),
    ))


def export_mixed(base: DataFrame) -> DataFrame:
    """An export with a channel column, a date layout for every line number (one of them
    no date, one blank), and cost cells that are no numbers, negative or blank."""
    d = F.col("d")
    day = _case(F.col("ln"), {1: d.cast("string"), 2: F.date_format(d, "yyyy/MM/dd"), 3: F.date_format(d, "MM/dd/yyyy"),
                              4: F.date_format(d, "MMM d, yyyy"), 5: "not a date", 6: F.lit(None).cast("string")},
                F.date_format(d, "yyyyMMdd"))
    platforms = {"AUTOMOBILE": "Google Ads", "BUILDING": "adwords", "MACHINERY": "Bing", "FURNITURE": "facebook"}
    spend = F.col("spend").cast("string")
    cost = _case(F.col("qty") % 10, {0: "n/a", 1: F.concat(F.lit("-"), spend), 2: F.lit(None).cast("string")}, spend)
    return base.select(day.alias("Day"), _case(F.col("seg"), platforms, "TikTok").alias("Platform"),
                       _name(F.col("seg"), F.col("t"), F.col("v")).alias("Campaign"), F.col("t").alias("Campaign type"),
                       cost.alias("Cost"), F.col("revenue").cast("string").alias("Conversion value"))


def mixed_exports(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> dict[str, DataFrame]:
    """Exports of every outcome by name: the mixed one, a recognised one without any
    date, and a header without rows."""
    base = ads_base(spark, sf_dir) if base is None else base
    return {"agency_export": export_mixed(base),
            "bing_undated_stats": export_microsoft(base).withColumn("TimePeriod", F.lit("n/a")),
            "google_ads_empty": export_google(base).where(F.lit(False))}


def exports(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> list[DataFrame]:
    """The regular exports, of the staged ``base`` where there is one."""
    base = ads_base(spark, sf_dir) if base is None else base
    return [export_google(base), export_microsoft(base), export_meta(base)]


def ads_long(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """The three exports run through the normaliser and unioned (S9 + U1)."""
    from .exports import to_long, union_long

    return union_long([to_long(e) for e in exports(spark, sf_dir, base)])


def short_history_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 30-day export derived from ``events`` (short-history edge case)."""
    from .exports import to_long

    ev = table(spark, sf_dir, "events").select(
        F.col("ts").cast("date").cast("string").alias("date"),
        F.concat(F.lit("Search "), F.col("event_type")).alias("campaign_name"),
        F.lit("SEARCH").alias("campaign_type"),
        F.lit("google").alias("channel"),
        F.lit(100).alias("impressions"),
        F.lit(1).alias("clicks"),
        F.col("value").cast("decimal(12,2)").alias("cost"),
        (F.col("value").cast("decimal(12,2)") * 3).alias("conversion_value"),
    )
    return to_long(ev)


def provider_claims(out: DataFrame) -> DataFrame:
    """Answers of two providers on a forecast, one claim for every one of its blended,
    channel and campaign rows and provider: summaries (wrong by 10 % for ``first`` at 30
    days, without evidence at 90; ``second`` promises at 90), channel risks (an action with
    a number of its own at 60 days), campaigns to watch and a shift to an unknown channel."""
    providers = F.explode(F.array(*[F.struct(F.lit(n).alias("provider"), F.lit(r).alias("provider_rank")) for r, n in enumerate(("first", "second"))]))
    x = out.where(F.col("level").isin("blended", "channel", "campaign")).withColumn("_p", providers).select("*", "_p.*")
    is_first, w = F.col("provider") == "first", F.col("window_days")
    who = F.when(F.col("level") == "blended", "Blended revenue").otherwise(F.col("channel"))
    p50 = F.col("revenue_p50") * F.when(is_first & (w == 30), 1.1).otherwise(1.0)

    def money(c):
        return F.concat(F.lit("$"), F.format_number(c, 0))

    def claim(kind, text, action=None, ref=None, target=None):
        none = F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), (none if action is None else action).alias("action"),
                        (none if ref is None else ref).alias("ref_name"), (none if target is None else target).alias("target_channel"))

    summary = claim("summary", F.concat(who, F.lit(" is forecast at "), money(p50), F.lit(" over the next "), w.cast("string"), F.lit(" days"),
                                        F.when(~is_first & (w == 90), ", guaranteed.").otherwise(".")))
    risk = claim("risk", F.concat(F.col("channel"), F.lit(" may fall to "), money(F.col("revenue_p10")), F.lit(".")),
                 F.when(w == 60, "Move $777,777,777 to other channels.").otherwise("Hold budgets."))
    watch = claim("watch", F.concat(F.lit("Forecast at "), money(F.col("revenue_p50")), F.lit(" (P50).")), ref=F.col("campaign"))
    shift = claim("shift", F.lit("Shift budget to where it pays more."), target=F.when(is_first, "tiktok").otherwise("google"))
    made = (F.when(F.col("level") == "blended", F.array(summary, shift)).when(F.col("level") == "channel", F.array(summary, risk))
            .otherwise(F.array(watch)))
    evidence = F.when(is_first & (w == 90), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.col("level"), F.lit(".revenue_p50"))))
    return x.withColumn("_c", F.explode(made)).select(
        "window_days", "provider", "provider_rank", "_c.*", evidence.alias("evidence"),
        F.concat_ws("/", "level", "channel", "campaign").alias("key"), F.lit(None).cast("string").alias("source_channel"))


def raw_answers(out: DataFrame) -> DataFrame:
    """An answer as a provider writes it for every row of a forecast: fenced after a think
    block (channel), with words around it (campaign type), cut off (blended), without any
    object (campaigns without revenue) or bare."""
    p50 = F.round("revenue_p50").cast("long").cast("string")
    body = F.concat(F.lit('{"claim": "'), F.col("level"), F.lit(' forecast", "value": '), p50, F.lit("}"))
    raw = (F.when(F.col("level") == "channel", F.concat(F.lit('<think>\n{"claim": "draft"}\n</think>\n```json\n'), body, F.lit("\n```")))
           .when(F.col("level") == "campaign_type", F.concat(F.lit("Here you are: "), body, F.lit(" Anything else?")))
           .when(F.col("level") == "blended", F.concat(F.lit('{"claim": "'), p50))
           .when(F.col("revenue_p50") <= 0, F.lit("Not enough evidence in the provided data.")).otherwise(body))
    return out.select("level", "channel", "campaign_type", "campaign", "window_days", raw.alias("raw"))
