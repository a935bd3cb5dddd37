"""Schemas and fixed vocabularies.

The vocabularies, alias lists and token lists below are FIXED VALUES: they must
equal the values the forecasting contract was defined with, so that exports map
to the same channels / campaign types and the one-hot layout never drifts.
"""
from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES — vocabularies, column aliases, name tokens, type map.
# ---------------------------------------------------------------------------
CHANNELS = ("google", "meta", "microsoft", "other")

CAMPAIGN_TYPES = (
    "Search",
    "Shopping",
    "PerformanceMax",
    "Display",
    "Video",
    "DemandGen",
    "Prospecting",
    "Retargeting",
    "Brand",
    "DPA",
    "Other",
)

# Column aliases per logical field, first match wins.
ALIASES = {
    "date": ["date", "day", "segments_date", "timeperiod", "time_period", "date_start",
             "reporting_starts", "reporting_date"],
    "campaign": ["campaign_name", "campaign", "campaignname"],
    "campaign_type": ["campaign_type", "campaigntype", "campaign_advertising_channel_type",
                      "advertising_channel_type", "campaign_subtype", "objective"],
    "adset": ["adset_name", "ad_set_name", "adgroup_name", "ad_group_name"],
    "impressions": ["impressions", "metrics_impressions", "impr"],
    "clicks": ["clicks", "metrics_clicks", "link_clicks", "all_clicks", "clicks_all"],
    "spend": ["spend", "metrics_cost_micros", "cost", "cost_micros", "amount_spent",
              "amount_spent_usd", "cost_usd"],
    "conversions": ["conversions", "metrics_conversions", "purchases", "results",
                    "website_purchases", "total_conversions", "all_conversions", "conv"],
    "revenue": ["metrics_conversions_value", "conversion_value", "conv_value", "conv_val",
                "all_conv_value", "purchase_conversion_value", "purchases_conversion_value",
                "conversions_value", "purchase_value", "revenue", "total_conversion_value",
                "website_purchases_conversion_value", "conversion"],
    "budget": ["campaign_budget_amount", "dailybudget", "daily_budget", "budget"],
    "channel": ["channel", "platform", "source", "publisher_platform"],
}

MICROS_TOKEN = "micros"

# Channel of a value and of a file name: pattern found in its key, first match wins.
VALUE_CHANNELS = (
    ("google", r"google|^(g|gads|googleads|adwords)$"),
    ("meta", r"meta|facebook|fb|instagram|^ig$"),
    ("microsoft", r"microsoft|bing|msft"),
)
FILE_CHANNELS = (
    ("google", r"google|adwords"),
    ("microsoft", r"bing|microsoft|msads"),
    ("meta", r"meta|facebook|instagram"),
)
# Channel of a header: every pattern matches some whole header key, first match wins.
HEADER_CHANNELS = (
    ("google", (r"metrics_.*|segments_date",)),
    ("microsoft", (r"timeperiod|time_period",)),
    ("meta", (r"date_start", r"cpm|reach|daily_budget")),
    ("meta", (r".*purchase.*|adset_name|ad_set_name",)),
    ("microsoft", (r".*microsoft.*|bing",)),
    ("google", (r"cost|conversion_value|advertising_channel_type",)),
)

BRAND_TOKENS = ("brand", "branded", "trademark")
DPA_TOKENS = ("dpa", "catalog", "advantage_catalog", "product_set", "asc")
RETARGET_TOKENS = ("retarget", "remarket", "rmkt", "rtg", "mof", "bof", "warm", "abandon",
                   "cart", "purchasers", "site_visitors", "engaged", "lookback")
PROSPECT_TOKENS = ("prospect", "tof", "cold", "acquisition", "broad", "interest", "lookalike",
                   "lal", "new_user")

# Explicit campaign-type labels (search/shopping/... and Microsoft labels) →
# canonical type, matched as substrings in this order.
TYPE_MAP = (
    ("search", "Search"),
    ("shopping", "Shopping"),
    ("performance_max", "PerformanceMax"),
    ("performancemax", "PerformanceMax"),
    ("pmax", "PerformanceMax"),
    ("display", "Display"),
    ("video", "Video"),
    ("youtube", "Video"),
    ("demand_gen", "DemandGen"),
    ("demandgen", "DemandGen"),
    ("discovery", "DemandGen"),
    ("audience", "Display"),
    ("hotel", "Other"),
    ("smart", "Search"),
    ("dynamicsearchads", "Search"),
    ("dynamic_search", "Search"),
)

# Forecast horizons, trailing spans, hierarchy levels.
WINDOWS = (30, 60, 90)
TRAIL_SHORT = 14
TRAIL_LONG = 28
LEVELS = ("blended", "channel", "campaign_type", "campaign")
CURRENCY = "USD"
ROAS_CAP = 100.0
TRAIN_CUT_STEP = 7
# ---------------------------------------------------------------------------

METRICS = ("impressions", "clicks", "spend", "conversions", "revenue")

# Money and counts are kept exact (decimal) in the long table so that sums do
# not depend on partitioning or reduction order; ratios are computed in double.
# The widest decimal: sums keep its type, and no parseable metric is cut.
MONEY = T.DecimalType(38, 6)

LONG_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType(), False),
        T.StructField("channel", T.StringType(), False),
        T.StructField("campaign", T.StringType(), False),
        T.StructField("campaign_type", T.StringType(), False),
        T.StructField("is_brand", T.IntegerType(), False),
        *[T.StructField(m, MONEY, False) for m in METRICS],
        T.StructField("daily_budget", MONEY, False),
    ]
)
LONG_COLUMNS = [f.name for f in LONG_SCHEMA.fields]

# 32 ordered numeric features; budget_input is index 0.
NUMERIC_FEATURES = [
    "budget_input", "window_days",
    "tr14_revenue", "tr28_revenue", "tr14_spend", "tr28_spend", "tr14_roas", "tr28_roas",
    "tr14_conversions", "tr28_conversions", "tr14_clicks", "tr28_clicks", "tr14_impr", "tr28_impr",
    "ctr14", "cvr14", "cpc14", "ctr28", "cvr28", "cpc28",
    "rev_growth_wow", "rev_growth_mom", "spend_growth_wow", "spend_growth_mom",
    "daily_spend_rate", "active_days",
    "month_start", "wom_start", "frac_peak", "has_bfcm", "trend_index", "seasonal_index",
]
IDENTITY = ["channel", "campaign_type", "campaign", "is_brand"]
DESIGN_COLUMNS = (
    list(NUMERIC_FEATURES)
    + [f"ch_{c}" for c in CHANNELS]
    + [f"ct_{t}" for t in CAMPAIGN_TYPES]
    + ["is_brand"]
)

REVENUE_Q = ["revenue_p10", "revenue_p50", "revenue_p90"]
ROAS_Q = ["roas_p10", "roas_p50", "roas_p90"]

OUTPUT_SCHEMA = T.StructType(
    [
        T.StructField("level", T.StringType(), False),
        T.StructField("channel", T.StringType(), False),
        T.StructField("campaign_type", T.StringType(), False),
        T.StructField("campaign", T.StringType(), False),
        T.StructField("window_days", T.IntegerType(), False),
        *[T.StructField(c, T.DoubleType(), False) for c in REVENUE_Q + ROAS_Q],
    ]
)
OUTPUT_COLUMNS = [f.name for f in OUTPUT_SCHEMA.fields]

_Q = T.StructType([T.StructField(p, T.DoubleType()) for p in ("p10", "p50", "p90")])
PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("date_min", T.StringType()),
        T.StructField("date_max", T.StringType()),
        T.StructField("channels", T.ArrayType(T.StringType())),
        T.StructField("campaign_types", T.ArrayType(T.StringType())),
        T.StructField("n_campaigns", T.LongType()),
        T.StructField("monthly_spend", _Q),
        T.StructField("monthly_revenue", _Q),
        T.StructField("campaign_monthly_spend", _Q),
        T.StructField("campaign_monthly_revenue", _Q),
        T.StructField("roas", _Q),
        T.StructField("other_channel_share", T.DoubleType()),
        T.StructField(
            "by_channel",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("monthly_spend", _Q),
                        T.StructField("monthly_revenue", _Q),
                        T.StructField("roas", T.DoubleType()),
                    ]
                ),
            ),
        ),
    ]
)
