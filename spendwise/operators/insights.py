"""Grounded insights as bulk jobs over a claims table.

A context per forecast window lists the numbers and names a written claim may
cite; claims are validated with higher-order array functions (no UDF); rule
based insights are formatted selects.  A context is bounded by design (the
blended row, channel and type rows, top 8 campaigns), so it is broadcast to the
claims of its window.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S

# FIXED VALUES — banned phrases, trivially grounded numbers, number token
# pattern, always-known names, tolerances, top-k sizes.
BANNED_PHRASES = (
    "will definitely", "guaranteed", "certainly", "without a doubt",
    "because of competitor", "competitor activity", "because of inflation",
    "inflation", "algorithm update", "algorithm change",
    "customers are changing behavior", "market crash",
)
TRIVIAL_NUMBERS = (10.0, 50.0, 90.0, 30.0, 60.0, 80.0)
TRIVIAL_ABS = 12.0
NUMBER_TOKEN = r"-?\$?\d[\d,]*\.?\d*"
FIXED_NAMES = ("google", "meta", "microsoft", "bing", "microsoft/bing", "blended")
REL_TOL, ABS_TOL = 0.015, 0.51
TOP_CAMPAIGNS, WATCH_LIST, WIDE_RANGE = 8, 3, 4.0
TOP_DRIVERS = 6
ALLOWED_METRICS = ("revenue_p10", "revenue_p50", "revenue_p90", "roas_p10", "roas_p50", "roas_p90", "spend", "budget")
# texts of the contract: actions, headings and lines of empty sections
RISK_ACTIONS = {"medium": "Review pacing weekly and re-forecast as new data arrives.",
                "low": "Maintain current allocation; re-evaluate as data arrives."}
HEADINGS = {"forecast_summary": "**Forecast Summary**", "risks": "**Anomalies & Risks**",
            "budget_recommendations": "**Budget Recommendation**", "campaigns_to_watch": "**Campaigns to Watch**",
            "suggested_budget_shift": "**Suggested Budget Shift**", "limitations": "**Limitations**"}
NONE_LINES = {"risks": "- None flagged.", "budget_recommendations": "- Maintain current allocation."}
NO_SUMMARY = "no grounded forecast_summary claims survived validation"
MALFORMED = "response is not a JSON object"
LOG_HEAD = 3
LIMITATIONS = (
    "Forecast assumes budgets and attribution remain as observed in the input data.",
    "P10-P90 intervals are calibrated on historical backtests (~80% target coverage).",
    "Not enough evidence in the provided data to attribute changes to external market events.",
)


def _money(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(x, 0))


def top_campaigns(out: DataFrame, k: int = TOP_CAMPAIGNS) -> DataFrame:
    """Top k campaign rows by P50 per window (tie → campaign name)."""
    w = Window.partitionBy("window_days").orderBy(F.col("revenue_p50").desc(), "campaign")
    return out.where(F.col("level") == "campaign").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked_channels(out: DataFrame) -> DataFrame:
    """Channel rows by P50 per window (tie → channel name), with their ``rank`` and
    ``share`` of the window's blended P50 (null without one).  A window partition holds a
    row per channel of the vocabulary."""
    w = Window.partitionBy("window_days").orderBy(F.col("revenue_p50").desc(), "channel")
    whole = out.where(F.col("level") == "blended").select("window_days", F.col("revenue_p50").alias("_all"))  # a row per window
    return out.where(F.col("level") == "channel").withColumn("rank", F.row_number().over(w)).join(
        F.broadcast(whole), "window_days", "left").withColumn("share", F.try_divide("revenue_p50", "_all")).drop("_all")


FACT_COLUMNS = ["window_days", "part", "rank", "entity", "metric", "value"]
_FACT_CHOICE = ("blended", "channels", "campaign_types", "top_campaigns", "top_drivers", "historical_summary", "budget_simulation")


def facts(out: DataFrame, drivers: DataFrame | None = None, history: DataFrame | None = None,
          simulation: DataFrame | None = None) -> DataFrame:
    """N1 in long form: every number that a claim may cite, by window, part of the context,
    rank in that part, entity and metric.

    ``drivers(feature, importance)`` gives the first ``TOP_DRIVERS`` (all importances are
    of a fixed design, so a bounded table); ``history`` is a one-row summary whose numeric
    columns all count; ``simulation(scenario_id, channel, budget, revenue, roas)`` are
    scored budgets.  The last three hold for every window."""
    levels = {"blended": out.where(F.col("level") == "blended").withColumn("rank", F.lit(1)),
              "channels": ranked_channels(out).drop("share"),
              "campaign_types": out.where(F.col("level") == "campaign_type").withColumn("rank", F.lit(0)),
              "top_campaigns": top_campaigns(out)}
    values = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in S.REVENUE_Q + S.ROAS_Q])
    parts = []
    for part, rows in levels.items():
        entity = F.concat_ws("/", *[F.when(F.col(c) != "", F.col(c)) for c in ("channel", "campaign_type", "campaign")])
        parts.append(rows.select("window_days", F.lit(part).alias("part"), F.col("rank").cast("int").alias("rank"), entity.alias("entity"),
                                 F.inline(values)))
    anywhere = []
    if drivers is not None:
        w = Window.orderBy(F.col("importance").desc(), "feature")
        anywhere.append(drivers.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP_DRIVERS).select(
            F.lit("top_drivers").alias("part"), "rank", F.col("feature").alias("entity"), F.lit("importance").alias("metric"),
            F.col("importance").cast("double").alias("value")))
    if history is not None:
        numeric = [f.name for f in history.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal")]
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numeric])
        anywhere.append(history.select(F.lit("historical_summary").alias("part"), F.lit(1).alias("rank"), F.lit("").alias("entity"), F.inline(cells)))
    if simulation is not None:
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("budget", "revenue", "roas")])
        anywhere.append(simulation.select(F.lit("budget_simulation").alias("part"), F.lit(0).alias("rank"),
                                          F.concat_ws("/", "scenario_id", "channel").alias("entity"), F.inline(cells)))
    windows = out.select("window_days").distinct()
    for rows in anywhere:  # bounded tables, repeated for the few windows
        parts.append(windows.crossJoin(F.broadcast(rows)).select(*FACT_COLUMNS))
    found = parts[0]
    for rows in parts[1:]:
        found = found.unionByName(rows)
    return found


def full_context(out: DataFrame, drivers: DataFrame | None = None, history: DataFrame | None = None,
                 simulation: DataFrame | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """One context per window: a list of facts for each part (by rank and entity), the
    ``validation_warnings`` (from ``warnings(message)``, in the order of the text), the
    allow-lists, and the ``numbers`` and ``names`` that :func:`validate_claims` takes."""
    one = facts(out, drivers, history, simulation)
    fact = F.struct("rank", "entity", "metric", "value")
    parts = one.groupBy("window_days").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("part") == p, fact))).alias(p) for p in _FACT_CHOICE],
        F.collect_set("value").alias("_cited"))
    known = context(out)
    found = parts.join(F.broadcast(known), "window_days").withColumn("numbers", F.array_union("numbers", "_cited")).drop("_cited")
    said = F.array().cast("array<string>")
    if warnings is not None:
        found = found.crossJoin(F.broadcast(warnings.agg(F.sort_array(F.collect_set("message")).alias("validation_warnings"))))
    else:
        found = found.withColumn("validation_warnings", said)
    return found.withColumn("allowed_metrics", F.array(*[F.lit(m) for m in ALLOWED_METRICS]))


def context(out: DataFrame) -> DataFrame:
    """Per window the allowed numbers, names and allow-lists."""
    rows = out.where(F.col("level").isin("blended", "channel", "campaign_type")).withColumn("rank", F.lit(None).cast("int"))
    ctx_rows = rows.unionByName(top_campaigns(out))
    nums = F.array(F.col("window_days").cast("double"), *[F.col(c) for c in S.REVENUE_Q + S.ROAS_Q])
    names = F.array(F.lower(F.trim("channel")), F.lower(F.trim("campaign_type")), F.lower(F.trim("campaign")))
    return ctx_rows.groupBy("window_days").agg(
        F.array_distinct(F.flatten(F.collect_list(nums))).alias("numbers"),
        F.array_union(F.array_distinct(F.filter(F.flatten(F.collect_list(names)), lambda n: n != "")),
                      F.array(*[F.lit(n) for n in FIXED_NAMES])).alias("names"),
        F.sort_array(F.collect_set(F.when((F.col("level") == "channel") & (F.col("channel") != ""), F.col("channel")))).alias("allowed_channels"),
        F.sort_array(F.collect_set(F.when(F.col("level") == "campaign", F.col("campaign")))).alias("allowed_campaigns"),
    )


def number_tokens(text: Column) -> Column:
    """Numeric tokens as doubles (unparseable tokens → null, skipped)."""
    toks = F.regexp_extract_all(text, F.lit(NUMBER_TOKEN), 0)
    return F.transform(toks, lambda t: F.regexp_replace(t, r"[,$]", "").try_cast("double"))


def grounded(text: Column, numbers: Column) -> Column:
    """Every number is trivial or within tolerance of a non-zero context
    number."""
    def ok(v):
        trivial = v.isin(*TRIVIAL_NUMBERS) | (F.abs(v) <= TRIVIAL_ABS)
        near = F.exists(numbers, lambda a: (a != 0) & (F.abs(v - a) <= F.greatest(F.lit(REL_TOL) * F.abs(a), F.lit(ABS_TOL))))
        return v.isNull() | trivial | near
    return F.forall(number_tokens(text), ok)


def clean_language(text: Column) -> Column:
    """No banned phrase (case-insensitive substring)."""
    low = F.lower(text)
    bad = F.lit(False)
    for p in BANNED_PHRASES:
        bad = bad | low.contains(p)
    return ~bad


def name_grounded(ref: Column, names: Column) -> Column:
    """Reference equals, contains or is contained in a context name."""
    r = F.lower(F.trim(ref))
    return (r != "") & F.exists(names, lambda n: (n == r) | n.contains(r) | r.contains(n))


def validate_claims(claims: DataFrame, ctx: DataFrame) -> DataFrame:
    """N6 → N5 → N3 (→ N4 for watch items, channel membership for shifts):
    first failing check is the rejection reason (a limitation needs no evidence).  Adds ``accepted``,
    ``reason``.  A claim's ``action``, if there is such a column, is checked with its text
    (N7); a claim of no kind stands for an answer that could not be read."""
    said = F.concat_ws("\n", "text", "action") if "action" in claims.columns else F.col("text")
    x = claims.join(F.broadcast(ctx.select("window_days", "numbers", "names")), "window_days", "left")
    reason = (
        F.when(F.col("kind").isNull(), MALFORMED)
        .when((F.col("kind") != "limitation") & (F.coalesce(F.size("evidence"), F.lit(-1)) <= 0), "dropped item without evidence references")
        .when(~clean_language(said), "dropped item with deterministic/unsupported-causality language")
        .when(~grounded(said, F.coalesce("numbers", F.array().cast("array<double>"))),
              "dropped item citing a number not present in the context")
        .when((F.col("kind") == "watch") & ~name_grounded(F.coalesce(F.col("ref_name"), F.lit("")), F.col("names")),
              "dropped watch item: unknown campaign or group")
        .when((F.col("kind") == "shift") & (
            (F.col("source_channel").isNotNull() & ~F.array_contains("names", F.lower(F.trim("source_channel"))))
            | (F.col("target_channel").isNotNull() & ~F.array_contains("names", F.lower(F.trim("target_channel"))))),
            "dropped budget shift: unknown channel")
    )
    return x.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()).drop("numbers", "names")


def claims_from_forecast(out: DataFrame) -> DataFrame:
    """Test claims derived from forecast rows: summary claims for blended /
    channel rows and watch items for the top campaigns; by position within the
    window (a bounded set: blended + channels + top 8) every third number is
    perturbed by 10 %, every fifth evidence list removed and every seventh
    claim given a banned phrase."""
    rows = out.where(F.col("level").isin("blended", "channel")).withColumn("kind", F.lit("summary")).unionByName(
        top_campaigns(out).drop("rank").withColumn("kind", F.lit("watch")))
    pos = F.row_number().over(Window.partitionBy("window_days").orderBy("level", "channel", "campaign"))
    rows = rows.withColumn("pos", pos)
    p50 = F.when(F.col("pos") % 3 == 0, F.col("revenue_p50") * 1.1).otherwise(F.col("revenue_p50"))
    who = F.when(F.col("level") == "blended", F.lit("Blended revenue")).when(
        F.col("level") == "channel", F.initcap("channel")).otherwise(F.col("campaign"))
    text = F.concat(who, F.lit(" is forecast at "), _money(p50), F.lit(" (P50) over the next "),
                    F.col("window_days").cast("string"), F.lit(" days"),
                    F.when(F.col("pos") % 7 == 0, F.lit(", and will definitely grow")).otherwise(F.lit("")), F.lit("."))
    evidence = F.when(F.col("pos") % 5 == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.col("level"), F.lit("["), who, F.lit("].revenue_p50"))))
    return rows.select(
        "window_days", "kind", text.alias("text"), evidence.alias("evidence"),
        F.when(F.col("kind") == "watch", F.col("campaign")).alias("ref_name"),
        F.lit(None).cast("string").alias("source_channel"), F.lit(None).cast("string").alias("target_channel"),
    )


def rule_insights(out: DataFrame) -> DataFrame:
    """N8 (+T6, T8): deterministic insights per window → (window_days,
    section, ordinal, text, evidence)."""
    b = out.where(F.col("level") == "blended").select("window_days", *[F.col(c).alias(f"b_{c}") for c in S.REVENUE_Q + S.ROAS_Q])
    ch = out.where(F.col("level") == "channel")
    best = ch.groupBy("window_days").agg(
        F.max_by("channel", "revenue_p50").alias("top_ch"),
        F.max("revenue_p50").alias("top_p50"),
        F.max_by("channel", "roas_p50").alias("best_ch"),
        F.max("roas_p50").alias("best_roas"),
        F.min_by("channel", "roas_p50").alias("worst_ch"),
        F.min("roas_p50").alias("worst_roas"),
        F.count("*").alias("n_ch"),
    )
    summary = b.select(
        "window_days", F.lit("forecast_summary").alias("section"), F.lit(0).alias("ordinal"),
        F.concat(F.lit("Over the next "), F.col("window_days").cast("string"), F.lit(" days, blended revenue is forecast at "),
                 _money(F.col("b_revenue_p50")), F.lit(" expected (P50), with a range of "), _money(F.col("b_revenue_p10")),
                 F.lit(" (P10) to "), _money(F.col("b_revenue_p90")), F.lit(" (P90) and an expected ROAS of "),
                 F.format_string("%.2f", F.col("b_roas_p50")), F.lit("x (P50).")).alias("text"),
        F.array(*[F.lit(f"blended.{c}") for c in ("revenue_p10", "revenue_p50", "revenue_p90", "roas_p50")]).alias("evidence"),
    )
    top = best.select(
        "window_days", F.lit("forecast_summary").alias("section"), F.lit(1).alias("ordinal"),
        F.concat(F.initcap("top_ch"), F.lit(" contributes the largest share of forecast revenue at "), _money(F.col("top_p50")),
                 F.lit(" (P50), so changes in "), F.initcap("top_ch"), F.lit(" spend may have the largest blended impact.")).alias("text"),
        F.array(F.concat(F.lit("channels["), F.col("top_ch"), F.lit("].revenue_p50"))).alias("evidence"),
    )
    rec = best.select(
        "window_days", F.lit("budget_recommendations").alias("section"), F.lit(0).alias("ordinal"),
        F.concat(F.initcap("best_ch"), F.lit(" shows the highest expected ROAS ("), F.format_string("%.2f", F.col("best_roas")),
                 F.lit("x P50) among detected channels; incremental budget appears most efficient there, subject to diminishing returns.")).alias("text"),
        F.array(F.concat(F.lit("channels["), F.col("best_ch"), F.lit("].roas_p50"))).alias("evidence"),
    )
    wide = ch.where((F.col("revenue_p50") > 0) & ((F.col("revenue_p90") - F.col("revenue_p10")) > WIDE_RANGE * F.col("revenue_p50")))
    risks = wide.select(
        "window_days", F.lit("risks").alias("section"), F.lit(1).alias("ordinal"),
        F.concat(F.initcap("channel"), F.lit(" has a wide P10-P90 revenue range ("), _money(F.col("revenue_p10")), F.lit(" to "),
                 _money(F.col("revenue_p90")), F.lit("), so forecast confidence for this channel may be lower.")).alias("text"),
        F.array(F.concat(F.lit("channels["), F.col("channel"), F.lit("].revenue_p10")),
                F.concat(F.lit("channels["), F.col("channel"), F.lit("].revenue_p90"))).alias("evidence"),
    )
    no_risk = b.join(wide.select("window_days").distinct(), "window_days", "left_anti").select(
        "window_days", F.lit("risks").alias("section"), F.lit(0).alias("ordinal"),
        F.lit("No channel-level anomaly flags in the current forecast output.").alias("text"),
        F.array(F.lit("channels")).alias("evidence"))
    watch = top_campaigns(out, WATCH_LIST).select(
        "window_days", F.lit("campaigns_to_watch").alias("section"), F.col("rank").alias("ordinal"),
        F.concat(F.col("campaign"), F.lit(": Top forecast contributor at "), _money(F.col("revenue_p50")),
                 F.lit(" expected revenue (P50) over "), F.col("window_days").cast("string"), F.lit(" days.")).alias("text"),
        F.array(F.concat(F.lit("top_campaigns["), F.col("campaign"), F.lit("].revenue_p50"))).alias("evidence"),
    )
    shift_ok = (F.col("n_ch") >= 2) & (F.col("worst_ch") != F.col("best_ch"))
    shift = best.select(
        "window_days", F.lit("suggested_budget_shift").alias("section"), F.lit(0).alias("ordinal"),
        F.when(shift_ok, F.concat(
            F.lit("Based on the forecast output, shifting incremental budget from "), F.initcap("worst_ch"), F.lit(" ("),
            F.format_string("%.2f", F.col("worst_roas")), F.lit("x expected ROAS) toward "), F.initcap("best_ch"), F.lit(" ("),
            F.format_string("%.2f", F.col("best_roas")),
            F.lit("x expected ROAS) may improve blended efficiency, subject to diminishing returns.")))
        .otherwise(F.lit("Not enough evidence in the provided data.")).alias("text"),
        F.when(shift_ok, F.array(F.concat(F.lit("channels["), F.col("worst_ch"), F.lit("].roas_p50")),
                                 F.concat(F.lit("channels["), F.col("best_ch"), F.lit("].roas_p50"))))
        .otherwise(F.array(F.lit("channels"))).alias("evidence"),
    )
    lim = b.select("window_days", F.lit("limitations").alias("section"),
                   F.posexplode(F.array(*[F.lit(t) for t in LIMITATIONS])).alias("ordinal", "text")).select(
        "window_days", "section", "ordinal", "text", F.array().cast("array<string>").alias("evidence"))
    parts = [summary, top, rec, risks, no_risk, watch, shift, lim]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


SECTION_OF = {"summary": "forecast_summary", "risk": "risks", "recommendation": "budget_recommendations",
              "watch": "campaigns_to_watch", "shift": "suggested_budget_shift", "limitation": "limitations"}


def _lookup(key: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def with_fields(rules: DataFrame) -> DataFrame:
    """Severity and recommended action of risks, confidence of summaries and of the
    shift, expected direction of recommendations (null where a section has none)."""
    of = {s: F.col("section") == s for s in HEADINGS}
    found = F.col("ordinal") > 0  # a risk found in a channel; 0 says that there is none
    grounds = F.size("evidence") > 1  # a shift between two channels
    severity = F.when(of["risks"], F.when(found, "medium").otherwise("low"))
    confidence = F.when(of["forecast_summary"], "high").when(of["suggested_budget_shift"], F.when(grounds, "medium").otherwise("low"))
    return rules.withColumn("severity", severity).withColumn("action", _lookup(F.col("severity"), RISK_ACTIONS)).withColumn(
        "confidence", confidence).withColumn("direction", F.when(of["budget_recommendations"], "increase_revenue"))


def narrative(items: DataFrame) -> DataFrame:
    """One markdown text per window: headed sections in a fixed order, a risk with
    its action.  Risks and recommendations have a line when there are none, other empty
    sections are left out."""
    line = F.concat(F.lit("- "), F.col("text"),
                    F.when(F.col("section") == "risks", F.concat(F.lit(" _Action: "), F.coalesce("action", F.lit("n/a")), F.lit("_"))).otherwise(""))
    lines = items.select("window_days", "section", "ordinal", line.alias("line"))
    listed = lines.groupBy("window_days").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == s, F.struct("ordinal", "line")))), lambda x: x["line"]).alias(s)
        for s in HEADINGS])
    none = F.array().cast("array<string>")
    parts = []
    for i, (s, heading) in enumerate(HEADINGS.items()):
        full = F.concat(F.array(F.lit(("\n" if i else "") + heading)),
                        F.when(F.size(s) > 0, F.col(s)).otherwise(F.array(F.lit(NONE_LINES[s])) if s in NONE_LINES else none))
        parts.append(full if i == 0 or s in NONE_LINES else F.when(F.size(s) > 0, full).otherwise(none))
    return listed.select("window_days", F.array_join(F.concat(*parts), "\n").alias("narrative"))


def extract_json(raw: Column, schema) -> Column:
    """Tolerant JSON extraction — drop think blocks and code fences, take
    the first '{' to the last '}', parse; malformed → null."""
    t = F.regexp_replace(raw, r"(?s)<think>.*?</think>", "")
    t = F.regexp_replace(t, r"```(?:json)?", "")
    body = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(body != "", body), schema, {"mode": "PERMISSIVE"})


def choose(validated: DataFrame, rules: DataFrame) -> DataFrame:
    """Per window use the validated claims when a summary claim survived,
    else the rule-based insights; report status and rejections."""
    verdict = validated.groupBy("window_days").agg(
        F.count_if(F.col("accepted") & (F.col("kind") == "summary")).alias("summaries"),
        F.count_if(~F.col("accepted")).alias("rejected"),
        F.count("*").alias("claims"),
    )
    v = verdict.withColumn("status", F.when(F.col("summaries") > 0, "passed").otherwise("fallback"))
    r = rules.groupBy("window_days").agg(F.count("*").alias("rule_items"))
    return v.join(r, "window_days", "full").select(
        "window_days", F.coalesce("status", F.lit("fallback")).alias("status"),
        F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("rejected", F.lit(0)).alias("rejected"),
        F.when(F.col("status") == "passed", F.col("summaries")).otherwise(F.col("rule_items")).alias("items_used"),
    )


ITEM_COLUMNS = ["window_days", "provider", "guardrail", "section", "key", "text", "action"]


def _chosen(validated: DataFrame) -> DataFrame:
    """Per window the first provider of which a summary claim survived."""
    return validated.where(F.col("accepted") & (F.col("kind") == "summary")).groupBy("window_days").agg(
        F.min_by("provider", "provider_rank").alias("provider"))


def chosen_items(validated: DataFrame, rules: DataFrame) -> DataFrame:
    """The insights of every window.  ``validated`` holds the claims of several
    providers (``provider``, ``provider_rank``, ``key``: its order within the section);
    the accepted ones of the first provider with a surviving summary are the items, of
    which only the first shift counts.  A window without such a provider gets the rule
    items (:func:`with_fields`)."""
    chosen = _chosen(validated)
    passed = validated.where("accepted").join(chosen, ["window_days", "provider"]).withColumn("section", _lookup(F.col("kind"), SECTION_OF))
    shift = F.col("kind") == "shift"
    first = passed.where(shift).groupBy("window_days").agg(F.min("key").alias("_first"))
    passed = passed.join(first, "window_days", "left").where(~shift | (F.col("key") == F.col("_first")))
    template = rules.join(chosen, "window_days", "left_anti").withColumn("provider", F.lit("template")).withColumn(
        "key", F.lpad(F.col("ordinal").cast("string"), 9, "0"))
    return passed.withColumn("guardrail", F.lit("passed")).select(*ITEM_COLUMNS).unionByName(
        template.withColumn("guardrail", F.lit("fallback")).select(*ITEM_COLUMNS))


def rejection_log(validated: DataFrame) -> DataFrame:
    """Why claims were dropped.  A window that took a provider has all reasons of
    that provider; a fallback window has, for every provider, the first three, the last of
    which is the missing summary when fewer claims were dropped.  Limitations are dropped
    silently.  One row per reason: no list grows with an answer."""
    chosen = _chosen(validated)
    order = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in SECTION_OF]), F.col("kind")).cast("int"), F.lit(0))
    dropped = validated.where(~F.col("accepted") & (F.coalesce("kind", F.lit("")) != "limitation")).select(
        "window_days", "provider", order.alias("section_rank"), "key", "reason")
    passed = dropped.join(chosen, ["window_days", "provider"], "left_semi").withColumn("guardrail", F.lit("passed"))
    asked = validated.select("window_days", "provider").distinct().select(
        "*", F.lit(len(SECTION_OF) + 1).alias("section_rank"), F.lit("").alias("key"), F.lit(NO_SUMMARY).alias("reason"))
    w = Window.partitionBy("window_days", "provider").orderBy("section_rank", "key", "reason")
    head = dropped.unionByName(asked).join(chosen, "window_days", "left_anti").withColumn("_n", F.row_number().over(w)).where(
        F.col("_n") <= LOG_HEAD).drop("_n")
    return passed.unionByName(head.withColumn("guardrail", F.lit("fallback")).select(*passed.columns))
