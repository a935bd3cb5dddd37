"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark plans: the long table is the expected
normaliser output defined directly on the driver's tables, trailing/forward
sums are range *joins* (not window frames), modes use ranked counts, and the
Black-Friday rule uses day-of-week arithmetic.  Money stays DECIMAL until it
is aggregated.
"""
from __future__ import annotations

from .. import schema as S

FIXTURES = """
ads_base AS (
SELECT CAST(l_shipdate AS DATE) AS d, c_mktsegment AS seg, p_type AS t, p_partkey % 4 AS v,
       CAST(l_quantity AS INT) AS qty, l_linenumber AS ln,
       CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS spend,
       4 * CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS revenue
FROM lineitem JOIN part ON l_partkey = p_partkey
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
export_google AS (
SELECT CAST(d AS VARCHAR) AS segments_date, concat(seg, '_', t, '_0', CAST(v AS VARCHAR)) AS campaign_name,
       CASE t WHEN 'ECONOMY' THEN 'SEARCH' WHEN 'PROMO' THEN 'SHOPPING' WHEN 'STANDARD' THEN 'PERFORMANCE_MAX'
              WHEN 'LARGE' THEN 'DISPLAY' WHEN 'MEDIUM' THEN 'VIDEO' ELSE 'DEMAND_GEN' END AS campaign_advertising_channel_type,
       qty * 100 AS metrics_impressions, qty AS metrics_clicks, spend * 1000000 AS metrics_cost_micros,
       ln AS metrics_conversions, revenue AS metrics_conversions_value, 50.0 AS campaign_budget_amount
FROM ads_base WHERE seg IN ('AUTOMOBILE', 'BUILDING')),
export_microsoft AS (
SELECT CAST(d AS VARCHAR) AS TimePeriod, concat(seg, '_', t, '_0', CAST(v AS VARCHAR)) AS CampaignName,
       CASE t WHEN 'ECONOMY' THEN 'Search' WHEN 'PROMO' THEN 'Shopping' WHEN 'STANDARD' THEN 'Performance max'
              WHEN 'LARGE' THEN 'Audience' WHEN 'MEDIUM' THEN 'DynamicSearchAds' ELSE 'Hotel' END AS CampaignType,
       qty * 100 AS Impressions, qty AS Clicks, spend AS Spend, ln AS Conversions, revenue AS Revenue, 10.0 AS DailyBudget
FROM ads_base WHERE seg = 'MACHINERY'),
export_meta AS (
SELECT CAST(d AS VARCHAR) AS date_start,
       concat(CASE t WHEN 'ECONOMY' THEN 'DPA Catalog' WHEN 'PROMO' THEN 'BOF Retargeting' WHEN 'STANDARD' THEN 'TOF Prospecting'
              WHEN 'LARGE' THEN 'Brand Reach' WHEN 'MEDIUM' THEN 'MOF Engaged' ELSE 'Evergreen' END,
              ' ', seg, ' 0', CAST(v AS VARCHAR)) AS campaign_name,
       qty * 100 AS impressions, qty AS clicks, spend AS spend, revenue AS conversion, qty * 90 AS reach
FROM ads_base WHERE seg IN ('FURNITURE', 'HOUSEHOLD')),
ads_long AS (
SELECT CAST(segments_date AS DATE) AS date, 'google' AS channel, campaign_name AS campaign,
       CASE campaign_advertising_channel_type WHEN 'SEARCH' THEN 'Search' WHEN 'SHOPPING' THEN 'Shopping' WHEN 'PERFORMANCE_MAX' THEN 'PerformanceMax'
            WHEN 'DISPLAY' THEN 'Display' WHEN 'VIDEO' THEN 'Video' ELSE 'DemandGen' END AS campaign_type, 0 AS is_brand,
       metrics_impressions AS impressions, metrics_clicks AS clicks, CAST(metrics_cost_micros / 1000000 AS DECIMAL(18,4)) AS spend,
       metrics_conversions AS conversions, CAST(metrics_conversions_value AS DECIMAL(18,4)) AS revenue,
       CAST(campaign_budget_amount AS DECIMAL(18,4)) AS daily_budget FROM export_google
UNION ALL
SELECT CAST(TimePeriod AS DATE), 'microsoft', CampaignName,
       CASE CampaignType WHEN 'Search' THEN 'Search' WHEN 'DynamicSearchAds' THEN 'Search' WHEN 'Shopping' THEN 'Shopping'
            WHEN 'Performance max' THEN 'PerformanceMax' WHEN 'Audience' THEN 'Display' ELSE 'Other' END, 0,
       Impressions, Clicks, CAST(Spend AS DECIMAL(18,4)), Conversions, CAST(Revenue AS DECIMAL(18,4)), CAST(DailyBudget AS DECIMAL(18,4)) FROM export_microsoft
UNION ALL
SELECT CAST(date_start AS DATE), 'meta', campaign_name,
       CASE WHEN campaign_name LIKE 'DPA%' THEN 'DPA' WHEN campaign_name LIKE 'Brand%' THEN 'Brand'
            WHEN campaign_name LIKE 'BOF%' OR campaign_name LIKE 'MOF%' THEN 'Retargeting'
            WHEN campaign_name LIKE 'TOF%' THEN 'Prospecting' ELSE 'Other' END,
       CASE WHEN campaign_name LIKE 'Brand%' THEN 1 ELSE 0 END,
       impressions, clicks, CAST(spend AS DECIMAL(18,4)), 0, CAST(conversion AS DECIMAL(18,4)), 0 FROM export_meta),
daily AS (
SELECT campaign, date, SUM(impressions) AS impressions, SUM(clicks) AS clicks, SUM(spend) AS spend,
       SUM(conversions) AS conversions, SUM(revenue) AS revenue
FROM ads_long GROUP BY campaign, date),
bnd AS (SELECT MIN(date) AS gmin, MAX(date) AS gmax FROM daily),
attrs AS (
SELECT a.campaign, a.channel, b.campaign_type, c.is_brand FROM
 (SELECT campaign, channel FROM (SELECT campaign, channel, row_number() OVER (PARTITION BY campaign ORDER BY n DESC, channel) AS rn
   FROM (SELECT campaign, channel, COUNT(*) AS n FROM ads_long GROUP BY campaign, channel)) WHERE rn = 1) a
 JOIN (SELECT campaign, campaign_type FROM (SELECT campaign, campaign_type, row_number() OVER (PARTITION BY campaign ORDER BY n DESC, campaign_type) AS rn
   FROM (SELECT campaign, campaign_type, COUNT(*) AS n FROM ads_long GROUP BY campaign, campaign_type)) WHERE rn = 1) b ON a.campaign = b.campaign
 JOIN (SELECT campaign, CAST(round_even(AVG(is_brand), 0) AS INTEGER) AS is_brand FROM ads_long GROUP BY campaign) c ON a.campaign = c.campaign),
season AS (
SELECT month, seasonal_index FROM (
  SELECT m.month, m.m_mean / o.overall AS seasonal_index, o.overall FROM
   (SELECT month(date) AS month, CAST(SUM(rev) AS DOUBLE) / COUNT(*) AS m_mean FROM (SELECT date, SUM(revenue) AS rev FROM ads_long GROUP BY date) GROUP BY 1) m,
   (SELECT CAST(SUM(rev) AS DOUBLE) / COUNT(*) AS overall FROM (SELECT date, SUM(revenue) AS rev FROM ads_long GROUP BY date)) o
  WHERE o.overall > 0
  UNION ALL
  SELECT CAST(r.range AS INTEGER), 1.0, o.overall FROM range(1, 13) r,
   (SELECT CAST(SUM(rev) AS DOUBLE) / COUNT(*) AS overall FROM (SELECT date, SUM(revenue) AS rev FROM ads_long GROUP BY date)) o
  WHERE NOT (o.overall > 0))),
wins AS (SELECT * FROM (VALUES (30), (60), (90)) t(window_days))
"""


def with_fixtures(body: str) -> str:
    body = body.strip()
    assert body.upper().startswith("WITH ") or body.upper().startswith("SELECT")
    if body.upper().startswith("WITH "):
        return "WITH " + FIXTURES.strip() + ",\n" + body[5:]
    return "WITH " + FIXTURES.strip() + "\n" + body


# ---------------------------------------------------------------------------
# shared SQL fragments
# ---------------------------------------------------------------------------

_SHORT = {"revenue": "revenue", "spend": "spend", "conversions": "conversions", "clicks": "clicks", "impr": "impressions"}


def _sdiv(a: str, b: str, cap: float) -> str:
    return (f"CASE WHEN CAST({b} AS DOUBLE) > 0 THEN LEAST(GREATEST(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE), 0.0), {cap}) "
            f"ELSE 0.0 END")


def _growth(now: str, prev: str) -> str:
    n, p = f"CAST({now} AS DOUBLE)", f"CAST({prev} AS DOUBLE)"
    return f"CASE WHEN {p} > 0 THEN LEAST(GREATEST(({n} - {p}) / {p}, -1.0), 5.0) ELSE 0.0 END"


def _trailing_sums(age: str) -> str:
    """Conditional sums over ``age`` = days before the cut (0 = the cut day)."""
    parts = []
    for span in (14, 28):
        for short, col in _SHORT.items():
            parts.append(f"COALESCE(SUM(CASE WHEN {age} BETWEEN 0 AND {span - 1} THEN {col} END), 0) AS tr{span}_{short}")
    for short in ("revenue", "spend"):
        parts.append(f"COALESCE(SUM(CASE WHEN {age} BETWEEN 0 AND 6 THEN {short} END), 0) AS last7_{short}")
        parts.append(f"COALESCE(SUM(CASE WHEN {age} BETWEEN 7 AND 13 THEN {short} END), 0) AS prev7_{short}")
        parts.append(f"COALESCE(SUM(CASE WHEN {age} BETWEEN 28 AND 55 THEN {short} END), 0) AS prev28_{short}")
    parts.append(f"COALESCE(SUM(CASE WHEN {age} BETWEEN 0 AND 27 AND spend > 0 THEN 1 ELSE 0 END), 0) AS active28")
    return ",\n  ".join(parts)


def _feature_exprs(budget: str) -> str:
    f = [f"{budget} AS budget_input", "x.window_days AS window_days"]
    f += [
        "CAST(tr14_revenue AS DOUBLE) AS tr14_revenue", "CAST(tr28_revenue AS DOUBLE) AS tr28_revenue",
        "CAST(tr14_spend AS DOUBLE) AS tr14_spend", "CAST(tr28_spend AS DOUBLE) AS tr28_spend",
        f"{_sdiv('tr14_revenue', 'tr14_spend', 100.0)} AS tr14_roas",
        f"{_sdiv('tr28_revenue', 'tr28_spend', 100.0)} AS tr28_roas",
        "CAST(tr14_conversions AS DOUBLE) AS tr14_conversions", "CAST(tr28_conversions AS DOUBLE) AS tr28_conversions",
        "CAST(tr14_clicks AS DOUBLE) AS tr14_clicks", "CAST(tr28_clicks AS DOUBLE) AS tr28_clicks",
        "CAST(tr14_impr AS DOUBLE) AS tr14_impr", "CAST(tr28_impr AS DOUBLE) AS tr28_impr",
    ]
    for span in (14, 28):
        f += [
            f"{_sdiv(f'tr{span}_clicks', f'tr{span}_impr', 1.0)} AS ctr{span}",
            f"{_sdiv(f'tr{span}_conversions', f'tr{span}_clicks', 1.0)} AS cvr{span}",
            f"{_sdiv(f'tr{span}_spend', f'tr{span}_clicks', 1000.0)} AS cpc{span}",
        ]
    f += [
        f"{_growth('last7_revenue', 'prev7_revenue')} AS rev_growth_wow",
        f"{_growth('tr28_revenue', 'prev28_revenue')} AS rev_growth_mom",
        f"{_growth('last7_spend', 'prev7_spend')} AS spend_growth_wow",
        f"{_growth('tr28_spend', 'prev28_spend')} AS spend_growth_mom",
        "CAST(tr28_spend AS DOUBLE) / 28.0 AS daily_spend_rate",
        "CAST(active28 AS DOUBLE) AS active_days",
        "cal.month_start", "cal.wom_start", "cal.frac_peak", "cal.has_bfcm", "cal.trend_index", "cal.seasonal_index",
    ]
    return ",\n  ".join(f)


def _calendar(cuts: str) -> str:
    """(ts, window_days) → calendar features, from an explicit day list.
    BF = first Thursday of November + 22 days via day-of-week arithmetic."""
    return f"""(SELECT ts, window_days, ws,
    CAST(month(ws) AS DOUBLE) AS month_start,
    CAST((day(ws) - 1) // 7 + 1 AS DOUBLE) AS wom_start,
    AVG(CASE WHEN (month(dd) = 11 AND day(dd) >= 15) OR month(dd) = 12 THEN 1.0 ELSE 0.0 END) AS frac_peak,
    CAST(MAX(CASE WHEN dd = bf OR dd = bf + 3 THEN 1 ELSE 0 END) AS DOUBLE) AS has_bfcm,
    date_diff('day', gmin, ws) / 365.0 AS trend_index,
    AVG(COALESCE(s.seasonal_index, 1.0)) AS seasonal_index
  FROM (
    SELECT ts, window_days, gmin, ws, dd,
      make_date(year(dd), 11, 1) + CAST((4 - dayofweek(make_date(year(dd), 11, 1)) + 7) % 7 AS INTEGER) + 22 AS bf
    FROM (SELECT c.ts, w.window_days, c.gmin, c.ts + 1 AS ws, c.ts + 1 + CAST(unnest(range(0, w.window_days)) AS INTEGER) AS dd
          FROM {cuts} c, wins w)
  ) days LEFT JOIN season s ON s.month = month(days.dd)
  GROUP BY ts, window_days, gmin, ws)"""


SQL: dict[str, str] = {}

SQL["to_long"] = """
SELECT date, channel, campaign, campaign_type, is_brand, impressions, clicks, spend, conversions, revenue, daily_budget FROM ads_long
"""

SQL["daily"] = "SELECT * FROM daily"

SQL["channel_daily"] = """
SELECT channel, date, SUM(spend) AS spend, SUM(revenue) AS revenue FROM ads_long GROUP BY channel, date
"""

SQL["campaign_attrs"] = "SELECT * FROM attrs"

SQL["seasonal_index"] = "SELECT month, seasonal_index FROM season"

_PRED_TABLE = f"""
WITH sums AS (
  SELECT d.campaign,
  {_trailing_sums("date_diff('day', d.date, b.gmax)")}
  FROM daily d, bnd b GROUP BY d.campaign),
cal AS {_calendar("(SELECT gmax AS ts, gmin FROM bnd)")},
x AS (SELECT s.*, w.window_days FROM sums s, wins w)
SELECT a.channel, a.campaign_type, x.campaign, a.is_brand, cal.ws AS window_start,
  {_feature_exprs("GREATEST(CAST(tr28_spend AS DOUBLE) / 28.0, 0.0) * x.window_days")}
FROM x JOIN attrs a ON a.campaign = x.campaign JOIN cal ON cal.window_days = x.window_days
"""
SQL["prediction_table"] = _PRED_TABLE

_TRAIN_TABLE = f"""
WITH cb0 AS (
  SELECT gmin, gmax, (gmax - 90) <= (gmin + 56) AS short FROM bnd),
cb AS (
  SELECT gmin, gmax,
    CASE WHEN short THEN gmin + 28 ELSE gmin + 56 END AS first_cut,
    CASE WHEN short THEN GREATEST(gmin + 28, gmax - 30) ELSE gmax - 90 END AS last_cut FROM cb0),
cuts AS (
  SELECT gmin, gmax, first_cut + CAST(k * 7 AS INTEGER) AS ts FROM (
    SELECT gmin, gmax, first_cut, unnest(range(0, CAST(floor(date_diff('day', first_cut, last_cut) / 7) AS BIGINT) + 1)) AS k FROM cb)),
pairs AS (
  SELECT DISTINCT d.campaign, c.ts, c.gmin, c.gmax FROM daily d JOIN cuts c
  ON d.date BETWEEN c.ts - 27 AND c.ts WHERE d.spend > 0),
sums AS (
  SELECT p.campaign, p.ts, p.gmax,
  {_trailing_sums("date_diff('day', d.date, p.ts)")}
  FROM pairs p JOIN daily d ON d.campaign = p.campaign AND d.date BETWEEN p.ts - 55 AND p.ts
  GROUP BY p.campaign, p.ts, p.gmax),
fwd AS (
  SELECT p.campaign, p.ts, w.window_days,
    COALESCE(SUM(CASE WHEN d.date > p.ts AND d.date <= p.ts + w.window_days THEN d.revenue END), 0) AS frev,
    COALESCE(SUM(CASE WHEN d.date > p.ts AND d.date <= p.ts + w.window_days THEN d.spend END), 0) AS fspd
  FROM pairs p CROSS JOIN wins w LEFT JOIN daily d ON d.campaign = p.campaign AND d.date > p.ts AND d.date <= p.ts + 90
  WHERE p.ts + w.window_days <= p.gmax
  GROUP BY p.campaign, p.ts, w.window_days),
cal AS {_calendar("(SELECT ts, gmin FROM cuts)")},
x AS (SELECT s.*, f.window_days, f.frev, f.fspd FROM sums s JOIN fwd f ON f.campaign = s.campaign AND f.ts = s.ts)
SELECT a.channel, a.campaign_type, x.campaign, a.is_brand, cal.ws AS window_start,
  {_feature_exprs("GREATEST(CAST(x.fspd AS DOUBLE), 0.0)")},
  GREATEST(CAST(tr28_spend AS DOUBLE) / 28.0, 0.0) * x.window_days AS budget_input_ex,
  GREATEST(CAST(x.frev AS DOUBLE), 0.0) AS target_revenue,
  GREATEST(CAST(x.fspd AS DOUBLE), 0.0) AS target_spend
FROM x JOIN attrs a ON a.campaign = x.campaign JOIN cal ON cal.ts = x.ts AND cal.window_days = x.window_days
"""
SQL["training_table"] = _TRAIN_TABLE

# campaign rows with the G8 baseline quantiles at the origin


def _baseline_campaign_sql() -> str:
    return f"""
WITH sums AS (
  SELECT d.campaign,
  {_trailing_sums("date_diff('day', d.date, b.gmax)")}
  FROM daily d, bnd b GROUP BY d.campaign),
cal AS {_calendar("(SELECT gmax AS ts, gmin FROM bnd)")},
x AS (SELECT s.*, w.window_days FROM sums s, wins w),
pt AS (
SELECT a.channel, a.campaign_type, x.campaign, a.is_brand, cal.ws AS window_start,
  {_feature_exprs("GREATEST(CAST(tr28_spend AS DOUBLE) / 28.0, 0.0) * x.window_days")}
FROM x JOIN attrs a ON a.campaign = x.campaign JOIN cal ON cal.window_days = x.window_days),
chr AS (SELECT channel, CASE WHEN SUM(tr28_spend) > 0 THEN SUM(tr28_revenue) / SUM(tr28_spend) ELSE 0.0 END AS ch_roas
        FROM pt GROUP BY channel),
r0 AS (SELECT pt.*, CASE WHEN tr28_roas > 0 THEN tr28_roas ELSE tr14_roas END AS r1, COALESCE(chr.ch_roas, 0.0) AS ch_roas
       FROM pt LEFT JOIN chr ON chr.channel = pt.channel),
r AS (SELECT *, LEAST(GREATEST(CASE WHEN r1 > 0 THEN r1 WHEN ch_roas > 0 THEN ch_roas ELSE 1.0 END, 0.0), 100.0) AS rb FROM r0),
bq AS (SELECT *, GREATEST(rb * GREATEST(budget_input, 0.0) * seasonal_index, 0.0) AS p50 FROM r)
SELECT *, p50 * 0.55 AS revenue_p10, p50 AS revenue_p50, p50 * 1.65 AS revenue_p90 FROM bq
"""


def _rollup_tail(cp: str, spend: str = "budget_input") -> str:
    """``lv`` CTE + final SELECT of the four-level roll-up over CTE ``cp``."""
    return f"""lv AS (
  SELECT 'campaign' AS level, channel, campaign_type, campaign, window_days,
         revenue_p10 AS r10, revenue_p50 AS r50, revenue_p90 AS r90, {spend} AS sp FROM {cp}
  UNION ALL
  SELECT 'campaign_type', channel, campaign_type, '', window_days, SUM(revenue_p10), SUM(revenue_p50), SUM(revenue_p90), SUM({spend})
  FROM {cp} GROUP BY channel, campaign_type, window_days
  UNION ALL
  SELECT 'channel', channel, '', '', window_days, SUM(revenue_p10), SUM(revenue_p50), SUM(revenue_p90), SUM({spend})
  FROM {cp} GROUP BY channel, window_days
  UNION ALL
  SELECT 'blended', '', '', '', window_days, SUM(revenue_p10), SUM(revenue_p50), SUM(revenue_p90), SUM({spend})
  FROM {cp} GROUP BY window_days)
SELECT level, channel, campaign_type, campaign, window_days,
  r10 AS revenue_p10, r50 AS revenue_p50, r90 AS revenue_p90,
  CASE WHEN sp > 0 THEN r10 / sp ELSE 0.0 END AS roas_p10,
  CASE WHEN sp > 0 THEN r50 / sp ELSE 0.0 END AS roas_p50,
  CASE WHEN sp > 0 THEN r90 / sp ELSE 0.0 END AS roas_p90
FROM lv"""


def _rollup_sql(campaign_sql: str, spend: str = "budget_input") -> str:
    body = campaign_sql.strip()
    assert body.upper().startswith("WITH ")
    head, _, tail = body.rpartition("\nSELECT ")
    return f"""{head},
cp AS (SELECT {tail}),
{_rollup_tail("cp", spend)}"""


SQL["forecast_baseline"] = _rollup_sql(_baseline_campaign_sql())


# ---------------------------------------------------------------------------
# response curves
# ---------------------------------------------------------------------------

CURVES = """
cdy AS (SELECT channel, date, CAST(SUM(spend) AS DOUBLE) AS s, CAST(SUM(revenue) AS DOUBLE) AS r FROM ads_long GROUP BY channel, date),
cst AS (SELECT channel, COUNT(*) AS n, MAX(s) AS smax, MAX(r) AS rmax, SUM(s) AS ssum, SUM(r) AS rsum FROM cdy GROUP BY channel),
cgrid AS (SELECT channel, t.i AS i,
            CASE WHEN t.i = 59 THEN smax * 5.0 ELSE t.i * ((smax * 5.0 - smax * 0.05) / 59) + smax * 0.05 END AS k
          FROM cst, range(0, 60) t(i) WHERE n >= 5 AND smax > 0 AND rmax > 0),
cxr AS (SELECT g.channel, g.i, g.k, c.r, c.s / (g.k + c.s + 1e-9) AS x FROM cdy c JOIN cgrid g ON c.channel = g.channel),
cp1 AS (SELECT channel, i, k, SUM(x * r) / SUM(x * x) AS vmax FROM cxr GROUP BY channel, i, k HAVING SUM(x * x) > 0),
csse AS (SELECT x.channel, x.i, x.k, p.vmax, SUM(pow(p.vmax * x.x - x.r, 2)) AS sse
         FROM cxr x JOIN cp1 p ON p.channel = x.channel AND p.i = x.i WHERE p.vmax > 0 GROUP BY x.channel, x.i, x.k, p.vmax),
cbest AS (SELECT channel, vmax, k FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY sse, i) AS rn FROM csse) WHERE rn = 1),
curves AS (
  SELECT st.channel,
    COALESCE(b.vmax, (CASE WHEN ssum > 0 THEN rsum / ssum ELSE 1.0 END) * (CASE WHEN smax > 0 THEN GREATEST(smax * 10.0, 1.0) ELSE 1.0 END)) AS vmax,
    GREATEST(COALESCE(b.k, CASE WHEN smax > 0 THEN GREATEST(smax * 10.0, 1.0) ELSE 1.0 END), 1e-9) AS k,
    CASE WHEN b.k IS NULL THEN 'linear' ELSE 'hill' END AS method
  FROM cst st LEFT JOIN cbest b ON b.channel = st.channel),
cmean AS (SELECT AVG(vmax) AS mv, AVG(k) AS mk FROM curves)
"""


def _hill(v: str, k: str, s: str) -> str:
    return f"({v} * GREATEST({s}, 0.0) / (GREATEST({k}, 1e-9) + GREATEST({s}, 0.0) + 1e-9))"


SQL["channel_curves"] = "WITH " + CURVES.strip() + "\nSELECT channel, vmax, k, method FROM curves"

SQL["curve_points"] = "WITH " + CURVES.strip() + f""",
pts AS (
  SELECT channel, t.i AS i, CASE WHEN t.i = 29 THEN hi ELSE t.i * (hi / 29) END AS spend FROM (
    SELECT channel, GREATEST((CAST(SUM(spend) AS DOUBLE) / COUNT(*)) * 30.0 * 2.5, 1000.0) AS hi
    FROM (SELECT channel, date, SUM(spend) AS spend FROM ads_long GROUP BY channel, date) GROUP BY channel
  ), range(0, 30) t(i))
SELECT p.channel, p.i, p.spend, {_hill("COALESCE(c.vmax, m.mv, 1.0)", "COALESCE(c.k, m.mk, 1.0)", "p.spend")} AS revenue
FROM pts p LEFT JOIN curves c ON c.channel = p.channel CROSS JOIN cmean m
"""


def _scenario_sql(final: str) -> str:
    fo = _rollup_sql(_baseline_campaign_sql())
    return "WITH " + CURVES.strip() + f""",
fo AS ({fo}),
cur AS (SELECT channel, CAST(floor(revenue_p50 / CASE WHEN roas_p50 <> 0 THEN roas_p50 ELSE 1.0 END + 0.5) AS DOUBLE) AS budget
        FROM fo WHERE level = 'channel' AND window_days = 30),
mult AS (SELECT * FROM (VALUES ('x0.5', 0.5), ('x1.0', 1.0), ('x1.5', 1.5), ('x2.0', 2.0)) t(scenario_id, multiplier)),
scen AS (SELECT m.scenario_id, c.channel, c.budget * m.multiplier AS budget FROM cur c CROSS JOIN mult m
         UNION ALL SELECT 'current', channel, budget FROM cur),
sc AS (
  SELECT s.scenario_id, s.channel, s.budget,
    {_hill("COALESCE(c.vmax, m.mv, 1.0)", "COALESCE(c.k, m.mk, 1.0)", "s.budget")} AS revenue,
    {_hill("COALESCE(c.vmax, m.mv, 1.0)", "COALESCE(c.k, m.mk, 1.0)", "s.budget + 1000.0")} AS revenue_more
  FROM scen s LEFT JOIN curves c ON c.channel = s.channel CROSS JOIN cmean m),
scored AS (
  SELECT scenario_id, channel, budget, revenue,
    CASE WHEN budget > 0 THEN revenue / budget ELSE 0.0 END AS roas,
    CASE WHEN budget > 0 THEN (revenue_more - revenue) / 1000.0 ELSE 0.0 END AS marginal_roas FROM sc),
tot AS (SELECT scenario_id, SUM(budget) AS budget, SUM(revenue) AS revenue,
          CASE WHEN SUM(budget) > 0 THEN SUM(revenue) / SUM(budget) ELSE 0.0 END AS roas FROM scored GROUP BY scenario_id)
{final}"""


SQL["budget_scenarios"] = _scenario_sql(
    "SELECT scenario_id, channel, budget, revenue, roas, marginal_roas FROM scored WHERE scenario_id <> 'current'")
SQL["scenario_totals"] = _scenario_sql("SELECT scenario_id, budget, revenue, roas FROM tot WHERE scenario_id <> 'current'")
SQL["scenario_deltas"] = _scenario_sql("""
SELECT s.scenario_id, s.channel, c.budget AS current_budget, s.budget, s.revenue, s.roas, s.marginal_roas,
  s.budget - COALESCE(c.budget, 0.0) AS delta_spend, t.revenue - b.revenue AS delta_revenue, t.roas - b.roas AS delta_roas
FROM scored s LEFT JOIN cur c ON c.channel = s.channel JOIN tot t ON t.scenario_id = s.scenario_id
CROSS JOIN (SELECT revenue, roas FROM tot WHERE scenario_id = 'current') b
WHERE s.scenario_id <> 'current'""")


# ---------------------------------------------------------------------------
# backtest: the fixture CTEs re-pointed at the training period
# ---------------------------------------------------------------------------

def with_train_fixtures(body: str) -> str:
    fx = FIXTURES.strip().replace("FROM ads_long", "FROM ads_train")
    fx = fx.replace("\ndaily AS (", "\nads_train AS (SELECT * FROM ads_long WHERE date <= (SELECT MAX(date) - 90 FROM ads_long)),\ndaily AS (", 1)
    body = body.strip()
    assert body.upper().startswith("WITH ")
    return "WITH " + fx + ",\n" + body[5:]


TRAIN_FIXTURE_QUERIES = {"backtest_metrics"}

_ACTUALS = """
act AS (
  SELECT c.campaign, w.window_days,
    GREATEST(CAST(COALESCE(SUM(CASE WHEN d.date > o.origin AND d.date <= o.origin + w.window_days THEN d.revenue END), 0) AS DOUBLE), 0.0) AS actual_revenue,
    GREATEST(CAST(COALESCE(SUM(CASE WHEN d.date > o.origin AND d.date <= o.origin + w.window_days THEN d.spend END), 0) AS DOUBLE), 0.0) AS actual_spend
  FROM (SELECT DISTINCT campaign FROM ads_long) c
  CROSS JOIN wins w
  CROSS JOIN (SELECT MAX(date) AS gmax, MAX(date) - 90 AS origin FROM ads_long) o
  LEFT JOIN (SELECT campaign, date, SUM(spend) AS spend, SUM(revenue) AS revenue FROM ads_long GROUP BY campaign, date) d
    ON d.campaign = c.campaign
  WHERE o.origin + w.window_days <= o.gmax
  GROUP BY c.campaign, w.window_days)
"""

SQL["backtest_actuals"] = "WITH " + _ACTUALS.strip() + "\nSELECT * FROM act"


def _backtest_metrics_sql() -> str:
    camp = _baseline_campaign_sql().strip()
    head, _, tail = camp.rpartition("\nSELECT ")
    return head + ",\ncp AS (SELECT " + tail + "),\n" + _ACTUALS.strip() + """,
bp AS (SELECT cp.*, GREATEST((CASE WHEN tr28_roas > 0 THEN tr28_roas ELSE tr14_roas END) * GREATEST(budget_input, 0.0) * seasonal_index, 0.0) AS m6 FROM cp),
m AS (
  SELECT bp.channel, bp.window_days, a.actual_revenue AS a, 'model' AS variant, revenue_p10 AS q10, revenue_p50 AS q50, revenue_p90 AS q90
  FROM bp JOIN act a ON a.campaign = bp.campaign AND a.window_days = bp.window_days WHERE a.actual_spend > 0
  UNION ALL
  SELECT bp.channel, bp.window_days, a.actual_revenue, 'baseline', m6 * 0.55, m6 * 1.0, m6 * 1.65
  FROM bp JOIN act a ON a.campaign = bp.campaign AND a.window_days = bp.window_days WHERE a.actual_spend > 0
  UNION ALL
  SELECT bp.channel, bp.window_days, a.actual_revenue, 'blend', 0.25 * revenue_p10 + 0.75 * (m6 * 0.55),
    0.25 * revenue_p50 + 0.75 * (m6 * 1.0), 0.25 * revenue_p90 + 0.75 * (m6 * 1.65)
  FROM bp JOIN act a ON a.campaign = bp.campaign AND a.window_days = bp.window_days WHERE a.actual_spend > 0),
g AS (
  SELECT variant, 'all' AS grouping, '' AS key, * EXCLUDE (variant, channel, window_days) FROM m
  UNION ALL SELECT variant, 'window', CAST(window_days AS VARCHAR), * EXCLUDE (variant, channel, window_days) FROM m
  UNION ALL SELECT variant, 'channel', channel, * EXCLUDE (variant, channel, window_days) FROM m)
SELECT variant, grouping, key, COUNT(*) AS n,
  AVG(CASE WHEN a >= q10 AND a <= q90 THEN 1.0 ELSE 0.0 END) AS coverage,
  CASE WHEN SUM(abs(a)) > 0 THEN SUM(abs(a - q50)) / SUM(abs(a)) END AS wape,
  AVG(CASE WHEN a > 0 THEN abs(a - q50) / a END) AS mape,
  AVG(GREATEST(0.1 * (a - q10), -0.9 * (a - q10))) AS pinball_p10,
  AVG(GREATEST(0.5 * (a - q50), -0.5 * (a - q50))) AS pinball_p50,
  AVG(GREATEST(0.9 * (a - q90), -0.09999999999999998 * (a - q90))) AS pinball_p90,
  (AVG(GREATEST(0.1 * (a - q10), -0.9 * (a - q10))) + AVG(GREATEST(0.5 * (a - q50), -0.5 * (a - q50)))
   + AVG(GREATEST(0.9 * (a - q90), -0.09999999999999998 * (a - q90)))) / 3.0 AS pinball_mean
FROM g GROUP BY variant, grouping, key"""


SQL["backtest_metrics"] = _backtest_metrics_sql()


# ---------------------------------------------------------------------------
# data quality
# ---------------------------------------------------------------------------

SQL["csv_ingest"] = SQL["to_long"]

SQL["dataset_summary"] = """
SELECT COUNT(*) AS rows, COUNT(DISTINCT campaign) AS campaigns, array_to_string(list_sort(list_distinct(list(channel))), ',') AS channels,
  MIN(date) AS date_min, MAX(date) AS date_max, SUM(spend) AS total_spend, SUM(revenue) AS total_revenue,
  AVG(CASE WHEN channel = 'other' THEN 1.0 ELSE 0.0 END) AS other_share FROM ads_long"""

SQL["channel_summary"] = """
SELECT channel, SUM(spend) AS spend, SUM(revenue) AS revenue, COUNT(DISTINCT campaign) AS campaigns, COUNT(*) AS rows
FROM ads_long GROUP BY channel"""

SQL["campaign_consistency"] = """
WITH per AS (
  SELECT l.campaign, MAX(is_brand) AS is_brand, COUNT(DISTINCT date) AS active_days,
    date_diff('day', MIN(date), MAX(date)) + 1 AS span_days, SUM(spend) AS spend, SUM(revenue) AS revenue
  FROM ads_long l GROUP BY l.campaign)
SELECT p.campaign, a.channel, a.campaign_type, p.is_brand, p.active_days, p.span_days,
  round(CAST(p.active_days AS DOUBLE) / p.span_days, 3) AS coverage, p.spend, p.revenue
FROM per p JOIN attrs a ON a.campaign = p.campaign"""

SQL["top_campaigns_by_spend"] = """
SELECT campaign, spend, row_number() OVER (ORDER BY spend DESC, campaign) AS rank FROM (
  SELECT campaign, SUM(spend) AS spend FROM ads_long GROUP BY campaign ORDER BY spend DESC, campaign LIMIT 25)"""


def _contract_sql() -> str:
    fo = _rollup_sql(_baseline_campaign_sql())
    return f"""WITH fo AS ({fo})
SELECT 1 AS columns_ok, COUNT(*) AS rows,
  SUM(CASE WHEN level NOT IN ('blended', 'channel', 'campaign_type', 'campaign') THEN 1 ELSE 0 END) AS bad_level,
  SUM(CASE WHEN window_days NOT IN (30, 60, 90) THEN 1 ELSE 0 END) AS bad_window,
  SUM(CASE WHEN NOT (isfinite(revenue_p10) AND isfinite(revenue_p50) AND isfinite(revenue_p90)
                 AND isfinite(roas_p10) AND isfinite(roas_p50) AND isfinite(roas_p90)) THEN 1 ELSE 0 END) AS non_finite,
  SUM(CASE WHEN LEAST(revenue_p10, revenue_p50, revenue_p90, roas_p10, roas_p50, roas_p90) < 0 THEN 1 ELSE 0 END) AS negative,
  SUM(CASE WHEN revenue_p10 > revenue_p50 + 1e-9 OR revenue_p50 > revenue_p90 + 1e-9 THEN 1 ELSE 0 END) AS crossing_revenue,
  SUM(CASE WHEN roas_p10 > roas_p50 + 1e-9 OR roas_p50 > roas_p90 + 1e-9 THEN 1 ELSE 0 END) AS crossing_roas,
  CASE WHEN COUNT(*) > 0 AND SUM(CASE WHEN revenue_p10 > revenue_p50 + 1e-9 OR revenue_p50 > revenue_p90 + 1e-9
       OR roas_p10 > roas_p50 + 1e-9 OR roas_p50 > roas_p90 + 1e-9 THEN 1 ELSE 0 END) = 0 THEN 1 ELSE 0 END AS valid
FROM fo"""


SQL["output_contract"] = _contract_sql()

SQL["quality_issues"] = """
WITH c AS (SELECT COUNT(*) AS n, SUM(CASE WHEN channel = 'other' THEN 1 ELSE 0 END) AS other_ch,
                  SUM(CASE WHEN campaign_type = 'Other' THEN 1 ELSE 0 END) AS other_type FROM ads_long),
per AS (SELECT campaign, COUNT(DISTINCT date) AS active_days, date_diff('day', MIN(date), MAX(date)) + 1 AS span_days,
               COUNT(DISTINCT channel) AS n_channels FROM ads_long GROUP BY campaign)
SELECT 'error' AS severity, 'no_data' AS code, '' AS entity, 'No parseable rows found in the uploaded files.' AS message FROM c WHERE n = 0
UNION ALL SELECT 'warning', 'unmapped_channel', '', printf('%d rows could not be mapped to a known channel (fell back to ''other'').', other_ch) FROM c WHERE other_ch > 0
UNION ALL SELECT 'info', 'other_type', '', printf('%d rows mapped to campaign_type ''Other'' (name did not match a known pattern).', other_type) FROM c WHERE other_type > 0
UNION ALL SELECT 'warning', 'channel_drift', campaign, printf('Campaign ''%s'' appears under multiple channels.', campaign) FROM per WHERE n_channels > 1
UNION ALL SELECT 'info', 'sparse_history', campaign, printf('Campaign ''%s'' has sparse history (%d/%d active days).', campaign, active_days, span_days)
  FROM per WHERE CAST(active_days AS DOUBLE) / span_days < 0.5 AND span_days > 14"""


# ---------------------------------------------------------------------------
# guard profiles, A10, Q1
# ---------------------------------------------------------------------------

def _q3(expr: str, name: str) -> str:
    return ", ".join(f"COALESCE(quantile_cont({expr}, {p}) FILTER (WHERE isfinite({expr})), 0.0) AS {name}_p{int(p * 100)}"
                     for p in (0.1, 0.5, 0.9))


SQL["training_profile"] = f"""
WITH src AS (SELECT * FROM ads_long),
mo AS (SELECT strftime(date, '%Y-%m') AS month, CAST(SUM(spend) AS DOUBLE) AS s, CAST(SUM(revenue) AS DOUBLE) AS r FROM src GROUP BY 1),
cm AS (SELECT campaign, strftime(date, '%Y-%m') AS month, CAST(SUM(spend) AS DOUBLE) AS s, CAST(SUM(revenue) AS DOUBLE) AS r
       FROM src GROUP BY 1, 2 HAVING SUM(spend) > 0),
ct AS (SELECT campaign, LEAST(GREATEST(CAST(SUM(revenue) AS DOUBLE) / CAST(SUM(spend) AS DOUBLE), 0.0), 100.0) AS roas
       FROM src GROUP BY 1 HAVING SUM(spend) > 0),
o AS (SELECT strftime(MIN(date), '%Y-%m-%d') AS date_min, strftime(MAX(date), '%Y-%m-%d') AS date_max,
        array_to_string(list_sort(list_distinct(list(channel))), ',') AS channels,
        array_to_string(list_sort(list_distinct(list(campaign_type))), ',') AS campaign_types,
        COUNT(DISTINCT campaign) AS n_campaigns, AVG(CASE WHEN channel = 'other' THEN 1.0 ELSE 0.0 END) AS other_channel_share FROM src)
SELECT o.date_min, o.date_max, o.channels, o.campaign_types, o.n_campaigns, a.*, b.*, c.*, o.other_channel_share
FROM o,
 (SELECT {_q3('s', 'monthly_spend')}, {_q3('r', 'monthly_revenue')} FROM mo) a,
 (SELECT {_q3('s', 'campaign_monthly_spend')}, {_q3('r', 'campaign_monthly_revenue')} FROM cm) b,
 (SELECT {_q3('roas', 'roas')} FROM ct) c
"""

SQL["profile_by_channel"] = f"""
WITH src AS (SELECT * FROM ads_long),
chm AS (SELECT channel, strftime(date, '%Y-%m') AS month, CAST(SUM(spend) AS DOUBLE) AS s, CAST(SUM(revenue) AS DOUBLE) AS r
        FROM src GROUP BY 1, 2)
SELECT channel, {_q3('s', 'monthly_spend')}, {_q3('r', 'monthly_revenue')},
  CASE WHEN SUM(s) > 0 THEN LEAST(GREATEST(SUM(r) / SUM(s), 0.0), 100.0) ELSE 0.0 END AS roas
FROM chm GROUP BY channel
"""


def _upload_profile_sql() -> str:
    pt = _PRED_TABLE.strip()
    head, _, tail = pt.rpartition("\nSELECT ")
    return head + ",\npt AS (SELECT " + tail + f"""),
t AS (SELECT channel, campaign_type, tr28_spend * (30.0 / 28.0) AS s, tr28_revenue * (30.0 / 28.0) AS r
      FROM pt WHERE window_days = (SELECT MIN(window_days) FROM pt)),
ta AS (SELECT *, LEAST(GREATEST(CASE WHEN s > 0 THEN r / s ELSE 0.0 END, 0.0), 100.0) AS roas FROM t)
SELECT array_to_string(list_sort(list_distinct(list(channel))), ',') AS channels,
  array_to_string(list_sort(list_distinct(list(campaign_type))), ',') AS campaign_types,
  COUNT(*) AS n_campaigns,
  0.0 AS monthly_spend_p10, SUM(s) AS monthly_spend_p50, 0.0 AS monthly_spend_p90,
  0.0 AS monthly_revenue_p10, SUM(r) AS monthly_revenue_p50, 0.0 AS monthly_revenue_p90,
  {", ".join(f"COALESCE(quantile_cont(s, {p}) FILTER (WHERE s > 0), 0.0) AS campaign_monthly_spend_p{int(p * 100)}" for p in (0.1, 0.5, 0.9))},
  {", ".join(f"COALESCE(quantile_cont(r, {p}) FILTER (WHERE s > 0), 0.0) AS campaign_monthly_revenue_p{int(p * 100)}" for p in (0.1, 0.5, 0.9))},
  {", ".join(f"COALESCE(quantile_cont(roas, {p}) FILTER (WHERE s > 0), 0.0) AS roas_p{int(p * 100)}" for p in (0.1, 0.5, 0.9))},
  AVG(CASE WHEN channel = 'other' THEN 1.0 ELSE 0.0 END) AS other_channel_share
FROM ta"""


SQL["upload_profile"] = _upload_profile_sql()


def _train_cte() -> str:
    """The training table as a nested CTE ``tt``."""
    return f"tt AS ({_TRAIN_TABLE.strip()})"


SQL["global_median_roas"] = "WITH " + _train_cte() + """
SELECT quantile_cont(LEAST(GREATEST(target_revenue / GREATEST(budget_input, 1e-9), 0.0), 100.0), 0.5) AS global_median_roas FROM tt"""

SQL["ingest_checks"] = """
WITH one AS (SELECT AVG(CASE WHEN channel = 'other' THEN 1.0 ELSE 0.0 END) AS other_share, SUM(revenue) AS rev,
                    MAX(spend) AS max_spend, COUNT(*) AS n FROM ads_long)
SELECT 'rows_parsed' AS "check", CASE WHEN n > 0 THEN 1 ELSE 0 END AS ok, CAST(n AS VARCHAR) AS detail FROM one
UNION ALL SELECT 'other_channel_share', CASE WHEN COALESCE(other_share, 0) <= 0.05 THEN 1 ELSE 0 END, CAST(other_share AS VARCHAR) FROM one
UNION ALL SELECT 'revenue_parsed', CASE WHEN COALESCE(rev, 0) > 0 THEN 1 ELSE 0 END, CAST(CAST(rev AS DECIMAL(38,6)) AS VARCHAR) FROM one
UNION ALL SELECT 'spend_scale', CASE WHEN COALESCE(max_spend, 0) <= 10000000 THEN 1 ELSE 0 END, CAST(CAST(max_spend AS DECIMAL(18,6)) AS VARCHAR) FROM one"""


# ---------------------------------------------------------------------------
# G8 / M5 building blocks over an arbitrary feature-table CTE
# ---------------------------------------------------------------------------

def _g8(src: str, out: str, budget: str = "budget_input", fallback: str = "1.0") -> str:
    """CTEs computing G8 baseline quantiles (q10/q50/q90) and the M6 baseline
    (m6) over the table ``src``; result CTE ``out``."""
    return f"""{out}_ch AS (SELECT channel, CASE WHEN SUM(tr28_spend) > 0 THEN SUM(tr28_revenue) / SUM(tr28_spend) ELSE 0.0 END AS ch_roas
        FROM {src} GROUP BY channel),
{out}_r AS (SELECT s.*, CASE WHEN tr28_roas > 0 THEN tr28_roas ELSE tr14_roas END AS _r1, COALESCE(c.ch_roas, 0.0) AS _chr
        FROM {src} s LEFT JOIN {out}_ch c ON c.channel = s.channel),
{out}_p AS (SELECT *, GREATEST(LEAST(GREATEST(CASE WHEN _r1 > 0 THEN _r1 WHEN _chr > 0 THEN _chr ELSE {fallback} END, 0.0), 100.0)
                 * GREATEST({budget}, 0.0) * seasonal_index, 0.0) AS _p50,
                 GREATEST(_r1 * GREATEST({budget}, 0.0) * seasonal_index, 0.0) AS m6 FROM {out}_r),
{out} AS (SELECT * EXCLUDE (_r1, _chr, _p50), _p50 * 0.55 AS q10, _p50 * 1.0 AS q50, _p50 * 1.65 AS q90 FROM {out}_p)"""


def _clean(x: str) -> str:
    return f"(CASE WHEN isfinite({x}) THEN GREATEST({x}, 0.0) ELSE 0.0 END)"


def _m5(src: str, out: str, params: str | None, fallback: str = "1.0") -> str:
    """CTEs for M5 post-processing of q10/q50/q90 in ``src`` (with m6 and
    budget_input); ``params`` = CTE (window_days, blend_weight, width_factor)
    with window 0 = pooled, or None."""
    if params is None:
        join = f"SELECT *, 1.0 AS bw, 1.0 AS wf FROM {src}"
    else:
        join = f"""SELECT s.*, COALESCE(p.blend_weight, g.blend_weight, 1.0) AS bw, COALESCE(p.width_factor, g.width_factor, 1.0) AS wf
        FROM {src} s LEFT JOIN (SELECT * FROM {params} WHERE window_days <> 0) p ON p.window_days = s.window_days
        LEFT JOIN (SELECT * FROM {params} WHERE window_days = 0) g ON TRUE"""
    return f"""{out}_a AS ({join}),
{out}_s AS (SELECT *, list_sort([{_clean('q10')}, {_clean('q50')}, {_clean('q90')}]) AS _s0,
        isfinite(q10) AND isfinite(q50) AND isfinite(q90) AS _ok FROM {out}_a),
{out}_b AS (SELECT *, CASE WHEN bw < 1.0 THEN bw * _s0[2] + (1.0 - bw) * m6 ELSE _s0[2] END AS _mid FROM {out}_s),
{out}_c AS (SELECT *, LEAST(_s0[1], _mid) AS _lo, GREATEST(_s0[3], _mid) AS _hi FROM {out}_b),
{out}_d AS (SELECT *, list_sort([{_clean('_mid - wf * (_mid - _lo)')}, {_clean('_mid')}, {_clean('_mid + wf * (_hi - _mid)')}]) AS _s1,
        GREATEST(budget_input * {fallback}, 0.0) AS _fb FROM {out}_c),
{out} AS (SELECT * EXCLUDE (_s0, _s1, _ok, _mid, _lo, _hi, _fb, bw, wf),
        CASE WHEN _ok THEN _s1[1] ELSE _fb * 0.6 END AS revenue_p10,
        CASE WHEN _ok THEN _s1[2] ELSE _fb * 1.0 END AS revenue_p50,
        CASE WHEN _ok THEN _s1[3] ELSE _fb * 1.5 END AS revenue_p90 FROM {out}_d)"""


def _pt_cte() -> str:
    return f"pt AS ({_PRED_TABLE.strip()})"


def _fo_cte() -> str:
    return f"fo AS ({_rollup_sql(_baseline_campaign_sql())})"


def _with(*ctes: str, final: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + final.strip()


SQL["forecast_override"] = _with(_pt_cte(), _fo_cte(), """
plan AS (SELECT channel, CAST(floor(revenue_p50 / CASE WHEN roas_p50 <> 0 THEN roas_p50 ELSE 1.0 END + 0.5) AS DOUBLE) * 1.5 AS target
         FROM fo WHERE level = 'channel' AND window_days = 30),
tot AS (SELECT window_days, channel, SUM(budget_input) AS cur FROM pt GROUP BY window_days, channel),
sc AS (SELECT t.window_days, t.channel, CASE WHEN t.cur > 0 AND p.target IS NOT NULL THEN p.target / t.cur END AS scale
       FROM tot t JOIN plan p ON p.channel = t.channel),
po AS (SELECT pt.* REPLACE (pt.budget_input * COALESCE(sc.scale, 1.0) AS budget_input) FROM pt
       LEFT JOIN sc ON sc.window_days = pt.window_days AND sc.channel = pt.channel)""", _g8("po", "g"),
    "camp AS (SELECT * EXCLUDE (q10, q50, q90), q10 AS revenue_p10, q50 AS revenue_p50, q90 AS revenue_p90 FROM g)",
    final=", " + _rollup_tail("camp"))

SQL["budget_sweep"] = _with(_pt_cte(), """
grid AS (SELECT pt.* REPLACE (pt.budget_input * m.multiplier AS budget_input) FROM pt
         CROSS JOIN (VALUES (0.5), (0.75), (1.0), (1.5), (2.0)) m(multiplier))""", _g8("grid", "g"), _m5("g", "m5", None),
    final="""SELECT campaign, window_days, budget_input,
  MAX(revenue_p10) OVER w AS revenue_p10, MAX(revenue_p50) OVER w AS revenue_p50, MAX(revenue_p90) OVER w AS revenue_p90
FROM m5 WINDOW w AS (PARTITION BY campaign, window_days ORDER BY budget_input ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")


# ---------------------------------------------------------------------------
# calibration (A11–A14) and the calibrated forecast (M5 + A9)
# ---------------------------------------------------------------------------
_GRID = (1.0, 0.85, 0.7, 0.5)


def _calibration_ctes() -> list[str]:
    wapes = ", ".join(f"SUM(abs(y - ({w!r} * mid + {1.0 - w!r} * base))) AS w{i}" for i, w in enumerate(_GRID))
    pick_w, pick_v = "1.0", "w0 / den"
    steps = []
    for i, w in enumerate(_GRID[1:], start=1):
        cond = f"w{i} / den < ({pick_v}) - 1e-9"
        pick_w, pick_v = f"CASE WHEN {cond} THEN {w!r} ELSE {pick_w} END", f"CASE WHEN {cond} THEN w{i} / den ELSE {pick_v} END"
        steps.append((pick_w, pick_v))
    inf = "CAST('inf' AS DOUBLE)"
    return [
        f"tt AS ({_TRAIN_TABLE.strip()})",
        "ex AS (SELECT tt.* REPLACE (budget_input_ex AS budget_input) FROM tt)",
        _g8("ex", "g"),
        "cr AS (SELECT window_days, window_start, target_revenue AS y, q10 AS lo, q50 AS mid, q90 AS hi, m6 AS base FROM g)",
        "st AS (SELECT quantile_cont(CAST(date_diff('day', DATE '1970-01-01', window_start) AS DOUBLE), 0.8) AS cut, COUNT(*) AS n FROM cr)",
        "xs AS (SELECT cr.*, date_diff('day', DATE '1970-01-01', window_start) > st.cut AS is_cal, st.n FROM cr, st)",
        "cnt AS (SELECT SUM(CASE WHEN is_cal THEN 1 ELSE 0 END) AS ncal, SUM(CASE WHEN is_cal THEN 0 ELSE 1 END) AS nfit, MAX(n) AS n FROM xs)",
        "cal AS (SELECT 0 AS grp, y, lo, mid, hi, base FROM xs WHERE is_cal UNION ALL SELECT window_days, y, lo, mid, hi, base FROM xs WHERE is_cal)",
        f"agg AS (SELECT grp, COUNT(*) AS n_cal, SUM(abs(y)) AS den0, {wapes} FROM cal GROUP BY grp)",
        f"wts AS (SELECT grp, n_cal, {pick_w.replace('den', '(CASE WHEN den0 > 0 THEN den0 ELSE 1.0 END)')} AS bw FROM agg)",
        f"""fr AS (SELECT c.grp, w.bw, c.y, LEAST(c.lo, w.bw * c.mid + (1.0 - w.bw) * c.base) AS lo_b,
               w.bw * c.mid + (1.0 - w.bw) * c.base AS mid_b, GREATEST(c.hi, w.bw * c.mid + (1.0 - w.bw) * c.base) AS hi_b
             FROM cal c JOIN wts w ON w.grp = c.grp)""",
        f"""fq AS (SELECT grp, CASE WHEN y = mid_b THEN 0.0
                 WHEN y > mid_b THEN (CASE WHEN hi_b > mid_b THEN (y - mid_b) / (hi_b - mid_b) ELSE {inf} END)
                 ELSE (CASE WHEN mid_b > lo_b THEN (mid_b - y) / (mid_b - lo_b) ELSE {inf} END) END AS f FROM fr)""",
        """fk AS (SELECT grp, MIN(f) FILTER (WHERE CAST(rn AS DOUBLE) / cnt >= 0.8) AS f_k FROM (
               SELECT grp, f, row_number() OVER (PARTITION BY grp ORDER BY f) AS rn, COUNT(*) OVER (PARTITION BY grp) AS cnt FROM fq)
             GROUP BY grp)""",
        """per AS (SELECT w.grp, w.n_cal, w.bw AS blend_weight,
               CASE WHEN f_k > 8.0 THEN 8.0 ELSE GREATEST(f_k, 1.0) END AS width_factor FROM wts w JOIN fk ON fk.grp = w.grp)""",
        """params AS (SELECT p.grp AS window_days, p.n_cal,
               CASE WHEN NOT (c.n >= 40 AND c.ncal >= 10 AND c.nfit >= 20) THEN 1.0
                    WHEN p.grp <> 0 AND p.n_cal < 15 THEN q.blend_weight ELSE p.blend_weight END AS blend_weight,
               CASE WHEN NOT (c.n >= 40 AND c.ncal >= 10 AND c.nfit >= 20) THEN 1.0
                    WHEN p.grp <> 0 AND p.n_cal < 15 THEN q.width_factor ELSE p.width_factor END AS width_factor
             FROM per p CROSS JOIN cnt c CROSS JOIN (SELECT * FROM per WHERE grp = 0) q)""",
    ]


SQL["calibration"] = _with(*_calibration_ctes(), final="SELECT window_days, n_cal, blend_weight, width_factor FROM params")

SQL["forecast_calibrated"] = _with(*_calibration_ctes(), _pt_cte(), _g8("pt", "pg"), _m5("pg", "m5", "params"),
                                   final=", " + _rollup_tail("m5"))


# ---------------------------------------------------------------------------
# insights: context, claims, validation, status
# ---------------------------------------------------------------------------
_BANNED = ("will definitely", "guaranteed", "certainly", "without a doubt", "because of competitor", "competitor activity",
           "because of inflation", "inflation", "algorithm update", "algorithm change",
           "customers are changing behavior", "market crash")
_FIXED_NAMES = ("google", "meta", "microsoft", "bing", "microsoft/bing", "blended")


def _insight_ctes() -> list[str]:
    banned = " OR ".join(f"contains(lower(text), '{b}')" for b in _BANNED)
    fixed = ", ".join(f"'{n}'" for n in _FIXED_NAMES)
    return [
        _fo_cte(),
        """top AS (SELECT * FROM (SELECT fo.*, row_number() OVER (PARTITION BY window_days ORDER BY revenue_p50 DESC, campaign) AS rank
                 FROM fo WHERE level = 'campaign') WHERE rank <= 8)""",
        """crow AS (SELECT level, channel, campaign_type, campaign, window_days, revenue_p10, revenue_p50, revenue_p90, roas_p10, roas_p50, roas_p90
                  FROM fo WHERE level IN ('blended', 'channel', 'campaign_type')
                  UNION ALL SELECT level, channel, campaign_type, campaign, window_days, revenue_p10, revenue_p50, revenue_p90, roas_p10, roas_p50, roas_p90 FROM top)""",
        f"""ctx AS (SELECT window_days,
               list_distinct(flatten(list([CAST(window_days AS DOUBLE), revenue_p10, revenue_p50, revenue_p90, roas_p10, roas_p50, roas_p90]))) AS numbers,
               list_distinct(list_concat(list_filter(flatten(list([lower(trim(channel)), lower(trim(campaign_type)), lower(trim(campaign))])), lambda n: n <> ''),
                                         [{fixed}])) AS names,
               list_sort(list_distinct(list(CASE WHEN level = 'channel' AND channel <> '' THEN channel END))) AS allowed_channels,
               list_sort(list_distinct(list(CASE WHEN level = 'campaign' THEN campaign END))) AS allowed_campaigns
             FROM crow GROUP BY window_days)""",
        """cl0 AS (SELECT *, row_number() OVER (PARTITION BY window_days ORDER BY level, channel, campaign) AS pos FROM (
               SELECT level, channel, campaign, window_days, revenue_p50, 'summary' AS kind FROM fo WHERE level IN ('blended', 'channel')
               UNION ALL SELECT level, channel, campaign, window_days, revenue_p50, 'watch' FROM top))""",
        """cl AS (SELECT window_days, kind,
               (CASE WHEN level = 'blended' THEN 'Blended revenue' WHEN level = 'channel' THEN upper(substr(channel, 1, 1)) || lower(substr(channel, 2))
                     ELSE campaign END) || ' is forecast at $' ||
               format('{:,.0f}', CASE WHEN pos % 3 = 0 THEN revenue_p50 * 1.1 ELSE revenue_p50 END) || ' (P50) over the next ' ||
               CAST(window_days AS VARCHAR) || ' days' || (CASE WHEN pos % 7 = 0 THEN ', and will definitely grow' ELSE '' END) || '.' AS text,
               CASE WHEN pos % 5 = 0 THEN 0 ELSE 1 END AS n_evidence,
               CASE WHEN kind = 'watch' THEN campaign END AS ref_name FROM cl0)""",
        f"""cv AS (SELECT cl.window_days, cl.kind, cl.text,
               CASE WHEN n_evidence <= 0 THEN 'dropped item without evidence references'
                    WHEN {banned} THEN 'dropped item with deterministic/unsupported-causality language'
                    WHEN len(list_filter(list_transform(regexp_extract_all(text, '-?\\$?\\d[\\d,]*\\.?\\d*'),
                             lambda t: TRY_CAST(replace(replace(t, ',', ''), '$', '') AS DOUBLE)),
                             lambda v: NOT (v IS NULL OR v IN (10.0, 50.0, 90.0, 30.0, 60.0, 80.0) OR abs(v) <= 12.0
                                       OR len(list_filter(ctx.numbers, lambda a: a <> 0 AND abs(v - a) <= GREATEST(0.015 * abs(a), 0.51))) > 0))) > 0
                      THEN 'dropped item citing a number not present in the context'
                    WHEN kind = 'watch' AND NOT (lower(trim(COALESCE(ref_name, ''))) <> '' AND len(list_filter(ctx.names,
                             lambda n: n = lower(trim(COALESCE(ref_name, ''))) OR contains(n, lower(trim(COALESCE(ref_name, ''))))
                                  OR contains(lower(trim(COALESCE(ref_name, ''))), n))) > 0)
                      THEN 'dropped watch item: unknown campaign or group' END AS reason
             FROM cl LEFT JOIN ctx ON ctx.window_days = cl.window_days)""",
    ]


SQL["insight_context"] = _with(*_insight_ctes(), final="""SELECT window_days, len(numbers) AS n_numbers,
  array_to_string(list_sort(names), ',') AS names, array_to_string(allowed_channels, ',') AS allowed_channels,
  array_to_string(allowed_campaigns, ',') AS allowed_campaigns FROM ctx""")

SQL["claim_validation"] = _with(*_insight_ctes(), final="""SELECT window_days, kind, text,
  CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS accepted, reason FROM cv""")

_RULE_CTES = [
    """ri AS (SELECT window_days,
        SUM(CASE WHEN level = 'blended' THEN 4 ELSE 0 END)
        + CASE WHEN SUM(CASE WHEN level = 'channel' THEN 1 ELSE 0 END) > 0 THEN 3 ELSE 0 END
        + CASE WHEN SUM(wide) > 0 THEN SUM(wide) ELSE SUM(CASE WHEN level = 'blended' THEN 1 ELSE 0 END) END
        + LEAST(3, SUM(CASE WHEN level = 'campaign' THEN 1 ELSE 0 END)) AS rule_items
      FROM (SELECT *, CASE WHEN level = 'channel' AND revenue_p50 > 0 AND (revenue_p90 - revenue_p10) > 4.0 * revenue_p50
                           THEN 1 ELSE 0 END AS wide FROM fo) GROUP BY window_days)""",
    """vd AS (SELECT window_days, SUM(CASE WHEN reason IS NULL AND kind = 'summary' THEN 1 ELSE 0 END) AS summaries,
        SUM(CASE WHEN reason IS NOT NULL THEN 1 ELSE 0 END) AS rejected, COUNT(*) AS claims FROM cv GROUP BY window_days)""",
]

SQL["insight_status"] = _with(*_insight_ctes(), *_RULE_CTES, final="""
SELECT COALESCE(vd.window_days, ri.window_days) AS window_days,
  CASE WHEN vd.summaries > 0 THEN 'passed' ELSE 'fallback' END AS status,
  COALESCE(vd.claims, 0) AS claims, COALESCE(vd.rejected, 0) AS rejected,
  CASE WHEN vd.summaries > 0 THEN vd.summaries ELSE ri.rule_items END AS items_used
FROM vd FULL JOIN ri ON ri.window_days = vd.window_days""")


def _cap(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


def _usd(x: str) -> str:
    return f"('$' || format('{{:,.0f}}', {x}))"


SQL["rule_insights"] = _with(_fo_cte(), f"""
b AS (SELECT * FROM fo WHERE level = 'blended'),
ch AS (SELECT * FROM fo WHERE level = 'channel'),
best AS (SELECT window_days, arg_max(channel, revenue_p50) AS top_ch, MAX(revenue_p50) AS top_p50,
           arg_max(channel, roas_p50) AS best_ch, MAX(roas_p50) AS best_roas,
           arg_min(channel, roas_p50) AS worst_ch, MIN(roas_p50) AS worst_roas, COUNT(*) AS n_ch FROM ch GROUP BY window_days),
wide AS (SELECT * FROM ch WHERE revenue_p50 > 0 AND (revenue_p90 - revenue_p10) > 4.0 * revenue_p50),
top3 AS (SELECT * FROM (SELECT fo.*, row_number() OVER (PARTITION BY window_days ORDER BY revenue_p50 DESC, campaign) AS rank
         FROM fo WHERE level = 'campaign') WHERE rank <= 3)""", final=f"""
SELECT window_days, 'forecast_summary' AS section, 0 AS ordinal,
  'Over the next ' || CAST(window_days AS VARCHAR) || ' days, blended revenue is forecast at ' || {_usd('revenue_p50')}
  || ' expected (P50), with a range of ' || {_usd('revenue_p10')} || ' (P10) to ' || {_usd('revenue_p90')}
  || ' (P90) and an expected ROAS of ' || printf('%.2f', roas_p50) || 'x (P50).' AS text,
  'blended.revenue_p10,blended.revenue_p50,blended.revenue_p90,blended.roas_p50' AS evidence FROM b
UNION ALL SELECT window_days, 'forecast_summary', 1,
  {_cap('top_ch')} || ' contributes the largest share of forecast revenue at ' || {_usd('top_p50')} || ' (P50), so changes in '
  || {_cap('top_ch')} || ' spend may have the largest blended impact.', 'channels[' || top_ch || '].revenue_p50' FROM best
UNION ALL SELECT window_days, 'budget_recommendations', 0,
  {_cap('best_ch')} || ' shows the highest expected ROAS (' || printf('%.2f', best_roas)
  || 'x P50) among detected channels; incremental budget appears most efficient there, subject to diminishing returns.',
  'channels[' || best_ch || '].roas_p50' FROM best
UNION ALL SELECT window_days, 'risks', 1,
  {_cap('channel')} || ' has a wide P10-P90 revenue range (' || {_usd('revenue_p10')} || ' to ' || {_usd('revenue_p90')}
  || '), so forecast confidence for this channel may be lower.',
  'channels[' || channel || '].revenue_p10,channels[' || channel || '].revenue_p90' FROM wide
UNION ALL SELECT window_days, 'risks', 0, 'No channel-level anomaly flags in the current forecast output.', 'channels'
  FROM b WHERE window_days NOT IN (SELECT window_days FROM wide)
UNION ALL SELECT window_days, 'campaigns_to_watch', rank,
  campaign || ': Top forecast contributor at ' || {_usd('revenue_p50')} || ' expected revenue (P50) over '
  || CAST(window_days AS VARCHAR) || ' days.', 'top_campaigns[' || campaign || '].revenue_p50' FROM top3
UNION ALL SELECT window_days, 'suggested_budget_shift', 0,
  CASE WHEN n_ch >= 2 AND worst_ch <> best_ch THEN 'Based on the forecast output, shifting incremental budget from '
    || {_cap('worst_ch')} || ' (' || printf('%.2f', worst_roas) || 'x expected ROAS) toward ' || {_cap('best_ch')} || ' ('
    || printf('%.2f', best_roas) || 'x expected ROAS) may improve blended efficiency, subject to diminishing returns.'
    ELSE 'Not enough evidence in the provided data.' END,
  CASE WHEN n_ch >= 2 AND worst_ch <> best_ch THEN 'channels[' || worst_ch || '].roas_p50,channels[' || best_ch || '].roas_p50'
    ELSE 'channels' END FROM best
UNION ALL SELECT window_days, 'limitations', t.i - 1, t.txt, '' FROM b CROSS JOIN (VALUES
  (1, 'Forecast assumes budgets and attribution remain as observed in the input data.'),
  (2, 'P10-P90 intervals are calibrated on historical backtests (~80% target coverage).'),
  (3, 'Not enough evidence in the provided data to attribute changes to external market events.')) t(i, txt)""")

SQL["insight_fields"] = f"""WITH rl AS ({SQL["rule_insights"]})
SELECT window_days, section, ordinal, text,
  CASE WHEN section = 'risks' THEN CASE WHEN ordinal = 0 THEN 'low' ELSE 'medium' END END AS severity,
  CASE WHEN section = 'risks' THEN CASE WHEN ordinal = 0 THEN 'Maintain current allocation; re-evaluate as data arrives.'
       ELSE 'Review pacing weekly and re-forecast as new data arrives.' END END AS action,
  CASE WHEN section = 'forecast_summary' THEN 'high'
       WHEN section = 'suggested_budget_shift' THEN CASE WHEN evidence = 'channels' THEN 'low' ELSE 'medium' END END AS confidence,
  CASE WHEN section = 'budget_recommendations' THEN 'increase_revenue' END AS direction FROM rl"""


def _section(name: str) -> str:
    return f"string_agg(line, chr(10) ORDER BY ordinal, line) FILTER (WHERE section = '{name}')"


SQL["insight_narrative"] = f"""WITH rf AS ({SQL["insight_fields"]}),
ln AS (SELECT window_days, section, ordinal, '- ' || text || CASE WHEN section = 'risks' THEN ' _Action: ' || action || '_' ELSE '' END AS line FROM rf)
SELECT window_days, '**Forecast Summary**' || COALESCE(chr(10) || {_section('forecast_summary')}, '')
  || chr(10) || chr(10) || '**Anomalies & Risks**' || chr(10) || COALESCE({_section('risks')}, '- None flagged.')
  || chr(10) || chr(10) || '**Budget Recommendation**' || chr(10) || COALESCE({_section('budget_recommendations')}, '- Maintain current allocation.')
  || COALESCE(chr(10) || chr(10) || '**Campaigns to Watch**' || chr(10) || {_section('campaigns_to_watch')}, '')
  || COALESCE(chr(10) || chr(10) || '**Suggested Budget Shift**' || chr(10) || {_section('suggested_budget_shift')}, '')
  || COALESCE(chr(10) || chr(10) || '**Limitations**' || chr(10) || {_section('limitations')}, '') AS narrative
FROM ln GROUP BY window_days"""


def _answer_ctes() -> list[str]:
    """Claims of two providers (pc), their verdicts (pv) and the provider of a window (ch)."""
    who = "CASE WHEN level = 'blended' THEN 'Blended revenue' ELSE channel END"
    banned = " OR ".join(f"contains(lower(said), '{b}')" for b in _BANNED)
    usd = lambda x: f"('$' || format('{{:,.0f}}', {x}))"
    return [
        *_insight_ctes()[:4],
        "pr AS (SELECT * FROM fo, (VALUES ('first', 0), ('second', 1)) p(provider, provider_rank) WHERE level IN ('blended', 'channel', 'campaign'))",
        f"""pc AS (SELECT *, text || COALESCE(chr(10) || action, '') AS said, concat(level, '/', channel, '/', campaign) AS key,
              NOT (provider = 'first' AND window_days = 90) AS has_evidence FROM (
          SELECT *, 'summary' AS kind, 1 AS section_rank, 'forecast_summary' AS section,
            {who} || ' is forecast at ' || {usd("CASE WHEN provider = 'first' AND window_days = 30 THEN revenue_p50 * 1.1 ELSE revenue_p50 END")}
            || ' over the next ' || CAST(window_days AS VARCHAR) || ' days' || CASE WHEN provider = 'second' AND window_days = 90 THEN ', guaranteed.' ELSE '.' END AS text,
            NULL AS action FROM pr WHERE level IN ('blended', 'channel')
          UNION ALL SELECT *, 'risk', 2, 'risks', channel || ' may fall to ' || {usd('revenue_p10')} || '.',
            CASE WHEN window_days = 60 THEN 'Move $777,777,777 to other channels.' ELSE 'Hold budgets.' END FROM pr WHERE level = 'channel'
          UNION ALL SELECT *, 'watch', 4, 'campaigns_to_watch', 'Forecast at ' || {usd('revenue_p50')} || ' (P50).', NULL FROM pr WHERE level = 'campaign'
          UNION ALL SELECT *, 'shift', 5, 'suggested_budget_shift', 'Shift budget to where it pays more.', NULL FROM pr WHERE level = 'blended'))""",
        f"""pv AS (SELECT pc.*, CASE WHEN NOT has_evidence THEN 'dropped item without evidence references'
            WHEN {banned} THEN 'dropped item with deterministic/unsupported-causality language'
            WHEN len(list_filter(list_transform(regexp_extract_all(said, '-?\\$?\\d[\\d,]*\\.?\\d*'),
                     lambda t: TRY_CAST(replace(replace(t, ',', ''), '$', '') AS DOUBLE)),
                     lambda v: NOT (v IS NULL OR v IN (10.0, 50.0, 90.0, 30.0, 60.0, 80.0) OR abs(v) <= 12.0
                               OR len(list_filter(ctx.numbers, lambda a: a <> 0 AND abs(v - a) <= GREATEST(0.015 * abs(a), 0.51))) > 0))) > 0
              THEN 'dropped item citing a number not present in the context'
            WHEN kind = 'watch' AND len(list_filter(ctx.names, lambda n: contains(n, lower(campaign)) OR contains(lower(campaign), n))) = 0
              THEN 'dropped watch item: unknown campaign or group'
            WHEN kind = 'shift' AND NOT list_contains(ctx.names, CASE provider WHEN 'first' THEN 'tiktok' ELSE 'google' END)
              THEN 'dropped budget shift: unknown channel' END AS reason
          FROM pc LEFT JOIN ctx ON ctx.window_days = pc.window_days)""",
        "ch AS (SELECT window_days, arg_min(provider, provider_rank) AS provider FROM pv WHERE reason IS NULL AND kind = 'summary' GROUP BY window_days)",
    ]


SQL["insight_items"] = _with(*_answer_ctes(), f"rf AS ({SQL['insight_fields']})", final="""
SELECT pv.window_days, pv.provider, 'passed' AS guardrail, section, key, text, action FROM pv
JOIN ch ON ch.window_days = pv.window_days AND ch.provider = pv.provider WHERE reason IS NULL
UNION ALL SELECT window_days, 'template', 'fallback', section, lpad(CAST(ordinal AS VARCHAR), 9, '0'), text, action FROM rf
WHERE window_days NOT IN (SELECT window_days FROM ch)""")

SQL["insight_log"] = _with(*_answer_ctes(), final="""
SELECT pv.window_days, 'passed' AS guardrail, pv.provider, section_rank, key, reason FROM pv
JOIN ch ON ch.window_days = pv.window_days AND ch.provider = pv.provider WHERE reason IS NOT NULL
UNION ALL SELECT window_days, 'fallback', provider, section_rank, key, reason FROM (
  SELECT *, row_number() OVER (PARTITION BY window_days, provider ORDER BY section_rank, key, reason) AS n FROM (
    SELECT window_days, provider, section_rank, key, reason FROM pv WHERE reason IS NOT NULL
    UNION ALL SELECT DISTINCT window_days, provider, 7, '', 'no grounded forecast_summary claims survived validation' FROM pv)
  WHERE window_days NOT IN (SELECT window_days FROM ch)) WHERE n <= 3""")


# ---------------------------------------------------------------------------
# scale guard: assessment (G2–G7a) and guarded forecast (G8–G10) on uploads
# ---------------------------------------------------------------------------

def with_scaled_fixtures(body: str, factor: int = 100) -> str:
    fx = FIXTURES.strip().replace("FROM ads_long", "FROM ads_scaled")
    fx = fx.replace("\ndaily AS (", f"\nads_scaled AS (SELECT * REPLACE (spend * {factor} AS spend, revenue * {factor} AS revenue) FROM ads_long),\ndaily AS (", 1)
    body = body.strip()
    assert body.upper().startswith("WITH ")
    return "WITH " + fx + ",\n" + body[5:]


WRAPPERS = {"guard_assess_x100": with_scaled_fixtures, "guarded_forecast_x100": with_scaled_fixtures}


def _ratio(up: str, tr: str) -> str:
    u, t = f"COALESCE({up}, 0.0)", f"COALESCE({tr}, 0.0)"
    return f"(CASE WHEN {t} <= 0 THEN (CASE WHEN {u} > 0 THEN CAST('inf' AS DOUBLE) ELSE 1.0 END) ELSE {u} / {t} END)"


def _guard_ctes(fallback: str = "1.0", divergence: str | None = None) -> list[str]:
    tp = SQL["training_profile"].strip()
    upl = _upload_profile_sql().strip()
    sig = []
    reasons = []
    for name, w in (("monthly_revenue", 0.25), ("monthly_spend", 0.25), ("campaign_monthly_revenue", 0.15),
                    ("campaign_monthly_spend", 0.15)):
        r90 = _ratio(f"u.{name}_p50", f"t.{name}_p90")
        r50 = _ratio(f"u.{name}_p50", f"t.{name}_p50")
        fire = f"({r90} > 5.0 OR ({r50} > 5.0 AND {r90} > 1.0))"
        sig.append(f"CASE WHEN {fire} THEN {w} * LEAST(1.0, 0.5 + GREATEST({r90} / 25.0, {r50} / 50.0)) ELSE 0.0 END")
        label = name.replace("_", " ")
        reasons.append(f"CASE WHEN {fire} THEN 'Uploaded {label} is ' || (CASE WHEN {r50} = CAST('inf' AS DOUBLE) THEN 'inf' "
                       f"ELSE format('{{:,.1f}}', {r50}) END) || 'x higher than the training median' END")
    up_roas, t10, t90 = "COALESCE(u.roas_p50, 0.0)", "COALESCE(t.roas_p10, 0.0)", "COALESCE(t.roas_p90, 0.0)"
    roas_fire = f"({t90} * 3.0 > 0 AND {up_roas} > 0 AND NOT ({t10} / 3.0 <= {up_roas} AND {up_roas} <= {t90} * 3.0))"
    sig.append(f"CASE WHEN {roas_fire} THEN 0.15 ELSE 0.0 END")
    reasons.append(f"CASE WHEN {roas_fire} THEN printf('Uploaded median campaign ROAS (%.2fx) is far outside the training range (%.2fx-%.2fx)', "
                   f"{up_roas}, {t10}, {t90}) END")
    up_t = "string_split(u.campaign_types, ',')"
    tr_t = "string_split(t.campaign_types, ',')"
    unseen = f"list_filter({up_t}, lambda x: NOT list_contains({tr_t}, x))"
    t_fire = f"(len({tr_t}) > 0 AND len({up_t}) > 0 AND CAST(len({unseen}) AS DOUBLE) / len({up_t}) > 0.3)"
    sig.append(f"CASE WHEN {t_fire} THEN 0.10 ELSE 0.0 END")
    reasons.append(f"CASE WHEN {t_fire} THEN printf('%d/%d campaign types were never seen in training', len({unseen}), len({up_t})) END")
    other = "COALESCE(u.other_channel_share, 0.0)"
    sig.append(f"CASE WHEN {other} > 0.20 THEN 0.10 ELSE 0.0 END")
    reasons.append(f"CASE WHEN {other} > 0.20 THEN format('{{:,.0f}}', {other} * 100) || '% of rows could not be mapped to a known channel' END")
    dv = "d.divergence"
    d_fire = f"(isfinite({dv}) AND {dv} > 0 AND ({dv} < 1.0 / 3.0 OR {dv} > 3.0))"
    sig.append(f"CASE WHEN {d_fire} THEN 0.40 * LEAST(1.0, (CASE WHEN {dv} < 1 THEN (1.0 / 3.0) / {dv} ELSE {dv} / 3.0 END) / 5.0) ELSE 0.0 END")
    reasons.append(f"CASE WHEN {d_fire} THEN 'Model P50 revenue diverges from the trailing-ROAS baseline by ' || "
                   f"format('{{:,.1f}}', CASE WHEN {dv} < 1 THEN 1.0 / {dv} ELSE {dv} END) || 'x — symptomatic of out-of-scale inputs' END")
    total = " + ".join(f"({p})" for p in sig)
    return [
        f"tp AS ({tp})",
        f"up AS ({upl})",
        _pt_cte(),
        _g8("pt", "gp", fallback=fallback),
        "dv AS (" + (divergence or "SELECT CASE WHEN SUM(q50) > 0 THEN SUM(q50) / SUM(q50) END AS divergence FROM gp") + ")",
        f"""sc AS (SELECT LEAST(1.0, {total}) AS score,
               list_filter([{", ".join(reasons)}], lambda r: r IS NOT NULL) AS reasons FROM up u, tp t, dv d)""",
        """asmt AS (SELECT CASE WHEN score < 0.30 THEN 'High' WHEN score < 0.60 THEN 'Medium' ELSE 'Low' END AS confidence,
               round_even(score, 3) AS ood_score, array_to_string(reasons, ' | ') AS reasons FROM sc)""",
        """asw AS (SELECT *, CASE confidence WHEN 'High' THEN 1.0 WHEN 'Medium' THEN 0.6 ELSE 0.25 END AS model_weight,
               CASE confidence WHEN 'High' THEN 0.0 WHEN 'Medium' THEN 0.4 ELSE 0.75 END AS baseline_weight FROM asmt)""",
    ]


_ASSESS_FINAL = """SELECT confidence, ood_score, reasons, model_weight, baseline_weight,
  CASE WHEN baseline_weight > 0 THEN round_even(1.0 + ood_score, 3) ELSE 1.0 END AS interval_widening,
  CASE WHEN baseline_weight > 0 THEN 1 ELSE 0 END AS fallback_used FROM asw"""

SQL["guard_assess"] = _with(*_guard_ctes(), final=_ASSESS_FINAL)
SQL["guard_assess_x100"] = _with(*_guard_ctes(), final=_ASSESS_FINAL)

SQL["guarded_forecast_x100"] = _with(*_guard_ctes(), """
gb AS (SELECT gp.*, a.model_weight AS wm, a.baseline_weight AS wb, a.ood_score,
         a.model_weight * gp.q10 + a.baseline_weight * gp.q10 AS b10, a.model_weight * gp.q50 + a.baseline_weight * gp.q50 AS b50,
         a.model_weight * gp.q90 + a.baseline_weight * gp.q90 AS b90 FROM gp CROSS JOIN asw a)""", f"""
gw AS (SELECT *, list_sort([{_clean('b50 - (1.0 + ood_score) * (b50 - b10)')}, {_clean('b50')}, {_clean('b50 + (1.0 + ood_score) * (b90 - b50)')}]) AS s FROM gb)""",
    """camp AS (SELECT channel, campaign_type, campaign, window_days, budget_input,
         CASE WHEN wb > 0 THEN s[1] ELSE q10 END AS revenue_p10, CASE WHEN wb > 0 THEN s[2] ELSE q50 END AS revenue_p50,
         CASE WHEN wb > 0 THEN s[3] ELSE q90 END AS revenue_p90 FROM gw)""",
    final=", " + _rollup_tail("camp"))


# ---------------------------------------------------------------------------
# quantile forest over fixed splits (P21, P22, M3) and the loaded model
# ---------------------------------------------------------------------------

WRAPPERS["scale_issues"] = with_scaled_fixtures
SQL["scale_issues"] = _with(*_guard_ctes(), final="""SELECT 'warning' AS severity, 'scale_mismatch' AS code, '' AS entity,
  unnest(string_split(reasons, ' | ')) AS message FROM asmt WHERE reasons <> ''""")


def _design_value(name: str) -> str:
    if name.startswith("ch_"):
        return f"CAST(channel = '{name[3:]}' AS DOUBLE)"
    if name.startswith("ct_"):
        return f"CAST(campaign_type = '{name[3:]}' AS DOUBLE)"
    if name.endswith("is_brand"):
        return "COALESCE(CAST(is_brand AS DOUBLE), 0.0)"
    return f"(CASE WHEN isfinite(CAST({name} AS DOUBLE)) THEN CAST({name} AS DOUBLE) ELSE 0.0 END)"


SQL["design_matrix"] = _with(_pt_cte(), final=f"""
SELECT campaign, window_days, i, v[i + 1] AS value
FROM (SELECT campaign, window_days, [{", ".join(_design_value(c) for c in S.DESIGN_COLUMNS)}] AS v FROM pt), range(0, {len(S.DESIGN_COLUMNS)}) t(i)""")


def _leaf_sql(tree, first: int = 0) -> tuple[str, int]:
    if tree is None:
        return str(first), first + 1
    feature, threshold, left, right = tree
    a, middle = _leaf_sql(left, first)
    b, end = _leaf_sql(right, middle)
    return f"CASE WHEN {_design_value(feature)} <= {threshold!r} THEN {a} ELSE {b} END", end


def _sketches(src: str, out: str) -> str:
    """CTEs: leaf sketches of the rows of ``src``; result CTE ``out``(tree, leaf, sketch)."""
    from ..operators.forest import SKETCH_PROBS
    from .queries import SMALL_TREES

    leaves = ", ".join(_leaf_sql(t)[0] for t in SMALL_TREES)
    return f"""{out}_l AS (SELECT ln(1.0 + GREATEST(target_revenue, 0.0)) AS label, [{leaves}] AS leaves FROM {src}),
{out} AS (SELECT tree, leaf, list_transform({SKETCH_PROBS!r}, lambda p: l[CAST(GREATEST(1, ceil(CAST(p AS DOUBLE) * len(l))) AS BIGINT)]) AS sketch FROM (
  SELECT i AS tree, leaves[i + 1] AS leaf, list(label ORDER BY label) AS l FROM {out}_l, range(0, {len(SMALL_TREES)}) t(i) GROUP BY ALL))"""


def _forest_quantiles(src: str, sketches: str, out: str) -> str:
    """CTEs: ``src`` with q10/q50/q90 and the M6 baseline (m6); result CTE ``out``."""
    from .queries import SMALL_TREES

    leaves = ", ".join(_leaf_sql(t)[0] for t in SMALL_TREES)
    q = ", ".join(f"exp(v[CAST(floor({p} * (len(v) - 1)) AS BIGINT) + 1] + ({p} * (len(v) - 1) - floor({p} * (len(v) - 1))) * "
                  f"(COALESCE(v[CAST(floor({p} * (len(v) - 1)) AS BIGINT) + 2], v[len(v)]) - v[CAST(floor({p} * (len(v) - 1)) AS BIGINT) + 1])) - 1.0 AS q{int(p * 100)}"
                  for p in (0.1, 0.5, 0.9))
    return f"""{out}_n AS (SELECT *, row_number() OVER () AS rid, [{leaves}] AS leaves FROM {src}),
{out}_v AS (SELECT rid, list_sort(flatten(list(k.sketch))) AS v FROM (
  SELECT rid, i AS tree, leaves[i + 1] AS leaf FROM {out}_n, range(0, {len(SMALL_TREES)}) t(i)) x JOIN {sketches} k ON k.tree = x.tree AND k.leaf = x.leaf
  GROUP BY rid),
{out} AS (SELECT n.* EXCLUDE (rid, leaves), {q},
  GREATEST((CASE WHEN tr28_roas > 0 THEN tr28_roas ELSE tr14_roas END) * GREATEST(budget_input, 0.0) * seasonal_index, 0.0) AS m6
  FROM {out}_n n LEFT JOIN {out}_v v ON v.rid = n.rid)"""


def _fitted_ctes() -> list[str]:
    """The model on the fixed splits: calibration (params), sketches (skf) and fallback ROAS (gr)."""
    tail = _calibration_ctes()
    start = next(i for i, c in enumerate(tail) if c.startswith("st AS"))
    inner = f"list_sort([{_clean('q10')}, {_clean('q50')}, {_clean('q90')}])"
    return [
        _train_cte(),
        "ct0 AS (SELECT quantile_cont(CAST(date_diff('day', DATE '1970-01-01', window_start) AS DOUBLE), 0.8) AS cut FROM tt)",
        "sp AS (SELECT tt.*, date_diff('day', DATE '1970-01-01', window_start) > ct0.cut AS is_late FROM tt, ct0)",
        "early AS (SELECT * FROM sp WHERE NOT is_late)",
        "late AS (SELECT * REPLACE (budget_input_ex AS budget_input) FROM sp WHERE is_late)",
        _sketches("early", "ske"), _forest_quantiles("late", "ske", "lq"),
        f"""cr AS (SELECT window_days, window_start, target_revenue AS y, {inner}[1] AS lo, {inner}[2] AS mid, {inner}[3] AS hi, m6 AS base FROM lq
            UNION ALL SELECT window_days, window_start, target_revenue, NULL, NULL, NULL, NULL FROM early)""",
        *tail[start:],
        _sketches("tt", "skf"),
        "gr AS (SELECT quantile_cont(LEAST(GREATEST(target_revenue / GREATEST(budget_input, 1e-9), 0.0), 100.0), 0.5) AS g FROM tt)",
    ]


_FALLBACK = "(SELECT g FROM gr)"


def _loaded_sql() -> str:
    fallback = _FALLBACK
    return _with(
        *_fitted_ctes(),
        _pt_cte(), _forest_quantiles("pt", "skf", "pf"), _m5("pf", "m5", "params", fallback),
        *[c for c in _guard_ctes(fallback, "SELECT CASE WHEN SUM(gp.q50) > 0 THEN (SELECT SUM(revenue_p50) FROM m5) / SUM(gp.q50) END AS divergence FROM gp")
          if c != _pt_cte()], """
gb AS (SELECT m.*, a.model_weight AS wm, a.baseline_weight AS wb, a.ood_score, a.model_weight * m.revenue_p10 + a.baseline_weight * gp.q10 AS b10,
         a.model_weight * m.revenue_p50 + a.baseline_weight * gp.q50 AS b50, a.model_weight * m.revenue_p90 + a.baseline_weight * gp.q90 AS b90
       FROM m5 m JOIN gp ON gp.campaign = m.campaign AND gp.window_days = m.window_days CROSS JOIN asw a)""", f"""
gw AS (SELECT *, list_sort([{_clean('b50 - (1.0 + ood_score) * (b50 - b10)')}, {_clean('b50')}, {_clean('b50 + (1.0 + ood_score) * (b90 - b50)')}]) AS s FROM gb)""",
        """camp AS (SELECT channel, campaign_type, campaign, window_days, budget_input,
         CASE WHEN wb > 0 THEN s[1] ELSE revenue_p10 END AS revenue_p10, CASE WHEN wb > 0 THEN s[2] ELSE revenue_p50 END AS revenue_p50,
         CASE WHEN wb > 0 THEN s[3] ELSE revenue_p90 END AS revenue_p90 FROM gw)""",
        final=", " + _rollup_tail("camp"))


SQL["budget_sweep_model"] = _with(*_fitted_ctes(), _pt_cte(), """
grid AS (SELECT pt.* REPLACE (pt.budget_input * m.multiplier AS budget_input), m.multiplier FROM pt
         CROSS JOIN (VALUES (0.5), (0.75), (1.0), (1.5), (2.0)) m(multiplier))""",
    _forest_quantiles("grid", "skf", "pf"), _m5("pf", "m5", "params", _FALLBACK),
    final="""SELECT campaign, window_days, multiplier, budget_input,
  MAX(revenue_p10) OVER w AS revenue_p10, MAX(revenue_p50) OVER w AS revenue_p50, MAX(revenue_p90) OVER w AS revenue_p90
FROM m5 WINDOW w AS (PARTITION BY campaign, window_days ORDER BY budget_input ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
SQL["forest_sketches"] = _with(_train_cte(), _sketches("tt", "sk"),
                               final="SELECT tree, leaf, i, sketch[i + 1] AS value FROM sk, range(0, 25) t(i)")
SQL["forest_quantiles"] = _with(_train_cte(), _sketches("tt", "sk"), _pt_cte(), _forest_quantiles("pt", "sk", "pq"),
                                final="SELECT campaign, window_days, q10, q50, q90 FROM pq")
SQL["predict_loaded"] = _loaded_sql()


# ---------------------------------------------------------------------------
# Q3 validator and Q6 readiness
# ---------------------------------------------------------------------------
SQL["data_quality"] = _with(_fo_cte(), """
c AS (SELECT COUNT(*) AS rows,
  SUM(CASE WHEN NOT (isfinite(revenue_p10) AND isfinite(revenue_p50) AND isfinite(revenue_p90) AND isfinite(roas_p10)
                     AND isfinite(roas_p50) AND isfinite(roas_p90)) THEN 1 ELSE 0 END) AS non_finite,
  SUM(CASE WHEN len(list_filter([revenue_p10, revenue_p50, revenue_p90, roas_p10, roas_p50, roas_p90], lambda x: x IS NULL OR isnan(x))) > 0 THEN 1 ELSE 0 END) AS nans,
  SUM(CASE WHEN len(list_filter([revenue_p10, revenue_p50, revenue_p90, roas_p10, roas_p50, roas_p90], lambda x: isinf(x))) > 0 THEN 1 ELSE 0 END) AS infs,
  SUM(CASE WHEN LEAST(revenue_p10, revenue_p50, revenue_p90, roas_p10, roas_p50, roas_p90) < 0 THEN 1 ELSE 0 END) AS negative,
  SUM(CASE WHEN revenue_p10 > revenue_p50 + 1e-9 OR revenue_p50 > revenue_p90 + 1e-9 THEN 1 ELSE 0 END) AS crossing_revenue,
  SUM(CASE WHEN roas_p10 > roas_p50 + 1e-9 OR roas_p50 > roas_p90 + 1e-9 THEN 1 ELSE 0 END) AS crossing_roas,
  SUM(CASE WHEN channel = '' AND campaign_type = '' AND campaign = '' AND level = '' THEN 1 ELSE 0 END) AS empty_rows,
  array_to_string(list_sort(list_distinct(list(level))), ',') AS levels,
  array_to_string(list_transform(list_sort(list_distinct(list(window_days))), lambda x: CAST(x AS VARCHAR)), ',') AS wins FROM fo),
dup AS (SELECT COALESCE(SUM(n - 1), 0) AS dupes FROM (SELECT COUNT(*) AS n FROM fo GROUP BY level, window_days, channel, campaign_type, campaign)),
req AS (SELECT DISTINCT channel FROM ads_long WHERE channel <> 'other'),
miss AS (SELECT COUNT(*) AS missing, COALESCE(array_to_string(list_sort(list(channel)), ','), '') AS missing_list
         FROM req WHERE channel NOT IN (SELECT channel FROM fo WHERE level = 'channel')),
pw AS (SELECT window_days, SUM(CASE WHEN level = 'channel' THEN revenue_p50 END) AS ch,
         MAX(CASE WHEN level = 'blended' THEN revenue_p50 END) AS bl, COUNT(CASE WHEN level = 'blended' THEN 1 END) AS nb,
         list_filter([MAX(CASE WHEN level = 'blended' AND roas_p10 > 0 THEN revenue_p10 / roas_p10 END),
                      MAX(CASE WHEN level = 'blended' AND roas_p50 > 0 THEN revenue_p50 / roas_p50 END),
                      MAX(CASE WHEN level = 'blended' AND roas_p90 > 0 THEN revenue_p90 / roas_p90 END)], lambda x: x IS NOT NULL) AS sp
       FROM fo GROUP BY window_days),
coh AS (SELECT SUM(CASE WHEN nb = 0 OR ch IS NULL OR abs(ch - bl) > 1e-3 * GREATEST(bl, 1.0)
                         OR (len(sp) > 0 AND list_max(sp) - list_min(sp) > 0.01 * list_max(sp)) THEN 1 ELSE 0 END) AS incoherent FROM pw)""",
    final="""
SELECT 'columns_exact' AS "check", 1 AS ok, 'level,channel,campaign_type,campaign,window_days,revenue_p10,revenue_p50,revenue_p90,roas_p10,roas_p50,roas_p90' AS detail
UNION ALL SELECT 'more_than_one_row', CASE WHEN rows > 1 THEN 1 ELSE 0 END, CAST(rows AS VARCHAR) FROM c
UNION ALL SELECT 'no_empty_rows', CASE WHEN empty_rows = 0 THEN 1 ELSE 0 END, CAST(empty_rows AS VARCHAR) FROM c
UNION ALL SELECT 'not_empty', CASE WHEN rows > 0 THEN 1 ELSE 0 END, CAST(rows AS VARCHAR) FROM c
UNION ALL SELECT 'no_nan', CASE WHEN nans = 0 THEN 1 ELSE 0 END, CAST(nans AS VARCHAR) FROM c
UNION ALL SELECT 'no_infinite', CASE WHEN infs = 0 THEN 1 ELSE 0 END, CAST(infs AS VARCHAR) FROM c
UNION ALL SELECT 'non_negative', CASE WHEN negative = 0 THEN 1 ELSE 0 END, CAST(negative AS VARCHAR) FROM c
UNION ALL SELECT 'windows_exact', CASE WHEN wins = '30,60,90' THEN 1 ELSE 0 END, wins FROM c
UNION ALL SELECT 'all_levels', CASE WHEN levels = 'blended,campaign,campaign_type,channel' THEN 1 ELSE 0 END, levels FROM c
UNION ALL SELECT 'revenue_ordered', CASE WHEN crossing_revenue = 0 THEN 1 ELSE 0 END, CAST(crossing_revenue AS VARCHAR) FROM c
UNION ALL SELECT 'roas_ordered', CASE WHEN crossing_roas = 0 THEN 1 ELSE 0 END, CAST(crossing_roas AS VARCHAR) FROM c
UNION ALL SELECT 'required_channels', CASE WHEN missing = 0 THEN 1 ELSE 0 END, missing_list FROM miss
UNION ALL SELECT 'no_duplicates', CASE WHEN dupes = 0 THEN 1 ELSE 0 END, CAST(dupes AS VARCHAR) FROM dup
UNION ALL SELECT 'coherent', CASE WHEN incoherent = 0 THEN 1 ELSE 0 END, CAST(incoherent AS VARCHAR) FROM coh""")

SQL["readiness"] = _with("""
bc AS (SELECT channel, CAST(SUM(spend) AS DOUBLE) AS spend, SUM(revenue) AS rev, COUNT(DISTINCT campaign) AS camps FROM ads_long GROUP BY channel),
tot AS (SELECT SUM(spend) AS ts, SUM(revenue) AS tr FROM ads_long)""", final="""
SELECT 'Google data detected' AS label, CASE WHEN EXISTS (SELECT 1 FROM bc WHERE channel = 'google') THEN 'Pass' ELSE 'Warning' END AS status,
  COALESCE((SELECT printf('%.0f spend parsed', spend) FROM bc WHERE channel = 'google'), 'No google rows found') AS detail
UNION ALL SELECT 'Microsoft/Bing data detected', CASE WHEN EXISTS (SELECT 1 FROM bc WHERE channel = 'microsoft') THEN 'Pass' ELSE 'Warning' END,
  COALESCE((SELECT printf('%.0f spend parsed', spend) FROM bc WHERE channel = 'microsoft'), 'No microsoft rows found')
UNION ALL SELECT 'Meta data detected', CASE WHEN EXISTS (SELECT 1 FROM bc WHERE channel = 'meta') THEN 'Pass' ELSE 'Warning' END,
  COALESCE((SELECT printf('%.0f spend parsed', spend) FROM bc WHERE channel = 'meta'), 'No meta rows found')
UNION ALL SELECT 'Unmapped channel rows (channel = other)', CASE WHEN EXISTS (SELECT 1 FROM bc WHERE channel = 'other') THEN 'Warning' ELSE 'Pass' END,
  COALESCE((SELECT printf('%d campaign(s) unmapped', camps) FROM bc WHERE channel = 'other'), 'None')
UNION ALL SELECT 'Revenue fields present', CASE WHEN COALESCE(tr, 0) > 0 THEN 'Pass' ELSE 'Error' END, CAST(CAST(COALESCE(tr, 0) AS DECIMAL(38,6)) AS VARCHAR) FROM tot
UNION ALL SELECT 'Spend fields present', CASE WHEN COALESCE(ts, 0) > 0 THEN 'Pass' ELSE 'Error' END, CAST(CAST(COALESCE(ts, 0) AS DECIMAL(38,6)) AS VARCHAR) FROM tot
UNION ALL SELECT c || ' parsed rows', CASE WHEN rev = 0 THEN 'Warning' ELSE 'Pass' END,
  CASE WHEN rev = 0 THEN 'Channel present but revenue is zero' ELSE 'Rows and revenue parsed' END
FROM (VALUES ('google'), ('meta'), ('microsoft')) v(c) JOIN bc ON bc.channel = v.c""")


# ---------------------------------------------------------------------------
# breakdown views
# ---------------------------------------------------------------------------
_BREAKDOWN = """bd AS (
  SELECT f.window_days, f.level, f.channel, f.campaign_type, f.campaign, f.revenue_p10, f.revenue_p50, f.revenue_p90, f.roas_p50,
    CASE WHEN f.roas_p50 > 0 THEN f.revenue_p50 / f.roas_p50 ELSE 0.0 END AS implied_spend,
    f.revenue_p50 / (CASE WHEN COALESCE(b.revenue_p50, 0.0) <> 0 THEN b.revenue_p50 ELSE 1.0 END) AS contribution,
    CASE WHEN COALESCE(f.roas_p50, 0.0) < 1.0 THEN 'Watch'
         WHEN f.revenue_p50 > 0 AND (f.revenue_p90 - f.revenue_p10) > 5.0 * f.revenue_p50 THEN 'Watch' ELSE 'OK' END AS risk
  FROM fo f LEFT JOIN (SELECT window_days, revenue_p50 FROM fo WHERE level = 'blended') b ON b.window_days = f.window_days
  WHERE f.level <> 'blended')"""

SQL["breakdown"] = _with(_fo_cte(), _BREAKDOWN, final="SELECT * FROM bd")
SQL["breakdown_search"] = _with(_fo_cte(), _BREAKDOWN, final="""SELECT * FROM bd WHERE window_days = 30
  AND contains(lower(concat_ws(' ', channel, campaign_type, campaign, level)), 'search')""")
SQL["top_campaign_rows"] = _with(_fo_cte(), final="""SELECT * FROM fo WHERE level = 'campaign' AND campaign IN (
  SELECT campaign FROM fo WHERE level = 'campaign' GROUP BY campaign ORDER BY MAX(revenue_p50) DESC, campaign LIMIT 10)""")


def _conf(guard_low: str) -> str:
    return f"""CASE WHEN {guard_low} THEN 'Low' WHEN NOT (revenue_p50 > 0) THEN 'Low'
      WHEN (revenue_p90 - revenue_p10) / revenue_p50 < 1.5 THEN 'High'
      WHEN (revenue_p90 - revenue_p10) / revenue_p50 < 3.5 THEN 'Medium' ELSE 'Low' END"""


SQL["confidence_labels"] = _with(_fo_cte(), final=f"""SELECT level, channel, campaign_type, campaign, window_days,
  {_conf('FALSE')} AS confidence FROM fo WHERE level = 'channel'""")

WRAPPERS["confidence_labels_x100"] = with_scaled_fixtures
SQL["confidence_labels_x100"] = f"""WITH gfo AS ({SQL["guarded_forecast_x100"]}),
ga AS ({SQL["guard_assess_x100"]})
SELECT level, channel, campaign_type, campaign, window_days,
  {_conf("(SELECT fallback_used = 1 AND confidence = 'Low' FROM ga)")} AS confidence FROM gfo WHERE level = 'channel'"""


# ---------------------------------------------------------------------------
# per-export parse report (A17) and micros reconciliation (Q4)
# ---------------------------------------------------------------------------
_EXPORT_OF = ("CASE channel WHEN 'google' THEN 'google_ads_campaign_stats' WHEN 'microsoft' THEN 'bing_campaign_stats' "
              "ELSE 'meta_ads_campaign_stats' END")

SQL["file_report"] = f"""
WITH raw AS (SELECT 'google_ads_campaign_stats' AS source_file, COUNT(*) AS raw_rows FROM export_google
             UNION ALL SELECT 'bing_campaign_stats', COUNT(*) FROM export_microsoft
             UNION ALL SELECT 'meta_ads_campaign_stats', COUNT(*) FROM export_meta),
p AS (SELECT {_EXPORT_OF} AS source_file, COUNT(*) AS parsed_rows,
        AVG(CASE WHEN spend = 0 THEN 1.0 ELSE 0.0 END) AS zero_spend_share, AVG(CASE WHEN revenue = 0 THEN 1.0 ELSE 0.0 END) AS zero_revenue_share,
        SUM(spend) AS spend, SUM(revenue) AS revenue,
        array_to_string(list_sort(list_distinct(list(campaign_type))), ',') AS campaign_types,
        array_to_string(list_sort(list_distinct(list(channel))), ',') AS channels
      FROM ads_long GROUP BY 1)
SELECT raw.source_file, raw.raw_rows, COALESCE(p.parsed_rows, 0) AS parsed_rows, raw.raw_rows - COALESCE(p.parsed_rows, 0) AS invalid_rows,
  p.zero_spend_share, p.zero_revenue_share, p.spend, p.revenue, p.campaign_types, p.channels
FROM raw LEFT JOIN p ON p.source_file = raw.source_file"""

SQL["parse_inspection"] = """
WITH r AS (SELECT 'google_ads_campaign_stats' AS source_file, CAST(SUM(metrics_cost_micros) AS DECIMAL(38,6)) / 1000000 AS raw_spend FROM export_google),
p AS (SELECT SUM(spend) AS parsed_spend FROM ads_long WHERE channel = 'google')
SELECT source_file, CAST(raw_spend AS DOUBLE) AS raw_spend, CAST(parsed_spend AS DOUBLE) AS parsed_spend,
  CAST(abs(raw_spend - parsed_spend) AS DOUBLE) AS diff,
  CASE WHEN CAST(abs(raw_spend - parsed_spend) AS DOUBLE) <= GREATEST(1.0, abs(CAST(raw_spend AS DOUBLE)) * 0.001) THEN 1 ELSE 0 END AS ok
FROM r, p"""


# ---------------------------------------------------------------------------
# outcomes of the mixed exports
# ---------------------------------------------------------------------------
_MIXED = """
mixed AS (SELECT *, CASE WHEN ln IN (5, 6) THEN NULL ELSE d END AS date,
  CASE seg WHEN 'AUTOMOBILE' THEN 'google' WHEN 'BUILDING' THEN 'google' WHEN 'MACHINERY' THEN 'microsoft'
           WHEN 'FURNITURE' THEN 'meta' ELSE 'other' END AS channel,
  concat(seg, '_', t, '_0', CAST(v AS VARCHAR)) AS campaign,
  CASE WHEN qty % 10 IN (0, 1, 2) THEN 0 ELSE spend END AS paid FROM ads_base)"""

SQL["mixed_ingest"] = _with(_MIXED, final="""
SELECT date, channel, campaign, 'Other' AS campaign_type, 0 AS is_brand, 0 AS impressions, 0 AS clicks, paid AS spend, 0 AS conversions,
  revenue, 0 AS daily_budget FROM mixed WHERE date IS NOT NULL""")

SQL["file_outcomes"] = _with(_MIXED, final="""
SELECT 'agency_export' AS source_file, 'read' AS status, NULL AS channel_hint, 1 AS has_revenue, COUNT(*) AS raw_rows, COUNT(date) AS parsed_rows,
  COUNT(*) - COUNT(date) AS dropped_rows,
  SUM(CASE WHEN qty % 10 IN (0, 2) OR (qty % 10 = 1 AND spend > 0) THEN 1 ELSE 0 END) AS zeroed_cells,
  MIN(date) AS date_min, MAX(date) AS date_max, COUNT(DISTINCT CASE WHEN date IS NOT NULL THEN campaign END) AS campaigns,
  SUM(CASE WHEN date IS NOT NULL THEN paid END) AS spend, SUM(CASE WHEN date IS NOT NULL THEN revenue END) AS revenue, 0 AS stops_strict_run FROM mixed
UNION ALL SELECT 'bing_undated_stats', 'zero_rows', 'microsoft', 1, COUNT(*), 0, COUNT(*), 0, NULL, NULL, 0, 0, 0, 1 FROM export_microsoft
UNION ALL SELECT 'google_ads_empty', 'skipped', 'google', 1, 0, 0, 0, 0, NULL, NULL, 0, 0, 0, 0""")

SQL["rejected_cells"] = _with(_MIXED, final="""
SELECT 'agency_export' AS source_file, 'date' AS "column", CASE ln WHEN 5 THEN 'not_a_date' ELSE 'blank' END AS reason, COUNT(*) AS cells
FROM mixed WHERE ln IN (5, 6) GROUP BY ALL
UNION ALL SELECT 'agency_export', 'spend', CASE qty % 10 WHEN 0 THEN 'not_a_number' WHEN 1 THEN 'negative' ELSE 'blank' END, COUNT(*)
FROM mixed WHERE qty % 10 IN (0, 2) OR (qty % 10 = 1 AND spend > 0) GROUP BY ALL
UNION ALL SELECT 'bing_undated_stats', 'date', 'not_a_date', COUNT(*) FROM export_microsoft""")


# ---------------------------------------------------------------------------
# positions
# ---------------------------------------------------------------------------
SQL["output_order"] = _with(_fo_cte(), final="""SELECT *, row_number() OVER (ORDER BY window_days,
  CASE level WHEN 'blended' THEN 0 WHEN 'channel' THEN 1 WHEN 'campaign_type' THEN 2 ELSE 3 END, channel, campaign_type, campaign) AS position FROM fo""")
SQL["breakdown_order"] = _with(_fo_cte(), _BREAKDOWN, final="""SELECT *, row_number() OVER (ORDER BY level, revenue_p50 DESC, channel,
  campaign_type, campaign, window_days) AS position FROM bd""")
_RANKED = """rch AS (SELECT c.*, row_number() OVER (PARTITION BY c.window_days ORDER BY c.revenue_p50 DESC, c.channel) AS rank,
  c.revenue_p50 / NULLIF(b.revenue_p50, 0.0) AS share
  FROM fo c JOIN fo b ON b.window_days = c.window_days AND b.level = 'blended' WHERE c.level = 'channel')"""
SQL["channel_ranking"] = _with(_fo_cte(), _RANKED, final="SELECT window_days, rank, channel, revenue_p50, share FROM rch")

# ---------------------------------------------------------------------------
# sinks read back and branches of their own
# ---------------------------------------------------------------------------
SQL["feature_store"] = _with(_pt_cte(), final="SELECT * FROM pt WHERE window_days = 60")
SQL["predictions_reread"] = SQL["forecast_baseline"]
WRAPPERS["guard_report"] = with_scaled_fixtures
SQL["guard_report"] = SQL["guard_assess_x100"]
SQL["hinted_ingest"] = """
SELECT date, CASE channel WHEN 'google' THEN 'microsoft' WHEN 'microsoft' THEN 'google' ELSE channel END AS channel, campaign, campaign_type,
  is_brand, impressions, clicks, spend, conversions, revenue, daily_budget FROM ads_long
"""
SQL["forecast_fallback"] = _with(f"gr AS ({SQL['global_median_roas'].strip()})", _pt_cte(), _g8("pt", "pg"), """
ph AS (SELECT * REPLACE (CASE WHEN channel = 'microsoft' THEN NULL ELSE q10 END AS q10,
  CASE WHEN campaign_type = 'Search' THEN CAST('nan' AS DOUBLE) ELSE q50 END AS q50,
  CASE WHEN window_days = 90 THEN CAST('inf' AS DOUBLE) ELSE q90 END AS q90) FROM pg)""", _m5("ph", "m5", None, "(SELECT global_median_roas FROM gr)"),
    final=", " + _rollup_tail("m5"))


def _filled_sql() -> str:
    cols = ("tr14_roas", "cpc28", "tr28_revenue", "trend_index")
    ctes = [_pt_cte(), """
f0 AS (SELECT * REPLACE (CASE WHEN window_days = 60 THEN NULL ELSE tr14_roas END AS tr14_roas,
  CASE WHEN campaign_type IN ('Shopping', 'DPA') THEN NULL ELSE cpc28 END AS cpc28,
  CASE WHEN channel = 'meta' THEN NULL ELSE tr28_revenue END AS tr28_revenue, CAST(NULL AS DOUBLE) AS trend_index) FROM pt)"""]
    for i, keys in enumerate(("channel, campaign_type", "channel", "")):
        means = ", ".join(f"AVG({c}) AS m_{c}" for c in cols)
        of = f"SELECT {keys + ', ' if keys else ''}{means} FROM f{i}" + (f" GROUP BY {keys}" if keys else "")
        fill = ", ".join(f"COALESCE({c}, m_{c}) AS {c}" for c in cols)
        ctes.append(f"f{i + 1} AS (SELECT f.* REPLACE ({fill}) FROM f{i} f " + (f"JOIN ({of}) m USING ({keys}))" if keys else f"CROSS JOIN ({of}) m)"))
    zero = ", ".join(f"COALESCE({c}, 0.0) AS {c}" for c in cols)
    return _with(*ctes, final=f"SELECT * REPLACE ({zero}) FROM f3")


SQL["filled_features"] = _filled_sql()
SQL["scenario_unknown_channel"] = _scenario_sql(f""",
moved AS (SELECT scenario_id, SUM(budget) AS budget FROM scen WHERE scenario_id <> 'current' GROUP BY scenario_id),
mr AS (SELECT scenario_id, budget, {_hill("mv", "mk", "budget")} AS revenue, {_hill("mv", "mk", "budget + 1000.0")} AS more FROM moved CROSS JOIN cmean)
SELECT scenario_id, 'tiktok' AS channel, budget, revenue, CASE WHEN budget > 0 THEN revenue / budget ELSE 0.0 END AS roas,
  CASE WHEN budget > 0 THEN (more - revenue) / 1000.0 ELSE 0.0 END AS marginal_roas FROM mr""")


def with_mixed_upload(body: str) -> str:
    """The upload's tables from the mixed export, the profile from the google account."""
    long = SQL["mixed_ingest"].strip().partition("\nSELECT ")[2]
    fx = FIXTURES.strip().replace("FROM ads_long", "FROM ads_mixed").replace(
        "\ndaily AS (", f"\n{_MIXED.strip()},\nads_mixed AS (SELECT {long} AND channel <> 'google'),\ndaily AS (", 1)
    body = body.strip().replace("src AS (SELECT * FROM ads_long)", "src AS (SELECT * FROM ads_long WHERE channel = 'google')")
    return "WITH " + fx + ",\n" + body[5:]


WRAPPERS["guard_assess_foreign"] = with_mixed_upload
SQL["guard_assess_foreign"] = SQL["guard_assess"]
SQL["answers_parsed"] = _with(_fo_cte(), final="""SELECT level, channel, campaign_type, campaign, window_days,
  CASE WHEN level = 'blended' OR (level = 'campaign' AND revenue_p50 <= 0) THEN NULL ELSE level || ' forecast' END AS claim,
  CASE WHEN level = 'blended' OR (level = 'campaign' AND revenue_p50 <= 0) THEN NULL ELSE CAST(round(revenue_p50) AS BIGINT) END AS value FROM fo""")


# ---------------------------------------------------------------------------
# the whole context
# ---------------------------------------------------------------------------
def _unpivoted(source: str, part: str, rank: str, entity: str, metrics) -> str:
    return "\nUNION ALL ".join(f"SELECT window_days, '{part}' AS part, {rank} AS rank, {entity} AS entity, '{m}' AS metric, "
                               f"CAST({m} AS DOUBLE) AS value FROM {source}" for m in metrics)


def _facts_ctes() -> list[str]:
    triples = S.REVENUE_Q + S.ROAS_Q
    forecast = [_unpivoted(*x, triples) for x in (
        ("fo WHERE level = 'blended'", "blended", "1", "''"), ("rch", "channels", "rank", "channel"),
        ("fo WHERE level = 'campaign_type'", "campaign_types", "0", "channel || '/' || campaign_type"),
        ("top", "top_campaigns", "rank", "channel || '/' || campaign_type || '/' || campaign"))]
    totals = ("rows", "campaigns", "total_spend", "total_revenue", "other_share")
    return [_insight_ctes()[1], _RANKED, f"hist AS (SELECT w.window_days, h.* FROM ({SQL['dataset_summary'].strip()}) h CROSS JOIN wins w)",
            "sim AS (SELECT w.window_days, s.* FROM scored s CROSS JOIN wins w WHERE s.scenario_id <> 'current')",
            "facts AS (" + "\nUNION ALL ".join([*forecast, _unpivoted("hist", "historical_summary", "1", "''", totals), _unpivoted(
                "sim", "budget_simulation", "0", "scenario_id || '/' || channel", ("budget", "revenue", "roas"))]) + ")"]


SQL["insight_facts"] = _scenario_sql(", " + ",\n".join(_facts_ctes()) + "\nSELECT * FROM facts")
SQL["insight_full_context"] = _scenario_sql(", " + ",\n".join([*_facts_ctes(), f"iss AS ({with_scaled_fixtures(SQL['scale_issues'])})", """
placed AS (SELECT *, entity || ':' || metric AS label, row_number() OVER (PARTITION BY window_days, part ORDER BY rank, entity, metric) AS rn FROM facts)"""]) + f"""
SELECT window_days, part, COUNT(*) AS facts, arg_min(label, rn) AS "first", arg_max(label, rn) AS "last" FROM placed GROUP BY window_days, part
UNION ALL SELECT w.window_days, 'validation_warnings', COUNT(DISTINCT message), MIN(message), MAX(message) FROM wins w LEFT JOIN iss ON TRUE GROUP BY w.window_days
UNION ALL SELECT window_days, 'allowed_channels', COUNT(DISTINCT channel), MIN(channel), MAX(channel) FROM fo WHERE level = 'channel' AND channel <> '' GROUP BY window_days
UNION ALL SELECT window_days, 'allowed_campaigns', COUNT(DISTINCT campaign), MIN(campaign), MAX(campaign) FROM top GROUP BY window_days
UNION ALL SELECT window_days, 'allowed_metrics', 8, 'revenue_p10', 'budget' FROM wins""")
