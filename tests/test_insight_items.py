"""Chosen insights and their rejection log, on small written answers."""
from spendwise import schema as S
from spendwise.operators import insights as IN
from spendwise.operators import quality as QA

CLAIM = ("window_days int, provider string, provider_rank int, kind string, key string, text string, action string, evidence array<string>, "
         "ref_name string, source_channel string, target_channel string")


def _claim(window, provider, kind, key, text, action=None, evidence=("e",), ref=None, target=None):
    return (window, provider, {"a": 0, "b": 1}[provider], kind, key, text, action, list(evidence), ref, None, target)


def _forecast(spark):
    rows = [(lv, ch, "", camp, w, 100.0 * m, 200.0 * m, 300.0 * m, 1.0, 2.0, 3.0)
            for w in S.WINDOWS for lv, ch, camp, m in (("blended", "", "", 100.0), ("channel", "google", "", 60.0),
                                                       ("channel", "meta", "", 40.0), ("campaign", "google", "Spring", 60.0))]
    return spark.createDataFrame(rows, S.OUTPUT_SCHEMA)


def test_chosen_items_and_log(spark):
    out = _forecast(spark)
    claims = spark.createDataFrame([
        # 30: the first provider is wrong, the second one is taken
        _claim(30, "a", "summary", "0", "Revenue will reach $99,999."),
        _claim(30, "b", "summary", "1", "Revenue is forecast at $20,000."),
        _claim(30, "b", "summary", "2", "Revenue is guaranteed."),
        _claim(30, "b", "risk", "0", "Meta may fall to $4,000.", "Cut budgets by 777."),
        _claim(30, "b", "risk", "1", "Meta may fall to $4,000.", "Hold budgets."),
        _claim(30, "b", "watch", "0", "It leads.", ref="spring"),
        _claim(30, "b", "watch", "1", "It leads.", ref="Winter"),
        _claim(30, "b", "watch", "2", "It leads.", ref=" "),
        _claim(30, "b", "shift", "0", "Shift budget.", target="tiktok"),
        _claim(30, "b", "shift", "1", "Shift budget.", target="Google"),
        _claim(30, "b", "shift", "2", "Shift more budget.", target="Google"),
        _claim(30, "b", "limitation", "0", "Numbers hold.", evidence=()),
        _claim(30, "b", "limitation", "1", "Inflation is not modelled.", evidence=()),
        # 60: an unreadable answer and one without a summary: the rules speak
        _claim(60, "a", None, "0", None),
        _claim(60, "b", "watch", "0", "It leads.", ref="Spring"),
    ], CLAIM)
    v = IN.validate_claims(claims, IN.context(out))
    rules = IN.with_fields(IN.rule_insights(out))
    items = IN.chosen_items(v, rules).collect()
    assert sorted((r.section, r.key) for r in items if r.window_days == 30) == [
        ("campaigns_to_watch", "0"), ("forecast_summary", "1"), ("limitations", "0"), ("risks", "1"), ("suggested_budget_shift", "1")]
    assert {(r.window_days, r.provider, r.guardrail) for r in items} == {
        (30, "b", "passed"), (60, "template", "fallback"), (90, "template", "fallback")}
    assert sum(r.window_days == 60 for r in items) == rules.where("window_days = 60").count()
    log = sorted((r.window_days, r.provider, r.section_rank, r.key, r.reason) for r in IN.rejection_log(v).collect())
    assert [x[:4] for x in log] == [(30, "b", 1, "2"), (30, "b", 2, "0"), (30, "b", 4, "1"), (30, "b", 4, "2"), (30, "b", 5, "0"),
                                    (60, "a", 0, "0"), (60, "a", 7, ""), (60, "b", 7, "")]
    assert log[5][4] == IN.MALFORMED and log[6][4] == log[7][4] == IN.NO_SUMMARY
    assert "number" in log[1][4]  # the risk's action is checked too


def test_no_answers_at_all(spark):
    out = _forecast(spark)
    none = spark.createDataFrame([], CLAIM)
    v = IN.validate_claims(none, IN.context(out))
    rules = IN.with_fields(IN.rule_insights(out))
    assert {r.provider for r in IN.chosen_items(v, rules).collect()} == {"template"}
    assert IN.rejection_log(v).count() == 0


def test_narrative_sections(spark):
    rows = [(30, "forecast_summary", 1, "two", None), (30, "forecast_summary", 0, "one", None), (30, "risks", 0, "wide", None),
            (60, "limitations", 0, "holds", None)]
    items = spark.createDataFrame(rows, "window_days int, section string, ordinal int, text string, action string")
    got = {r.window_days: r.narrative for r in IN.narrative(items).collect()}
    assert got[30] == ("**Forecast Summary**\n- one\n- two\n\n**Anomalies & Risks**\n- wide _Action: n/a_\n\n"
                       "**Budget Recommendation**\n- Maintain current allocation.")
    assert got[60] == ("**Forecast Summary**\n\n**Anomalies & Risks**\n- None flagged.\n\n**Budget Recommendation**\n"
                       "- Maintain current allocation.\n\n**Limitations**\n- holds")


def test_validator_tells_nan_infinite_and_empty_apart(spark):
    out = _forecast(spark)
    need = spark.createDataFrame([("google",)], "channel string")

    def failed(df):
        return {r.check for r in QA.validate_output(df, need).collect() if not r.ok}

    F = IN.F
    types = out.where("level = 'campaign'").withColumn("level", F.lit("campaign_type"))
    good = out.unionByName(types)
    spoil = F.col("level") == "campaign"
    assert failed(good) == set()
    assert failed(good.withColumn("roas_p90", F.when(spoil, float("nan")).otherwise(F.col("roas_p90")))) == {"no_nan"}
    assert failed(good.withColumn("roas_p90", F.when(spoil, float("inf")).otherwise(F.col("roas_p90")))) == {"no_infinite"}
    assert {"not_empty", "more_than_one_row", "all_levels"} <= failed(good.limit(0))
