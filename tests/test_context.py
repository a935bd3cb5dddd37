"""Positions without a window over all rows (T1, T7), channels by P50 (T8) and the whole
context of insights (N1)."""
import pytest
from pyspark.sql import functions as F

from spendwise import schema as S
from spendwise.operators import insights as IN
from spendwise.operators.breakdown import breakdown, breakdown_order
from spendwise.operators.ordinals import numbered
from spendwise.operators.rollup import LEVEL_RANK, output_positions

OUT = [("blended", "", "", "", 30, 50.0, 100.0, 165.0, 1.0, 2.0, 3.3),
       ("channel", "google", "", "", 30, 30.0, 60.0, 99.0, 1.0, 2.0, 3.3),
       ("channel", "meta", "", "", 30, 20.0, 40.0, 66.0, 1.0, 2.0, 3.3),
       ("campaign_type", "google", "Search", "", 30, 30.0, 60.0, 99.0, 1.0, 2.0, 3.3),
       ("campaign", "google", "Search", "a", 30, 30.0, 60.0, 99.0, 1.0, 2.0, 3.3),
       ("campaign", "meta", "Brand", "b", 30, 20.0, 40.0, 66.0, 1.0, 2.0, 3.3)]


@pytest.fixture(scope="module")
def out(spark):
    return spark.createDataFrame(OUT, S.OUTPUT_SCHEMA)


def test_numbered_over_many_partitions_and_ties(spark):
    rows = spark.range(0, 5000, 1, 13).select((F.col("id") * 7919 % 997).alias("k"), "id")
    got = [(r.k, r.id, r.place) for r in numbered(rows, ["k", "id"], "place").collect()]
    want = sorted((i * 7919 % 997, i) for i in range(5000))
    assert sorted(got, key=lambda r: r[2]) == [(k, i, n + 1) for n, (k, i) in enumerate(want)]
    tied = numbered(rows.withColumn("one", F.lit(1)), ["one"], "place")
    assert sorted(r.place for r in tied.collect()) == list(range(1, 5001))


def test_numbered_takes_nulls_first_empty_tables_and_no_clash(spark):
    rows = spark.createDataFrame([(2,), (None,), (1,)], "k int")
    assert {(r.k, r.position) for r in numbered(rows, ["k"]).collect()} == {(None, 1), (1, 2), (2, 3)}
    assert numbered(rows.where("false"), ["k"]).collect() == []
    with pytest.raises(ValueError):
        numbered(rows, ["k"], "k")


def test_output_and_breakdown_positions(out):
    rows = sorted(output_positions(out).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(1, 7))
    assert [LEVEL_RANK[r.level] for r in rows] == [0, 1, 1, 2, 3, 3]
    view = sorted(breakdown_order(breakdown(out)).collect(), key=lambda r: r.position)
    assert [(r.level, r.channel) for r in view] == [("campaign", "google"), ("campaign", "meta"), ("campaign_type", "google"),
                                                    ("channel", "google"), ("channel", "meta")]


def test_channels_by_p50(out):
    got = {r.channel: (r.rank, round(r.share, 6)) for r in IN.ranked_channels(out).collect()}
    assert got == {"google": (1, 0.6), "meta": (2, 0.4)}
    alone = IN.ranked_channels(out.where("level = 'channel'")).collect()
    assert {r.rank for r in alone} == {1, 2} and all(r.share is None for r in alone)


def test_context_holds_drivers_history_simulation_and_warnings(spark, out):
    drivers = spark.createDataFrame([(f"f{i}", 0.1 + i / 100) for i in range(9)], "feature string, importance double")
    history = spark.createDataFrame([(1234, 987654.0, "google")], "rows long, total_revenue double, channels string")
    simulation = spark.createDataFrame([("x2.0", "google", 4000.0, 31000.0, 7.75)],
                                       "scenario_id string, channel string, budget double, revenue double, roas double")
    warnings = spark.createDataFrame([("b",), ("a",), ("a",)], "message string")
    ctx = IN.full_context(out, drivers, history, simulation, warnings)
    (row,) = ctx.collect()
    assert [(f.rank, f.entity) for f in row.top_drivers] == [(i + 1, f"f{8 - i}") for i in range(IN.TOP_DRIVERS)]
    assert {f.metric: f.value for f in row.historical_summary} == {"rows": 1234.0, "total_revenue": 987654.0}
    assert {f.metric: f.value for f in row.budget_simulation} == {"budget": 4000.0, "revenue": 31000.0, "roas": 7.75}
    assert row.validation_warnings == ["a", "b"] and row.allowed_metrics == list(IN.ALLOWED_METRICS)
    assert [f.entity for f in row.channels if f.metric == "revenue_p50"] == ["google", "meta"]
    claims = spark.createDataFrame([(30, "summary", "Revenue so far is $987,654.", ["historical_summary"], None, None, None),
                                    (30, "summary", "Doubling the plan may return $31,000.", ["budget_simulation"], None, None, None),
                                    (30, "summary", "Revenue so far is $555,555.", ["historical_summary"], None, None, None)],
                                   "window_days int, kind string, text string, evidence array<string>, ref_name string, source_channel string, target_channel string")
    accepted = [r.accepted for r in IN.validate_claims(claims, ctx).orderBy("text").collect()]
    assert accepted == [True, False, True]
    plain = [r.accepted for r in IN.validate_claims(claims, IN.context(out)).orderBy("text").collect()]
    assert plain == [False, False, False]


def test_context_without_the_optional_parts(out):
    (row,) = IN.full_context(out).collect()
    assert row.top_drivers == row.historical_summary == row.budget_simulation == row.validation_warnings == []
    assert len(row.top_campaigns) == 12 and set(row.allowed_campaigns) == {"a", "b"}
