"""Validator and claim rules on small hand-made rows."""
from spendwise import schema as S
from spendwise.operators import insights as IN
from spendwise.operators import quality as QA


def _row(level, channel="", kind="", campaign="", window=30):
    return (level, channel, kind, campaign, window, 1.0, 2.0, 3.0, 1.0, 2.0, 3.0)


def test_unknown_level_is_rejected(spark):
    rows = [_row(level, channel="google", window=w) for level in S.LEVELS for w in S.WINDOWS]
    need = spark.createDataFrame([("google",)], "channel string")

    def levels_ok(more):
        out = spark.createDataFrame(rows + more, S.OUTPUT_SCHEMA)
        return {r.check: r.ok for r in QA.validate_output(out, need).collect()}["all_levels"]

    assert levels_ok([])
    assert not levels_ok([_row("bogus")])


def test_limitation_needs_no_evidence(spark):
    claims = spark.createDataFrame(
        [(30, kind, "Seasonality beyond the history is not covered.", [], None, None, None) for kind in ("limitation", "summary")],
        "window_days int, kind string, text string, evidence array<string>, ref_name string, source_channel string, target_channel string")
    ctx = spark.createDataFrame([(30, [1.0], ["google"])], "window_days int, numbers array<double>, names array<string>")
    assert {r.kind: r.accepted for r in IN.validate_claims(claims, ctx).collect()} == {"limitation": True, "summary": False}
