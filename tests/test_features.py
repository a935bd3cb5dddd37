"""Sums at cut dates from running sums against plain loops; the base stage against the
raw fact; date filters that prune the base's files."""
import datetime as dt
import random
from decimal import Decimal

from conftest import SF_SMALL
from spendwise import schema as S
from spendwise.operators import backtest as BT
from spendwise.operators import base as B
from spendwise.operators import daily as D
from spendwise.operators import features as FE
from spendwise.operators import guard as G
from spendwise.plans.workspace import workspace

START = dt.date(2024, 1, 1)


def long_rows(rng, n=400):
    out = []
    for _ in range(n):
        day = START + dt.timedelta(days=int(rng.triangular(0, 200, 30)))
        spend = Decimal(rng.randint(-200, 3000)) / 100
        out.append((day, rng.choice(["google", "meta", "other"]), rng.choice("abcd"), rng.choice(["Search", "Video", None]), rng.choice([0, 1, None]),
                    Decimal(rng.randint(0, 90)), Decimal(rng.randint(0, 9)), spend, Decimal(rng.randint(0, 3)), spend * rng.randint(0, 4)))
    return out


def frame(spark, rows):
    money = "decimal(38,6)"
    return spark.createDataFrame(rows, "date date, channel string, campaign string, campaign_type string, is_brand int, "
                                 + ", ".join(f"{m} {money}" for m in S.METRICS))


def test_spans_match_plain_loops(spark):
    rows = long_rows(random.Random(2))
    d = D.daily(frame(spark, rows))
    cuts = [(c, START + dt.timedelta(days=k)) for c in "abcd" for k in (-80, -1, 0, 13, 28, 55, 56, 130, 199, 400)]
    got = FE.spans(d, spark.createDataFrame(cuts, "campaign string, date date"), (30, 90)).collect()
    assert len(got) == len(cuts)
    at = {m: i + 5 for i, m in enumerate(S.METRICS)}
    spend_by_day = {}
    for r in rows:
        spend_by_day[r[2], r[0]] = spend_by_day.get((r[2], r[0]), 0) + r[at["spend"]]

    def total(campaign, ts, lo, hi, metric):
        return sum((r[at[metric]] for r in rows if r[2] == campaign and lo <= (r[0] - ts).days <= hi), Decimal(0))

    for r in got:
        for name, (lo, hi) in FE.FRAMES.items():
            for short, metric in FE._SUMMED.items():
                if f"{name}_{short}" in r:
                    assert r[f"{name}_{short}"] == total(r.campaign, r.ts, lo, hi, metric), (r.campaign, r.ts, name, short)
        for w in (30, 90):
            assert r[f"fwd_revenue_{w}"] == total(r.campaign, r.ts, 1, w, "revenue") and r[f"fwd_spend_{w}"] == total(r.campaign, r.ts, 1, w, "spend")
        assert r.active28 == sum(1 for (c, day), s in spend_by_day.items() if c == r.campaign and -27 <= (day - r.ts).days <= 0 and s > 0)


def test_base_stage_stands_for_the_fact(spark):
    long = frame(spark, long_rows(random.Random(7)))
    base = B.staged(long)
    assert B.staged(base) is base and base.count() < long.count()
    same = lambda f: sorted(map(str, f(long).collect())) == sorted(map(str, f(base).select(f(long).columns).collect()))
    assert same(D.daily) and same(D.channel_daily) and same(D.campaign_attrs) and same(D.bounds) and same(G.training_profile)
    assert same(lambda x: FE.training_table(x, (30,), 7)) and same(lambda x: FE.prediction_table(x, (30, 60)))
    empty = B.staged(long.limit(0))
    assert empty.count() == 0 and BT.origin_of(empty) is None and D.daily(empty).count() == 0


def test_attributes_take_the_most_frequent_value_and_the_smaller_of_ties(spark):
    z = [Decimal(1)] * 5
    rows = [(START, ch, "a", t, b, *z) for ch, t, b in (("meta", "Video", 1), ("google", "Search", 0), ("google", "Video", 1), ("meta", "Search", None))]
    rows += [(START, None, "b", None, None, *z)]
    assert [tuple(r) for r in D.campaign_attrs(frame(spark, rows)).orderBy("campaign").collect()] == [("a", "google", "Search", 1), ("b", None, None, None)]


def test_backtest_reads_only_the_months_before_the_origin(spark):
    base = workspace(spark, SF_SMALL).base
    gmax, origin = BT.origin_of(base, 90)
    assert (gmax - origin).days == 90
    early = BT.train_split(base, origin)
    plan = early._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "PushedFilters: [IsNotNull(date), LessThanOrEqual(date" in plan
    assert early.agg({"date": "max"}).first()[0] <= origin
    assert early.count() == base.where(base.date <= origin).count()


def test_training_plan_has_no_bounded_frame(spark):
    plan = FE.training_table(workspace(spark, SF_SMALL).base)._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" not in plan and "unboundedpreceding$(), currentrow$()" in plan
