"""Exact distributed selection against plain sorting, with limits small enough that
every bracket is narrowed several times."""
import math
import random

import pytest

from spendwise.operators import quantiles as Q

PROBS = [0.0, 0.1, 0.5, 0.8, 0.9, 1.0]


def expected(values, p, how):
    s = sorted(values)
    if how == "order":
        return s[max(math.ceil(p * len(s)), 1) - 1]
    at = p * (len(s) - 1)
    k = math.floor(at)
    return s[k] + (at - k) * (s[min(k + 1, len(s) - 1)] - s[k]) if at > k else s[k]


def samples():
    rng = random.Random(5)
    yield "even", [rng.uniform(-5, 5) for _ in range(30_000)]
    yield "skew", [rng.paretovariate(0.4) for _ in range(20_000)]
    yield "ties", [rng.choice([1.0, 1.0, 1.0, 2.0, rng.random()]) for _ in range(20_000)]
    yield "one value", [3.5] * 9_000
    yield "few", [4.0, -2.0, 4.0]
    yield None, [7.0, 8.0]


@pytest.mark.parametrize("limit", [50, 5_000, Q.LIMIT])
def test_selection_matches_sorting(spark, limit):
    data = dict(samples())
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("few", None), ("few", float("nan")), ("nothing", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    for how in ("linear", "order"):
        got = {(r.g, r.i): (r.n, r.value) for r in Q.select(df, ["g"], "v", PROBS, how, limit).collect()}
        assert set(got) == {(g, i) for g in data for i in range(len(PROBS))}
        for (g, i), (n, value) in got.items():
            assert n == len(data[g]) and math.isclose(value, expected(data[g], PROBS[i], how), rel_tol=1e-12), (g, i, how)


def test_infinite_values_are_ordered_and_no_group_is_one_group(spark):
    rows = [(float("inf"),), (1.0,), (2.0,), (-float("inf"),), (float("inf"),)]
    df = spark.createDataFrame(rows, "v double")
    assert [r.value for r in Q.select(df, [], "v", [0.2, 0.4, 0.6, 1.0], "order").orderBy("i").collect()] == [-math.inf, 1.0, 2.0, math.inf]
    assert Q.select(df.limit(0), [], "v", [0.5]).count() == 0
    with pytest.raises(ValueError):
        Q.select(df, [], "v", [0.5], "nearest")
