import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quilate.llm import percentiles as P


def brute(values, p):
    v = sorted(values)
    return v[max(1, math.ceil(round(p * len(v), 9))) - 1]


def run(spark, rows, e=0.0, keys=("g",)):
    df = spark.createDataFrame(rows, "g string, v double, pct string, pct_n int")
    return {(r["g"], r["pct"]): (r["value"], r["n_values"]) for r in P.percentiles(P.value_counts(df, list(keys), "v", e), list(keys)).collect()}


def test_against_brute_force_with_ties_signs_and_clashing_names(spark):
    a = [((i * 37) % 101 - 50) / 4 for i in range(500)]
    rows = [("a", v, "x", 1) for v in a] + [("b", 3.0, None, None)] * 7 + [(None, 1.5, "q", 2), (None, -0.0, "q", 2)]
    got = run(spark, rows)
    for p in P.DEFAULT_PERCENTILES:
        assert got["a", p] == (brute(a, p), 500) and got["b", p] == (3.0, 7)
    assert got[None, 0.5] == (0.0, 2) and got[None, 0.95] == (1.5, 2)


def test_null_nan_infinite_and_empty(spark):
    assert run(spark, [("a", None, "", 0), ("a", float("nan"), "", 0), ("a", float("inf"), "", 0)]) == {}
    assert run(spark, []) == {}
    with pytest.raises(ValueError):
        P.percentiles(spark.createDataFrame([], "pct_value double, pct_count long"), [], (2.0,))


def test_no_groups(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "v double")
    got = {r["pct"]: r["value"] for r in P.percentiles(P.value_counts(df, [], "v"), [], (0.0, 0.5, 1.0)).collect()}
    assert got == {0.0: 1.0, 0.5: 50.0, 1.0: 100.0}


@given(st.lists(st.floats(-1e9, 1e9, allow_subnormal=False).filter(lambda x: x == 0 or abs(x) > 1e-6), min_size=1, max_size=40))
@settings(max_examples=12, deadline=None)
def test_bounded_error(spark, values):
    got = run(spark, [("a", v, "", 0) for v in values], 0.01)
    for p in P.DEFAULT_PERCENTILES:
        want = brute(values, p)
        assert abs(got["a", p][0] - want) <= 0.0100001 * abs(want)


def test_days_combine(spark):
    rows = [(f"d{i % 5}", "g", float(i * i % 97 + 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "day string, g string, v double")
    for e in (0.0, 0.02):
        daily = [P.value_counts(df.where(f"day = 'd{k}'"), ["g"], "v", e) for k in range(5)]
        parts = {tuple(r) for r in P.percentiles(P.combine(daily, ["g"]), ["g"]).collect()}
        assert parts == {tuple(r) for r in P.percentiles(P.value_counts(df, ["g"], "v", e), ["g"]).collect()}


def test_a_hot_group_spreads_over_ranges_and_their_number_changes_nothing(spark):
    rows = [("hot", 100 + (i * 7919 % 3000) / 1000) for i in range(3000)] + [("cold", 5.0), (None, 1.0)]
    counts = P.value_counts(spark.createDataFrame(rows, "g string, v double"), ["g"], "v")
    sizes = {(r["g"], r["pct_block"]): r["count"] for r in P.range_sorted(counts, ["g"], 10).groupBy("g", "pct_block").count().collect()}
    hot = [n for (g, _), n in sizes.items() if g == "hot"]
    assert len(hot) >= 8 and max(hot) < 900 and sum(hot) == 3000
    got = [sorted(map(str, P.percentiles(counts, ["g"], ranges=k).collect())) for k in (1, 3, 10)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 18
