"""Exact distributed quantiles against numpy, including forced multi-pass
refinement (tiny bin counts and collect limits) and heavy duplicates."""

import random

import numpy as np
import pytest

from tessera.functions import quantiles as Q


@pytest.mark.parametrize("bins,limit", [(4096, 50_000), (4, 10), (2, 3)])
def test_exact_quantiles_match_numpy(spark, bins, limit, monkeypatch):
    if bins < 4096:                                      # by refinement alone
        monkeypatch.setattr(Q, "SKETCH_POINTS", 0)
    rng = np.random.default_rng(7)
    a = np.round(rng.lognormal(3, 1, 3000), 2)
    b = rng.integers(0, 5, 3000).astype(float)          # heavy duplicates
    c = np.concatenate([np.full(2000, 1.0), rng.normal(0, 1e6, 1000)])   # a hot value
    rows = [(float(x), float(y), float(z)) for x, y, z in zip(a, b, c)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    stats = Q.column_bounds(df, ["a", "b", "c"])
    got = Q.exact_quantiles(df, ["a", "b", "c"], probs, bins=bins, leaf=limit, stats=stats)
    for name, arr in (("a", a), ("b", b), ("c", c)):
        want = np.quantile(arr, probs)
        assert np.allclose(got[name], want, rtol=1e-12, atol=1e-9), name


def test_group_quantiles(spark):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 3, 2000)
    x = rng.normal(0, 1, 2000)
    df = spark.createDataFrame([(int(i), float(v)) for i, v in zip(g, x)], "g int, x double")
    got = {r["g"]: r for r in Q.group_quantiles(df, "g", "x", [0.25, 0.5, 0.75], bins=8, leaf=5).collect()}
    for k in range(3):
        assert got[k]["n"] == int((g == k).sum())
        assert np.allclose(got[k]["q"], np.quantile(x[g == k], [0.25, 0.5, 0.75]))


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_many_groups_stay_on_the_executors(spark, monkeypatch, broadcast):
    """5 000 groups: the driver sees a few numbers per pass, never values or groups."""
    monkeypatch.setattr(Q, "BROADCAST_INTERVALS", broadcast)
    rng = np.random.default_rng(9)
    g = rng.integers(0, 5000, 40_000)
    g[: 13_000] = 7                                     # a third of the rows in one group
    x = np.round(rng.normal(0, 1, 40_000), 2)
    df = spark.createDataFrame(list(zip(g.tolist(), x.tolist())), "g int, x double").repartition(8)
    seen = []
    for name in ("collect", "first"):
        real = getattr(type(df), name)
        monkeypatch.setattr(type(df), name, lambda self, *a, real=real: seen.append(real(self, *a)) or seen[-1])
    frame = Q.group_quantiles(df, "g", "x", [0.25, 0.9], bins=16, leaf=50)
    assert sum(len(r) if isinstance(r, list) and not hasattr(r, "asDict") else 1 for r in seen) < 100
    monkeypatch.undo()
    got = {r["g"]: r["q"] for r in frame.collect()}
    assert set(got) == set(g.tolist())
    for k in (7, *rng.choice(g, 40).tolist()):
        assert np.allclose(got[k], np.quantile(x[g == k], [0.25, 0.9]))


def test_names_with_dots_and_backticks(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0)], "`emp.var.rate` double, `a``b` double")
    assert Q.exact_quantiles(df, ["emp.var.rate", "a`b"], [0.5]) == {"emp.var.rate": [2.0], "a`b": [3.5]}


def test_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    got = Q.exact_quantiles(df, ["a", "b"], [0.5])
    assert got["a"] == [None] and got["b"] == [1.5]


from hypothesis import given, settings, strategies as st  # noqa: E402


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=60),
       st.sampled_from([0.0, 0.1, 0.5, 0.9, 1.0]))
def test_exact_quantile_property(spark, values, p):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = Q.exact_quantiles(df, ["x"], [p], bins=3, leaf=4)["x"][0]
    want = float(np.quantile(np.array(values), p))
    assert abs(got - want) <= 1e-9 * max(1.0, abs(want))


@pytest.mark.parametrize("values", [
    [1.0, 2.0, 2.0, 2.0, 9.0, None, None, None],               # ties at the median, odd n
    [5.0, 1.0, 3.0, 8.0, None],                                 # even n, interpolated median
    [4.0, 4.0, 4.0, 4.0, None, None],                           # constant column
    [1.0, 2.0, 3.0, 4.0, 100.0],                                # nothing to fill
    [float(i % 13) for i in range(97)] + [None] * 41,           # many gaps
    [None, None, None],                                         # nothing to fill from
])
def test_filled_quartiles_match_quartiles_of_filled_column(spark, values):
    """The fences found with the medians equal the quartiles of the column
    after it is median-filled (brute force with numpy)."""
    import numpy as np
    from tessera.operators import clean
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    plan = clean.fit_fill(df, quartiles_for=["x"])
    known = [v for v in values if v is not None]
    if not known:
        assert "x" not in plan.filled_quartiles and "x" not in plan.numeric
        return
    med = float(np.median(known))
    if len(known) < len(values):
        assert plan.numeric["x"] == pytest.approx(med, rel=0, abs=0)
    else:
        assert "x" not in plan.numeric
    filled = np.array([med if v is None else v for v in values])
    q1, q3 = np.quantile(filled, [0.25, 0.75])
    assert plan.filled_quartiles["x"] == pytest.approx((q1, q3), rel=1e-12, abs=1e-12)


def test_sketch_brackets_take_two_passes_whatever_the_spread(spark, monkeypatch):
    r = random.Random(3)
    values = [10.0 ** r.uniform(-300, 300) * r.choice([-1, 1]) for _ in range(3000)] + [7.0] * 1500
    df = spark.createDataFrame([(x, -x) for x in values], "a double, b double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    want = {"a": [float(q) for q in np.quantile(values, probs)], "b": [float(q) for q in np.quantile([-x for x in values], probs)]}
    refined = Q.order_statistics
    with monkeypatch.context() as m:
        m.setattr(Q, "order_statistics", lambda *a, **k: pytest.fail("a third pass"))
        got = Q.exact_quantiles(df, ["a", "b"], probs)
    for c in "ab":
        assert np.allclose(got[c], want[c], rtol=1e-9)
    calls = []
    monkeypatch.setattr(Q, "order_statistics", lambda *a, **k: calls.append(1) or refined(*a, **k))
    monkeypatch.setattr(Q, "SKETCH_POINTS", 1)               # no bracket: the other way
    assert Q.exact_quantiles(df, ["a", "b"], probs) == got and calls
