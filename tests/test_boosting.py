"""Boosted trees against brute force, and the models of one fit against separate fits."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tessera.operators import boosting
from tessera.operators.boosting import Boosting


def table(spark, n=600, seed=1, noise=0.3, kind=0, digits=1):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 4)), digits)
    y = (3 * x[:, 0] * x[:, 1] + np.sin(3 * x[:, 2]), np.where(x[:, 0] > 0, 5 * x[:, 3], -2 * x[:, 1] ** 2))[kind] + noise * r.normal(size=n)
    rows = [(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double")
    return df.withColumns({"features": array_to_vector("x"), "val": F.col("id") % 7 == 0, "fold": F.col("id") % 3}).repartition(3).cache(), x, y


def rmse(model, df):
    return math.sqrt(model.transform(df).select(F.avg((F.col("prediction") - F.col("label")) ** 2)).first()[0])


def test_first_gains_equal_brute_force(spark):
    df, x, y = table(spark, 200)
    g = y.mean() - y
    got = boosting.first_gains(df, Boosting(l2=1.0, min_child=3)).collect()
    want = {}
    for f in range(4):
        for t in np.unique(x[:, f]):
            left = x[:, f] <= t
            if min(left.sum(), (~left).sum()) >= 3:
                want[str(f), float(t)] = sum(g[s].sum() ** 2 / (s.sum() + 1) for s in (left, ~left)) / 2 - g.sum() ** 2 / (len(y) + 1) / 2
    assert {(r.feature, r.threshold) for r in got} == set(want)
    assert all(math.isclose(r.gain, want[r.feature, r.threshold], rel_tol=1e-4, abs_tol=1e-4) for r in got)


def plain_tree(x, g, h, depth, l2=1.0, min_child=1.0):
    """Prediction of one exact second-order tree, grown row by row."""
    def score(s):
        return g[s].sum() ** 2 / (h[s].sum() + l2)

    def grow(rows, level):
        best = (1e-9, None)
        for f in range(x.shape[1]) if level < depth else ():
            for t in np.unique(x[rows, f]):
                left, right = rows[x[rows, f] <= t], rows[x[rows, f] > t]
                if len(left) and len(right) and min(h[left].sum(), h[right].sum()) >= min_child:
                    gain = (score(left) + score(right) - score(rows)) / 2
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (left, right))
        if best[1] is None:
            out[rows] = -g[rows].sum() / (h[rows].sum() + l2)
        else:
            for part in best[1]:
                grow(part, level + 1)
    out = np.zeros(len(x))
    grow(np.arange(len(x)), 0)
    return out


@pytest.mark.parametrize("objective", ["squared", "logistic"])
def test_trees_equal_plain_newton_boosting(spark, objective):
    df, x, y = table(spark, 250)
    if objective == "logistic":
        y = (y > 0.2).astype(float)
        df = df.withColumn("label", (F.col("label") > 0.2).cast("double"))
    model = Boosting(objective=objective, rounds=4, depth=3).fit(df)
    margin = np.full(len(y), y.mean() if objective == "squared" else math.log(y.mean() / (1 - y.mean())))
    for _ in range(4):
        p = 1 / (1 + np.exp(-margin))
        g, h = (margin - y, np.ones(len(y))) if objective == "squared" else (p - y, p * (1 - p))
        margin = margin + 0.3 * plain_tree(x, g, h, 3)
    assert np.allclose(model.margins(x)[:, 0], margin, atol=1e-4)


@pytest.mark.parametrize("kind", [0, 1])
def test_second_order_beats_the_plain_booster(spark, kind):
    df, _, _ = table(spark, 1500, kind=kind)
    train, test = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    own = rmse(Boosting(rounds=15, depth=6).fit(train), test)
    assert own < rmse(GBTRegressor(maxIter=15, maxDepth=6, stepSize=0.3, seed=1).fit(train), test)


def test_stopping_rule():
    r = random.Random(2)
    for _ in range(200):
        losses = [10 / (i + 1) + r.random() for i in range(40)]
        history, want = [math.inf] * 10, None
        for i, loss in enumerate(losses):
            if any(loss + 1e-4 < b for b in history):
                history[i % 10] = loss
            else:
                want = i + 1
                break
        assert boosting.stopping_round(losses, 10) == want


def test_patience_stops_on_a_noisy_label(spark):
    df, x, y = table(spark, 900, noise=4.0)
    s = Boosting(rounds=40, depth=3, rate=0.5, newton=False, patience=10, valCol="val")
    model = s.fit(df)
    val = np.arange(900) % 7 == 0
    curve = []
    for k in range(1, model.kept + 1):
        part = boosting.BoostedModel(s, model.prior, model.scale, 4, model.trees[:k])
        curve.append(((part.margins(x[val])[:, 0] - y[val]) ** 2).mean())
    assert np.allclose(curve, model.curve, rtol=1e-5)
    assert model.kept == (boosting.stopping_round(curve, 10) or 40) and model.kept < 40
    assert min(curve) < curve[-1]


def test_first_order_tree_is_a_regression_tree(spark):
    """One unshrunk first-order round predicts the means of a tree of least squares."""
    df, x, y = table(spark, 300)
    model = Boosting(rounds=1, depth=3, rate=1.0, newton=False).fit(df)
    g, h = y.mean() - y, np.ones(len(y))
    assert np.allclose(model.margins(x)[:, 0], y.mean() + plain_tree(x, g, h, 3, l2=0.0), atol=1e-4)


def test_folds_in_one_fit_equal_separate_fits(spark):
    df, x, _ = table(spark, 500, digits=0)               # all fits have the same bins
    s = Boosting(rounds=8, depth=3, newton=False, subsample=0.8, patience=3, rate=0.4, valCol="val")
    together = s.fit_folds(df, "fold", 3)
    apart = [s.fit(df)] + [s.fit(df.where(F.col("fold") != k)) for k in range(3)]
    for a, b in zip(together, apart):
        assert a.kept == b.kept and np.allclose(a.margins(x), b.margins(x), atol=1e-3)


def test_rows_of_one_partition_are_dealt_to_all_cores(spark, monkeypatch):
    """A pass has a task for every core, each with its share of the rows, whatever the input's files are."""
    df, x, _ = table(spark, 4000)
    seen, plain = [], boosting._pass

    def counted(rows, *args):
        share = rows.select(F.spark_partition_id().alias("p"), F.octet_length("y").alias("b")).groupBy("p").agg(F.sum("b").alias("b")).collect()
        seen.append(sorted(r.b // 8 for r in share))
        return plain(rows, *args)
    monkeypatch.setattr(boosting, "_pass", counted)
    one = Boosting(rounds=1, depth=1).fit(df.coalesce(1))
    cores = spark.sparkContext.defaultParallelism
    assert all(len(s) == cores and sum(s) == 4000 and s[-1] < 2 * s[0] for s in seen) and seen
    monkeypatch.undo()
    many = Boosting(rounds=1, depth=1).fit(df.repartition(7))
    assert np.array_equal(one.margins(x), many.margins(x))


def test_places_equal_a_walk_of_each_row():
    r = np.random.default_rng(3)
    for depth in (0, 1, 4, 6, 8):
        t = boosting.Tree.empty(depth)
        inner = np.arange(len(t.feature) // 2)
        t.feature[inner], t.bin[inner] = np.where(r.random(len(inner)) < 0.8, r.integers(0, 3, len(inner)), -1), r.integers(0, 255, len(inner))
        x = r.integers(0, 256, (3, 500)).astype(np.uint8)
        want = []
        for row in x.T:
            at = 0
            while t.feature[at] >= 0:
                at = 2 * at + 1 + (row[t.feature[at]] > t.bin[at])
            want.append(at)
        assert t.places(x, t.bin).tolist() == want


def test_classes_round_trip_and_hard_rows(spark):
    df, x, y = table(spark, 400)
    three = df.withColumn("label", F.when(F.col("label") > 1, 2.0).when(F.col("label") < -1, 0.0).otherwise(1.0))
    model = Boosting(objective="softmax", classes=3, rounds=8, depth=4).fit(three)
    out = model.transform(three).select("label", "prediction", "probability").collect()
    assert sum(r.label == r.prediction for r in out) / len(out) > 0.85
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in out)
    again = boosting.BoostedModel.from_dict(model.to_dict())
    assert np.array_equal(again.margins(x), model.margins(x))
    assert abs(sum(model.featureImportances.toArray()) - 1) < 1e-9

    def rows(*r):
        return spark.createDataFrame(list(r), "x array<double>, label double").withColumn("features", array_to_vector("x"))
    assert Boosting(rounds=2).fit(rows(([1.0], 3.0))).margins(np.array([[0.0]]))[0, 0] == 3.0
    assert Boosting(rounds=2).fit(rows(([1.0], None))).kept == 0
    gaps = Boosting(rounds=1, depth=1, rate=1.0, l2=0.0).fit(rows(*[([float("nan")], 0.0)] * 3, *[([1.0], 9.0)] * 3))
    assert np.allclose(gaps.margins(np.array([[float("nan")], [1.0]]))[:, 0], [0, 9])
