"""Forests and boosted models grown from rows held in a task's memory."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tessera.operators import forest, held, score, train
from tessera.operators.boosting import Boosting
from tessera.operators.forest import Forest
from tessera.sources import artifacts


def table(spark, n=900, seed=1, gaps=0.02):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 4)), 1)
    x[:, 3] = r.integers(0, 3, n)
    x[r.random(n) < gaps, 1] = np.nan
    y = np.nan_to_num(3 * x[:, 0] * x[:, 1]) + np.sin(3 * x[:, 2]) + x[:, 3] + 0.3 * r.normal(size=n)
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, x array<double>, label double")
    return df.withColumns({"features": array_to_vector("x"), "val": F.col("id") % 7 == 0, "fold": F.col("id") % 3}).repartition(3).cache(), x, y


def rows_held(n=700, seed=3):
    r = np.random.default_rng(seed)
    sizes = np.array([9, 2, 2, 4, 7])
    bins = np.stack([r.integers(0, k, n) for k in sizes]).astype(np.uint8)
    y = bins[0] * (bins[1] + 1.0) - bins[3] + r.normal(size=n)
    return held.Held(*held.coded(bins, sizes), y, np.full(n, 3, np.uint16), np.zeros(n, bool), r.integers(0, 1 << 62, n).astype(np.uint64), sizes), bins


def plain_tree(bins, y, w, depth):
    """(prediction, number of nodes) of a regression tree grown row by row."""
    out, nodes = np.zeros(len(y)), 1

    def loss(rows):
        return (w[rows] * (y[rows] - np.average(y[rows], weights=w[rows])) ** 2).sum()

    def grow(rows, level):
        nonlocal nodes
        best = (1e-9, None)
        for f in range(len(bins)) if level < depth else ():
            for b in np.unique(bins[f, rows]):
                left, right = rows[bins[f, rows] <= b], rows[bins[f, rows] > b]
                if w[left].sum() and w[right].sum():
                    gain = loss(rows[w[rows] > 0]) - loss(left[w[left] > 0]) - loss(right[w[right] > 0])
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (left, right))
        if best[1] is None:
            out[rows] = np.average(y[rows], weights=w[rows])
        else:
            nodes += 2
            for part in best[1]:
                grow(part, level + 1)
    grow(np.arange(len(y)), 0)
    return out, nodes


@pytest.mark.parametrize("group", [1 << 16, 50])
def test_a_tree_equals_one_grown_row_by_row(group, monkeypatch):
    monkeypatch.setattr(forest, "GROUP", group)
    h, bins = rows_held()
    s = Forest(trees=1, depth=5)
    w = forest.drawn(h.draw, 0, 42)
    parts = forest.grown(h, 0, w, s)
    cuts = [np.arange(k - 1.0) for k in h.sizes]
    model = forest._joined(s, cuts, 0.0, {n: [p] for n, p in zip(forest._TREE, parts)})
    want, nodes = plain_tree(bins, h.y, w, 5)
    assert np.allclose(model.predict(bins.T.astype(float)), want)
    assert len(model.feature) == nodes and math.isclose(model.importance.sum(), 1)


def test_sums_by_code_are_the_sums_by_bin():
    h, bins = rows_held(400)
    assert len(h.codes) < len(bins)                 # features lie together
    slot = np.arange(400) % 3
    got, many = held.sums(h, h.code, slot, 3, [h.y, None])
    for f, (first, size) in enumerate(zip(h.first, h.sizes)):
        for k in range(3):
            for b in range(size):
                own = (slot == k) & (bins[f] == b)
                assert many[k, first + b] == own.sum() and math.isclose(got[k, first + b], h.y[own].sum(), abs_tol=1e-9)


def test_draws_are_a_bootstrap():
    draw = np.random.default_rng(1).integers(0, 1 << 62, 40_000).astype(np.uint64)
    share = np.bincount(forest.drawn(draw, 7, 42), minlength=8)[:4] / 40_000
    assert np.allclose(share, [math.exp(-1) / math.factorial(k) for k in range(4)], atol=0.01)
    assert np.corrcoef(forest.drawn(draw, 1, 42), forest.drawn(draw, 2, 42))[0, 1] < 0.02
    assert len(np.unique(forest.apart(np.zeros(50, np.uint64)))) == 50       # equal rows are drawn one by one


def test_cuts_keep_the_values_of_few_and_share_out_many():
    assert forest.cuts_of(np.repeat([0.0, 1.0, 5.0], [100, 100, 56]), False, 32).tolist() == [0, 1, 5]
    many = forest.cuts_of(np.arange(256.0), True, 32)
    assert many[0] == -np.inf and len(many) == 31 and many[1] == 8 and many[-1] >= 240


def test_forest_predicts_like_spark_and_whatever_the_partitions(spark):
    df, x, y = table(spark, gaps=0)                  # Spark's forest takes no NaN
    rows, test = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    s = Forest(trees=25, depth=8)
    model, *parts = s.fit_folds(rows, "fold", 2)

    def rmse(m, scored=test):
        return math.sqrt(m.transform(scored).select(F.avg((F.col("prediction") - F.col("label")) ** 2)).first()[0])
    plain = RandomForestRegressor(numTrees=25, featureSubsetStrategy="all", maxDepth=8, seed=1).fit(rows)
    assert rmse(model) < 1.3 * rmse(plain) and rmse(model) < 0.7 * y.std()
    assert all(rmse(m, rows.where(F.col("fold") == k)) > 1.2 * rmse(model, rows.where(F.col("fold") == k)) for k, m in enumerate(parts))
    again = s.fit(rows.repartition(5, "x"))
    assert np.allclose(model.predict(x), again.predict(x))
    assert np.allclose([r["prediction"] for r in model.transform(df).orderBy("id").collect()], model.predict(x))


@pytest.mark.parametrize("objective", ["squared", "logistic", "softmax"])
@pytest.mark.parametrize("s", [Boosting(rounds=3, depth=4), Boosting(rounds=12, depth=3, rate=0.5, newton=False, subsample=0.8, patience=3, valCol="val")])
def test_held_rows_give_the_trees_of_passes(spark, objective, s, monkeypatch):
    df, _, _ = table(spark, 400)
    if objective != "squared":
        df = df.withColumn("label", F.when(F.col("label") > 1, 2.0 if objective == "softmax" else 1.0).when(F.col("label") > 0, 1.0).otherwise(0.0))
    s = replace(s, objective=objective, classes=3)
    whole = s.fit_folds(df, "fold", 2)
    monkeypatch.setattr(held, "HELD_BYTES", 0)
    for a, b in zip(whole, s.fit_folds(df, "fold", 2), strict=True):
        assert len(a.trees) == len(b.trees) and np.allclose(a.curve, b.curve)
        for t, u in zip((t for ts in a.trees for t in ts), (u for us in b.trees for u in us)):
            assert all(np.array_equal(getattr(t, n), getattr(u, n)) for n in ("feature", "bin", "threshold", "value", "gain"))


def test_training_grows_trees_without_a_job_for_each_level(spark):
    """Spark's forest and boosting by passes took hundreds of jobs; few rows of a table took minutes."""
    rows = spark.range(600).select("id", (F.col("id") % 13).alias("a"), (F.hash("id") % 50).alias("b"),
                                   ((F.col("id") % 13) * (F.hash("id") % 50) / 10.0).alias("y"))
    prep = train.prepare(rows, "y", ["id"], problem_type="regression", cv_folds=2)
    spark.sparkContext.setJobGroup("forest", "forest")
    try:
        result = train.train_all_models(prep, cv_folds=2, models=["Random Forest", "Boosted Trees (second order)"], parallelism=1)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert isinstance(result.models["Random Forest"], forest.ForestModel)
    assert {r["Model"] for r in result.results.collect()} == {"Random Forest", "Boosted Trees (second order)"}
    assert all(r["CV Mean"] > 0.8 and r["R2"] > 0.8 for r in result.rows)
    assert len(result.models["Boosted Trees (second order)"].trees) == 100 and len(result.models["Random Forest"].roots) == 100
    assert dict(train.feature_importance(result.models["Random Forest"], prep.feature_names)).keys() == {"a", "b"}


def test_a_forest_is_stored_whole(spark):
    rows = spark.range(300).select("id", (F.col("id") % 13).alias("a"), ((F.col("id") % 13) * 2.5).alias("y"))
    from tessera.operators import features
    processed, fmodel = features.engineer_features(rows, "y", carry=["id"])
    prep = train.prepare(processed, "y", ["id"], problem_type="regression", cv_folds=2)
    result = train.train_all_models(prep, cv_folds=0, models=["Random Forest"])
    cfg = score.build_prediction_config(result, fmodel, prep)
    loaded = artifacts.load_prediction_config(spark, artifacts.save_training_artifacts(cfg, artifacts.artifact_dir(spark)))
    a, b = (score.predict_dataframe(rows, c, ["id"]).collect() for c in (cfg, loaded))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 300


def test_larger_rows_go_to_sparks_forest(spark, monkeypatch):
    assert isinstance(train.regression_estimator("Random Forest", train.RAW, held=True), Forest)
    assert isinstance(train.regression_estimator("Random Forest", train.RAW), RandomForestRegressor)
    monkeypatch.setattr(held, "HELD_BYTES", 30 * 1000)
    assert held.fits(1000, 11) and not held.fits(1001, 11)
