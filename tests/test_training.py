"""Model preparation, training, scoring and persistence on small data."""

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessera.operators import evaluate, features, score, train
from tessera.sources import artifacts, sinks
from tessera.sources.tables import read_table

from conftest import SF_SMALL


def test_regression_train_score_roundtrip(spark):
    orders = read_table(spark, SF_SMALL, "orders")
    processed, fmodel = features.engineer_features(orders, "o_totalprice", carry=["o_orderkey"])
    prep = train.prepare(processed, "o_totalprice", ["o_orderkey"], cv_folds=2)
    assert prep.problem_type == "regression"
    # fold union = training rows
    assert prep.train.count() == sum(prep.train.where(F.col("fold") == k).count() for k in range(2))
    result = train.train_all_models(prep, cv_folds=2, models=["Linear Regression", "Decision Tree"])
    ranked = result.results.collect()
    assert [r["Model"] for r in ranked][0] == result.best_model_name
    assert all(r["RMSE"] is not None for r in ranked)
    cfg = score.build_prediction_config(result, fmodel, prep)
    path = artifacts.save_training_artifacts(cfg, artifacts.artifact_dir(spark))
    loaded = artifacts.load_prediction_config(spark, path)
    a = score.predict_dataframe(orders, cfg, ["o_orderkey"])
    b = score.predict_dataframe(orders, loaded, ["o_orderkey"])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    ev = score.bulk_evaluation(a, "o_totalprice").collect()[0]
    assert ev["n"] == orders.count()


def test_training_rows_lie_on_all_cores(spark):
    """Folds put the training rows in blocks by their bytes; fits must not inherit that."""
    rows = spark.range(800).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).alias("y"))
    for kind in ("regression", "classification"):
        prep = train.prepare(rows.coalesce(1), "y", ["k"], problem_type=kind, cv_folds=2)
        share = prep.train.groupBy(F.spark_partition_id()).count().collect()
        cores = spark.sparkContext.defaultParallelism
        assert len(share) == cores and max(r["count"] for r in share) < 2 * 640 / cores
        assert prep.train_rows == 640 and prep.data.count() == 800
        prep.release()


def test_classification_with_unseen_category(spark):
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "lang", "source", "n_chars")
    labeled = docs.join(read_table(spark, SF_SMALL, "labels").select("doc_id", "quality"), "doc_id")
    processed, fmodel = features.engineer_features(labeled, "quality", carry=["doc_id"])
    prep = train.prepare(processed, "quality", ["doc_id"])
    assert prep.problem_type == "classification" and prep.classes == ["0", "1"]
    result = train.train_all_models(prep, cv_folds=0, models=["Logistic Regression", "Random Forest"])
    assert {r["Model"] for r in result.results.collect()} == {"Logistic Regression", "Random Forest"}
    cfg = score.build_prediction_config(result, fmodel, prep)
    new = docs.withColumn("lang", F.lit("xx"))          # unseen category → all one-hot zeros
    out = score.predict_dataframe(new, cfg, ["doc_id"]).collect()
    assert {r["predicted_quality"] for r in out} <= {"0", "1"}


def test_classifiers_score_after_an_observation(spark):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    rows = train.with_vectors(spark.range(60).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("label")),
                              ["x"], train.fit_scaler(spark.range(5).select(F.col("id").cast("double").alias("x")), ["x"], "standard"))
    for est in (LogisticRegression(featuresCol=train.RAW), RandomForestClassifier(featuresCol=train.RAW, numTrees=2, seed=1)):
        assert train.fit(est, rows).transform(rows).where("prediction IN (0, 1)").count() == 60


def test_publish_writes_tables(spark):
    orders = read_table(spark, SF_SMALL, "orders")
    tables = sinks.dashboard_tables(raw=orders, cleaned=orders)
    status = {r["table"]: r["ok"] for r in sinks.publish(tables, sinks.Target(
        path=artifacts.artifact_dir(spark, "pub"))).collect()}
    for t in ("raw_data", "cleaned_data", "column_statistics", "correlation_matrix", "missing_data_summary",
              "data_distribution", "pipeline_metadata"):
        assert status[t], t
    assert status["predictions"] is False


def test_metrics_detail_drops_nulls(spark):
    res = spark.createDataFrame([("a", 1.0, None), ("b", None, 2.0)], "Model string, MAE double, R2 double")
    out = sorted(map(tuple, evaluate.metrics_detail(res).collect()))
    assert out == [("a", "mae", 1.0), ("b", "r2", 2.0)]
