"""Batch scoring with a fitted feature model, scaler and Spark ML model.

Scoring is one lazy plan: feature transform (broadcast lookups for label /
target maps), numeric coercion, scaling expressions, vector assembly, then
``model.transform`` on the executors.  Nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import IndexToString
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import normalize_column_name
from tessera.functions.schema import col
from tessera.operators import evaluate
from tessera.operators.features import FeatureModel, transform_features
from tessera.operators.split_scale import ColumnScaler
from tessera.operators.train import LABEL, Prepared, TrainingResult, numeric, with_vectors


@dataclass
class PredictionConfig:
    target: str
    problem_type: str
    features: FeatureModel
    scaler: ColumnScaler
    model: object
    model_name: str
    classes: list[str] = field(default_factory=list)
    input_columns: list[str] = field(default_factory=list)
    metrics: dict = field(default_factory=dict)


def get_input_feature_columns(fmodel: FeatureModel) -> list[str]:
    """P20: raw input columns the model needs: the source features that are
    not derived calendar columns, plus the date columns they come from."""
    derived = set(fmodel.datetime_features)
    out = [c for c in fmodel.raw_features if c not in derived]
    for d in fmodel.date_columns:
        if fmodel.datetime_features and d not in out:
            out.append(d)
    return out


def build_prediction_config(result: TrainingResult, fmodel: FeatureModel, prep: Prepared,
                            model_name: str | None = None) -> PredictionConfig:
    """S10 (build): default target = the trained target, inputs = raw features."""
    name = model_name or result.best_model_name
    return PredictionConfig(prep.target, prep.problem_type, fmodel, prep.scaler, result.models[name], name,
                            list(prep.classes), get_input_feature_columns(fmodel),
                            {k: v for k, v in result.best_metrics.items()})


def transform_rows_for_prediction(df: DataFrame, cfg: PredictionConfig, carry: list[str] | None = None,
                                  normalize_names: bool = True) -> DataFrame:
    """Names → inputs aligned (missing → null) → encoders → numeric
    (missing → 0) → scaled copy → feature vectors."""
    carry = list(carry or [])
    if normalize_names:
        wanted = set(cfg.input_columns) | {cfg.target} | set(carry)
        renamed = [normalize_column_name(c) if c not in wanted and normalize_column_name(c) in wanted else c
                   for c in df.columns]
        if renamed != df.columns and len(set(renamed)) == len(renamed):
            df = df.toDF(*renamed)
    feats = transform_features(df, cfg.features, carry=carry)
    names = cfg.features.feature_names
    num = [numeric(c).alias(c) for c in names]
    rest = [col(c) for c in feats.columns if c not in names]
    return with_vectors(feats.select(*rest, *num), names, cfg.scaler)


def predict_from_features(frame: DataFrame, cfg: PredictionConfig) -> DataFrame:
    """Run the model on the right vector and decode class labels."""
    out = cfg.model.transform(frame)
    if cfg.problem_type == "classification" and cfg.classes:
        out = IndexToString(inputCol="prediction", outputCol="_decoded", labels=cfg.classes).transform(out)
        out = out.withColumn("prediction", F.col("_decoded")).drop("_decoded")
    return out


def predict_dataframe(df: DataFrame, cfg: PredictionConfig, keys: list[str] | None = None,
                      actual_column: str | None = None) -> DataFrame:
    """The input columns + ``predicted_<target>`` (+ ``actual_<target>``);
    ``keys`` name the columns to keep instead of all."""
    actual = actual_column or (cfg.target if cfg.target in df.columns else None)
    kept = list(keys or df.columns)
    # the input rides along as one column, so feature columns may share its names
    rows = df.withColumn("_input", F.struct(*[col(c) for c in df.columns]))
    scored = predict_from_features(transform_rows_for_prediction(rows, cfg, carry=["_input"]), cfg)
    given = F.col("_input")
    return scored.select(*[given.getField(c).alias(c) for c in kept], F.col("prediction").alias(f"predicted_{cfg.target}"),
                         *([given.getField(actual).alias(f"actual_{cfg.target}")] if actual else []))


def predict_test_split(prep: Prepared, cfg: PredictionConfig) -> DataFrame:
    """Actual vs predicted on the hold-out rows."""
    scored = predict_from_features(prep.test, cfg)
    actual = F.col("_y")
    return scored.select(*[col(k) for k in prep.keys], actual.alias("actual"),
                         F.col("prediction").alias("predicted"))


def bulk_evaluation(predictions: DataFrame, target: str) -> DataFrame:
    """MAE and R² of a scored table (regression), over rows where both
    sides are numeric."""
    m = evaluate.regression_metrics(predictions, f"actual_{target}", f"predicted_{target}")
    return m.select("mae", "r2", "n")


def predict_with_best_model(result: TrainingResult, prep: Prepared) -> DataFrame:
    """The best model on every prepared row, labels decoded."""
    model = result.best_model
    out = model.transform(prep.data)
    if prep.problem_type == "classification" and prep.classes:
        out = IndexToString(inputCol="prediction", outputCol="predicted", labels=prep.classes).transform(out)
    else:
        out = out.withColumn("predicted", F.col("prediction"))
    return out.select(*[col(k) for k in prep.keys], F.col("_y").alias("actual"), "predicted", LABEL)
