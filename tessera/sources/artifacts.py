"""Persist and restore a prediction configuration.

Layout under ``path`` (any Hadoop-compatible shared folder):

* ``model/``            the Spark ML model wrapped in a ``PipelineModel``, or
  ``boosted/``          a boosted model as JSON, one row for its head and each round, or
  ``forest/``           a forest held whole, one row for its head and each array
* ``labels/<i>/``       label-encoding maps (Parquet, written by executors)
* ``targets/<i>/``      target-encoding maps (Parquet)
* ``config.json``       small JSON sidecar: names, classes, one-hot values,
                        scaler parameters, metrics (written via Spark too, so
                        it lands in the same shared storage)
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from tessera.operators.boosting import BoostedModel
from tessera.operators.forest import ForestModel
from tessera.operators.features import (EncodingDetail, FeatureModel, LabelEncoding, OneHotEncoding,
                                        TargetEncoding)
from tessera.operators.score import PredictionConfig
from tessera.operators.split_scale import ColumnScaler
from tessera.session import checkpoint_dir


def artifact_dir(spark: SparkSession, name: str = "artifacts") -> str:
    """A fresh folder inside the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), name, uuid.uuid4().hex)


def save_training_artifacts(cfg: PredictionConfig, path: str) -> str:
    spark = SparkSession.getActiveSession()
    if isinstance(cfg.model, BoostedModel):
        head = cfg.model.to_dict()
        parts = [dict(head, trees=[])] + head["trees"]
        spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(parts)], "part int, value string").write.mode(
            "overwrite").parquet(os.path.join(path, "boosted"))
    elif isinstance(cfg.model, ForestModel):
        head, arrays = cfg.model.to_parts()
        spark.createDataFrame([("head", bytearray(json.dumps(head).encode()))] + [(n, bytearray(a)) for n, a in arrays.items()],
                              "part string, value binary").write.mode("overwrite").parquet(os.path.join(path, "forest"))
    else:
        PipelineModel(stages=[cfg.model]).write().overwrite().save(os.path.join(path, "model"))
    fm = cfg.features
    labels, targets = {}, {}
    for i, (c, enc) in enumerate(fm.labels.items()):
        enc.mapping.write.mode("overwrite").parquet(os.path.join(path, "labels", str(i)))
        labels[c] = {"dir": str(i), "size": enc.size}
    for i, (c, enc) in enumerate(fm.targets.items()):
        enc.mapping.write.mode("overwrite").parquet(os.path.join(path, "targets", str(i)))
        targets[c] = {"dir": str(i), "size": enc.size, "global_mean": enc.global_mean, "smoothing": enc.smoothing}
    config = {
        "target": cfg.target, "problem_type": cfg.problem_type, "model_name": cfg.model_name,
        "boosted": isinstance(cfg.model, BoostedModel), "forest": isinstance(cfg.model, ForestModel), "classes": cfg.classes, "input_columns": cfg.input_columns, "metrics": cfg.metrics,
        "features": {
            "target": fm.target, "date_columns": fm.date_columns, "datetime_features": fm.datetime_features,
            "raw_features": fm.raw_features, "excluded_ids": fm.excluded_ids,
            "dropped_columns": fm.dropped_columns, "feature_names": fm.feature_names,
            "onehots": {c: e.values for c, e in fm.onehots.items()},
            "labels": labels, "targets": targets, "date_formats": fm.date_formats, "date_values_lost": fm.date_values_lost,
            "details": [[d.column, d.strategy, d.unique_count, d.output_columns] for d in fm.details],
        },
        "scaler": {"kind": cfg.scaler.kind, "center": cfg.scaler.center, "scale": cfg.scaler.scale},
    }
    text = json.dumps(config, default=float)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
        os.path.join(path, "config.json"))
    return path


def load_prediction_config(spark: SparkSession, path: str) -> PredictionConfig:
    text = spark.read.text(os.path.join(path, "config.json")).collect()[0]["value"]
    cfg = json.loads(text)
    f = cfg["features"]
    labels = {c: LabelEncoding(c, spark.read.parquet(os.path.join(path, "labels", v["dir"])), v["size"])
              for c, v in f["labels"].items()}
    targets = {c: TargetEncoding(c, spark.read.parquet(os.path.join(path, "targets", v["dir"])), v["size"],
                                 v["global_mean"], v["smoothing"]) for c, v in f["targets"].items()}
    onehots = {c: OneHotEncoding(c, vals) for c, vals in f["onehots"].items()}
    fm = FeatureModel(f["target"], f["date_columns"], f["datetime_features"], f["raw_features"],
                      f["excluded_ids"], f["dropped_columns"], f["feature_names"], labels, onehots, targets,
                      [EncodingDetail(*d) for d in f["details"]], f["date_formats"], f["date_values_lost"])
    sc = ColumnScaler(cfg["scaler"]["kind"], cfg["scaler"]["center"], cfg["scaler"]["scale"])
    if cfg.get("boosted"):
        head, *rounds = [json.loads(r["value"]) for r in spark.read.parquet(os.path.join(path, "boosted")).orderBy("part").collect()]
        model = BoostedModel.from_dict(dict(head, trees=rounds))
    elif cfg.get("forest"):
        arrays = {r["part"]: bytes(r["value"]) for r in spark.read.parquet(os.path.join(path, "forest")).collect()}
        model = ForestModel.from_parts(json.loads(arrays.pop("head")), arrays)
    else:
        model = PipelineModel.load(os.path.join(path, "model")).stages[0]
    return PredictionConfig(cfg["target"], cfg["problem_type"], fm, sc, model, cfg["model_name"],
                            cfg["classes"], cfg["input_columns"], cfg["metrics"])
