"""Model preparation, the model zoo, cross-validation, leaderboard and
feature importance, on Spark ML.

``prepare`` turns processed features into one DataFrame holding a raw and a
scaled feature vector, the label, the split and a CV fold, all derived by
formula from the row key (deterministic on any partitioning).  It is
persisted once; every fit and evaluation reads it.  Metrics come from
:mod:`tessera.operators.evaluate` (aggregates over the scored rows).
"""

from __future__ import annotations

import math
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression, LogisticRegressionModel,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.schema import col
from tessera.operators import evaluate
from tessera.operators import held as held_rows
from tessera.operators.boosting import Boosting, quantiles
from tessera.operators.chartdata import hash_bucket
from tessera.operators.features import detect_problem_type
from tessera.operators.forest import FINE, Forest
from tessera.session import checkpoint_dir, cut_lineage
from tessera.operators.split_scale import (ColumnScaler, fit_scaler, fold_labels, model_requires_scaling,
                                           recommend_scaler, split_labels)

SEED = 42
DEFAULT_CV_FOLDS = 3
RAW, SCALED, LABEL = "features_raw", "features_scaled", "label"

# Model names shown in the leaderboard.
SECOND_ORDER = "Boosted Trees (second order)"
REGRESSION_MODELS = ("Linear Regression", "Decision Tree", "Random Forest", "Gradient Boosting", SECOND_ORDER)
CLASSIFICATION_MODELS = ("Logistic Regression", "Decision Tree", "Random Forest", "Gradient Boosting", SECOND_ORDER)
FOREST_MAX_DEPTH = 12


@dataclass
class Prepared:
    data: DataFrame                 # keys, RAW, SCALED, LABEL, split, fold, _val
    feature_names: list[str]
    problem_type: str
    target: str
    keys: list[str]
    scaler: ColumnScaler
    classes: list[str] = field(default_factory=list)    # label index → class text
    train_rows: int = 0

    @property
    def train(self) -> DataFrame:
        return self.data.where(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.data.where(F.col("split") == "test")

    def release(self) -> None:
        """Drop the cached copy (the checkpoint files stay until the folder is cleaned)."""
        self.data.unpersist(blocking=False)


def prepare(processed: DataFrame, target: str, keys: list[str], *, problem_type: str | None = None,
            scaler: str | None = None, test_size: float = 0.2, seed: int = SEED,
            cv_folds: int = DEFAULT_CV_FOLDS, persist: bool = True) -> Prepared:
    """P17/P18/P25 + M1 + M2: numeric features (missing → 0), label,
    deterministic (stratified) split, scaler fitted on the training rows."""
    problem_type = problem_type or detect_problem_type(processed, target)
    features = [c for c in processed.columns if c != target and c not in keys]
    num = [numeric(c).alias(c) for c in features]
    if problem_type == "regression":
        y = col(target).try_cast("double")
        base = processed.select(*[col(k) for k in keys], *num, y.alias("_y")).where(F.col("_y").isNotNull())
    else:
        base = processed.select(*[col(k) for k in keys], *num, col(target).cast("string").alias("_y")) \
            .where(F.col("_y").isNotNull())
    n_classes = 0
    if problem_type == "classification":
        n_classes = base.select("_y").distinct().limit(2).count()
    split = split_labels(base, keys, stratify="_y" if n_classes > 1 else None, test_size=test_size, seed=seed)
    split = fold_labels(split, keys, max(cv_folds, 1), stratify="_y" if n_classes > 1 else None, where=F.col("split") == "train")
    split = split.withColumn("_val", F.pmod(hash_bucket(keys, seed + 2), F.lit(10)) == 0)
    train_rows = split.where(F.col("split") == "train")
    kind = scaler or recommend_scaler(problem_type)
    fitted = fit_scaler(train_rows, features, kind)
    classes: list[str] = []
    scaled = with_vectors(split, features, fitted)
    if problem_type == "classification":
        indexer = StringIndexer(inputCol="_y", outputCol=LABEL, stringOrderType="alphabetAsc",
                                handleInvalid="error").fit(train_rows)
        classes = list(indexer.labels)
        scaled = indexer.transform(scaled)
    else:
        scaled = scaled.withColumn(LABEL, F.col("_y"))
    data = scaled.select(*[col(k) for k in keys], RAW, SCALED, LABEL, "_y", "split", "fold", "_val")
    if persist:
        # Training reads this many times (every boosting round of every
        # model and fold); a reliable checkpoint in the shared checkpoint
        # folder cuts the lineage, so a lost executor costs a re-read of
        # checkpoint files, not a re-run of cleaning and feature engineering.
        # The folds leave all training rows in as many blocks as their bytes
        # ask for, often one: they are dealt out evenly, so that every pass
        # of every fit has all cores.
        data = cut_lineage(data)
        tasks = max(data.rdd.getNumPartitions(), data.sparkSession.sparkContext.defaultParallelism)
        data = data.repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    n_train = data.where(F.col("split") == "train").count()
    return Prepared(data, features, problem_type, target, keys, fitted, classes, n_train)


def numeric(c: str) -> Column:
    """A feature as a number, 0 where there is none."""
    return F.coalesce(col(c).try_cast("double"), F.lit(0.0))


def with_vectors(df: DataFrame, features: list[str], scaler: ColumnScaler) -> DataFrame:
    """Add the raw and the scaled feature vector.  Columns go in by position,
    so names (dots, backticks, any category value) play no part."""
    return df.withColumns({RAW: array_to_vector(F.array(*[col(c) for c in features])),
                           SCALED: array_to_vector(F.array(*scaler.columns(features)))})


# ---------------------------------------------------------------------------
# M5 / M6 model zoo
# ---------------------------------------------------------------------------
def fit(estimator, rows: DataFrame):
    """The fitted model without its training summary.  A classifier's summary
    holds the session, which travels to the tasks with the model and cannot,
    once anything in the session has used an ``Observation``; a model that is
    read back has none."""
    model = estimator.fit(rows)
    if isinstance(model, (LogisticRegressionModel, RandomForestClassificationModel)) and model.hasSummary:
        path = f"{checkpoint_dir(rows.sparkSession)}/model-{uuid.uuid4().hex}"
        model.save(path)
        model = type(model).load(path)
    return model


def regression_estimator(name: str, features_col: str, held: bool = False):
    """``held``: the rows fit in a task's memory, where a forest's trees are grown whole."""
    common = dict(featuresCol=features_col, labelCol=LABEL, predictionCol="prediction")
    if name == "Linear Regression":
        return LinearRegression(**common)
    if name == "Decision Tree":
        return DecisionTreeRegressor(maxDepth=8, seed=SEED, **common)
    if name == "Random Forest" and held:
        return Forest(trees=100, depth=FOREST_MAX_DEPTH, seed=SEED, featuresCol=features_col, labelCol=LABEL)
    if name == "Random Forest":
        return RandomForestRegressor(numTrees=100, featureSubsetStrategy="all", maxDepth=FOREST_MAX_DEPTH,
                                     seed=SEED, **common)
    return _boosting(name, "squared", 1, features_col)


def _boosting(name: str, objective: str, classes: int, features_col: str) -> Boosting:
    """Rounds, depth, learning rate, sample share and patience
    of the two boosted models."""
    common = dict(objective=objective, classes=classes, seed=SEED, featuresCol=features_col, labelCol=LABEL)
    if name == "Gradient Boosting":
        return Boosting(rounds=50, depth=4, rate=0.1, newton=False, subsample=0.8, patience=10, valCol="_val", **common)
    if name == SECOND_ORDER:
        return Boosting(rounds=100, depth=6, rate=0.3, l2=1.0, **common)
    raise ValueError(name)


def classification_estimator(name: str, features_col: str, n_classes: int, n_train: int):
    common = dict(featuresCol=features_col, labelCol=LABEL, predictionCol="prediction")
    if name == "Logistic Regression":
        # sklearn's default C=1 on a summed loss equals regParam 1/n on Spark's mean loss
        return LogisticRegression(maxIter=1000, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                                  standardization=False, **common)
    if name == "Decision Tree":
        return DecisionTreeClassifier(maxDepth=8, seed=SEED, **common)
    if name == "Random Forest":
        return RandomForestClassifier(numTrees=100, maxDepth=FOREST_MAX_DEPTH, seed=SEED, **common)
    return _boosting(name, "logistic" if n_classes <= 2 else "softmax", n_classes, features_col)


class ModelPipeline:
    """M4: feature columns → (scale with M2's scaler) → estimator."""

    def __init__(self, feature_columns: list[str], estimator, scaler: str = "none"):
        self.features, self.scaler, self.fitted = feature_columns, scaler, None
        self.estimator = estimator.copy({estimator.featuresCol: SCALED if scaler != "none" else RAW})

    def _numbers(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: numeric(c) for c in self.features})

    def fit(self, df: DataFrame) -> "ModelPipeline":
        rows = self._numbers(df)
        self.fitted = fit_scaler(rows, self.features, self.scaler)
        self.model = fit(self.estimator, with_vectors(rows, self.features, self.fitted))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(with_vectors(self._numbers(df), self.features, self.fitted))


def features_col_for(name: str) -> str:
    return SCALED if model_requires_scaling(name) else RAW


# ---------------------------------------------------------------------------
# evaluation helpers
# ---------------------------------------------------------------------------
def _score(problem_type: str, scored: DataFrame, n_classes: int) -> dict[str, float | None]:
    if problem_type == "regression":
        r = evaluate.regression_metrics(scored, LABEL, "prediction").collect()[0]
        return {"MAE": r["mae"], "RMSE": r["rmse"], "R2": r["r2"]}
    m = evaluate.classification_scores(scored, LABEL, "prediction")
    out = {"Accuracy": m["accuracy"], "Precision": m["precision"], "Recall": m["recall"], "F1": m["f1"]}
    auc = None
    if "probability" in scored.columns:
        probs = scored.select(col(LABEL), vector_to_array("probability").alias("_p"))
        if n_classes == 2:
            auc = evaluate.roc_auc(probs.select(LABEL, F.col("_p")[1].alias("_s")), LABEL, "_s", 1.0)
        elif n_classes > 2:
            cols = {str(float(i)): f"_p{i}" for i in range(n_classes)}
            wide = probs.select(col(LABEL).cast("string").alias(LABEL),
                                *[F.col("_p")[i].alias(f"_p{i}") for i in range(n_classes)])
            auc = evaluate.weighted_ovr_auc(wide, LABEL, cols)
    out["ROC AUC"] = auc if auc is not None else float("nan")
    return out


def _cv_score(problem_type: str, scored: DataFrame) -> float | None:
    if problem_type == "regression":
        return evaluate.regression_metrics(scored, LABEL, "prediction").collect()[0]["r2"]
    return evaluate.classification_scores(scored, LABEL, "prediction")["f1"]


def _fold_score(estimator, prep: Prepared, k: int) -> float | None:
    train = prep.train
    model = fit(estimator, train.where(F.col("fold") != k))
    return _cv_score(prep.problem_type, model.transform(train.where(F.col("fold") == k)))


def _mean_std(scores: list[float | None]) -> tuple[float | None, float | None]:
    scores = [s for s in scores if s is not None]
    if not scores:
        return None, None
    mean = sum(scores) / len(scores)
    return mean, math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))


def cross_validate(estimator, prep: Prepared, folds: int, parallelism: int = 1) -> tuple[float | None, float | None]:
    """Fit on k-1 folds of the training rows, score the held-out fold
    (r² or weighted F1); mean and population std of the fold scores.  Folds
    are independent Spark jobs and can run concurrently (like
    ``CrossValidator(parallelism=…)``)."""
    if folds < 2:
        return None, None
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        scores = list(pool.map(lambda k: _fold_score(estimator, prep, k), range(folds)))
    return _mean_std(scores)


# ---------------------------------------------------------------------------
# M12 importance
# ---------------------------------------------------------------------------
def feature_importance(model, feature_names: list[str]) -> list[tuple[str, float]] | None:
    """Tree importances or |coefficients| (mean over classes), largest first."""
    values = None
    if hasattr(model, "featureImportances"):
        values = list(model.featureImportances.toArray())
    elif hasattr(model, "coefficientMatrix") and model.numClasses > 2:
        mat = model.coefficientMatrix.toArray()
        values = [float(abs(mat[:, j]).mean()) for j in range(mat.shape[1])]
    elif hasattr(model, "coefficients"):
        values = [abs(float(v)) for v in model.coefficients.toArray()]
    if values is None:
        return None
    pairs = list(zip(feature_names, [float(v) for v in values]))
    pairs.sort(key=lambda p: (-p[1], p[0]))
    return pairs


# ---------------------------------------------------------------------------
# M11 train all
# ---------------------------------------------------------------------------
@dataclass
class TrainingResult:
    problem_type: str
    results: DataFrame
    models: dict
    best_model_name: str
    best_model: object
    best_metrics: dict
    feature_names: list[str]
    classes: list[str]
    importance: DataFrame | None
    rows: list[dict] = field(default_factory=list)


def _rank(rows: list[dict], problem_type: str) -> list[dict]:
    """R² desc then RMSE asc; or F1, Accuracy, ROC AUC desc (NaN last)."""
    def num(v, default):
        return default if v is None or (isinstance(v, float) and math.isnan(v)) else v
    if problem_type == "regression":
        return sorted(rows, key=lambda r: (-num(r["R2"], -math.inf), num(r["RMSE"], math.inf)))
    return sorted(rows, key=lambda r: (-num(r["F1"], -math.inf), -num(r["Accuracy"], -math.inf),
                                       -num(r["ROC AUC"], -math.inf)))


FIT_HEAP_BYTES = 2 << 30


def default_parallelism(spark) -> int:
    """How many fits to run at once: enough to keep the cluster busy while
    small boosting iterations wait on each other, never more than 16.  On a
    single machine every fit (its cached training points, tree statistics
    and models) shares one JVM heap: one fit per ``FIT_HEAP_BYTES`` of it."""
    sc = spark.sparkContext
    n = max(1, min(16, sc.defaultParallelism))
    if sc.master.startswith("local"):
        heap = sc._jvm.java.lang.Runtime.getRuntime().maxMemory()
        n = max(1, min(n, int(heap // FIT_HEAP_BYTES)))
    return n


def train_all_models(prep: Prepared, *, cv_folds: int = DEFAULT_CV_FOLDS, models: list[str] | None = None,
                     progress_callback=None, parallelism: int | None = None) -> TrainingResult:
    """Fit every model, cross-validate, score the hold-out rows, rank.

    Each model's final fit and its CV fold fits are independent Spark jobs;
    they are submitted together from a thread pool so that small iterative
    fits (boosting) overlap instead of queueing one after another.  Fits
    from held rows need no JVM heap: unless ``parallelism`` is given, they
    run beside the others."""
    spark = prep.data.sparkSession
    reg = prep.problem_type == "regression"
    names = list(models or (REGRESSION_MODELS if reg else CLASSIFICATION_MODELS))
    n_classes = len(prep.classes)
    beside = parallelism is None
    parallelism = parallelism or default_parallelism(spark)
    test = prep.test
    held = 0 < prep.train_rows and held_rows.fits(prep.train_rows, len(prep.feature_names))

    def estimator(name):
        fcol = features_col_for(name)
        return regression_estimator(name, fcol, held) if reg else classification_estimator(
            name, fcol, n_classes, prep.train_rows)

    folds = cv_folds if cv_folds >= 2 else 0
    known, finding = {}, threading.Lock()

    def found(fcol):
        """The quantiles of the features, looked up once for all models that cut them into bins."""
        with finding:
            if fcol not in known:
                known[fcol] = quantiles(prep.train, fcol, len(prep.feature_names), FINE)
            return known[fcol]

    def full_fit(name):
        """The model, its metrics, the seconds, and the fold scores if the
        folds were fitted in the same passes."""
        t0 = time.time()
        est, scores, fcol = estimator(name), None, features_col_for(name)
        if folds and isinstance(est, Boosting | Forest):
            model, *parts = est.fit_folds(prep.train, "fold", folds, found(fcol) if est.bins in (FINE, Forest.bins) else None)
            scores = [_cv_score(prep.problem_type, m.transform(prep.train.where(F.col("fold") == k))) for k, m in enumerate(parts)]
        else:
            model = fit(est, prep.train)
        metrics = _score(prep.problem_type, model.transform(test), n_classes)
        return model, metrics, time.time() - t0, scores

    own = [name for name in reversed(names) if beside and held and folds and isinstance(estimator(name), Boosting | Forest)]
    with ThreadPoolExecutor(max_workers=parallelism) as pool, ThreadPoolExecutor(max_workers=max(1, len(own))) as side:
        fits = {name: side.submit(full_fit, name) for name in own}              # the longest come last in the zoo
        fits |= {name: pool.submit(full_fit, name) for name in names if name not in own}
        cv = {(name, k): pool.submit(_fold_score, estimator(name), prep, k)
              for name in names for k in range(folds) if not isinstance(estimator(name), Boosting | Forest)}
        rows, fitted = [], {}
        for i, name in enumerate(names):
            if progress_callback is not None:
                progress_callback(i, len(names), name)
            model, metrics, seconds, scores = fits[name].result()
            if folds and scores is None:
                scores = [cv[(name, k)].result() for k in range(folds)]
            cv_mean, cv_std = _mean_std(scores or [])
            fitted[name] = model
            rows.append({"Model": name, **metrics, "CV Mean": cv_mean, "CV Std": cv_std,
                         "Train Seconds": seconds})
    ranked = _rank(rows, prep.problem_type)
    metric_names = ["MAE", "RMSE", "R2"] if reg else ["Accuracy", "Precision", "Recall", "F1", "ROC AUC"]
    schema = T.StructType([T.StructField("Model", T.StringType())]
                          + [T.StructField(m, T.DoubleType()) for m in metric_names + ["CV Mean", "CV Std",
                                                                                     "Train Seconds"]])
    results = spark.createDataFrame(
        [tuple([r["Model"]] + [None if r[m] is None else float(r[m]) for m in schema.fieldNames()[1:]])
         for r in ranked], schema)
    best = ranked[0]["Model"]
    imp = feature_importance(fitted[best], prep.feature_names)
    imp_df = spark.createDataFrame(imp, "feature string, importance double") if imp else None
    return TrainingResult(prep.problem_type, results, fitted, best, fitted[best],
                          {k: v for k, v in ranked[0].items() if k != "Model"}, prep.feature_names,
                          prep.classes, imp_df, ranked)


def top_importance(result: TrainingResult, n: int = 15) -> DataFrame | None:
    """The n most important features of the best model."""
    if result.importance is None:
        return None
    return result.importance.orderBy(F.col("importance").desc(), F.col("feature")).limit(n)
