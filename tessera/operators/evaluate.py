"""Model evaluation as SQL-style aggregates over (actual, predicted) rows.

Regression (M8): MAE, RMSE, R² from one aggregate of residuals.
Classification (M9): accuracy and support-weighted precision / recall / F1
(zero when undefined) from per-class counts, distributed end to end.  ROC AUC: exact rank-sum form computed from
``groupBy(score)`` counts and a blocked running total of negatives (ties
count one half), so neither the rows nor the distinct scores meet in one
task.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.schema import col, group_of
from tessera.operators.ordered import row_index, running_total
from tessera.session import cut_lineage

REGRESSION_METRICS = ("MAE", "RMSE", "R2")
CLASSIFICATION_METRICS = ("Accuracy", "Precision", "Recall", "F1", "ROC AUC")


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                       group: str | None = None) -> DataFrame:
    """mae, rmse, r2, n (per ``group`` if given); rows with a missing side are skipped."""
    a, p = col(actual).cast("double"), col(predicted).cast("double")
    valid = df.where(a.isNotNull() & p.isNotNull() & ~F.isnan(a) & ~F.isnan(p))
    keys = [col(group).alias(group)] if group else []
    r = a - p
    agg = valid.groupBy(*keys).agg(
        F.avg(F.abs(r)).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"),
        F.sum(r * r).alias("_sse"), F.var_pop(a).alias("_var"), F.count(F.lit(1)).alias("n"))
    r2 = F.when(F.col("_var") > 0, F.lit(1.0) - F.col("_sse") / (F.col("_var") * F.col("n")))
    return agg.select(*([group] if group else []), "mae", "rmse", r2.alias("r2"), "n")


def classification_metrics(df: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """accuracy, support-weighted precision / recall / F1 (a class never
    predicted scores 0), n — one row.

    Every row adds one count to its actual class (support, and a true
    positive when the prediction matches) and one to its predicted class,
    so per-class counts come from one shuffle whose partial aggregation
    collapses a hot class; the weighted sums are a second, one-row
    aggregate.  Nothing proportional to the number of classes reaches the
    driver."""
    a, p = col(actual).cast("string"), col(predicted).cast("string")
    hit = (a == p).cast("long")
    sides = (df.where(col(actual).isNotNull() & col(predicted).isNotNull())
             .select(F.explode(F.array(
                 F.struct(a.alias("c"), F.lit(1).cast("long").alias("s"), F.lit(0).cast("long").alias("pn"),
                          hit.alias("tp")),
                 F.struct(p.alias("c"), F.lit(0).cast("long").alias("s"), F.lit(1).cast("long").alias("pn"),
                          F.lit(0).cast("long").alias("tp")))).alias("r"))
             .select("r.*"))
    per_class = sides.groupBy("c").agg(F.sum("s").alias("s"), F.sum("pn").alias("pn"), F.sum("tp").alias("tp"))
    s_, pn, tp = F.col("s").cast("double"), F.col("pn"), F.col("tp").cast("double")
    pc = F.when(pn > 0, tp / pn).otherwise(F.lit(0.0))
    rc = F.when(s_ > 0, tp / s_).otherwise(F.lit(0.0))
    fc = F.when(pc + rc > 0, F.lit(2.0) * pc * rc / (pc + rc)).otherwise(F.lit(0.0))
    total = F.sum("s")
    return per_class.agg(
        (F.sum("tp") / total).alias("accuracy"), (F.sum(s_ * pc) / total).alias("precision"),
        (F.sum(s_ * rc) / total).alias("recall"), (F.sum(s_ * fc) / total).alias("f1"),
        F.coalesce(total, F.lit(0).cast("long")).alias("n"))


def classification_scores(df: DataFrame, actual: str = "label", predicted: str = "prediction") -> dict[str, float]:
    return classification_metrics(df, actual, predicted).collect()[0].asDict()


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", positive=1) -> float | None:
    """Exact binary ROC AUC (ties between a positive and a negative count ½)."""
    y = (col(label) == F.lit(positive)).cast("long")
    by_score = (df.where(col(label).isNotNull() & col(score).isNotNull())
                .groupBy(col(score).cast("double").alias("s"))
                .agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")))
    with_before = running_total(by_score, "s", "neg", name="neg_before")
    row = with_before.agg(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") * 0.5)).alias("u"),
                          F.sum("pos").alias("P"), F.sum("neg").alias("N")).collect()[0]
    if not row["P"] or not row["N"]:
        return None
    return float(row["u"]) / (float(row["P"]) * float(row["N"]))


def roc_auc_frame(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return df.sparkSession.createDataFrame([(roc_auc(df, label, score),)], "roc_auc double")


def weighted_ovr_auc(df: DataFrame, label: str, prob_cols: dict[str, str]) -> float | None:
    """Support-weighted one-vs-rest AUC for multi-class scores.

    All classes in one pass: every row gives a (class, score, is-class)
    triple for each of its scores that is not 0, counted by
    ``groupBy(class, score)``; most scores of many classes are 0, and how
    many rows and positives have it follows from the counts of the others.
    The negatives before each score come from one running total grouped by
    class, and each class's rank sum is one grouped aggregate.  Classes
    without support, or without positives or negatives among the scored rows,
    are left out of the weighting."""
    lab = col(label).cast("string")
    labelled = df.where(col(label).isNotNull())
    scores = F.array(*[F.struct(F.lit(c).alias("c"), col(p).cast("double").alias("s"),
                                (lab == F.lit(c)).cast("long").alias("y")) for c, p in prob_cols.items()])
    other = F.filter(scores, lambda r: r["s"].isNull() | (r["s"] != 0))
    by = cut_lineage(labelled.select(F.inline(other)).groupBy("c", "s").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    sizes = cut_lineage(labelled.groupBy(lab.alias("c")).agg(F.count(F.lit(1)).alias("support")))
    rows = sizes.agg(F.sum("support")).first()[0] or 0
    classes = df.sparkSession.createDataFrame([(c,) for c in prob_cols], "c string").join(sizes, "c", "left").join(
        by.groupBy("c").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")), "c", "left").fillna(0)
    supports = {r["c"]: r["support"] for r in classes.select("c", "support").collect()}
    zero = classes.select("c", F.lit(0.0).alias("s"), (F.col("support") - F.col("p")).alias("pos"),
                          (F.lit(rows) - F.col("support") - F.col("n")).alias("neg")).where("pos + neg > 0")
    scored = by.where(F.col("s").isNotNull() & ~F.isnan("s")).unionByName(zero)
    with_before = running_total(scored, "s", "neg", name="neg_before", group="c")
    per = with_before.groupBy("c").agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") * 0.5)).alias("u"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N")).collect()
    total, acc = 0, 0.0
    for r in per:
        n = supports.get(r["c"], 0)
        if not n or not r["P"] or not r["N"]:
            continue
        acc += n * (float(r["u"]) / (float(r["P"]) * float(r["N"])))
        total += n
    return acc / total if total else None


# ---------------------------------------------------------------------------
# M13 / M14 / P21
# ---------------------------------------------------------------------------
#: Which column plays a role, as patterns of its lower-case
#: name; an earlier pattern wins over an earlier column.
ROLE_PATTERNS = {
    "actual": ("actual", "actual_.*|y_true|y_test|target|label"),
    "predicted": ("predicted", "prediction", "(predicted|prediction)_.*|y_pred|pred"),
    "model": ("model", "model_name", "name"),
}
#: Columns of a result table that describe a model, not a metric.
DESCRIPTIVE = frozenset(("model", "model_name", "name", "type", "problem_type"))


def _plain(name: str) -> str:
    return name.strip().lower()


def column_of(df: DataFrame, role: str) -> str | None:
    """The column of ``df`` that plays ``role``, if any."""
    fits = ((c for c in df.columns if re.fullmatch(p, _plain(c))) for p in ROLE_PATTERNS[role])
    return next((c for found in fits for c in found), None)


def normalize_predictions(df: DataFrame) -> DataFrame:
    """Make sure that numeric ``actual`` and ``predicted`` are there."""
    have = {c.lower() for c in df.columns}
    found = {role: column_of(df, role) for role in ("actual", "predicted")}
    return df.withColumns({role: col(c).try_cast("double") for role, c in found.items() if c and role not in have})


def prediction_residuals(df: DataFrame, order_by: str) -> DataFrame:
    """row_idx (1..n in ``order_by`` order over valid rows), actual,
    predicted, residual, abs_residual; rows with a non-numeric side dropped."""
    norm = normalize_predictions(df)
    a, p = (col(next(c for c in norm.columns if c.lower() == role)).try_cast("double") for role in ("actual", "predicted"))
    valid = (norm.select(col(order_by).alias(order_by), a.alias("actual"), p.alias("predicted"))
             .where(F.col("actual").isNotNull() & F.col("predicted").isNotNull()
                    & ~F.isnan("actual") & ~F.isnan("predicted")))
    indexed = row_index(valid, order_by, "row_idx")
    r = F.col("actual") - F.col("predicted")
    return indexed.select("row_idx", "actual", "predicted", r.alias("residual"), F.abs(r).alias("abs_residual"))


def metrics_detail(results: DataFrame) -> DataFrame:
    """Wide results → (model, metric lower-case, value), nulls dropped."""
    model = column_of(results, "model")
    if model is None:
        raise ValueError("results have no model column")
    metrics = [f.name for f in results.schema.fields
               if group_of(f.dataType) == "numeric" and _plain(f.name) not in DESCRIPTIVE]
    if not metrics:
        return results.sparkSession.createDataFrame([], "model string, metric string, value double")
    pairs = F.array(*[F.struct(F.lit(_plain(m)).alias("metric"), col(m).cast("double").alias("value")) for m in metrics])
    long = results.select(col(model).cast("string").alias("model"), F.inline(pairs))
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))
