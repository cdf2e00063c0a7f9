"""Sinks: CSV export (S5), table writes (S6), key/value metadata (S7) and
publishing of the dashboard tables (S8).

Writes run on the executors (``DataFrameWriter``); nothing is funnelled
through the driver.  A target is a folder (Parquet per table), a catalog
database (``saveAsTable``), or a JDBC connection whose options the caller
supplies (batches of 5 000 rows).

Publishing to a folder never touches what readers see until a table is
complete: each run writes its tables below ``versions/<run>``, then appends
one row a table to the manifest, and ``read_published`` reads the folders
that the newest rows name.  A table that fails or is empty keeps its last
version.  ``publish_run`` writes the raw and cleaned tables first and makes
all statistics from what was written, so a frame is computed once however
many tables come from it.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.schema import col
from tessera.session import cut_lineage

JDBC_BATCH = 5000
PUBLISHED_TABLES = ("raw_data", "cleaned_data", "processed_data", "predictions", "model_results",
                    "feature_importance", "column_statistics", "correlation_matrix", "missing_data_summary",
                    "data_distribution", "prediction_residuals", "model_metrics_detail", "pipeline_metadata")

_MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists",
          "overwrite": "overwrite", "errorifexists": "errorifexists", "ignore": "ignore"}


@dataclass(frozen=True)
class Target:
    """Where tables go: ``path`` (folder), ``database`` (catalog) or ``jdbc``
    (``{"url": …, "user": …, …}``)."""
    path: str | None = None
    database: str | None = None
    jdbc: dict | None = None


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def to_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """UTF-8 CSV with header (one file per partition, written in parallel)."""
    lower = df
    # quotes inside quoted fields are doubled, as pandas writes them
    lower.write.mode(mode).option("header", True).option("encoding", "UTF-8") \
        .option("quote", '"').option("escape", '"').csv(path)
    return path


def save_dataframe(df: DataFrame | None, table: str, target: Target, if_exists: str = "replace") -> bool:
    """Write one table; names lower-cased; an empty frame is skipped
    (returns False, like zero rows written)."""
    if df is None or df.isEmpty():
        return False
    out = lower_names(df)
    mode = _MODES[if_exists]
    name = table.lower()
    if target.jdbc is not None:
        opts = dict(target.jdbc)
        url = opts.pop("url")
        opts.setdefault("batchsize", str(JDBC_BATCH))
        out.write.mode(mode).jdbc(url, name, properties=opts)
    elif target.database is not None:
        out.write.mode(mode).saveAsTable(f"{target.database}.{name}")
    else:
        out.write.mode(mode).parquet(os.path.join(target.path, name))
    return True


def metadata_frame(spark: SparkSession, metadata: dict) -> DataFrame:
    """Key, value (text), updated_at (UTC, set when written)."""
    rows = [(str(k), str(v)) for k, v in metadata.items()]
    return (spark.createDataFrame(rows, "key string, value string")
            .withColumn("updated_at", F.current_timestamp()))


def pipeline_metadata(raw: DataFrame, stages: dict[str, bool] | None = None,
                      extra: dict | None = None) -> dict:
    """Size, missing and duplicate percentages, column-type counts, a
    0-100 quality score and stage flags, from one aggregate over ``raw``."""
    from tessera.operators.profile import dataset_summary
    from tessera.functions.schema import classify_columns
    s = dataset_summary(raw).collect()[0]
    rows, cols = int(s["row_count"]), int(s["column_count"])
    size = rows * cols
    missing_pct = float((s["missing_values"] / size) * 100) if size > 0 else 0.0
    dup_pct = float((s["duplicate_rows"] / rows) * 100) if rows > 0 else 0.0
    numeric = len(classify_columns(raw).numeric)
    meta = {
        "total_rows": rows, "total_columns": cols,
        "missing_percentage": missing_pct, "duplicate_percentage": dup_pct,
        "numeric_count": numeric, "categorical_count": cols - numeric,
        "data_quality_score": round(max(0.0, min(100.0, 100.0 - missing_pct - dup_pct)), 2),
    }
    for flag in ("has_raw", "has_cleaned", "has_processed", "has_predictions", "has_model_results"):
        meta[flag] = 1 if (stages or {}).get(flag) else 0
    meta.update(extra or {})
    return meta


def dashboard_tables(*, raw: DataFrame | None = None, cleaned: DataFrame | None = None,
                     processed: DataFrame | None = None, predictions: DataFrame | None = None,
                     results: DataFrame | None = None, importance: DataFrame | None = None,
                     order_by: str | None = None, extra: dict | None = None) -> dict[str, DataFrame]:
    """S8 (what): the 13 tables.  Statistics use the cleaned data, else raw."""
    from tessera.operators import evaluate, profile, relations
    tables: dict[str, DataFrame] = {}
    for name, df in (("raw_data", raw), ("cleaned_data", cleaned), ("processed_data", processed),
                     ("model_results", results), ("feature_importance", importance)):
        if df is not None:
            tables[name] = df
    if predictions is not None:
        tables["predictions"] = evaluate.normalize_predictions(predictions)
    analysis = cleaned if cleaned is not None else raw
    if analysis is not None:
        tables["column_statistics"] = profile.column_statistics(analysis).withColumn(
            "null_pct", F.bround("null_pct", 2))
        tables["correlation_matrix"] = relations.correlation_matrix(analysis).withColumn(
            "correlation", F.bround("correlation", 4))
        tables["missing_data_summary"] = profile.missing_summary(analysis).withColumn(
            "missing_pct", F.bround("missing_pct", 2))
        dist = relations.data_distribution(analysis)
        tables["data_distribution"] = dist.withColumn("bin_start", F.bround("bin_start", 4)) \
            .withColumn("bin_end", F.bround("bin_end", 4))
    if predictions is not None and order_by is not None:
        tables["prediction_residuals"] = evaluate.prediction_residuals(predictions, order_by)
    if results is not None:
        tables["model_metrics_detail"] = evaluate.metrics_detail(results).withColumn(
            "value", F.bround("value", 4))
    if raw is not None:
        stages = {"has_raw": raw is not None, "has_cleaned": cleaned is not None,
                  "has_processed": processed is not None, "has_predictions": predictions is not None,
                  "has_model_results": results is not None}
        tables["pipeline_metadata"] = metadata_frame(raw.sparkSession, pipeline_metadata(raw, stages, extra))
    return tables


def executive_summary(meta: dict, results: DataFrame | None = None, importance: DataFrame | None = None,
                      top_n: int = 5) -> DataFrame:
    """The headline numbers of a run as (item, value) rows: dataset
    size and quality, the best model and its metrics, the top features."""
    spark = SparkSession.getActiveSession()
    rows = [(k, str(meta[k])) for k in ("total_rows", "total_columns", "missing_percentage",
                                         "duplicate_percentage", "data_quality_score") if k in meta]
    if results is not None:
        best = results.limit(1).collect()            # results are ranked, best first
        if best:
            for k, v in best[0].asDict().items():
                rows.append(("best_model" if k == "Model" else f"best_{k.lower().replace(' ', '_')}", str(v)))
    if importance is not None:
        top = importance.orderBy(F.col("importance").desc(), F.col("feature")).limit(top_n).collect()
        rows += [(f"top_feature_{i + 1}", r["feature"]) for i, r in enumerate(top)]
    return spark.createDataFrame(rows, "item string, value string")


MANIFEST_SCHEMA = "run string, table string, folder string, mode string, rows long"


def _manifest(target: Target) -> str:
    return os.path.join(target.path, "manifest")


def manifest(spark: SparkSession, target: Target) -> DataFrame:
    """(run, table, folder, mode, rows): one row for each table of each run."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).json(_manifest(target))
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def _folders(spark: SparkSession, target: Target, table: str) -> list[str]:
    """Folders of the current version: the last replacement and what was appended since."""
    rows = manifest(spark, target).where(F.col("table") == table).orderBy("run").collect()
    last = max((i for i, r in enumerate(rows) if r["mode"] != "append"), default=0)
    return [os.path.join(target.path, r["folder"]) for r in rows[last:]]


def read_published(spark: SparkSession, target: Target, table: str) -> DataFrame | None:
    """The current version of a table of a folder target, None if there is none."""
    folders = _folders(spark, target, table.lower())
    return spark.read.parquet(*folders) if folders else None


def _new_run() -> str:
    return f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"


def _save_version(df: DataFrame, table: str, target: Target, run: str, if_exists: str) -> int:
    """Write one table's new version in a single pass and announce it; the
    number of rows (an empty table is not announced)."""
    name, mode = table.lower(), _MODES[if_exists]
    spark = df.sparkSession
    if mode != "append" and mode != "overwrite" and _folders(spark, target, name):
        if mode == "ignore":
            return 0
        raise ValueError(f"{name} is published already")
    seen, folder = Observation(), os.path.join("versions", run, name)
    lower_names(df).observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(os.path.join(target.path, folder))
    rows = seen.get["rows"]
    if rows:
        kind = "append" if mode == "append" else "replace"
        spark.createDataFrame([(run, name, folder, kind, rows)], MANIFEST_SCHEMA).coalesce(1).write.mode("append").json(_manifest(target))
    return rows


STATUS_SCHEMA = T.StructType([T.StructField("table", T.StringType()), T.StructField("ok", T.BooleanType()),
                              T.StructField("error", T.StringType())])


def _published(tables: dict[str, DataFrame], names, target: Target, if_exists: str, run: str) -> list[tuple]:
    status = []
    for name in names:
        df = tables.get(name)
        if df is None:
            status.append((name, False, "not available"))
            continue
        try:
            # a catalog or a database is asked whether rows are there before the write: both read one copy
            ok = (_save_version(df, name, target, run, if_exists) > 0 if target.path is not None
                  else save_dataframe(cut_lineage(df), name, target, if_exists))
            status.append((name, ok, None if ok else "empty"))
        except Exception as exc:  # noqa: BLE001 - reported per table
            status.append((name, False, f"{type(exc).__name__}: {exc}"[:500]))
    return status


def publish(tables: dict[str, DataFrame], target: Target, if_exists: str = "replace") -> DataFrame:
    """S8 (how): write every table; one failing table does not stop the
    others and keeps its last version.  Returns ``(table, ok, error)`` rows
    for all 13 names."""
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.getActiveSession()
    return spark.createDataFrame(_published(tables, PUBLISHED_TABLES, target, if_exists, _new_run()), STATUS_SCHEMA)


def publish_run(target: Target, *, raw: DataFrame, cleaned: DataFrame | None = None, if_exists: str = "replace", **more) -> DataFrame:
    """S8 to a folder: raw and cleaned rows are computed and written once;
    the other tables (see ``dashboard_tables``) are made from what was
    written.  Returns the status rows."""
    spark, run = raw.sparkSession, _new_run()
    given = {"raw_data": raw, "cleaned_data": cleaned}
    status = _published(given, given, target, if_exists, run)
    written = {}
    for name, ok, error in status:
        if ok:
            written[name] = spark.read.parquet(os.path.join(target.path, "versions", run, name)).toDF(*given[name].columns)
        elif error == "empty":
            written[name] = given[name]
    # a frame that failed is left out: computing it again would fail again
    tables = dashboard_tables(raw=written.get("raw_data"), cleaned=written.get("cleaned_data"), **more)
    rest = [n for n in PUBLISHED_TABLES if n not in given]
    return spark.createDataFrame(status + _published(tables, rest, target, if_exists, run), STATUS_SCHEMA)


__all__ = ["Target", "to_csv", "save_dataframe", "metadata_frame", "pipeline_metadata",
           "dashboard_tables", "publish", "publish_run", "read_published", "manifest", "col"]
