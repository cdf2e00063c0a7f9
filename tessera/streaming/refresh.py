"""Incremental column profile of arriving files (Structured Streaming).

The surveyed application refreshes its dashboard every 10 s by recomputing
statistics.  Here the same column statistics are a streaming aggregation:
new Parquet files are read as they land, each row is unpivoted into
``(column_name, value)``, and ``groupBy(column_name)`` keeps mergeable
state (count, mean, M2/M3/M4 moments, min, max) in the state store, so a
refresh costs only the new files.  Each trigger publishes the complete,
small result (one row per column) with ``foreachBatch`` to a table folder,
overwriting the previous one.  Checkpoints live in the shared checkpoint
folder, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.schema import classify_columns, col
from tessera.functions.stats import adjusted_kurtosis, adjusted_skewness
from tessera.session import checkpoint_dir

REFRESH_SECONDS = 10


def profile_stream(stream: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Streaming per-column statistics (complete output mode)."""
    cols = columns if columns is not None else list(classify_columns(stream).numeric)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), col(c).cast("double").alias("x")) for c in cols]))
    long = stream.select(pairs.alias("p")).select("p.column_name", "p.x")
    x = F.when(~F.isnan("x"), F.col("x"))
    return long.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(x).alias("non_null"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min_val"),
        F.max(x).alias("max_val"),
        adjusted_skewness(x).alias("skewness"),
        adjusted_kurtosis(x).alias("kurtosis"),
    )


def start_profile_refresh(spark: SparkSession, source: str, schema: T.StructType, out_path: str,
                          columns: list[str] | None = None, checkpoint: str | None = None,
                          refresh_seconds: int | None = REFRESH_SECONDS,
                          available_now: bool = False) -> StreamingQuery:
    """Start the refresh: every ``refresh_seconds`` (or once over what is
    there now) publish the column statistics of everything seen so far."""
    checkpoint = checkpoint or os.path.join(checkpoint_dir(spark), "streams", uuid.uuid4().hex)
    stream = spark.readStream.schema(schema).parquet(source)
    stats = profile_stream(stream, columns)

    def publish(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    writer = (stats.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
              .foreachBatch(publish))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif refresh_seconds:
        writer = writer.trigger(processingTime=f"{refresh_seconds} seconds")
    return writer.start()


def refresh_once(spark: SparkSession, source: str, schema: T.StructType,
                 columns: list[str] | None = None) -> DataFrame:
    """Run the refresh over the files present now and return the published table."""
    out = os.path.join(checkpoint_dir(spark), "profiles", uuid.uuid4().hex)
    q = start_profile_refresh(spark, source, schema, out, columns, available_now=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(out)
