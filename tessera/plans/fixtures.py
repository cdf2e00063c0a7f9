"""Derived inputs built from the given tables (same definitions as the SQL
in :mod:`tessera.plans.oracle`).

The given Parquet tables hold no nulls and no repeated rows, so the cleaning
operators get a "dirty" view computed from ``orders`` by formula: missing
numbers, padded and ``'nan'`` text, text dates, an all-null column, and
repeated rows.  Every row of ``orders`` is used; the formulas only decide
which values are made dirty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import read_table


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    dirty = o.select(
        k.alias("o_orderkey"),
        F.when(k % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(k % 11 == 0, F.lit(None).cast("string"))
         .when(k % 13 == 0, F.lit("nan"))
         .otherwise(F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" "))).alias("prio"),
        F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("d"),
        F.when(k % 5 == 0, F.lit(None).cast("timestamp")).otherwise(F.col("o_orderdate")).alias("dt"),
        F.lit(None).cast("double").alias("empty_col"),
    )
    return dirty.unionByName(dirty.where(k % 17 == 0))


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """actual / fixed prediction / binary label / tied score over all events."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id"),
        F.col("value").alias("actual"),
        (F.col("value") * F.lit(0.9) + (F.col("user_id") % 10).cast("double")).alias("predicted"),
        F.when(F.col("value") > 50, 1).otherwise(0).alias("label"),
        ((F.col("user_id") % 20).cast("double") / F.lit(20.0)).alias("score"),
    )
