"""Table sources.

``read_table`` is the Parquet entry point; ``nan_to_null`` is the one place
where float NaN becomes SQL NULL, so that every later operator only has to
handle NULL (pandas treats both as "missing"; Spark does not).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns:
        df = df.select(*columns)
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN → NULL for every float/double column (a projection, no job)."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[
        F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if c in floats else F.col(c)
        for c in df.columns
    ])
