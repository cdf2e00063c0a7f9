"""Schema classification (no Spark job: reads ``df.schema`` only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class ColumnGroups:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    datetime: tuple[str, ...]
    boolean: tuple[str, ...]
    other: tuple[str, ...]

    @property
    def all_feature_candidates(self) -> tuple[str, ...]:
        return self.numeric + self.categorical + self.boolean + self.datetime


def group_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dtype, DATETIME_TYPES):
        return "datetime"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "categorical"
    return "other"


def classify_columns(df: DataFrame) -> ColumnGroups:
    buckets: dict[str, list[str]] = {k: [] for k in ("numeric", "categorical", "datetime", "boolean", "other")}
    for field in df.schema.fields:
        buckets[group_of(field.dataType)].append(field.name)
    return ColumnGroups(**{k: tuple(v) for k, v in buckets.items()})


def numeric_columns(df: DataFrame) -> list[str]:
    return list(classify_columns(df).numeric)


def categorical_columns(df: DataFrame) -> list[str]:
    return list(classify_columns(df).categorical)


def dtype_name(dtype: T.DataType) -> str:
    """Short, stable type label used in reports (Spark's simple string;
    both timestamp flavours are reported as ``timestamp``)."""
    if isinstance(dtype, T.TimestampNTZType):
        return "timestamp"
    return dtype.simpleString()


def col(name: str):
    """``F.col`` that tolerates dots, spaces and backticks in the name."""
    from pyspark.sql import functions as F
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(name: str, taken) -> str:
    """``name``, with underscores added until no column has it (names are
    compared without case, as Spark does)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name
