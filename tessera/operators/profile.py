"""Dataset profiling: summary, dtype report, missing reports, column
statistics, describe.

Shape of every job: per-column statistics are computed in ONE wide
aggregate over the original rows (partial aggregation on every executor,
a single small final row); no per-column loop of jobs and no unpivot of the
data unless the statistic needs grouping by value (distinct counts, modes),
in which case ``(column, value)`` pairs are aggregated with a two-stage
``groupBy`` so that hot values collapse map-side.  Exact medians use the
histogram-refinement quantiles in :mod:`tessera.functions.quantiles`.
The reports themselves have one row per column, so they are assembled on
the driver from those tiny aggregate rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.quantiles import quantiles
from tessera.functions.schema import classify_columns, col, dtype_name, group_of
from tessera.functions.stats import adjusted_kurtosis, adjusted_skewness


def _is_float(dtype) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def _missing(c: str, dtype) -> Column:
    x = col(c)
    return x.isNull() | F.isnan(x) if _is_float(dtype) else x.isNull()


# ---------------------------------------------------------------------------
# A1 dataset summary
# ---------------------------------------------------------------------------
SUMMARY_SCHEMA = T.StructType([
    T.StructField("row_count", T.LongType()),
    T.StructField("column_count", T.LongType()),
    T.StructField("missing_values", T.LongType()),
    T.StructField("duplicate_rows", T.LongType()),
    T.StructField("numeric_columns", T.LongType()),
    T.StructField("categorical_columns", T.LongType()),
    T.StructField("datetime_columns", T.LongType()),
])


def dataset_summary(df: DataFrame) -> DataFrame:
    """rows, columns, missing cells, duplicate rows, column-group counts.

    One job: rows are grouped by 128 bits of hash (nulls and their places
    included, -0.0 as 0.0), so the shuffle carries 16 bytes and two counts
    for each distinct row, not the rows themselves.
    """
    groups = classify_columns(df)
    fields = df.schema.fields
    if not fields:
        raise ValueError("dataset has no columns")
    row_missing = sum((_missing(f.name, f.dataType).cast("long") for f in fields), F.lit(0).cast("long"))
    parts = [x for f in fields for x in (col(f.name) + F.lit(0.0) if _is_float(f.dataType) else col(f.name), col(f.name).isNull())]
    return (df.groupBy(F.xxhash64(*parts).alias("_a"), F.xxhash64(F.lit(1), *parts).alias("_b"))
            .agg(F.count(F.lit(1)).alias("_n"), F.sum(row_missing).alias("_m"))
            .agg(F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("dups"), F.sum("_m").alias("miss"))
            .select(
                F.coalesce(F.col("rows"), F.lit(0)).cast("long").alias("row_count"),
                F.lit(len(fields)).cast("long").alias("column_count"),
                F.coalesce(F.col("miss"), F.lit(0)).cast("long").alias("missing_values"),
                F.coalesce(F.col("dups"), F.lit(0)).cast("long").alias("duplicate_rows"),
                F.lit(len(groups.numeric)).cast("long").alias("numeric_columns"),
                F.lit(len(groups.categorical)).cast("long").alias("categorical_columns"),
                F.lit(len(groups.datetime)).cast("long").alias("datetime_columns"),
            ))


# ---------------------------------------------------------------------------
# A3 / A12 missing reports
# ---------------------------------------------------------------------------
MISSING_SCHEMA = T.StructType([
    T.StructField("column_name", T.StringType()),
    T.StructField("missing_count", T.LongType()),
    T.StructField("missing_pct", T.DoubleType()),
    T.StructField("dtype", T.StringType()),
])


def _missing_counts(df: DataFrame) -> tuple[int, list[tuple[str, int, str]]]:
    fields = df.schema.fields
    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.sum(_missing(f.name, f.dataType).cast("long")).alias(f"m{i}")
                   for i, f in enumerate(fields)]).collect()[0]
    n = int(row["_rows"])
    return n, [(f.name, int(row[f"m{i}"] or 0), dtype_name(f.dataType)) for i, f in enumerate(fields)]


def missing_summary(df: DataFrame) -> DataFrame:
    """Every column with missing count, % of rows and type."""
    n, counts = _missing_counts(df)
    rows = [(c, m, (m * 100.0 / n) if n else 0.0, t) for c, m, t in counts]
    return df.sparkSession.createDataFrame(rows, MISSING_SCHEMA)


def missing_report(df: DataFrame) -> DataFrame:
    """A3: columns with missing values only, most missing first."""
    n, counts = _missing_counts(df)
    rows = [(c, m, (m * 100.0 / n) if n else 0.0) for c, m, _ in counts if m > 0]
    rows.sort(key=lambda r: (-r[1], r[0]))
    schema = T.StructType(MISSING_SCHEMA.fields[:3])
    return df.sparkSession.createDataFrame(rows, schema)


# ---------------------------------------------------------------------------
# distinct counts and modes via (column, value) pairs
# ---------------------------------------------------------------------------
def _as_text(c: str, dtype) -> Column:
    x = col(c)
    if _is_float(dtype):
        x = F.when(~F.isnan(x), x + F.lit(0.0))      # -0.0 and 0.0 are one value
    return x.cast("string")


def value_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value)`` string pairs of non-missing values (Expand, no shuffle)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _as_text(c, types[c]).alias("value")) for c in columns
    ]))
    return df.select(pairs.alias("p")).select("p.column", "p.value").where(F.col("value").isNotNull())


def distinct_counts(df: DataFrame, columns: list[str], exact: bool = True) -> dict[str, int]:
    """Distinct non-null values per column.

    exact: two-stage aggregate over (column, value) — distributed, hot values
    collapse in partial aggregation.  Not exact: one HyperLogLog++ agg.
    """
    if not columns:
        return {}
    if not exact:
        types = {f.name: f.dataType for f in df.schema.fields}
        row = df.agg(*[F.approx_count_distinct(_as_text(c, types[c])).alias(f"d{i}")
                       for i, c in enumerate(columns)]).collect()[0]
        return {c: int(row[f"d{i}"]) for i, c in enumerate(columns)}
    # long values travel as their 16-byte MD5: ids and free text cost no more than numbers
    key = F.when(F.octet_length("value") > 16, F.unhex(F.md5(F.col("value").cast("binary")))).otherwise(F.col("value").cast("binary"))
    res = (value_pairs(df, columns).select("column", key.alias("value"), (F.octet_length("value") > 16).alias("long")).distinct()
           .groupBy("column").count().collect())
    out = {c: 0 for c in columns}
    out.update({r["column"]: int(r["count"]) for r in res})
    return out


def column_modes(df: DataFrame, columns: list[str]) -> dict[str, tuple[str | None, int]]:
    """Most frequent value per column (smallest value on ties) and its count.

    ``min(struct(-count, value))`` is an algebraic aggregate, so the per-column
    reduction is partial-aggregated too; no group of values is ever gathered.
    """
    if not columns:
        return {}
    res = (value_pairs(df, columns).groupBy("column", "value").count()
           .groupBy("column")
           .agg(F.min(F.struct((-F.col("count")).alias("neg"), F.col("value").alias("value"))).alias("m"))
           .select("column", F.col("m.value").alias("value"), (-F.col("m.neg")).alias("freq"))
           .collect())
    out: dict[str, tuple[str | None, int]] = {c: (None, 0) for c in columns}
    out.update({r["column"]: (r["value"], int(r["freq"])) for r in res})
    return out


def distinct_and_modes(df: DataFrame, columns: list[str]) -> tuple[dict[str, int], dict[str, tuple]]:
    """Exact distinct count and mode per column from ONE shuffle of
    ``(column, value)`` counts (both are reductions of the same table)."""
    if not columns:
        return {}, {}
    res = (value_pairs(df, columns).groupBy("column", "value").count()
           .groupBy("column")
           .agg(F.count(F.lit(1)).alias("unique"),
                F.min(F.struct((-F.col("count")).alias("neg"), F.col("value").alias("value"))).alias("m"))
           .select("column", "unique", F.col("m.value").alias("value"), (-F.col("m.neg")).alias("freq"))
           .collect())
    uniq = {c: 0 for c in columns}
    modes: dict[str, tuple] = {c: (None, 0) for c in columns}
    for r in res:
        uniq[r["column"]] = int(r["unique"])
        modes[r["column"]] = (r["value"], int(r["freq"]))
    return uniq, modes


# ---------------------------------------------------------------------------
# A2 dtype report
# ---------------------------------------------------------------------------
DTYPE_SCHEMA = T.StructType([
    T.StructField("column_name", T.StringType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("non_null", T.LongType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("unique_values", T.LongType()),
    T.StructField("sample_value", T.StringType()),
])


def dtype_report(df: DataFrame, order_by: str | None = None, exact: bool = True) -> DataFrame:
    """Per column: type, non-null, null, distinct, first non-null sample.

    The sample is the value of the first row by ``order_by`` (row position
    does not exist in Spark); without ``order_by`` the smallest value.
    """
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        miss = _missing(f.name, f.dataType)
        text = F.when(~miss, _as_text(f.name, f.dataType))
        aggs.append(F.sum((~miss).cast("long")).alias(f"nn{i}"))
        if order_by is not None:
            aggs.append(F.min_by(text, F.when(~miss, col(order_by))).alias(f"s{i}"))
        else:
            aggs.append(F.min(text).alias(f"s{i}"))
    row = df.agg(*aggs).collect()[0]
    n = int(row["_rows"])
    uniq = distinct_counts(df, [f.name for f in fields], exact=exact)
    rows = []
    for i, f in enumerate(fields):
        nn = int(row[f"nn{i}"] or 0)
        rows.append((f.name, dtype_name(f.dataType), nn, n - nn, uniq.get(f.name, 0), row[f"s{i}"] or ""))
    return df.sparkSession.createDataFrame(rows, DTYPE_SCHEMA)


# ---------------------------------------------------------------------------
# A10 column statistics
# ---------------------------------------------------------------------------
COLUMN_STATS_SCHEMA = T.StructType([
    T.StructField("column_name", T.StringType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("median", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("min_val", T.DoubleType()),
    T.StructField("max_val", T.DoubleType()),
    T.StructField("skewness", T.DoubleType()),
    T.StructField("kurtosis", T.DoubleType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("null_pct", T.DoubleType()),
])


def _moment_aggs(columns: list[str], prefix: str = "") -> list:
    aggs = []
    for i, c in enumerate(columns):
        x = col(c).cast("double")
        x = F.when(~F.isnan(x), x)
        aggs += [
            F.count(x).alias(f"{prefix}n{i}"),
            F.avg(x).alias(f"{prefix}mean{i}"),
            F.stddev_samp(x).alias(f"{prefix}std{i}"),
            F.min(x).alias(f"{prefix}min{i}"),
            F.max(x).alias(f"{prefix}max{i}"),
            adjusted_skewness(x).alias(f"{prefix}skew{i}"),
            adjusted_kurtosis(x).alias(f"{prefix}kurt{i}"),
        ]
    return aggs


def column_statistics(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """A10: mean, median, std, min, max, skewness, kurtosis, nulls per numeric column."""
    cols = list(columns) if columns is not None else list(classify_columns(df).numeric)
    if not cols:
        return df.sparkSession.createDataFrame([], COLUMN_STATS_SCHEMA)
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *_moment_aggs(cols)).collect()[0]
    total = int(row["_rows"])
    stats = {c: (int(row[f"n{i}"]), row[f"min{i}"], row[f"max{i}"]) for i, c in enumerate(cols)}
    medians = quantiles(df, cols, [0.5], exact=exact, stats=stats)
    rows = []
    for i, c in enumerate(cols):
        n = int(row[f"n{i}"])
        nulls = total - n
        has = n > 0
        rows.append((
            c,
            row[f"mean{i}"] if has else None,
            medians[c][0] if has else None,
            row[f"std{i}"] if has else None,
            row[f"min{i}"] if has else None,
            row[f"max{i}"] if has else None,
            row[f"skew{i}"] if has else None,
            row[f"kurt{i}"] if has else None,
            nulls,
            (nulls * 100.0 / total) if total else 0.0,
        ))
    return df.sparkSession.createDataFrame(rows, COLUMN_STATS_SCHEMA)


# ---------------------------------------------------------------------------
# A14 describe(include="all")
# ---------------------------------------------------------------------------
DESCRIBE_SCHEMA = T.StructType([
    T.StructField("column_name", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("unique", T.LongType()),
    T.StructField("top", T.StringType()),
    T.StructField("freq", T.LongType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("q25", T.DoubleType()),
    T.StructField("q50", T.DoubleType()),
    T.StructField("q75", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
])


def describe(df: DataFrame, exact: bool = True) -> DataFrame:
    """Pandas ``describe(include='all')`` as a long table.

    Numeric columns get count/mean/std/min/quartiles/max; text and boolean
    columns count/unique/top/freq (top = most frequent, smallest on ties);
    dates and timestamps count/mean/min/quartiles/max in seconds since 1970
    (the table has one type for all columns).
    """
    groups = classify_columns(df)
    dates = list(groups.datetime)
    df = df.select(*[col(c).cast("timestamp").cast("double").alias(c) if c in dates else col(c) for c in df.columns])
    num, cat = list(groups.numeric) + dates, list(groups.categorical) + list(groups.boolean)
    aggs = [F.count(F.lit(1)).alias("_rows")] + _moment_aggs(num)
    aggs += [F.count(col(c)).alias(f"cn{i}") for i, c in enumerate(cat)]
    row = df.agg(*aggs).collect()[0]
    stats = {c: (int(row[f"n{i}"]), row[f"min{i}"], row[f"max{i}"]) for i, c in enumerate(num)}
    qs = quantiles(df, num, [0.25, 0.5, 0.75], exact=exact, stats=stats)
    uniq, modes = distinct_and_modes(df, cat)
    rows = []
    for i, c in enumerate(num):
        q = qs[c]
        rows.append((c, int(row[f"n{i}"]), None, None, None, row[f"mean{i}"], None if c in dates else row[f"std{i}"],
                     row[f"min{i}"], q[0], q[1], q[2], row[f"max{i}"]))
    for i, c in enumerate(cat):
        top, freq = modes[c]
        rows.append((c, int(row[f"cn{i}"]), uniq[c], top, freq if top is not None else None,
                     None, None, None, None, None, None, None))
    return df.sparkSession.createDataFrame(rows, DESCRIBE_SCHEMA)


@dataclass(frozen=True)
class SummaryNumbers:
    rows: int
    columns: int
    missing_values: int
    duplicate_rows: int
    numeric_columns: int
    categorical_columns: int
    datetime_columns: int


def summary_numbers(df: DataFrame) -> SummaryNumbers:
    r = dataset_summary(df).collect()[0]
    return SummaryNumbers(r["row_count"], r["column_count"], r["missing_values"], r["duplicate_rows"],
                          r["numeric_columns"], r["categorical_columns"], r["datetime_columns"])


__all__ = [
    "dataset_summary", "missing_summary", "missing_report", "dtype_report", "column_statistics",
    "describe", "distinct_counts", "column_modes", "value_pairs", "summary_numbers", "group_of",
]


# ---------------------------------------------------------------------------
# P22 tighten schema
# ---------------------------------------------------------------------------
_INT_RANGES = ((T.ByteType(), -(2 ** 7), 2 ** 7 - 1), (T.ShortType(), -(2 ** 15), 2 ** 15 - 1),
               (T.IntegerType(), -(2 ** 31), 2 ** 31 - 1), (T.LongType(), -(2 ** 63), 2 ** 63 - 1))


def tighten_schema(df: DataFrame) -> DataFrame:
    """Narrowest integral type that holds each integer column's range, and
    float for double columns whose every value survives the round trip; one
    aggregate decides all columns.  (Text needs no categorical type: Parquet
    dictionary-encodes repeated strings by itself.)"""
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ByteType, T.ShortType,
                                                                         T.IntegerType, T.LongType))]
    dbls = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    if not ints and not dbls:
        return df
    aggs = []
    for i, c in enumerate(ints):
        aggs += [F.min(col(c)).alias(f"lo{i}"), F.max(col(c)).alias(f"hi{i}")]
    for i, c in enumerate(dbls):
        x = col(c)
        lossy = F.when(x.isNotNull() & ~F.isnan(x) & (x.cast("float").cast("double") != x), 1).otherwise(0)
        aggs.append(F.max(lossy).alias(f"lossy{i}"))
    row = df.agg(*aggs).collect()[0]
    target = {}
    for i, c in enumerate(ints):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if lo is None:
            continue
        for t, a, b in _INT_RANGES:
            if a <= lo and hi <= b:
                target[c] = t
                break
    for i, c in enumerate(dbls):
        if not row[f"lossy{i}"]:
            target[c] = T.FloatType()
    return df.select(*[col(c).cast(target[c]).alias(c) if c in target else col(c) for c in df.columns])
