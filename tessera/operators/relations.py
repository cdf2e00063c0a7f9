"""Relations between columns and value distributions: correlation matrix
(A11/A22), equal-width histograms (A13/V1/V13), OLS trend (V4).

Correlations come from one Gram matrix; histograms from ``min``/``max`` in
one job, then one ``groupBy(column, bin)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.schema import classify_columns, col

CORR_SCHEMA = T.StructType([
    T.StructField("col1", T.StringType()),
    T.StructField("col2", T.StringType()),
    T.StructField("correlation", T.DoubleType()),
])


def _num(c: str) -> Column:
    x = col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _gram(means: list[float]):
    """Per Arrow batch the pairwise sums over rows where both columns have a
    value: count, x, y, xx, yy, xy of the values less their column's mean."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        total = 0.0
        k = len(means)
        for batch in batches:
            x = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in batch.columns])
            valid = np.isfinite(x)
            d, m = np.where(valid, x - np.array(means)[:, None], 0.0), valid.astype(float)
            total = total + np.stack([m @ m.T, d @ m.T, m @ d.T, (d * d) @ m.T, m @ (d * d).T, d @ d.T])
        if k and not np.isscalar(total):
            i, j = np.triu_indices(k)
            names = ["i", "j", "n", "x", "y", "xx", "yy", "xy"]
            yield pa.RecordBatch.from_arrays([pa.array(i.astype("int32")), pa.array(j.astype("int32")),
                                              *[pa.array(t[i, j]) for t in total]], names=names)
    return run


def correlation_matrix(df: DataFrame, columns: list[str] | None = None,
                       max_columns: int | None = None) -> DataFrame:
    """Pearson correlation for every pair (upper triangle with the
    diagonal) of the numeric columns, pairwise-complete; null where a side is
    constant.  All columns unless ``max_columns`` says how many.

    One pass for the means, one for the Gram matrix: numpy multiplies each
    Arrow batch by itself, Spark adds the small matrices up, so the cost of a
    further column is one more row of a matrix product, not one more
    aggregate per pair."""
    cols = (list(columns) if columns is not None else list(classify_columns(df).numeric))[:max_columns]
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], CORR_SCHEMA)
    row = df.agg(*[f(_finite(c)).alias(f"{n}{i}") for i, c in enumerate(cols)
                   for n, f in (("m", F.avg), ("a", F.min), ("b", F.max))]).first()
    means = [float(row[f"m{i}"] or 0.0) for i in range(len(cols))]
    sums = (df.select(*[_finite(c).alias(f"c{i}") for i, c in enumerate(cols)])
            .mapInArrow(_gram(means), "i int, j int, n double, x double, y double, xx double, yy double, xy double")
            .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")]).collect())
    # a spread below rounding of the values is none
    least = [1e-14 * max(abs(float(row[f"a{i}"] or 0)), abs(float(row[f"b{i}"] or 0)), 1e-300) ** 2 for i in range(len(cols))]
    value = {}
    for r in sums:
        i, j, n = r["i"], r["j"], r["n"]
        vx, vy = ((r["xx"] - r["x"] ** 2 / n, r["yy"] - r["y"] ** 2 / n) if n else (0.0, 0.0))
        if vx > n * least[i] and vy > n * least[j]:
            c = (r["xy"] - r["x"] * r["y"] / n) / (vx ** 0.5 * vy ** 0.5)
            value[i, j] = 1.0 if i == j else max(-1.0, min(1.0, c))
    rows = [(a, cols[j], value.get((i, j))) for i, a in enumerate(cols) for j in range(i, len(cols))]
    return df.sparkSession.createDataFrame(rows, CORR_SCHEMA)


def _finite(c: str) -> Column:
    x = _num(c)
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def correlation_wide(df: DataFrame, columns: list[str] | None = None,
                     max_columns: int | None = None) -> DataFrame:
    """The full square matrix, one row per column (heatmap layout)."""
    cols = (list(columns) if columns is not None else list(classify_columns(df).numeric))[:max_columns]
    value = {}
    for r in correlation_matrix(df, cols).collect():
        value[(r["col1"], r["col2"])] = r["correlation"]
        value[(r["col2"], r["col1"])] = r["correlation"]
    schema = T.StructType([T.StructField("column_name", T.StringType())]
                          + [T.StructField(c, T.DoubleType()) for c in cols])
    rows = [(a, *[value.get((a, b)) for b in cols]) for a in cols]
    return df.sparkSession.createDataFrame(rows, schema)


# ---------------------------------------------------------------------------
# histograms
# ---------------------------------------------------------------------------
HIST_SCHEMA = T.StructType([
    T.StructField("column_name", T.StringType()),
    T.StructField("bin", T.IntegerType()),
    T.StructField("bin_start", T.DoubleType()),
    T.StructField("bin_end", T.DoubleType()),
    T.StructField("bin_label", T.StringType()),
])


def bin_edges(lo: float, hi: float, n_bins: int) -> list[float]:
    """numpy ``histogram`` edges: ``linspace`` (i·step + start, last = stop);
    a constant column spans ``[x − 0.5, x + 0.5]``."""
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / n_bins
    edges = [i * step + lo for i in range(n_bins + 1)]
    edges[-1] = hi
    return edges


def with_bins(df: DataFrame, values: dict[str, Column], edges_by_name: dict[str, list[float]],
              keep: list[str] | None = None) -> DataFrame:
    """Project ``keep`` columns plus one bin column per entry of ``values``
    (name → value expression), with numpy's edge corrections: last bin
    right-closed; a value left of its computed bin's start moves down, one
    at/after the next edge moves up; values outside the edges → null.

    The three steps are separate projections so each intermediate is
    computed once per row (a single nested expression would repeat the
    floor/lookup work nine times)."""
    keep = list(keep or [])
    names = list(values)
    x = {n: f"_x{i}" for i, n in enumerate(names)}
    i0 = {n: f"_a{i}" for i, n in enumerate(names)}
    i1 = {n: f"_b{i}" for i, n in enumerate(names)}
    arr = {n: F.array(*[F.lit(float(v)) for v in edges_by_name[n]]) for n in names}
    s1 = df.select(*[col(k) for k in keep], *[values[n].alias(x[n]) for n in names])
    step = []
    for n in names:
        e = edges_by_name[n]
        nb, lo, hi = len(e) - 1, e[0], e[-1]
        step.append(F.least(F.floor((F.col(x[n]) - F.lit(lo)) * F.lit(nb / (hi - lo))).cast("int"),
                            F.lit(nb - 1)).alias(i0[n]))
    s2 = s1.select("*", *step)
    s3 = s2.select(*[col(k) for k in keep], *[F.col(x[n]) for n in names], *[
        F.when(F.col(x[n]) < F.element_at(arr[n], F.col(i0[n]) + 1), F.col(i0[n]) - 1)
         .otherwise(F.col(i0[n])).alias(i1[n]) for n in names])
    out = []
    for n in names:
        e = edges_by_name[n]
        nb = len(e) - 1
        b = F.when((F.col(i1[n]) != nb - 1) & (F.col(x[n]) >= F.element_at(arr[n], F.col(i1[n]) + 2)),
                   F.col(i1[n]) + 1).otherwise(F.col(i1[n]))
        out.append(F.when((F.col(x[n]) >= F.lit(e[0])) & (F.col(x[n]) <= F.lit(e[-1])), b).alias(n))
    return s3.select(*[col(k) for k in keep], *out)


def histogram_grid(spark, edges_by_column: dict[str, list[float]]) -> DataFrame:
    rows = []
    for c, edges in edges_by_column.items():
        for i in range(len(edges) - 1):
            rows.append((c, i, edges[i], edges[i + 1], f"{edges[i]:.2f} – {edges[i + 1]:.2f}"))
    return spark.createDataFrame(rows, HIST_SCHEMA)


def histogram_counts(df: DataFrame, edges_by_column: dict[str, list[float]]) -> DataFrame:
    """``(column_name, bin, count)`` for every non-empty bin: bin indices are
    computed column-wise in a projection, unpivoted, and counted by one
    ``groupBy(column, bin)`` (partial aggregation keeps the shuffle at
    ≤ columns × bins rows per task)."""
    cols = list(edges_by_column)
    binned = with_bins(df, {c: _num(c) for c in cols}, edges_by_column)
    return (binned.unpivot([], cols, "column_name", "bin")
            .where(F.col("bin").isNotNull())
            .groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("count")))


def data_distribution(df: DataFrame, n_bins: int = 10, columns: list[str] | None = None,
                      max_columns: int | None = None, lower_names: bool = True) -> DataFrame:
    """Equal-width histogram of the numeric
    columns, empty bins included: column_name, bin_start, bin_end, bin_label, count."""
    cols = (list(columns) if columns is not None else list(classify_columns(df).numeric))[:max_columns]
    out_schema = T.StructType([f for f in HIST_SCHEMA.fields if f.name != "bin"]
                              + [T.StructField("count", T.LongType())])
    if not cols:
        return df.sparkSession.createDataFrame([], out_schema)
    row = df.agg(*[F.min(_num(c)).alias(f"lo{i}") for i, c in enumerate(cols)],
                 *[F.max(_num(c)).alias(f"hi{i}") for i, c in enumerate(cols)]).collect()[0]
    edges = {c: bin_edges(row[f"lo{i}"], row[f"hi{i}"], n_bins)
             for i, c in enumerate(cols) if row[f"lo{i}"] is not None}
    if not edges:
        return df.sparkSession.createDataFrame([], out_schema)
    return _distribution_from_edges(df, edges, lower_names)


def _distribution_from_edges(df: DataFrame, edges: dict[str, list[float]], lower_names: bool) -> DataFrame:
    counts = histogram_counts(df, edges)
    grid = histogram_grid(df.sparkSession, edges)
    name = F.lower(F.col("column_name")) if lower_names else F.col("column_name")
    # grid and counts both have ≤ columns × bins rows
    return (grid.join(F.broadcast(counts), ["column_name", "bin"], "left")
            .select(name.alias("column_name"), "bin_start", "bin_end", "bin_label",
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """V1: histogram of one column."""
    return data_distribution(df, n_bins=bins, columns=[column], lower_names=False)


def outlier_comparison(before: DataFrame, after: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """The same column before/after outlier treatment on shared edges."""
    x = _num(column)
    r1 = before.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).collect()[0]
    r2 = after.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).collect()[0]
    los = [v for v in (r1["lo"], r2["lo"]) if v is not None]
    his = [v for v in (r1["hi"], r2["hi"]) if v is not None]
    if not los:
        return _distribution_from_edges(before.limit(0), {column: bin_edges(0.0, 1.0, bins)}, False) \
            .withColumn("stage", F.lit("before"))
    edges = {column: bin_edges(min(los), max(his), bins)}
    b = _distribution_from_edges(before, edges, False).withColumn("stage", F.lit("before"))
    a = _distribution_from_edges(after, edges, False).withColumn("stage", F.lit("after"))
    return b.unionByName(a)


def ols_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """V4 trend line over ALL rows (the chart samples points, the line does
    not need to): slope, intercept, r², n."""
    xx, yy = _num(x), _num(y)
    return df.agg(F.regr_slope(yy, xx).alias("slope"),
                  F.regr_intercept(yy, xx).alias("intercept"),
                  F.regr_r2(yy, xx).alias("r2"),
                  F.regr_count(yy, xx).alias("n"))
