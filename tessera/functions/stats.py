"""Column-expression helpers for statistics (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def adjusted_skewness(x: Column) -> Column:
    """Bias-adjusted sample skewness G1 (pandas ``skew``): null for n < 3,
    0 for a constant column."""
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    var = F.var_pop(x)
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(var == 0, F.lit(0.0))
            .otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2)))


def adjusted_kurtosis(x: Column) -> Column:
    """Bias-adjusted excess kurtosis G2 (pandas ``kurt``): null for n < 4,
    0 for a constant column."""
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    var = F.var_pop(x)
    return (F.when(n < 4, F.lit(None).cast("double"))
            .when(var == 0, F.lit(0.0))
            .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)))
