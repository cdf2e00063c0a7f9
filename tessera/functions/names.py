"""Column-name normalisation (driver-side: names are metadata, not data)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: Everything that separates the words of a name: symbols, spaces, underscores.
_GAP = re.compile(r"[\W_]+")


def normalize_column_name(name: str) -> str:
    """Lower-case words of ``name`` joined by single underscores."""
    return "_".join(word for word in _GAP.split(str(name).lower()) if word)


class NameCollisionError(ValueError):
    pass


def normalize_column_names(df: DataFrame) -> DataFrame:
    """Rename every column with :func:`normalize_column_name`.

    Two source names that normalise to the same name would give an ambiguous
    Spark column, so that raises instead of silently duplicating.
    """
    new = [normalize_column_name(c) for c in df.columns]
    seen: dict[str, str] = {}
    for old, n in zip(df.columns, new):
        if n in seen:
            raise NameCollisionError(f"columns {seen[n]!r} and {old!r} both normalise to {n!r}")
        seen[n] = old
    if new == list(df.columns):
        return df
    return df.toDF(*new)
