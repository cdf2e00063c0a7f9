"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir
from tessera.sources.tables import table_path

#: What separates words; every other character belongs to one.
WHITE_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and reread
    it: the lineage ends there, and a lost executor costs a file read, not
    the jobs before it.  The folder belongs to the cluster's clean-up."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.  An expression
    used inside a lambda would otherwise be evaluated once per element."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does that for pure ASCII text (as many
    bytes as characters); other text takes the slower per-character map."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, UPPER.lower())))


def words(text: Column) -> Column:
    """Array of the white-space separated words of ``text`` (null text: none).
    Splitting at one literal character needs no regular expression, so the
    other white space becomes a space first."""
    spaced = F.coalesce(text, F.lit(""))
    for other in WHITE_SPACE[1:]:
        spaced = F.replace(spaced, F.lit(other), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")
