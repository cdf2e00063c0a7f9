"""Documents to a training mix: rules, line dedup, near-duplicates,
decontamination, mixing.

Each stage takes the rows its predecessor kept, all of them, and is written
as Parquet in the shared checkpoint folder before the next one reads it.  All
but the last return the columns of ``documents`` (further columns included);
the last one returns its documents as often as the mix takes them.

Cases: see the operators; rows with null text fail the quality rules, rows
with a null id pass every stage on their own merits, an empty table stays
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, line_dedup, mixing, near_dedup, oracles, quality_rules
from tessera.llm.common import staged, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the threshold table."""
    return quality_rules.drop_failed(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source."""
    return line_dedup.cleaned(docs, host="source", length="n_chars" if "n_chars" in docs.columns else None)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest id."""
    return near_dedup.drop_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' targets."""
    return mixing.mixed(docs)


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage),
          ("decontamination", decontamination_stage), ("mixing", mixing_stage)]

ORACLE_SQL = oracles.pipeline()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
