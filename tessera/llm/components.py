"""Connected components of an edge table, by alternating large-star and
small-star steps.  Each step replaces edges by edges to a neighbourhood's
minimum: a partial-aggregation minimum per node, written, and a join that AQE
can split at a node with many neighbours; every round is written to the
shared folder, and only two numbers reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged


def _star(edges: DataFrame, directed: DataFrame, larger: bool) -> DataFrame:
    """Link neighbours to the minimum of each node's neighbourhood: those
    above the node (``larger``), or the node and those below it."""
    low = staged(directed.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc-low")
    joined = directed.join(low, "u")
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (u, v); ``component`` is
    the smallest node that can be reached.  Loops and repeated edges are
    harmless; an empty table gives an empty one."""
    def mark(e):
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]
    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(),
                 "cc-edges")
    seen = mark(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = staged(_star(now, both, True), "cc-large")
        now = staged(_star(large, large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False), "cc-small")
        before, seen = seen, mark(now)
        if seen == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
