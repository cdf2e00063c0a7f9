"""Mixing sources to target weights.

Tokens (here: white-space words) are summed per source with partial
aggregation, each source gets a target, and the repetition rate
``target / size`` decides how often each of its documents is emitted:
``floor(rate)`` times, plus once more when a hash of (seed, document) falls
below the fraction.  The per-source table has one row per source; documents
meet it in a join that carries no group into one task.

Targets: a source's share of the budget goes by weight, a target stops at
``max_repeat`` times the source's size, and the excess is shared again by
weight among the others until none is above.

Cases: a null text has no words; null is a source of its own, after all
others; a null document id is hashed as an empty one; repeated rows draw the
same number and are emitted alike; an empty table, or one without words,
gives targets of 0 and no copies; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged, words
from tessera.operators.ordered import dense_index

WEIGHTS = (5, 2, 1)
BUDGET = 1.5               # of all tokens
MAX_REPEAT = 2.0
SEED = 17
#: A source table of at most so many rows is broadcast (under 10 MB).
BROADCAST_SOURCES = 100_000


def n_tokens(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_sizes(sized: DataFrame) -> DataFrame:
    """One row per source: ``source_size`` tokens over all its documents."""
    return sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))


def by_rank(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Weights repeat over the sources in code-point order, null last."""
    n = len(weights)
    ranked = dense_index(sizes, "source", "_rank")
    out = sizes.join(ranked, "source", "left")
    last = sizes.where("source IS NOT NULL").count()
    rank = F.coalesce(F.col("_rank"), F.lit(last))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % n + 1).cast("int"))
    return out.select("source", "source_size", weight.alias("weight"))


def targets(weighted: DataFrame, budget: float = BUDGET, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Add ``target``.  Sources at their limit are those whose limit is below
    ``level * weight``; the level follows from the sources that are not.  Each
    round is a one-row aggregate and adds sources to the limited set, so it
    ends; only two numbers ever reach the driver."""
    limit = F.col("source_size") * F.lit(max_repeat)
    total = weighted.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    level, before = 0.0, -1
    while True:
        at_limit = limit <= F.col("weight") * F.lit(level)
        r = weighted.agg(F.count(F.when(at_limit, 1)).alias("n"), F.sum(F.when(at_limit, limit)).alias("used"),
                         F.sum(F.when(~at_limit, F.col("weight"))).alias("w")).first()
        if r["n"] == before or not r["w"]:
            break
        before = r["n"]
        level = max(0.0, total * budget - (r["used"] or 0.0)) / r["w"]
    return weighted.withColumn("target", F.least(limit, F.col("weight") * F.lit(float(level))).cast("double"))


def draw(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the MD5 of (seed, key): the same on every run."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def planned(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
            weights=WEIGHTS, budget: float = BUDGET, max_repeat: float = MAX_REPEAT, seed: int = SEED,
            rows: bool = False) -> DataFrame:
    """Per document: key (as ``doc_id``), ``size``, ``source_size``, ``target``
    of its source, ``copies`` and ``taken`` (= size x copies).  With ``rows``
    the whole input row comes along as the struct ``row``."""
    c = {n: docs[f"`{n}`"] for n in docs.columns}
    sized = docs.select(c[key].alias("doc_id"), c[source].alias("source"), n_tokens(c[text]).alias("size"),
                        *([F.struct(*[v.alias(n) for n, v in c.items()]).alias("row")] if rows else []))
    if not rows:
        sized = staged(sized, "mix-sizes")     # texts are read once
    per = staged(by_rank(staged(source_sizes(sized), "mix-sources"), weights), "mix-weights")
    goal = targets(per, budget, max_repeat).withColumnRenamed("source", "_source")
    if goal.count() <= BROADCAST_SOURCES:
        goal = F.broadcast(goal)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor("rate") + F.when(draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return (sized.join(goal, F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("rate", rate).withColumn("copies", copies.cast("long"))
            .select("doc_id", "size", "source_size", "target", "copies",
                    (F.col("size") * F.col("copies")).alias("taken"), *(["row"] if rows else [])))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as its plan says."""
    plan = planned(docs, rows=True, **how).where("copies > 0")
    once = plan.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
    return once.select("row.*")
