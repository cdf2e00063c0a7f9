"""Exact order statistics without putting a whole column in one task.

Spark's exact ``percentile`` keeps a value→count map of the entire column in
the single final-aggregation task, which does not survive a 100 TB column
with billions of distinct values.  ``percentile_approx`` is bounded but not
exact.  Here exact ranks are found by histogram refinement, for any number
of groups together and on one path for every size:

1. every wanted rank starts with its group's interval [min, max];
2. each pass buckets the values inside the open intervals into ``bins``
   equal-width buckets with a ``groupBy(interval, bucket)`` (partial
   aggregation on every executor); a running total over the at most ``bins``
   buckets of an interval finds the bucket that holds the rank, and the real
   min/max of its values become the next interval;
3. an interval with a single distinct value is resolved; one that holds at
   most ``leaf`` values is resolved from the counts of its distinct values.

Groups of up to ``leaf * SKETCH / 5`` values, whatever their spread, take two
passes instead (``_bracketed``): a mergeable quantile sketch brackets every
rank, and one exact pass counts the values below the bracket and those inside.
A rank that its bracket misses goes the way above.

All of it happens on the executors: a group's values never meet in one task
before they are few, and only the resolved ``(group, rank, value)`` rows — as
many as were asked for — leave it.  The number of passes is logarithmic in
the value spread (typically 1-3).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.schema import col
from tessera.session import cut_lineage

DEFAULT_BINS = 4096
DEFAULT_LEAF = 50_000
#: Interval tables of at most so many rows (some 60 bytes each, and the group
#: key) are broadcast; larger ones meet the values in a shuffled join.
BROADCAST_INTERVALS = 100_000
_MAX_PASSES = 64
_KEY = ["g", "lo"]              # the open intervals of a group never overlap


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Unpivot ``columns`` into ``(g string, x double)`` keeping non-null, non-NaN x."""
    pairs = F.array(*[F.struct(F.lit(c).alias("g"), col(c).cast("double").alias("x")) for c in columns])
    return df.select(F.inline(pairs)).where(F.col("x").isNotNull() & ~F.isnan("x"))


def _inside(long_df: DataFrame, intervals: DataFrame, few: bool) -> DataFrame:
    """Values joined to the interval that holds them (``g, lo, hi, x``)."""
    table = intervals.select("g", "lo", "hi").distinct()
    if few:
        table = F.broadcast(table)
    return long_df.join(table, "g").where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))


def _holding(counted: DataFrame, todo: DataFrame, order: str) -> DataFrame:
    """The counted row (bucket or value) of its interval that holds each wanted rank."""
    running = Window.partitionBy(*_KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counted.withColumn("upto", F.sum("n").over(running))
    wanted = todo.select(*_KEY, "rank", "below")
    local = F.col("rank") - F.col("below")
    return upto.join(wanted, _KEY).where((local < F.col("upto")) & (local >= F.col("upto") - F.col("n")))


def _refined(long_df: DataFrame, todo: DataFrame, bins: int, few: bool) -> DataFrame:
    x, lo, hi = F.col("x") / 2, F.col("lo") / 2, F.col("hi") / 2        # halves: no overflow
    bucket = F.least(F.floor((x - lo) / (hi - lo) * F.lit(bins)).cast("int"), F.lit(bins - 1))
    hist = (_inside(long_df, todo, few).groupBy(*_KEY, bucket.alias("b"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("mn"), F.max("x").alias("mx")))
    return _holding(hist, todo, "b").select(
        "g", "rank", F.col("mn").alias("lo"), F.col("mx").alias("hi"), "n",
        (F.col("below") + F.col("upto") - F.col("n")).alias("below"))


def _resolved(long_df: DataFrame, todo: DataFrame, few: bool) -> DataFrame:
    counted = _inside(long_df, todo, few).groupBy(*_KEY, "x").agg(F.count(F.lit(1)).alias("n"))
    return _holding(counted, todo, "x").select("g", "rank", F.col("x").alias("value"))


def order_statistics(long_df: DataFrame, wanted: DataFrame, bins: int = DEFAULT_BINS, leaf: int = DEFAULT_LEAF,
                     hold=cut_lineage) -> DataFrame:
    """``(g, rank, value)``: the exact rank-th smallest ``x`` (0-based) of
    group ``g`` of ``long_df``.

    ``wanted``: ``(g, rank, lo, hi, n)`` with the group's minimum, maximum and
    number of values.  ``hold`` fixes a table of intervals between passes (by
    default a reliable checkpoint).
    """
    todo = hold(wanted.select("g", "rank", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"),
                              F.col("n").cast("long").alias("n"), F.lit(0).cast("long").alias("below")))
    done = []
    for _ in range(_MAX_PASSES):
        open_, single, small = F.col("lo") < F.col("hi"), F.col("lo") == F.col("hi"), F.col("n") <= leaf
        n = todo.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(single, 1)).alias("single"),
                     F.count(F.when(open_ & small, 1)).alias("small")).first()
        few = n["all"] <= BROADCAST_INTERVALS
        if n["single"]:
            done.append(todo.where(single).select("g", "rank", F.col("lo").alias("value")))
        if n["small"]:
            done.append(_resolved(long_df, todo.where(open_ & small), few))
        if n["all"] == n["single"] + n["small"]:
            break
        todo = hold(_refined(long_df, todo.where(open_ & ~small), bins, few))
    else:
        raise RuntimeError("order statistics did not converge")
    out = done[0] if done else todo.select("g", "rank", F.col("lo").alias("value"))
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _held_locally(table: DataFrame) -> DataFrame:
    """For tables of requested ranks, which the caller's own list bounds."""
    return table.sparkSession.createDataFrame([tuple(r) for r in table.collect()], table.schema)


#: Accuracy of the sketch: its ranks are off by n / SKETCH at most.  Ranks are
#: bracketed by twice that on each side, so a bracket holds n * 5 / SKETCH values or so.
SKETCH = 10_000
#: Points asked of one sketch at most.
SKETCH_POINTS = 256


def _bracketed(long_df: DataFrame, ranks: dict[str, list[int]], counts: dict[str, int]) -> dict[tuple[str, int], float]:
    """The ranks found between two points of a sketch, in two passes."""
    def around(g, r):
        share, slack = (r + 0.5) / counts[g], 2.0 / SKETCH
        return max(0.0, share - slack), min(1.0, share + slack)
    points = sorted({p for g, rs in ranks.items() for r in rs for p in around(g, r)})
    if len(points) > SKETCH_POINTS:
        return {}
    place = {p: i for i, p in enumerate(points)}
    sketch = long_df.groupBy("g").agg(F.percentile_approx("x", F.array(*[F.lit(p) for p in points]), SKETCH).alias("q"))
    at = {r["g"]: r["q"] for r in sketch.collect()}
    rows = []
    for g, rs in ranks.items():
        for r in rs if g in at else ():
            low, high = around(g, r)
            rows.append((g, r, at[g][place[low]] if low > 0 else -math.inf, at[g][place[high]] if high < 1 else math.inf))
    kind = long_df.schema["g"].dataType
    asked = long_df.sparkSession.createDataFrame(rows, T.StructType([
        T.StructField("g", kind), T.StructField("rank", T.LongType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))
    brackets = asked.select("g", "lo", "hi").distinct()
    counted = (long_df.join(F.broadcast(brackets), "g").where(F.col("x") <= F.col("hi"))
               .groupBy("g", "lo", "hi", F.when(F.col("x") >= F.col("lo"), F.col("x")).alias("x")).agg(F.count(F.lit(1)).alias("n")))
    below = Window.partitionBy("g", "lo", "hi").orderBy(F.col("x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counted.withColumn("upto", F.sum("n").over(below)).where(F.col("x").isNotNull())
    hit = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
    found = upto.join(F.broadcast(asked), ["g", "lo", "hi"]).where(hit)
    return {(r["g"], int(r["rank"])): float(r["x"]) for r in found.select("g", "rank", "x").collect()}


def kth_smallest(long_df: DataFrame, ranks: dict[str, list[int]],
                 bounds: dict[str, tuple[float, float]], counts: dict[str, int],
                 bins: int = DEFAULT_BINS, leaf: int = DEFAULT_LEAF) -> dict[tuple[str, int], float]:
    """Exact k-th smallest ``x`` per group for a short list of ranks:
    ``{(g, rank): value}``; ``bounds[g]`` and ``counts[g]`` are the group's
    (min, max) and size."""
    ranks = {g: sorted({int(r) for r in rs}) for g, rs in ranks.items()}
    near = {g: rs for g, rs in ranks.items() if rs and counts[g] * 5 <= leaf * SKETCH}
    known = _bracketed(long_df, near, counts) if near else {}
    rows = [(g, r, float(bounds[g][0]), float(bounds[g][1]), int(counts[g])) for g, rs in ranks.items() for r in rs if (g, r) not in known]
    if not rows:
        return known
    schema = T.StructType([T.StructField("g", long_df.schema["g"].dataType), T.StructField("rank", T.LongType()),
                           T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()),
                           T.StructField("n", T.LongType())])
    wanted = long_df.sparkSession.createDataFrame(rows, schema)
    found = order_statistics(long_df, wanted, bins, leaf, hold=_held_locally).collect()
    return known | {(r["g"], int(r["rank"])): float(r["value"]) for r in found}


def _rank_plan(n: int, p: float) -> tuple[int, int, float]:
    pos = (n - 1) * p
    k = int(math.floor(pos))
    frac = pos - k
    k2 = min(k + 1, n - 1) if frac > 0 else k
    return k, k2, frac


def column_bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple]:
    """``{column: (non-null count, min, max)}`` in one aggregate."""
    aggs = []
    for i, c in enumerate(columns):
        x = col(c).cast("double")
        x = F.when(~F.isnan(x), x)
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*aggs).collect()[0]
    return {c: (int(row[f"n{i}"]), row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    bins: int = DEFAULT_BINS, leaf: int = DEFAULT_LEAF,
                    stats: dict[str, tuple] | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation (pandas ``quantile`` / SQL
    ``percentile_cont``), nulls and NaN ignored.  ``{column: [q per prob]}``.
    ``stats`` (count, min, max per column) can be passed when the caller's own
    aggregate already computed them, saving one pass."""
    if not columns:
        return {}
    if stats is None:
        stats = column_bounds(df, columns)
    filled = [c for c in columns if stats[c][0]]
    ranks = {c: [r for p in probs for r in _rank_plan(stats[c][0], p)[:2]] for c in filled}
    found = kth_smallest(long_values(df, filled), ranks, {c: stats[c][1:3] for c in filled},
                         {c: stats[c][0] for c in filled}, bins, leaf) if filled else {}
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    for c in filled:
        for i, p in enumerate(probs):
            k, k2, frac = _rank_plan(stats[c][0], p)
            lo, hi = found[(c, k)], found[(c, k2)]
            out[c][i] = lo + (hi - lo) * frac if frac > 0 else lo
    return out


def approx_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                     accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """Bounded-memory approximate quantiles (one ``percentile_approx`` agg)."""
    if not columns:
        return {}
    row = df.agg(*[F.percentile_approx(col(c).cast("double"), list(probs), accuracy).alias(f"q{i}")
                   for i, c in enumerate(columns)]).collect()[0]
    return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs))
            for i, c in enumerate(columns)}


def quantiles(df: DataFrame, columns: list[str], probs: list[float],
              exact: bool = True, stats=None) -> dict[str, list[float | None]]:
    if exact:
        return exact_quantiles(df, columns, probs, stats=stats)
    return approx_quantiles(df, columns, probs)


def group_quantiles(df: DataFrame, group: str, value: str, probs: list[float],
                    bins: int = DEFAULT_BINS, leaf: int = DEFAULT_LEAF) -> DataFrame:
    """``(g, n, min, max, q)``: exact quantiles of ``value`` per non-null
    ``group`` as an array, one row per group; groups of any number and size
    go through the same passes."""
    x = col(value).cast("double")
    long_df = (df.select(col(group).alias("g"), x.alias("x"))
               .where(F.col("g").isNotNull() & F.col("x").isNotNull() & ~F.isnan("x")))
    stats = cut_lineage(long_df.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")))
    at = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    wanted = stats.select("g", "lo", "hi", "n", F.explode(F.array_distinct(F.array(
        *[f(a).cast("long") for a in at for f in (F.floor, F.ceil)]))).alias("rank"))
    found = order_statistics(long_df, wanted, bins, leaf)
    per = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_v"))
    q = []
    for a in at:
        lo, hi = F.element_at("_v", F.floor(a).cast("long")), F.element_at("_v", F.ceil(a).cast("long"))
        q.append(lo + (hi - lo) * (a - F.floor(a)))
    return stats.join(per, "g").select("g", "n", F.col("lo").alias("min"), F.col("hi").alias("max"), F.array(*q).alias("q"))
