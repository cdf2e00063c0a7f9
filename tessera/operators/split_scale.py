"""Deterministic train/test split and column scalers.

Split (M1): every row gets a 32-bit bucket from MD5 of ``'<seed>|key…'``.
``ceil(rows × test_size)`` test rows are shared among the classes by largest
remainder, and the test rows of a class are those with the smallest (bucket,
key): the per-class cut-off bucket is an exact order statistic found by
distributed histogram refinement (no window over a class, so a class holding
most rows is still spread over all tasks), and rows sharing the cut-off
bucket are settled by key.  Classes are rows of a table that is joined, so
their number is not bounded by a plan or the driver.

Scalers (M2) are plain column expressions from one aggregate (mean and
population std / min and max / exact median and quartiles) fitted on the
training rows only, so no feature vectors are needed to scale.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.quantiles import kth_smallest, order_statistics, quantiles
from tessera.functions.schema import col, free_name
from tessera.operators.chartdata import hash_bucket
from tessera.operators.ordered import class_positions, dense_index, running_total
from tessera.session import cut_lineage

SEED = 42
TEST_SIZE = 0.2


#: Class tables of at most so many rows are broadcast to the rows.
BROADCAST_CLASSES = 100_000


def split_labels(df: DataFrame, keys: list[str], stratify: str | None = None,
                 test_size: float = TEST_SIZE, seed: int = SEED, name: str = "split") -> DataFrame:
    """Add ``split`` = ``'test'`` / ``'train'`` (U1: one DataFrame, a label
    column, instead of two copies).  A class with a single row cannot be on
    both sides: ValueError.  Rows that share a key stay together."""
    g = col(stratify).cast("string") if stratify else F.lit("all")
    taken = set(df.columns)
    h_, g_ = free_name("_h", taken), free_name("_g", taken)
    # the fitting passes read a narrow, persisted (keys, class, bucket)
    # projection: MD5 is computed once for them, and once more for the output
    full = df.withColumn(h_, hash_bucket(keys, seed)).withColumn(g_, g)
    base = full.select(F.struct(*[col(k).alias(k) for k in keys]).alias("k"), F.col(g_).alias("g"),
                       F.col(h_).alias("h")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cuts = cut_lineage(_class_cuts(base, test_size, stratify is not None))
    finally:
        base.unpersist(blocking=False)
    if cuts.count() <= BROADCAST_CLASSES:
        cuts = F.broadcast(cuts)
    joined = full.join(cuts, full[g_].eqNullSafe(cuts["cut_g"]), "left")
    key = F.struct(*[col(k).alias(k) for k in keys])
    is_test = (full[h_] < cuts["cut_h"]) | ((full[h_] == cuts["cut_h"]) & (key <= cuts["cut_k"]))
    return joined.select(*[col(c) for c in df.columns], F.when(is_test, "test").otherwise("train").alias(name))


def _class_sizes(base: DataFrame, test_size: float, classes: bool) -> DataFrame:
    """``(g, n, lo, hi, t)``: per class its rows and its share of the
    ``ceil(rows x test_size)`` test rows, by largest remainder (ties by
    class).  The class with the last whole row is found as an order
    statistic of the remainders, so no task sorts all classes."""
    sizes = cut_lineage(base.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("h").cast("double").alias("lo"),
                                              F.max("h").cast("double").alias("hi")))
    r = sizes.agg(F.sum("n").alias("n"), F.min("n").alias("least"), F.count(F.lit(1)).alias("k")).first()
    total = int(r["n"] or 0)
    if classes and r["k"] > 1 and r["least"] < 2:
        raise ValueError("stratified split: a class has only one row")
    test = math.ceil(round(total * test_size, 9))
    share = F.col("n").cast("decimal(19,0)") * F.lit(test).cast("decimal(19,0)")       # exact integers
    sizes = sizes.withColumn("whole", F.floor(share / F.lit(max(total, 1))).cast("long"))
    sizes = sizes.withColumn("rest", (share - F.col("whole").cast("decimal(19,0)") * F.lit(max(total, 1))).cast("long"))
    extra = test - int(sizes.agg(F.sum("whole").alias("s")).first()["s"] or 0)
    plus = F.lit(0)
    if extra > 0:
        b = sizes.agg(F.min(-F.col("rest")).alias("lo"), F.max(-F.col("rest")).alias("hi")).first()
        ranked = sizes.select(F.lit("all").alias("g"), (-F.col("rest")).cast("double").alias("x"))
        cut = -int(kth_smallest(ranked, {"all": [extra - 1]}, {"all": (b["lo"], b["hi"])}, {"all": int(r["k"])})[("all", extra - 1)])
        above = sizes.where(F.col("rest") > cut).count()
        tied = dense_index(sizes.where(F.col("rest") == cut).select(F.coalesce("g", F.lit("")).alias("g")), "g", "i")
        sizes = sizes.join(tied.withColumnRenamed("g", "tg"), (F.coalesce("g", F.lit("")) == F.col("tg")) & (F.col("rest") == cut), "left")
        plus = F.when((F.col("rest") > cut) | (F.col("i") < extra - above), 1).otherwise(0)
    return sizes.select("g", "n", "lo", "hi", (F.col("whole") + plus).alias("t"))


def _class_cuts(base: DataFrame, test_size: float, classes: bool) -> DataFrame:
    """``(cut_g, cut_h, cut_k)``: per class with test rows the bucket and key
    of its last test row in (bucket, key) order.  The bucket is an exact order
    statistic; among rows on it (copies of a key, and rare collisions) one
    count per distinct key decides."""
    sizes = cut_lineage(_class_sizes(base, test_size, classes).where("t > 0").withColumn("g", F.coalesce("g", F.lit(_NULL))))
    rows = base.select(F.coalesce("g", F.lit(_NULL)).alias("g"), "k", "h")
    wanted = sizes.select("g", (F.col("t") - 1).alias("rank"), "lo", "hi", "n")
    at = order_statistics(rows.select("g", F.col("h").cast("double").alias("x")), wanted)
    cut = cut_lineage(at.join(sizes.select("g", "t"), "g").select("g", F.col("value").cast("long").alias("cut"), "t"))
    if cut.count() <= BROADCAST_CLASSES:
        cut = F.broadcast(cut)
    near = rows.join(cut, "g").where(F.col("h") <= F.col("cut"))
    tied = near.groupBy("g", "cut", "t", F.when(F.col("h") == F.col("cut"), F.col("k")).alias("k")).agg(F.count(F.lit(1)).alias("c"))
    # keys on the cut-off bucket in order, after the rows below it (null key)
    upto = F.sum("c").over(Window.partitionBy("g").orderBy(F.col("k").asc_nulls_first()))
    last = tied.withColumn("upto", upto).where(F.col("k").isNotNull() & (F.col("upto") >= F.col("t")))
    return last.groupBy("g").agg(F.min(F.struct("k", "cut")).alias("m")).select(
        F.when(F.col("g") != _NULL, F.col("g")).alias("cut_g"), F.col("m.cut").alias("cut_h"), F.col("m.k").alias("cut_k"))


def fold_labels(df: DataFrame, order_by: str | list[str], folds: int, stratify: str | None = None,
                where=None, name: str = "fold", blocks: int | None = None) -> DataFrame:
    """Add ``fold`` (0..folds-1), contiguous in ``order_by`` order.

    Without ``stratify`` the rows are cut into folds of equal size, the first
    ones a row larger.  With it every class is cut by itself: laid one after
    the other in the order in which they first appear, the classes' rows are
    dealt to the folds in turn, which gives each fold's share of a class, and
    its rows go to the folds in order.  Rows outside ``where`` have no fold."""
    group, inside, at = (free_name(n, df.columns) for n in ("_class", "_in", "_position"))
    rows = df.withColumns({group: F.coalesce(col(stratify).cast("string"), F.lit(_NULL)) if stratify else F.lit("all"),
                           inside: F.lit(True) if where is None else F.coalesce(where, F.lit(False))})
    used = rows.where(inside)
    placed = cut_lineage(class_positions(used, order_by, group, at, blocks))
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    first = F.struct(*[F.struct(col(k).isNull().alias("gap"), col(k).alias("key")).alias(f"k{i}") for i, k in enumerate(keys)])
    classes = placed.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))
    start = running_total(classes, ["first", group], "n", "start").select(col(group).alias("of"), "n", "start")

    def dealt(k):
        """Rows of the class dealt to the folds before ``k``, if all classes lie in a row."""
        return sum((F.floor((F.col("start") + F.col("n") - i + folds - 1) / folds) - F.floor((F.col("start") - i + folds - 1) / folds)
                    for i in range(k)), F.lit(0))
    ends = start.select("of", F.array(*[dealt(k).cast("long") for k in range(1, folds)]).cast("array<long>").alias("ends"))
    ends = cut_lineage(ends)
    if ends.count() <= BROADCAST_CLASSES:
        ends = F.broadcast(ends)
    fold = F.size(F.filter("ends", lambda e: e <= F.col(at))).cast("int").alias(name)
    out = placed.join(ends, placed[group] == ends["of"]).select(*[col(c) for c in df.columns], fold)
    if where is None:
        return out
    return out.unionByName(rows.where(~F.col(inside)).select(*[col(c) for c in df.columns], F.lit(0).alias(name)))


#: Stands for the null class where classes are joined by equality.
_NULL = "\0null"


# ---------------------------------------------------------------------------
# scalers
# ---------------------------------------------------------------------------
@dataclass
class ColumnScaler:
    kind: str
    center: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    def columns(self, names: list[str] | None = None, suffix: str = "") -> list[Column]:
        out = []
        for c in (names or list(self.center)):
            x = col(c).cast("double")
            out.append(((x - F.lit(self.center[c])) / F.lit(self.scale[c])).alias(c + suffix))
        return out

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        scaled = set(self.center)
        if suffix:
            return df.select("*", *self.columns(suffix=suffix))
        return df.select(*[self.columns([c])[0] if c in scaled else col(c) for c in df.columns])


def fit_scaler(df: DataFrame, columns: list[str], kind: str = "standard", exact: bool = True) -> ColumnScaler:
    """standard: (x − mean)/population std; minmax: (x − min)/(max − min);
    robust: (x − median)/IQR; none: identity.  A zero spread scales by 1
    (a constant column becomes 0).  Nulls are ignored when fitting."""
    s = ColumnScaler(kind)
    if kind == "none" or not columns:
        for c in columns:
            s.center[c], s.scale[c] = 0.0, 1.0
        return s
    if kind in ("standard", "minmax"):
        aggs = []
        for i, c in enumerate(columns):
            x = col(c).cast("double")
            x = F.when(~F.isnan(x), x)
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"),
                     F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        row = df.agg(*aggs).collect()[0]
        for i, c in enumerate(columns):
            if kind == "standard":
                center, spread = row[f"m{i}"], row[f"s{i}"]
            else:
                center = row[f"lo{i}"]
                spread = None if row[f"hi{i}"] is None else row[f"hi{i}"] - row[f"lo{i}"]
            s.center[c] = center if center is not None else 0.0
            s.scale[c] = spread if spread else 1.0
        return s
    if kind == "robust":
        qs = quantiles(df, columns, [0.25, 0.5, 0.75], exact=exact)
        for c in columns:
            q1, med, q3 = qs[c]
            s.center[c] = med if med is not None else 0.0
            s.scale[c] = (q3 - q1) if (q1 is not None and q3 - q1) else 1.0
        return s
    raise ValueError(f"unknown scaler {kind!r}")


def recommend_scaler(problem_type: str) -> str:
    """M3: robust for classification, standard otherwise."""
    return "robust" if problem_type == "classification" else "standard"


#: Parts of the names of model families that split on single
#: features, whatever their scale.
UNSCALED_FAMILIES = ("tree", "forest", "boost", "xgb", "lgbm", "catboost")


def model_requires_scaling(name: str) -> bool:
    """Tree families read raw features, every other model scaled ones."""
    return not any(part in name.lower() for part in UNSCALED_FAMILIES)
