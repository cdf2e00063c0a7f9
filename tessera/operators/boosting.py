"""Boosted trees grown from histograms of gradients.

Features are cut into at most 256 quantile bins once, and every row keeps one
byte for each.  Rows are packed into blocks, one array a feature, which are
dealt evenly to all cores.  A level of a tree is one pass over the blocks: each task sums
gradients, hessians and rows per (model, class, node, feature, bin), Spark
adds the sums, and the driver, which holds these tables alone, chooses the
splits with the largest gain and sends the grown trees back.  Rows never
leave the executors; their margins are written every ``REFRESH`` rounds, so a
pass replays only the trees since then.

Several models are grown in the same passes: the final fit and the folds of a
cross-validation differ in the rows they may use, which is one bit mask a row.

If there are several models and the rows fit in a task's memory
(:mod:`tessera.operators.held`), they are not passed over by jobs: each model is
grown by one task, with the same sums and trees.

Two kinds of trees:

* ``newton=True``: second order.  Gain of a split is
  G_l^2 / (H_l + l2) + G_r^2 / (H_r + l2) - G^2 / (H + l2), halved; a leaf is
  -G / (H + l2).
* ``newton=False``: first order.  Splits reduce the squared error of the
  residuals, leaves take one Newton step.

With ``patience`` the rows marked ``val`` are not learned from; their loss is
measured after every round, in the same passes, and a model stops growing at
the first round whose loss is not smaller (by ``tolerance``) than one of the
last ``patience`` rounds.

Sums are whole numbers (gradients in units of 2^-24), so a fit does not depend
on the order of tasks.  NaN counts as smaller than every number; rows with a null label are
left out; without rows a model is its prior, with one row a constant.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.schema import col
from tessera.operators import held as held_rows
from tessera.operators.held import Held, binned, mixed
from tessera.session import cut_lineage

REFRESH = 10
#: Rows of sums that the driver takes from the tasks directly (32 bytes each).
DIRECT_ROWS = 2_000_000
#: Most rows of a block, and about the bytes of a task's blocks (one Arrow batch may hold them all).
BLOCK_ROWS = 16_384
TASK_BYTES = 48 << 20
#: Quantile sketches behind the bins are exact up to about this many rows.
SKETCH = 20_000
_UNIT_BITS = 24


@dataclass(frozen=True)
class Boosting:
    """Settings, used like an estimator: ``fit(df)`` gives a model whose
    ``transform`` adds ``prediction`` (and ``probability``)."""
    objective: str = "squared"              # squared, logistic, softmax
    classes: int = 1                        # number of classes of softmax
    rounds: int = 100
    depth: int = 6
    rate: float = 0.3
    l2: float = 1.0
    min_gain: float = 0.0
    min_child: float = 1.0                  # hessian (newton) or rows on each side of a split
    newton: bool = True
    subsample: float = 1.0
    patience: int = 0
    tolerance: float = 1e-4
    bins: int = 256
    seed: int = 42
    featuresCol: str = "features"
    labelCol: str = "label"
    valCol: str | None = None

    def copy(self, extra: dict | None = None) -> "Boosting":
        """With another features column (``{featuresCol: name}``)."""
        return replace(self, featuresCol=(extra or {}).get(self.featuresCol, self.featuresCol))

    @property
    def outputs(self) -> int:
        return self.classes if self.objective == "softmax" else 1

    def fit(self, df: DataFrame) -> "BoostedModel":
        return fit_many(df, self, [F.lit(True)])[0]

    def fit_folds(self, df: DataFrame, fold: str, folds: int, found: list | None = None) -> list["BoostedModel"]:
        """The model of all rows, then those of all rows but one fold, all grown in the same passes.
        ``found``: see ``fit_many``."""
        return fit_many(df, self, [F.lit(True)] + [col(fold) != k for k in range(folds)], found)


@dataclass
class Tree:
    """Node i has the children 2i + 1 (at most ``threshold``) and 2i + 2."""
    feature: np.ndarray                     # -1: leaf
    bin: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> "Tree":
        n = (2 << depth) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n), np.zeros(n))

    def places(self, x: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Node of every row; ``x`` has a line for each feature (bins with
        ``cut`` the bins, or values with the thresholds).  Every split is
        judged for all rows at once, then halves of the tree are merged
        upwards by bit masks: no row is looked up by itself."""
        kind = np.uint8 if len(self.feature) <= 256 else np.uint32

        def walk(node):
            f = self.feature[node]
            if f < 0:
                return kind(node)
            left, right = walk(2 * node + 1), walk(2 * node + 2)
            return left ^ ((left ^ right) & np.negative((x[f] > cut[node]).astype(kind)))
        at = walk(0)
        return at if np.ndim(at) else np.full(x.shape[1], at)


@dataclass
class BoostedModel:
    settings: Boosting
    prior: np.ndarray
    scale: float
    features: int
    trees: list[list[Tree]] = field(default_factory=list)   # round, output
    curve: list[float] = field(default_factory=list)        # validation loss after each round

    @property
    def kept(self) -> int:
        return len(self.trees)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.prior, (len(x), 1))
        for i in range(0, len(x), BLOCK_ROWS):
            part = np.ascontiguousarray(np.where(np.isnan(x[i:i + BLOCK_ROWS]), -np.inf, x[i:i + BLOCK_ROWS]).T)
            for trees in self.trees:
                for k, t in enumerate(trees):
                    out[i:i + BLOCK_ROWS, k] += self.scale * t.value[t.places(part, t.threshold)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        s = self.settings
        held = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def margins(v):
            import pandas as pd
            return pd.Series(list(held.value.margins(np.stack(v.to_list()) if len(v) else np.empty((0, 1)))))
        m = margins(vector_to_array(col(s.featuresCol)))
        if s.objective == "squared":
            return df.withColumn("prediction", m[0])
        if s.objective == "logistic":
            p = F.lit(1.0) / (1.0 + F.exp(-F.col("_m")[0]))
            out = df.withColumn("_m", m).withColumn("_p", F.array(1.0 - p, p))
        else:
            top = F.array_max("_m")
            e = F.transform("_m", lambda v: F.exp(v - top))
            out = df.withColumn("_m", m).withColumn("_e", e).withColumn(
                "_p", F.transform("_e", lambda v: v / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b))).drop("_e")
        best = F.array_position("_p", F.array_max("_p")) - 1
        return out.withColumns({"probability": array_to_vector("_p"), "prediction": best.cast("double")}).drop("_m", "_p")

    @property
    def featureImportances(self):
        """Mean gain of a feature's splits (second order) or the mean over
        trees of its share of the gain (first order); they add up to 1."""
        from pyspark.ml.linalg import Vectors
        total, count = np.zeros(self.features), np.zeros(self.features)
        for t in (t for trees in self.trees for t in trees):
            own, many = np.zeros(self.features), np.zeros(self.features)
            split = t.feature >= 0
            np.add.at(own, t.feature[split], t.gain[split])
            np.add.at(many, t.feature[split], 1)
            if self.settings.newton:
                total, count = total + own, count + many
            elif own.sum() > 0:
                total, count = total + own / own.sum(), count + 1
        mean = total / np.maximum(count, 1)
        return Vectors.dense(mean / mean.sum() if mean.sum() > 0 else mean)

    def to_dict(self) -> dict:
        trees = [[{"feature": t.feature.tolist(), "threshold": t.threshold.tolist(), "value": t.value.tolist(),
                   "gain": t.gain.tolist()} for t in ts] for ts in self.trees]
        return {"settings": self.settings.__dict__, "prior": self.prior.tolist(), "scale": self.scale,
                "features": self.features, "curve": self.curve, "trees": trees}

    @staticmethod
    def from_dict(d: dict) -> "BoostedModel":
        def tree(t):
            return Tree(np.array(t["feature"], np.int32), np.zeros(len(t["feature"]), np.int32), np.array(t["threshold"], float),
                        np.array(t["value"], float), np.array(t["gain"], float))
        return BoostedModel(Boosting(**d["settings"]), np.array(d["prior"], float), d["scale"], d["features"],
                            [[tree(t) for t in ts] for ts in d["trees"]], d["curve"])


def stopping_round(losses: list[float], patience: int, tolerance: float = 1e-4) -> int | None:
    """Rounds to keep, once a round's loss is not smaller than one of the
    last ``patience`` accepted losses; None while it goes on."""
    best = [math.inf] * patience
    for i, loss in enumerate(losses):
        if all(loss + tolerance >= b for b in best):
            return i + 1
        best[i % patience] = loss
    return None


# ---- bins -----------------------------------------------------------------------

def quantiles(df: DataFrame, features: str, n: int, bins: int = 256) -> list[tuple[np.ndarray, bool]]:
    """Of each of the ``n`` features the quantiles 0, 1/bins, 2/bins, ... from
    one mergeable sketch, and whether it has NaN."""
    x = F.posexplode(vector_to_array(col(features))).alias("f", "x")
    shares = F.array(*[F.lit(i / bins) for i in range(bins)])
    number = F.when(~F.isnan("x"), F.col("x"))
    got = (df.select(x).groupBy("f").agg(F.percentile_approx(number, shares, SKETCH).alias("cuts"),
                                         F.max(F.isnan("x")).alias("gaps")).collect())
    out = [(np.empty(0), False)] * n
    for r in got:
        out[r["f"]] = np.array(r["cuts"] or [], float), r["gaps"]
    return out


def quantile_cuts(df: DataFrame, features: str, n: int, bins: int = 256, found: list | None = None) -> list[np.ndarray]:
    """Upper ends of the bins of each of the ``n`` features, the last bin
    open.  A feature with few values has a bin for each."""
    return [(np.r_[-np.inf, np.unique(q)] if gaps else np.unique(q))[:bins - 1]      # NaN has a bin of its own
            for q, gaps in found or quantiles(df, features, n, bins)]


def labelled_rows(df: DataFrame, s: Boosting, masks: list[Column]) -> DataFrame:
    """(x, y, mask, val, draw) of the rows with a label."""
    mask = sum((F.coalesce(m, F.lit(False)).cast("long") * F.lit(1 << i) for i, m in enumerate(masks)), F.lit(0).cast("long"))
    val = F.coalesce(col(s.valCol), F.lit(False)) if s.valCol and s.patience else F.lit(False)
    x = vector_to_array(col(s.featuresCol))
    return df.where(col(s.labelCol).isNotNull()).select(x.alias("x"), col(s.labelCol).cast("double").alias("y"),
                                                        mask.alias("mask"), val.alias("val"), F.xxhash64(x, col(s.labelCol)).alias("draw"))


_BLOCK = "bins binary, y binary, mask binary, val binary, draw binary, margin binary"


def packed(rows: DataFrame, cuts: list[np.ndarray], prior: np.ndarray, n: int) -> DataFrame:
    """Blocks of ``rows``, each column one array, with the bins instead of the
    features and the margins before the first round.  Blocks are dealt out in
    turn, so neither the input's files nor its partitions decide which cores
    have work, and a task holds about ``TASK_BYTES`` at most."""
    sc = rows.sparkSession.sparkContext
    held = sc.broadcast(cuts)
    size = max(1, min(BLOCK_ROWS, -(-n // (4 * sc.defaultParallelism))))
    tasks = max(sc.defaultParallelism, -(-n * (len(cuts) + 25 + prior.nbytes) // TASK_BYTES))
    start = prior.ravel()

    def block(parts):
        bins, y, mask, val, draw = (np.concatenate(p, axis=-1) for p in zip(*parts))
        margin = np.repeat(start, len(y))
        arrays = bins, y, mask, val, draw, margin
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays],
                                          names=["bins", "y", "mask", "val", "draw", "margin"])

    def run(batches):
        kept, have = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            # a slice of a list column keeps its parent's values: flatten() leaves those out
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            lines = [binned(x, held.value)] + [batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "mask", "val", "draw")]
            at = 0
            while at < batch.num_rows:
                many = min(size - have, batch.num_rows - at)
                kept.append([a[..., at:at + many] for a in lines])
                have, at = have + many, at + many
                if have == size:
                    yield block(kept)
                    kept, have = [], 0
        if kept:
            yield block(kept)
    return rows.mapInArrow(run, _BLOCK).repartition(int(tasks))


# ---- gradients --------------------------------------------------------------------

def _shares(margin: np.ndarray, objective: str) -> np.ndarray:
    if objective == "logistic":
        return 1 / (1 + np.exp(-margin))
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margin: np.ndarray, y: np.ndarray, s: Boosting):
    """(gradient, hessian) of the loss at ``margin`` (rows, outputs)."""
    if s.objective == "squared":
        return margin - y[:, None], np.ones_like(margin)
    p = _shares(margin, s.objective)
    hit = y[:, None] if s.objective == "logistic" else (y[:, None] == np.arange(s.classes))
    h = p * (1 - p)
    return p - hit, np.maximum(2 * h if s.newton and s.objective == "softmax" else h, 1e-16)


def _loss(margin: np.ndarray, y: np.ndarray, s: Boosting) -> np.ndarray:
    if s.objective == "squared":
        return (margin[:, 0] - y) ** 2
    if s.objective == "logistic":
        return np.logaddexp(0, margin[:, 0]) - y * margin[:, 0]
    top = margin.max(axis=1)
    return top + np.log(np.exp(margin - top[:, None]).sum(axis=1)) - margin[np.arange(len(y)), y.astype(int)]


def _drawn(draw: np.ndarray, tree: int, s: Boosting) -> np.ndarray:
    """Rows of this round's sample: a hash of the row and the round."""
    if s.subsample >= 1:
        return np.ones(len(draw), bool)
    return mixed(draw, tree, s.seed) < s.subsample


@dataclass
class _Growing:
    """What a pass needs: trees since the margins were written, the trees
    being grown, and the open nodes."""
    settings: Boosting
    models: list[int]                       # models still growing
    recent: list[list[list[Tree]]]          # round, model, output
    now: list[list[Tree]]                   # model, output
    open: np.ndarray                        # (model, output, node) -> slot or -1
    slots: int
    first: np.ndarray                       # first place of each feature's bins
    total: int                              # bins of all features
    scale: float
    prior: np.ndarray                       # (model, output)
    unit: float
    round: int


def _blocks(batches, names: str, state: _Growing, features: int):
    """Per block: its batch of one row, bins (feature, row), margins (model,
    output, row) up to the last whole round, and the arrays of ``names``."""
    kinds = {"y": np.float64, "mask": np.int64, "val": np.bool_, "draw": np.uint64}

    def array(batch, name, kind):
        return np.frombuffer(batch.column(name)[0].as_buffer(), kind)
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            bins = array(one, "bins", np.uint8).reshape(features, -1)
            margin = array(one, "margin", np.float64).reshape(*state.prior.shape, -1).copy()
            for trees in state.recent:
                for m, outputs in enumerate(trees):
                    for k, t in enumerate(outputs):
                        if t.feature[0] < 0:
                            margin[m, k] += t.value[0]
                        else:
                            margin[m, k] += t.value[t.places(bins, t.bin)]
            yield one, bins, margin, *(array(one, c, kinds[c]) for c in names.split())


def _pass(rows: DataFrame, state: _Growing, features: int, level: int, tasks: int = 1 << 40):
    """Sums per (slot, bin): gradient, hessian, rows; and per model the
    validation loss and rows, at level 0.  Sums of ``tasks`` tasks that are
    known to be few go to the driver without a shuffle before."""
    held = rows.sparkSession.sparkContext.broadcast(state)

    def run(batches):
        st: _Growing = held.value
        s = st.settings
        sums = np.zeros((3, st.slots, st.total))
        loss = np.zeros((len(st.prior), 2))
        ends = np.append(st.first[1:], st.total)
        for _, bins, margin, y, mask, val, draw in _blocks(batches, "y mask val draw", st, features):
            used = ~val & _drawn(draw, st.round, s)
            for m in st.models:
                own = (mask >> m & 1).astype(bool)
                if level == 0 and s.patience:
                    at = np.flatnonzero(own & val)
                    loss[m] += _loss(margin[m][:, at].T, y[at], s).sum(), len(at)
                own &= used
                for k in range(s.outputs):
                    slots = st.open[m, k]
                    lines = np.flatnonzero(slots >= 0)
                    if not len(lines):
                        continue
                    low, many = slots[lines].min(), len(lines)              # a tree's slots follow one another
                    slot = slots[st.now[m][k].places(bins, st.now[m][k].bin)] - low
                    at = np.flatnonzero(own & (slot >= 0))
                    if not len(at):
                        continue
                    g, h = gradients(margin[m][:, at].T, y[at], s)
                    slot, g = slot[at], np.rint(g[:, k] * st.unit)
                    h = None if s.objective == "squared" else np.rint(h[:, k] * st.unit)
                    for f in range(features):
                        a, b = st.first[f], ends[f]
                        place = slot * (b - a) + bins[f][at]
                        into = sums[:, low:low + many, a:b]
                        rows_ = np.bincount(place, minlength=many * (b - a)).reshape(many, b - a)
                        into[0] += np.bincount(place, g, many * (b - a)).reshape(many, b - a)
                        into[1] += rows_ * st.unit if h is None else np.bincount(place, h, many * (b - a)).reshape(many, b - a)
                        into[2] += rows_
        sums = sums.reshape(3, -1)
        seen = np.flatnonzero(sums[2])
        part = np.concatenate([seen, -1 - np.arange(len(loss))])
        whole = np.concatenate([sums[:, seen], np.rint(np.stack([loss[:, 0] * st.unit, np.zeros(len(loss)), loss[:, 1]]))], axis=1).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(part)] + [pa.array(np.ascontiguousarray(w)) for w in whole], names=["place", "g", "h", "n"])
    parts = rows.mapInArrow(run, "place long, g long, h long, n long")
    if tasks * (state.slots * state.total + len(state.prior)) > DIRECT_ROWS:
        parts = parts.groupBy("place").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    out = parts.toArrow()
    held.destroy()
    place = out["place"].to_numpy() + len(state.prior)                   # the losses first
    whole = np.zeros((3, len(state.prior) + state.slots * state.total), np.int64)
    for into, name in zip(whole, "ghn"):
        np.add.at(into, place, out[name].to_numpy())
    loss = np.stack([whole[0, :len(state.prior)] / state.unit, whole[2, :len(state.prior)]], axis=1)[::-1]
    sums = whole[:, len(state.prior):] / np.array([state.unit, state.unit, 1.0])[:, None]
    return sums.reshape(3, state.slots, state.total), loss


def split_gains(sums: np.ndarray, first: np.ndarray, sizes: np.ndarray, s: Boosting):
    """For one node's sums (3, bins): gain and left sums of every split "bin
    at most b" (-inf where a side is too small)."""
    total = sums.shape[1]
    own = np.repeat(np.arange(len(first)), sizes)
    run = np.cumsum(sums, axis=1)
    before = np.where(first > 0, run[:, first - 1], 0.0)
    left = run - before[:, own]
    node = left[:, first[-1] + sizes[-1] - 1] if total else np.zeros(3)
    right = node[:, None] - left
    weight = 1 if s.newton else 2
    l2 = s.l2 if s.newton else 0.0

    def score(part):
        with np.errstate(divide="ignore", invalid="ignore"):
            return part[0] ** 2 / (part[weight] + l2)
    gain = (score(left) + score(right) - score(node[:, None])) / 2 - s.min_gain
    enough = (left[weight] >= s.min_child) & (right[weight] >= s.min_child) & (left[2] > 0) & (right[2] > 0)
    return np.where(enough, gain, -np.inf), left, node


def _leaf(node: np.ndarray, s: Boosting) -> float:
    value = -node[0] / (node[1] + (s.l2 if s.newton else 0.0)) if node[1] > 0 else 0.0
    return s.rate * value * (1.0 if s.newton or s.objective != "softmax" else (s.classes - 1) / s.classes)


def fit_many(df: DataFrame, s: Boosting, masks: list[Column], found: list | None = None) -> list[BoostedModel]:
    """One model for each of ``masks`` (the rows it may use), grown together.
    ``found``: the ``bins`` quantiles of the features, if they are known."""
    spark = df.sparkSession
    head = df.select(F.size(vector_to_array(col(s.featuresCol))).alias("n")).first()
    features = head["n"] if head else 0
    rows = labelled_rows(df, s, masks)
    models, scale, n = _priors(rows, s, features, len(masks))
    if not features or not n:
        return models
    cuts = quantile_cuts(df, s.featuresCol, features, s.bins, found)
    prior = np.stack([(m.prior - (models[0].prior if s.objective == "squared" else 0)) / scale for m in models]).astype(np.float64)
    unit = float(1 << min(_UNIT_BITS, max(4, 60 - math.ceil(math.log2(n + 1)))))
    centre = float(models[0].prior[0]) if s.objective == "squared" else 0.0
    rows = rows.withColumn("y", (F.col("y") - centre) / scale)
    if 1 < len(masks) <= held_rows.MODELS and held_rows.fits(n, features):       # one model alone has all cores by passes
        return _fit_held(rows, s, models, cuts, scale, prior, unit)
    source = _Spread(rows, s, cuts, scale, prior, n)
    _rounds(source, s, models, cuts, scale, prior, unit)
    source.data.unpersist()
    return models


def _rounds(source, s: Boosting, models: list[BoostedModel], cuts, scale: float, prior: np.ndarray, unit: float) -> None:
    """Grow the trees of ``models``; ``source`` passes over the rows."""
    sizes = np.array([len(c) + 1 for c in cuts])
    first = np.cumsum(sizes) - sizes
    growing, recent = list(range(len(models))), []
    for r in range(s.rounds):
        if len(recent) >= REFRESH:
            source.refresh(recent)
            recent = []
        now = [[Tree.empty(s.depth) for _ in range(s.outputs)] for _ in models]
        grown = _grow(source, s, growing, recent, now, first, sizes, cuts, scale, prior, unit, r,
                      lambda loss: _stop(models, growing, loss, scale, s))
        for m in growing:
            if m in grown:
                models[m].trees.append(now[m])
        for m in range(len(models)):
            if m not in grown:
                now[m] = [Tree.empty(0) for _ in range(s.outputs)]
        growing = [m for m in growing if m in grown]
        if not growing:
            break
        recent.append(now)
    if s.patience and growing:
        state = _Growing(s, growing, recent, [[Tree.empty(0)] * s.outputs for _ in models],
                         np.full((len(models), s.outputs, 1), -1, np.int64), 0, first, int(sizes.sum()), scale, prior, unit, s.rounds)
        _stop(models, growing, source.passed(state, 0)[1], scale, s)


class _Spread:
    """Rows in blocks on all executors: a pass is a Spark job."""

    def __init__(self, rows: DataFrame, s: Boosting, cuts, scale, prior, n: int):
        self.s, self.scale, self.prior, self.features = s, scale, prior, len(cuts)
        self.data = cut_lineage(packed(rows, cuts, prior, n)).persist(StorageLevel.MEMORY_AND_DISK)
        self.tasks = self.data.rdd.getNumPartitions()

    def passed(self, state: _Growing, level: int):
        return _pass(self.data, state, self.features, level, self.tasks)

    def refresh(self, recent) -> None:
        fresh = _refreshed(self.data, recent, self.s, self.features, self.prior, self.scale)
        self.data.unpersist()
        self.data = fresh


class _Whole:
    """The rows of one model in this process.  The same sums as of a pass over
    blocks, but a row's gradient is computed once a round and its node is
    kept from level to level."""

    def __init__(self, held: Held, model: int, prior: np.ndarray):
        at = np.flatnonzero(held_rows.of_model(held, model))
        everything = len(at) == len(held.y)
        self.held = held
        self.code = held.code if everything else held.code.take(at, axis=1)
        self.y, self.val, self.draw = (a if everything else a[at] for a in (held.y, held.val, held.draw))
        self.margin = np.repeat(prior.reshape(-1, 1), len(at), axis=1)
        self.trees: list[Tree] = []

    def refresh(self, recent) -> None:
        """Margins are always those of all whole rounds."""

    def _move(self) -> None:
        for k, t in enumerate(self.trees):
            node = np.arange(len(t.feature))
            leaf = t.feature < 0
            line, table = held_rows.routes(self.held, t.feature, t.bin, np.where(leaf, node, 2 * node + 1), np.where(leaf, node, 2 * node + 2))
            self.node[k] = held_rows.moved(self.code, self.node[k], line, table)

    def passed(self, state: _Growing, level: int):
        s, loss = state.settings, np.zeros((1, 2))
        self._move()
        if level == 0:
            for k, t in enumerate(self.trees):
                self.margin[k] += t.value.take(self.node[k])
            self.node = [np.zeros(len(self.y), np.int64) for _ in range(s.outputs)]
            if s.patience:
                at = np.flatnonzero(self.val)
                loss[0] = np.rint(_loss(self.margin[:, at].T, self.y[at], s).sum() * state.unit) / state.unit, len(at)
            if state.slots:
                used = ~self.val & _drawn(self.draw, state.round, s)
                self.used = None if used.all() else used.astype(np.float64)
                g, h = gradients(self.margin.T, self.y, s)
                self.g, self.h = (np.rint(a.T * state.unit) for a in (g, h))
                if self.used is not None:
                    self.g, self.h = self.g * self.used, self.h * self.used
        self.trees = state.now[0]
        sums = np.zeros((3, state.slots, state.total))
        for k in range(s.outputs):
            slots = state.open[0, k]
            lines = np.flatnonzero(slots >= 0)
            if not len(lines):
                continue
            low, many = slots[lines].min(), len(lines)                      # a tree's slots follow one another
            slot = np.where(slots >= 0, slots - low, many).take(self.node[k])   # rows in leaves: one slot more
            got = held_rows.sums(self.held, self.code, slot, many + 1, [self.g[k]] + ([] if s.objective == "squared" else [self.h[k]]) + [self.used])
            got = [a[:many] for a in got]
            sums[:, low:low + many] = got[0], got[-1] * state.unit if s.objective == "squared" else got[1], got[-1]
        sums[:2] /= state.unit
        return sums, loss


def _fit_held(rows: DataFrame, s: Boosting, models: list[BoostedModel], cuts, scale, prior, unit) -> list[BoostedModel]:
    """Each model grown by one task, from the rows held there."""
    spark = rows.sparkSession
    held = held_rows.shared(rows, cuts)

    def run(batches):
        for batch in batches:
            for m in batch.column("id").to_pylist():
                own = [models[m]]
                _rounds(_Whole(held.value, m, prior[m]), s, own, cuts, scale, prior[m:m + 1], unit)
                yield pa.RecordBatch.from_arrays([pa.array([m]), pa.array([pickle.dumps((own[0].trees, own[0].curve))], pa.binary())], names=["id", "model"])
    for r in spark.range(0, len(models), 1, len(models)).mapInArrow(run, "id long, model binary").collect():
        models[r["id"]].trees, models[r["id"]].curve = pickle.loads(r["model"])
    held.destroy()
    return models


def _stop(models, growing, loss, scale, s) -> list[int]:
    """Append the losses of the last round; the models that go on."""
    left = []
    for m in growing:
        model = models[m]
        if s.patience and model.trees and loss[m, 1]:
            model.curve.append(float(loss[m, 0] / loss[m, 1]) * (scale ** 2 if s.objective == "squared" else 1.0))
        if not (s.patience and stopping_round(model.curve, s.patience, s.tolerance)):
            left.append(m)
    return left


def _priors(rows: DataFrame, s: Boosting, features: int, many: int):
    """Models without trees, the scale of the labels, and the rows in use."""
    own = [(F.col("mask").bitwiseAND(F.lit(1 << m)) != 0) & ~F.col("val") for m in range(many)]
    k = s.outputs
    aggs = [F.count(F.lit(1)).alias("n"), F.min("y").alias("low"), F.max("y").alias("high")]
    for m, mask in enumerate(own):
        aggs += [F.count(F.when(mask, 1)).alias(f"n{m}"), F.sum(F.when(mask, F.col("y").cast("decimal(38,9)"))).alias(f"y{m}")]
        if s.objective == "softmax":
            aggs += [F.count(F.when(mask & (F.col("y") == c), 1)).alias(f"c{m}_{c}") for c in range(k)]
    a = rows.agg(*aggs).first()
    scale = 1.0
    if s.objective == "squared" and a["n"] and a["high"] > a["low"]:
        scale = 2.0 ** math.ceil(math.log2(a["high"] - a["low"]))
    models = []
    for m in range(many):
        n = a[f"n{m}"]
        if s.objective == "softmax":
            prior = np.log(np.array([(a[f"c{m}_{c}"] + 1e-9) / (n + 1e-9 * k) if n else 1 / k for c in range(k)]))
        else:
            mean = float(a[f"y{m}"]) / n if n else 0.0 if s.objective == "squared" else 0.5
            prior = np.array([mean if s.objective == "squared" else math.log(max(mean, 1e-9) / max(1 - mean, 1e-9))])
        models.append(BoostedModel(s, prior, scale, features))
    return models, scale, a["n"]


def _refreshed(data: DataFrame, recent, s: Boosting, features: int, prior, scale) -> DataFrame:
    """The rows with the margins of all trees so far."""
    state = _Growing(s, [], recent, [], np.empty(0), 0, np.empty(0), 0, scale, prior, 1.0, 0)
    held = data.sparkSession.sparkContext.broadcast(state)

    def run(batches):
        for one, _, margin in _blocks(batches, "", held.value, features):
            yield one.set_column(one.schema.get_field_index("margin"), "margin", pa.array([margin.tobytes()], pa.binary()))
    return cut_lineage(data.mapInArrow(run, data.schema)).persist(StorageLevel.MEMORY_AND_DISK)


def _grow(source, s, growing, recent, now, first, sizes, cuts, scale, prior, unit, r, stop) -> list[int]:
    """Grow ``now``, level by level; the models that went on."""
    total = int(sizes.sum())
    own = np.repeat(np.arange(len(first)), sizes)
    todo = {(m, k): [0] for m in growing for k in range(s.outputs)}
    for level in range(s.depth):
        slots, place = {}, np.full((len(now), s.outputs, (2 << s.depth) - 1), -1, np.int64)
        for (m, k), nodes in todo.items():
            for node in nodes:
                slots[m, k, node] = place[m, k, node] = len(slots)
        if not slots:
            break
        state = _Growing(s, growing, recent, now, place, len(slots), first, total, scale, prior, unit, r)
        sums, loss = source.passed(state, level)
        if level == 0:
            growing = stop(loss)
        following: dict = {}
        for (m, k, node), slot in slots.items():
            if m not in growing:
                continue
            tree = now[m][k]
            gain, left, whole = split_gains(sums[:, slot], first, sizes, s)
            if level == 0:
                tree.value[0] = _leaf(whole, s)
            best = int(np.argmax(gain))
            if not gain[best] > 1e-9:
                continue
            f = int(own[best])
            b = best - int(first[f])
            tree.feature[node], tree.bin[node], tree.threshold[node], tree.gain[node] = f, b, cuts[f][b], gain[best]
            for child, part in ((2 * node + 1, left[:, best]), (2 * node + 2, whole - left[:, best])):
                tree.value[child] = _leaf(part, s)
                following.setdefault((m, k), []).append(child)
        todo = following
    return growing


def first_gains(df: DataFrame, s: Boosting, names: list[str] | None = None) -> DataFrame:
    """(feature, threshold, gain, rows_left): every split of the first node
    that is allowed, with its gain in units of the label's loss."""
    spark = df.sparkSession
    head = df.select(F.size(vector_to_array(col(s.featuresCol))).alias("n")).first()
    features = head["n"] if head else 0
    rows = labelled_rows(df, s, [F.lit(True)])
    models, scale, n = _priors(rows, s, features, 1)
    out = []
    if features and n:
        cuts = quantile_cuts(df, s.featuresCol, features, s.bins)
        sizes = np.array([len(c) + 1 for c in cuts])
        first = np.cumsum(sizes) - sizes
        unit = float(1 << min(_UNIT_BITS, max(4, 60 - math.ceil(math.log2(n + 1)))))
        centre = float(models[0].prior[0]) if s.objective == "squared" else 0.0
        prior = (np.zeros((1, s.outputs)) if s.objective == "squared" else models[0].prior[None]).astype(np.float64)
        data = packed(rows.withColumn("y", (F.col("y") - centre) / scale), cuts, prior, n)
        state = _Growing(s, [0], [], [[Tree.empty(0) for _ in range(s.outputs)]], np.zeros((1, s.outputs, 1), np.int64), 1,
                         first, int(sizes.sum()), scale, prior, unit, 0)
        sums, _ = _pass(data, state, features, 1)
        gain, left, _ = split_gains(sums[:, 0], first, sizes, s)
        own = np.repeat(np.arange(features), sizes)
        loss = scale ** 2 if s.objective == "squared" else 1.0
        out = [((names or [str(i) for i in range(features)])[own[i]], float(cuts[own[i]][i - first[own[i]]]), float(gain[i] * loss), int(left[2, i]))
               for i in np.flatnonzero(np.isfinite(gain)) if i - first[own[i]] < len(cuts[own[i]])]
    return spark.createDataFrame(out, "feature string, threshold double, gain double, rows_left long")
