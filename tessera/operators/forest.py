"""Random forests of regression trees, each tree grown whole by one task.

The definition is that of Spark ML's ``RandomForestRegressor`` with all
features at every split: rows weighted by Poisson draws, at most ``bins``
quantile bins a feature, splits by the largest loss of squared error, and the
mean of the trees as prediction.  What differs is where sums are taken: Spark
shuffles the sums of every node of every tree for each level, here the rows
are sent once (:mod:`tessera.operators.held`) and nothing else is.  Draws are
a hash of the row, so a forest does not depend on the partitions, but for rounding.

The final fit and the folds of a cross-validation are grown side by side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.schema import col
from tessera.operators import held as held_rows
from tessera.operators.boosting import quantiles
from tessera.operators.held import Held

#: Rows scored at a time.
BLOCK = 8192
#: Rows whose nodes are summed at a time, and the levels after which rows are put in the order of
#: their nodes: else the sums of a level's nodes, several MB, are written to in no order.
GROUP = 1 << 16
ORDERED = 3
#: Quantiles looked up for the bins.
FINE = 256
#: Shares of rows that a bootstrap draws at most 0, 1, 2, ... times.
_DRAWN = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


@dataclass(frozen=True)
class Forest:
    """Settings, used like an estimator."""
    trees: int = 100
    depth: int = 12
    bins: int = 32
    seed: int = 42
    featuresCol: str = "features"
    labelCol: str = "label"

    def fit(self, df: DataFrame) -> "ForestModel":
        return fit_many(df, self, [F.lit(True)])[0]

    def fit_folds(self, df: DataFrame, fold: str, folds: int, found: list | None = None) -> list["ForestModel"]:
        """The forest of all rows, then those of all rows but one fold.  ``found``: see ``fit_many``."""
        return fit_many(df, self, [F.lit(True)] + [col(fold) != k for k in range(folds)], found)


@dataclass
class ForestModel:
    """Nodes of all trees one after the other: ``left`` is the place of the left child, the
    right one follows it; a leaf (feature -1) is its own."""
    settings: Forest
    cuts: list[np.ndarray]
    roots: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray
    importance: np.ndarray

    @property
    def featureImportances(self):
        """The mean over trees of a feature's share of the gain."""
        from pyspark.ml.linalg import Vectors
        return Vectors.dense(self.importance)

    @cached_property
    def _tables(self):
        """The splits that occur, (feature, bin), and for each node the place of its split's answers."""
        key = np.where(self.feature < 0, -1, self.feature.astype(np.int64) * 256 + self.bin)
        seen, line = np.unique(np.append(key, -1), return_inverse=True)     # the first: no split
        return [(k // 256, k % 256) for k in seen[1:]], line[:-1] * BLOCK, self.left.astype(np.int64)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Every split is judged once for all rows of a block; a row then looks its answers up."""
        splits, line, left = self._tables
        out = np.zeros(len(x))
        answers = np.zeros((len(splits) + 1, BLOCK), np.uint8)
        for i in range(0, len(x), BLOCK):
            part = np.where(np.isnan(x[i:i + BLOCK]), -np.inf, x[i:i + BLOCK]).T
            for j, (f, b) in enumerate(splits):
                answers[j + 1, :part.shape[1]] = part[f] > self.cuts[f][b]
            flat, row = answers.ravel(), np.arange(part.shape[1])
            at, node, to, got = (np.empty(len(row), k) for k in (np.int64, np.int64, np.int64, np.uint8))
            for root in self.roots:
                node[:] = root
                for _ in range(self.settings.depth):
                    np.take(line, node, out=at, mode="clip")
                    at += row
                    np.take(flat, at, out=got, mode="clip")
                    np.take(left, node, out=to, mode="clip")
                    np.add(to, got, out=node)
                out[i:i + BLOCK] += self.value.take(node)
        return out / len(self.roots)

    def transform(self, df: DataFrame) -> DataFrame:
        held = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def predicted(v):
            import pandas as pd
            return pd.Series(held.value.predict(np.stack(v.to_list())) if len(v) else np.empty(0))
        return df.withColumn("prediction", predicted(vector_to_array(col(self.settings.featuresCol))))

    def to_parts(self) -> tuple[dict, dict[str, bytes]]:
        """A head for JSON, and arrays."""
        return ({"settings": self.settings.__dict__, "cuts": [len(c) for c in self.cuts]},
                {n: getattr(self, n).tobytes() for n in _ARRAYS} | {"cuts": np.concatenate([*self.cuts, np.empty(0)]).tobytes()})

    @staticmethod
    def from_parts(head: dict, arrays: dict[str, bytes]) -> "ForestModel":
        cuts = np.split(np.frombuffer(arrays["cuts"], np.float64), np.cumsum(head["cuts"]))[:-1]
        return ForestModel(Forest(**head["settings"]), cuts, *(np.frombuffer(arrays[n], k) for n, k in _ARRAYS.items()))


_ARRAYS = {"roots": np.int64, "feature": np.int16, "bin": np.uint8, "left": np.int32, "value": np.float64, "importance": np.float64}
_TREE = {"feature": np.int16, "bin": np.uint8, "value": np.float64, "importance": np.float64}


def cuts_of(quantiles: np.ndarray, gaps: bool, bins: int) -> np.ndarray:
    """Upper ends of a feature's bins, the last one open: one for each value if they are few, else
    bins of as many rows each.  NaN has a bin of its own."""
    most = bins - 1 - gaps
    cuts = np.unique(quantiles)
    if len(cuts) > most:
        cuts = np.unique(quantiles[[FINE * i // bins for i in range(1, bins)]])[:most]
    return np.r_[-np.inf, cuts] if gaps else cuts


def drawn(draw: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in the tree's sample: Poisson draws of mean 1."""
    return np.searchsorted(_DRAWN, held_rows.mixed(draw, tree, seed), side="right").astype(np.uint8)


def apart(draw: np.ndarray) -> np.ndarray:
    """Equal rows get draws of their own: a bootstrap draws each by itself."""
    order = np.argsort(draw, kind="stable")
    run = draw[order]
    place = np.arange(len(run))
    start = np.maximum.accumulate(np.where(np.append(True, run[1:] != run[:-1]), place, 0)) if len(run) else place
    out = np.empty_like(draw)
    out[order] = run + (place - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return out


def _splits(held: Held, code: np.ndarray, slot: np.ndarray, slots: int, w: np.ndarray, wy: np.ndarray, own: np.ndarray):
    """For each slot the best split, "bin at most b" by its place among all bins (-1: none), its
    gain, and the rows and sums on its left and right."""
    n, y = (a[:slots] for a in held_rows.sums(held, code, slot, slots + 1, [w, wy]))
    ends = held.first + held.sizes - 1
    for a, b in zip(held.first, ends + 1):
        np.cumsum(n[:, a:b], axis=1, out=n[:, a:b])
        np.cumsum(y[:, a:b], axis=1, out=y[:, a:b])
    n_all, y_all = n[:, ends], y[:, ends]                                   # alike for all features
    right_n, right_y = n_all[:, own] - n, y_all[:, own] - y
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where((n > 0) & (right_n > 0), y * y / n + right_y * right_y / right_n, -np.inf)
        score -= (y_all * y_all / n_all)[:, own]
    best, line = np.argmax(score, axis=1) if slots else np.zeros(0, np.int64), np.arange(slots)
    gain, left_n, left_y, right_n, right_y = (a[line, best] for a in (score, n, y, right_n, right_y))
    enough = gain > 1e-13 * np.abs(y_all[:, 0] * y_all[:, 0] / np.maximum(n_all[:, 0], 1))
    return np.where(enough, best, -1), gain, left_n, left_y, right_n, right_y


def grown(held: Held, model: int, weight: np.ndarray, s: Forest):
    """One tree: (feature, bin, values of leaves, importance), its first node first and children
    in the order of their parents, two each."""
    at = np.flatnonzero(held_rows.of_model(held, model) & (weight > 0))
    code = held.code.take(at, axis=1)
    w = weight[at].astype(np.float64)
    wy = w * held.y[at]
    most = min((2 << s.depth) - 1, 2 * len(at) + 1)
    feature, cut, value = np.full(most, -1, np.int16), np.zeros(most, np.uint8), np.zeros(most)
    importance = np.zeros(len(held.sizes))
    value[0] = wy.sum() / max(w.sum(), 1)
    slot, nodes, count = np.zeros(len(at), np.int64), np.array([0]), 1
    own = np.repeat(np.arange(len(held.sizes)), held.sizes)
    rows, edges = np.array([0, len(at)]), np.array([0, 1])                  # of the groups: rows and nodes
    for level in range(s.depth if len(at) else 0):
        if level % ORDERED == 0 and len(slot) > GROUP:
            order = np.argsort(slot.astype(np.uint16 if len(nodes) < 1 << 16 else np.int64), kind="stable")
            order = order[:len(slot) - np.count_nonzero(slot == len(nodes))]
            code, w, wy, slot = code.take(order, axis=1), w.take(order), wy.take(order), slot.take(order)
            ends = np.cumsum(np.bincount(slot, minlength=len(nodes)))
            edges = np.unique(np.r_[0, np.searchsorted(ends, np.arange(GROUP, len(slot), GROUP)) + 1, len(nodes)])
            rows = np.r_[0, ends][edges]
        found = [_splits(held, code[:, a:b], np.minimum(slot[a:b] - i, j - i), j - i, w[a:b], wy[a:b], own)
                 for a, b, i, j in zip(rows[:-1], rows[1:], edges[:-1], edges[1:])]
        best, gain, ln, ly, rn, ry = (np.concatenate(a) for a in zip(*found))
        splits = best >= 0
        if not splits.any():
            break
        who, place = nodes[splits], best[splits]
        f = own[place]
        feature[who], cut[who] = f, place - held.first[f]
        children = count + 2 * np.arange(len(who))
        np.add.at(importance, f, gain[splits])
        value[children], value[children + 1] = ly[splits] / ln[splits], ry[splits] / rn[splits]
        count += 2 * len(who)
        goes = np.full(len(nodes) + 1, 2 * len(who))                        # rows in leaves: one slot more
        goes[:-1][splits] = 2 * np.arange(len(who))
        to = np.append(np.where(splits, feature[nodes], -1), -1)
        slot = held_rows.moved(code, slot, *held_rows.routes(held, to, np.append(cut[nodes], 0), goes, goes + 1))
        nodes = np.stack([children, children + 1], axis=1).ravel()
        edges = 2 * np.append(0, np.cumsum(splits))[edges]
    total = importance.sum()
    feature = feature[:count]
    return feature, cut[:count], value[:count][feature < 0], importance / total if total > 0 else importance


def fit_many(df: DataFrame, s: Forest, masks: list[Column], found: list | None = None) -> list[ForestModel]:
    """One forest for each of ``masks`` (the rows it may use).  ``found``: the ``FINE`` quantiles of
    the features, if they are known."""
    if len(masks) > held_rows.MODELS:
        return fit_many(df, s, masks[:held_rows.MODELS], found) + fit_many(df, s, masks[held_rows.MODELS:], found)
    spark = df.sparkSession
    labelled = df.where(col(s.labelCol).isNotNull())
    x = vector_to_array(col(s.featuresCol))
    head = labelled.agg(F.max(F.size(x)).alias("features"), F.avg(col(s.labelCol)).alias("centre")).first()
    features, centre = head["features"], head["centre"] and float(np.float32(head["centre"]))     # alike for all partitions
    if features is None:
        raise ValueError("a forest needs rows with a label")
    cuts = [cuts_of(q, gaps, s.bins) for q, gaps in found or quantiles(labelled, s.featuresCol, features, FINE)]
    mask = sum((F.coalesce(m, F.lit(False)).cast("long") * F.lit(1 << i) for i, m in enumerate(masks)), F.lit(0).cast("long"))
    plain = [col(c) for c, kind in labelled.dtypes if kind not in ("vector", "variant") and "map<" not in kind]
    rows = labelled.select(x.alias("x"), (col(s.labelCol).cast("double") - centre).alias("y"), mask.alias("mask"),
                           F.lit(False).alias("val"), F.xxhash64(x, *plain).alias("draw"))
    held, models = held_rows.shared(rows, cuts, ordered), len(masks)

    def run(batches):
        last, weight = -1, None
        for batch in batches:
            for i in batch.column("id").to_pylist():
                tree, model = divmod(i, models)
                if tree != last:
                    last, weight = tree, drawn(held.value.draw, tree, s.seed)
                parts = grown(held.value, model, weight, s)
                yield pa.RecordBatch.from_arrays([pa.array([i])] + [pa.array([p.tobytes()], pa.binary()) for p in parts],
                                                 names=["id", *_TREE])
    many = s.trees * models
    tasks = min(s.trees, 3 * spark.sparkContext.defaultParallelism)
    table = spark.range(0, many, 1, tasks).mapInArrow(run, ", ".join(["id long"] + [f"{c} binary" for c in _TREE])).toArrow()
    held.destroy()
    place = np.argsort(table["id"].to_numpy())
    return [_joined(s, cuts, centre, {n: [np.frombuffer(table[n][i].as_buffer(), k) for i in place[m::models]] for n, k in _TREE.items()})
            for m in range(models)]


def ordered(held: Held) -> None:
    """Rows in the order of their draws, so that sums do not depend on the partitions."""
    draw = apart(held.draw)
    order = np.argsort(draw)
    held.draw, held.y, held.mask, held.val = draw[order], held.y[order], held.mask[order], held.val[order]
    for i in range(len(held.code)):
        held.code[i] = held.code[i][order]


def _joined(s: Forest, cuts: list[np.ndarray], centre: float, trees: dict[str, list[np.ndarray]]) -> ForestModel:
    roots = np.cumsum([0] + [len(f) for f in trees["feature"]])[:-1]
    feature = np.concatenate(trees["feature"])
    left, value = np.arange(len(feature), dtype=np.int32), np.zeros(len(feature))
    for root, f in zip(roots, trees["feature"]):
        splits = root + np.flatnonzero(f >= 0)
        left[splits] = root + 1 + 2 * np.arange(len(splits))
    value[feature < 0] = np.concatenate(trees["value"]) + centre
    importance = np.sum(trees["importance"], axis=0)
    total = importance.sum()
    return ForestModel(s, cuts, roots, feature, np.concatenate(trees["bin"]), left, value, importance / total if total > 0 else importance)
