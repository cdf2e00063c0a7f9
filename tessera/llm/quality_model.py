"""Quality classifier: an SVM on n-gram indicators scaled by naive Bayes.

A text is turned into n-gram indicators, each indicator is scaled by its
log-count ratio between the classes, r = log((p / |p|) / (q / |q|)), and a
linear model with hinge loss is fitted on the scaled indicators by dual
coordinate descent.

Indicators (never from label, language, source or id):

* words, hashed;
* 1- and 2-grams over word *shapes*: case pattern, trailing punctuation, and
  whether the word repeats its predecessor or stands in a 3-word window that
  the text has more than once; each with the band of its share of the text,
  so the same shapes say something else when they fill the text.

The model is fitted on at most ``MAX_FIT`` labelled rows, picked by hash of
the id before any text is read: that list is small enough to broadcast by its
bound, so learning shuffles no text.  One fifth of the rows is kept out of the
descent to turn margins into probabilities.  Scoring is one pass over all
texts; the model that travels to the executors has a fixed size.

Cases: null and empty texts have the single indicator "no words" and a score
like any; texts of any length are read whole; repeated labelled rows count
repeatedly; labels other than 0 and 1, or null, are not learned from; with no
labels, or one class, every score is the smoothed share of class 1; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged
from tessera.llm.tokens import Rolling, encoded, word_hashes

MAX_FIT = 8000             # labelled rows that are learned from
SPARE = 1.1                # of that many rows drawn, to have enough
EPOCHS = 12
COST = 4.0                 # of a unit of hinge loss, before class balance
ALPHA = 1.0                # smoothing of the class counts
MIX = 0.5                  # of the descent's weights and their mean magnitude
CUT = 0.3                  # score from which label 1 is predicted

_CASES, _ENDS, _NEWS = 6, 6, 3
SHAPES = _CASES * _ENDS * _NEWS
BANDS = (0.01, 0.05, 0.2, 0.5)
WORD_BITS = 16
_UNI = 1 << WORD_BITS
_BI = _UNI + SHAPES * (len(BANDS) + 1)
#: Slots of neighbouring word pairs, by hash.
PAIR_BITS = 18
_PAIRS = _BI + SHAPES * SHAPES * (len(BANDS) + 1)
EMPTY = _PAIRS + (1 << PAIR_BITS)
SIZE = EMPTY + 1
#: Distinct words whose shapes are remembered at a time.
REMEMBERED = 200_000


def _shape(word: bytes) -> int:
    """Case pattern and last character class of a word, as a number."""
    text = word.decode("utf-8", "replace")
    letters = [c for c in text if c.isalpha()]
    upper = sum(c.isupper() for c in letters)
    if not letters:
        case = 0 if any(c.isdigit() for c in text) else 1
    elif upper == 0:
        case = 2
    elif upper == len(letters) and upper > 1:
        case = 3
    else:
        case = 4 if letters[0].isupper() and upper == 1 else 5
    last = text[-1]
    end = (0 if last.isalnum() else 1 if last in ".;:?" else 2 if last == "," else 3 if last == "!"
           else 4 if last in "#*$%&|<>=~^_\\" else 5)
    return case * _ENDS + end


class _Shapes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = s = _shape(word)
        return s


_shapes = _Shapes()


def _banded(codes: np.ndarray, first: int) -> np.ndarray:
    """Indicators (code, band of its share) of the codes of a text."""
    seen, n = np.unique(codes, return_counts=True)
    return first + seen * (len(BANDS) + 1) + np.searchsorted(BANDS, n / len(codes))


def indicators(text: str | None) -> np.ndarray:
    data = encoded(text)
    ws = data.split()
    if not ws:
        return np.array([EMPTY])
    h = word_hashes(data)
    new = np.zeros(len(h), np.int64)
    if len(h) >= 3:
        w = Rolling(h).windows(3)
        _, where, n = np.unique(w, return_inverse=True, return_counts=True)
        again = np.flatnonzero(n[where] > 1)
        for j in range(3):
            new[again + j] = 2
    new[1:][h[1:] == h[:-1]] = 1
    s = np.fromiter(map(_shapes.__getitem__, ws), np.int64, len(ws)) * _NEWS + new
    found = [np.unique(h >> np.uint64(64 - WORD_BITS)).astype(np.int64), _banded(s, _UNI)]
    if len(s) > 1:
        found.append(_banded(s[:-1] * SHAPES + s[1:], _BI))
        found.append(_PAIRS + np.unique(Rolling(h).windows(2) >> np.uint64(64 - PAIR_BITS)).astype(np.int64))
    return np.concatenate(found)


def featured(rows: DataFrame) -> DataFrame:
    """(label, key, found) of the rows (label, key, text)."""
    def run(batches):
        for batch in batches:
            found = pa.array([indicators(t.as_py()).astype(np.int32) for t in batch.column(2)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["label", "key", "found"])
    return rows.select("label", "key", "text").mapInArrow(run, "label int, key long, found array<int>")


@dataclass
class Model:
    weights: np.ndarray        # per indicator, the log-count ratio included
    bias: float
    slope: float               # margin -> log odds
    offset: float

    def score(self, found: np.ndarray) -> float:
        z = self.slope * (self.weights[found].sum() / np.sqrt(len(found)) + self.bias) + self.offset
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int,
            epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Dual coordinate descent for the L2-regularised hinge loss: one dual
    variable per row within [0, cost], each set to its best value in turn."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    square = np.array([v @ v for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            if not square[i]:
                continue
            gradient = y[i] * (w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                worst = max(worst, abs(new - alpha[i]))
                alpha[i] = new
        if worst < 1e-4:
            break
    return w


def _calibrated(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins (Newton steps,
    smoothed targets, so separable margins stay finite)."""
    hi, lo = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (hi + 1) / (hi + 2), 1 / (lo + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        v = p * (1 - p) + 1e-9
        g = np.array([((p - t) * m).sum() + 1e-3 * a, (p - t).sum()])
        hess = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum()]])
        step = np.linalg.solve(hess + 1e-9 * np.eye(2), g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def picked(labels: DataFrame, max_fit: int = MAX_FIT) -> DataFrame:
    """At most ``max_fit`` of the usable rows (label, key, ...): those with the
    smallest hashes of the key, on any partitioning the same ones."""
    usable = labels.where("label IN (0, 1) AND key IS NOT NULL")
    many = usable.count()
    if many <= max_fit:
        return usable
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    near = usable.where(draw < SPARE * max_fit / many)      # little more than the bound is merged by the ordered limit
    return near.orderBy(draw, *[c for c in ("key", "label", "text") if c in usable.columns]).limit(max_fit)


def fit_labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_fit: int = MAX_FIT) -> Model:
    """Fit on the documents that ``labels`` (label, key) names."""
    own = docs.select(docs[f"`{key}`"].try_cast("long").alias("_id"), docs[f"`{text}`"].alias("text"))
    # only labels that have a document are drawn from
    there = labels.join(own.select("_id"), F.col("key") == F.col("_id"), "left_semi")
    some = F.broadcast(picked(staged(there, "quality-labels"), max_fit).select("label", "key"))
    return fit(own.join(some, F.col("_id") == F.col("key")).select("label", "key", "text"), max_fit)


def fit(rows: DataFrame, max_fit: int = MAX_FIT, cost: float = COST) -> Model:
    """``rows``: (label 0/1, key long, text); see ``picked`` for how many count."""
    every = staged(featured(picked(rows, max_fit)), "quality-features")
    n = dict(every.groupBy("label").count().collect())
    prior = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
    if len(n) < 2:
        return Model(np.zeros(SIZE), 0.0, 1.0, float(np.log(prior / (1 - prior))))
    counts = every.select("label", F.explode("found").alias("i")).groupBy("label", "i").count()
    table = np.full((2, SIZE), ALPHA)
    got = counts.toArrow()                              # at most 2 x SIZE rows, a fixed number
    table[got["label"].to_numpy(), got["i"].to_numpy()] += got["count"].to_numpy()
    ratio = np.log(table[1] / table[1].sum()) - np.log(table[0] / table[0].sum())

    sample = every.toArrow().sort_by([("key", "ascending"), ("label", "ascending")])    # max_fit rows at most
    found = [np.asarray(x) for x in sample["found"].to_pylist()]
    y = np.where(sample["label"].to_numpy() > 0, 1.0, -1.0)
    kept = sample["key"].to_numpy() % 5 != 1            # the others calibrate
    if len(set(y[kept])) < 2 or len(set(y[~kept])) < 2:
        kept = np.ones(len(y), bool)
    # a text's scaled indicators are divided by the root of their number, so length alone moves no margin
    values = [ratio[f] / np.sqrt(len(f)) for f in found]
    balance = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    rows_with_bias = [np.append(f, SIZE) for f in found]
    with_bias = [np.append(v, 1.0) for v in values]
    train = np.flatnonzero(kept)
    w = descend([rows_with_bias[i] for i in train], [with_bias[i] for i in train], y[train], cost * balance[train], SIZE + 1)
    w[:SIZE] = MIX * w[:SIZE] + (1 - MIX) * np.abs(w[:SIZE]).mean()
    model = Model(w[:SIZE] * ratio, float(w[SIZE]), 1.0, 0.0)
    rest = np.flatnonzero(~kept) if not kept.all() else train
    margins = np.array([model.weights[found[i]].sum() / np.sqrt(len(found[i])) + model.bias for i in rest])
    model.slope, model.offset = _calibrated(margins, y[rest])
    if model.slope < 0:
        model.slope = 0.0
    return model


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """Per row: doc_id, score, predicted."""
    def run(batches):
        for batch in batches:
            s = np.array([model.score(indicators(t.as_py())) for t in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])
    return docs.select(docs[f"`{key}`"].try_cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int")
