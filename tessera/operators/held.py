"""Training rows held whole in a task's memory, and sums over them.

A level of a tree costs a pass; a forest or a boosted model has hundreds, and
as Spark jobs their sums are shuffled for every node, feature and bin.  Rows
whose bins fit in ``HELD_BYTES`` are instead sent to every executor once, as
arrays, and whole trees or models are grown by single tasks, many at a time.

Features with few bins share one code (status, priority and year have 105
combinations, say): a level adds one number a row for each code, and sums by
feature follow from the sums by code.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Most bytes of the rows that are held: a byte a feature and 19 for the rest.
HELD_BYTES = 256 << 20
#: Most models that share the rows, a bit each.
MODELS = 16
#: Most combinations of bins under one code.
CODE = 256
#: Rows whose places are computed at a time: they stay in a core's cache, and buffers are used again (``mode="clip"``, as numpy buffers the output otherwise).
STEP = 1 << 16
#: One gathering at a time: the driver holds the rows until they are sent.
_GATHERING = threading.Lock()


def fits(rows: int, features: int) -> bool:
    return rows * (features + 19) <= HELD_BYTES


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins, a line for each feature; NaN is below every number."""
    out = np.empty(x.shape[::-1], np.uint8)
    for f, c in enumerate(cuts):
        v = np.where(np.isnan(x[:, f]), -np.inf, x[:, f])
        out[f] = np.searchsorted(c, v, side="left")
    return out


@dataclass
class Code:
    """Features under one code: ``bins`` has a line for each combination, with the bin of each feature."""
    features: list[int]
    bins: np.ndarray

    def columns(self, first: np.ndarray, sizes: np.ndarray):
        """Places of the features' bins among all, and the matrix from sums by code to those."""
        places = np.concatenate([first[f] + np.arange(sizes[f]) for f in self.features])
        own = np.concatenate([self.bins[:, i, None] == np.arange(sizes[f]) for i, f in enumerate(self.features)], axis=1)
        return places, own.astype(np.float64)


def coded(bins: np.ndarray, sizes: np.ndarray) -> tuple[list[Code], np.ndarray]:
    """Features put together while their combinations number ``CODE`` at most."""
    codes: list[Code] = []
    lines: list[np.ndarray] = []
    for f in range(len(bins)):
        for i, c in enumerate(codes):
            if len(c.bins) == CODE:
                continue
            both = np.empty(bins.shape[1], np.uint16)
            seen = np.zeros(len(c.bins) * int(sizes[f]), bool)
            for at in range(0, bins.shape[1], STEP):
                both[at:at + STEP] = lines[i][at:at + STEP].astype(np.uint16) * np.uint16(sizes[f]) + bins[f, at:at + STEP]
                seen[both[at:at + STEP]] = True
            found = np.flatnonzero(seen)
            if len(found) <= CODE:
                number = np.zeros(len(seen), np.uint8)
                number[found] = np.arange(len(found))
                codes[i] = Code(c.features + [f], np.column_stack([c.bins[found // sizes[f]], found % sizes[f]]))
                lines[i] = number[both]
                break
        else:
            codes.append(Code([f], np.arange(sizes[f])[:, None]))
            lines.append(bins[f])
    return codes, np.stack(lines)


@dataclass
class Held:
    codes: list[Code]
    code: np.ndarray                        # (code, row)
    y: np.ndarray
    mask: np.ndarray                        # bit m: the row is used by model m
    val: np.ndarray
    draw: np.ndarray
    sizes: np.ndarray                       # bins of each feature

    def __post_init__(self):
        self.first = np.cumsum(self.sizes) - self.sizes
        self.total = int(self.sizes.sum())
        self.of = np.empty(len(self.sizes), np.int64)           # the code of each feature
        self.bin = np.zeros((len(self.sizes), CODE), np.uint8)  # bin of each feature by code
        self.maps = [c.columns(self.first, self.sizes) for c in self.codes]
        for i, c in enumerate(self.codes):
            for j, f in enumerate(c.features):
                self.of[f], self.bin[f, :len(c.bins)] = i, c.bins[:, j]


def gathered(rows: DataFrame, cuts: list[np.ndarray]) -> Held:
    """The (x, y, mask, val, draw) of ``rows``, with bins instead of features."""
    sc = rows.sparkSession.sparkContext
    held = sc.broadcast(cuts)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                # a slice of a list column keeps its parent's values: flatten() leaves those out
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                arrays = [binned(x, held.value)] + [batch.column(c).to_numpy(zero_copy_only=False).astype(k) for c, k in _KINDS.items()]
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays],
                                                 names=["bins", *_KINDS])
    table = rows.mapInArrow(run, ", ".join(f"{c} binary" for c in ("bins", *_KINDS))).toArrow()
    held.destroy()

    def parts(name, kind):
        return [np.frombuffer(v.as_buffer(), kind) for v in table.column(name)]
    bins = np.concatenate([p.reshape(len(cuts), -1) for p in parts("bins", np.uint8)], axis=1)
    rest = [np.concatenate(parts(c, k)) for c, k in _KINDS.items()]
    del table
    sizes = np.array([len(c) + 1 for c in cuts])
    return Held(*coded(bins, sizes), *rest, sizes)


_KINDS = {"y": np.float64, "mask": np.uint16, "val": np.bool_, "draw": np.uint64}


def shared(rows: DataFrame, cuts: list[np.ndarray], change=lambda held: None):
    """Broadcast of the gathered rows, after ``change``."""
    with _GATHERING:
        held = gathered(rows, cuts)
        change(held)
        return rows.sparkSession.sparkContext.broadcast(held)


def of_model(held: Held, model: int) -> np.ndarray:
    """Whether the model may use a row."""
    return (held.mask >> np.uint16(model) & np.uint16(1)).astype(bool)


def sums(held: Held, code: np.ndarray, slot: np.ndarray, slots: int, weights: list[np.ndarray | None]) -> list[np.ndarray]:
    """For each of ``weights`` (None: 1 a row) the sums by (slot, bin of all features)."""
    by = [[np.zeros(slots * len(own)) for _ in weights] for _, own in held.maps]
    room, ones = np.empty(STEP, np.int64), np.ones(STEP)
    for at in range(0, len(slot), STEP):
        part = slot[at:at + STEP]
        place = room[:len(part)]
        for i, into in enumerate(by):
            np.multiply(part, len(held.maps[i][1]), out=place)
            np.add(place, code[i, at:at + STEP], out=place)
            for total, w in zip(into, weights):
                w = ones[:len(part)] if w is None else w[at:at + STEP]
                if len(total) <= STEP:
                    total += np.bincount(place, w, len(total))
                else:
                    np.add.at(total, place, w)
    out = [np.empty((slots, held.total)) for _ in weights]
    for i, (places, own) in enumerate(held.maps):
        for into, total in zip(out, by[i]):
            total = total.reshape(slots, -1)
            into[:, places] = total if len(held.codes[i].features) == 1 else total @ own
    return out


def routes(held: Held, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray):
    """For ``moved``: slots of which bins of ``feature`` above ``cut`` go to ``right``, all others to
    ``left``; without a feature (-1) all rows do."""
    f = np.maximum(feature, 0)
    goes = (held.bin[f] > cut[:, None]) & (feature[:, None] >= 0)
    return held.of[f], np.where(goes, right[:, None], left[:, None]).ravel()


def moved(code: np.ndarray, slot: np.ndarray, line: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The rows' next slots."""
    out, flat, n = np.empty(len(slot), np.int64), code.ravel(), code.shape[1]
    row, place, found = np.arange(STEP), np.empty(STEP, np.int64), np.empty(STEP, np.uint8)
    for at in range(0, len(slot), STEP):
        own = slot[at:at + STEP]
        k = len(own)
        p, c = place[:k], found[:k]
        np.take(line, own, out=p, mode="clip")
        p *= n
        p += row[:k]
        p += at
        np.take(flat, p, out=c, mode="clip")
        np.multiply(own, CODE, out=p)
        p += c
        np.take(table, p, out=out[at:at + STEP], mode="clip")
    return out


def mixed(draw: np.ndarray, number: int, seed: int) -> np.ndarray:
    """A number from 0 to 1 for each row, a hash of its ``draw`` and of ``number``."""
    x = draw.view(np.uint64) + np.uint64((number + 1) * 0x9E3779B97F4A7C15 + seed & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (x >> np.uint64(11)).astype(float) / (1 << 53)
