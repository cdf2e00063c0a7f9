"""Hard negatives by exact integer scores from subset-sum tables (the method
of Four Russians).

Candidates are stored as bit planes: component j of a candidate is
sum over planes b of w(b) * bit(b, j), with w(b) = 2^b and the top plane
negative (two's complement), and eight components' bits of one plane are one
byte.  For an anchor, a table of 256 entries for every group of eight
components holds the sums of all subsets of its components there.  The score
is then lookups, adds and shifts alone:

    score = sum over planes b of w(b) * sum over groups g of T[g][byte(b, g)]

Tables of a block of anchors lie side by side, so one lookup serves them all.

Every row is scored against every anchor, in two passes over the candidates:
the first finds each anchor's positives (the best rows of its label), the
second, for each positive, the best rows of other labels within the
score band below it.  Anchors are broadcast in chunks of ``ANCHORS`` at most;
a task keeps the best few of each anchor and hands on only these, one list
for each task and not for each block, with as many tasks as the cluster has
cores.  Nothing is sampled, indexed or cut off.

Cases: rows with a null id, label, vector or component, or a component that is
not finite, take no part; a short vector counts as filled up with zeros;
scores are 64-bit integers, and wrap around beyond as Spark's longs do; ids
must be whole numbers (others count as null); rows with an anchor's own id
are never its partners, and rows with equal id and score are one partner;
ties go to the smaller id; an anchor without positives or negatives has no row; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import staged

EVERY = 50                  # anchors are the rows whose id it divides
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95          # per cent of the positive's score
ANCHORS = 32_768
SCALE = 256
#: Anchors and rows scored at a time, rows selected from at a time, entries held before they are cut down.
LANES, ROWS, BLOCK, HELD = 256, 256, 8192, 1_000_000


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
              scale: int = SCALE) -> DataFrame:
    """(id, label, q): whole components of the rows that take part."""
    x = F.transform(vectors[f"`{vector}`"], lambda v: v.cast("double"))
    own = vectors.select(vectors[f"`{key}`"].try_cast("long").alias("id"),
                         (vectors[f"`{label}`"] if isinstance(label, str) else label).cast("string").alias("label"), x.alias("x"))
    whole = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & whole)
            .select("id", "label", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("q")))


class Layout:
    """Planes and byte groups of the rows, and number types wide enough."""

    def __init__(self, dims: int, low: int, high: int):
        self.groups = max(1, -(-dims // 8))
        self.planes = 1 + max(int(high).bit_length(), (-1 - int(low)).bit_length() if low < 0 else 0)
        most = max(abs(int(low)), abs(int(high)), 1) * self.groups * 8
        self.sums = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
        self.score = np.int32 if most * max(abs(int(low)), abs(int(high)), 1) < 1 << 31 else np.int64

    def pack(self, q: np.ndarray) -> np.ndarray:
        """Rows of whole components -> (row, plane, group) bytes."""
        wide = np.zeros((len(q), self.groups * 8), np.int64)
        wide[:, :q.shape[1]] = q
        shifted = wide[:, None, :] >> np.arange(self.planes)[None, :, None] & 1
        return np.packbits(shifted.astype(np.uint8), axis=2, bitorder="little")

    def unpack(self, data: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(data, axis=2, bitorder="little").astype(np.int64)
        return (bits * self.weights()[None, :, None]).sum(axis=1)

    def weights(self) -> np.ndarray:
        w = np.left_shift(np.int64(1), np.arange(self.planes, dtype=np.int64))
        w[-1] = -w[-1]
        return w

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """(group, byte, anchor): sums of every subset of eight components."""
        parts = anchors.T.reshape(self.groups, 8, len(anchors)).astype(self.sums)
        out = np.zeros((self.groups, 256, len(anchors)), self.sums)
        for j in range(8):                           # a subset with bit j is one without it plus component j
            out[:, 1 << j:2 << j] = out[:, :1 << j] + parts[:, j:j + 1]
        return out

    def scores(self, tables: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Full exact scores of the rows ``data`` with the anchors of ``tables``."""
        lanes = tables.shape[2]
        out = np.zeros((len(data), lanes), self.score)
        for i in range(0, len(data), ROWS):
            part = data[i:i + ROWS]
            total, looked = out[i:i + ROWS], np.empty((len(part), lanes), self.sums)
            for b in range(self.planes):
                plane = np.take(tables[0], part[:, b, 0], axis=0, mode="clip")
                for g in range(1, self.groups):
                    np.take(tables[g], part[:, b, g], axis=0, out=looked, mode="clip")
                    plane += looked
                wide = plane.astype(self.score) << self.score(b)
                if b == self.planes - 1:
                    total -= wide
                else:
                    total += wide
        return out


def packed(rows: DataFrame, layout: Layout) -> DataFrame:
    """(id, label, planes) of ``rows`` (id, label, q)."""
    dims = layout.groups * 8

    def run(batches):
        for batch in batches:
            q = batch.column(2)
            n = q.value_lengths().to_numpy()
            wide = np.zeros((len(n), dims), np.int64)
            wide[np.arange(dims)[None, :] < n[:, None]] = q.flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in layout.pack(wide)], pa.binary())],
                                             names=["id", "label", "planes"])
    return rows.mapInArrow(run, "id long, label string, planes binary")


def _planes(column, layout: Layout) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint8).reshape(len(column), layout.planes, layout.groups)


class Best:
    """The best ``k`` different (score, id) of each of ``n`` lists."""

    def __init__(self, n: int, k: int):
        self.k, self.held, self.count = k, [], 0
        self.list = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.id = np.empty(0, np.int64)
        self.bound = np.full(n, np.iinfo(np.int64).min)    # below it nothing enters a full list

    def add(self, which, score, ids):
        if len(which):
            self.held.append((which, score.astype(np.int64), ids))
            self.count += len(which)
            if self.count >= HELD:
                self.settle()

    def settle(self):
        lists, scores, ids = (np.concatenate(c) for c in zip((self.list, self.score, self.id), *self.held))
        order = np.lexsort((ids, -scores, lists))
        lists, scores, ids = lists[order], scores[order], ids[order]
        new = np.r_[True, (lists[1:] != lists[:-1]) | (scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1])][:len(lists)]
        lists, scores, ids = lists[new], scores[new], ids[new]
        first = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]][:len(lists)])
        rank = np.arange(len(lists)) - np.repeat(first, np.diff(np.r_[first, len(lists)]))
        keep = rank < self.k
        self.list, self.score, self.id = lists[keep], scores[keep], ids[keep]
        full = rank == self.k - 1
        self.bound[lists[full]] = scores[full]
        self.held, self.count = [], 0


def _scan(rows: DataFrame, layout: Layout, anchors, width: int, k: int, select) -> DataFrame:
    """(list, score, id): each task's best ``k`` of every list.  ``select``
    gives the wanted (rows, lanes) of a block of scores for each of the
    ``width`` lists of an anchor."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(anchors)

    def run(batches):
        chunk = held.value
        best = Best(len(chunk["id"]) * width, k)
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                ids, data = part.column(0).to_numpy(), _planes(part.column(2), layout)
                names = np.array(part.column(1).to_pylist(), object)
                label = np.array([chunk["names"].get(x, -1) for x in names], np.int32)
                for a in range(0, len(chunk["id"]), LANES):
                    lane = slice(a, a + LANES)
                    scores = layout.scores(layout.tables(chunk["q"][lane]), data)
                    for j, (r, c) in enumerate(select(chunk, lane, best.bound, scores, ids, label)):
                        best.add((c + a) * width + j, scores[r, c], ids[r])
                best.settle()
        best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(best.list), pa.array(best.score), pa.array(best.id)], names=["list", "score", "id"])
    # as many tasks as cores, each over many splits: a task hands on one list for each anchor
    few = rows.coalesce(max(1, spark.sparkContext.defaultParallelism))
    out = few.mapInArrow(run, "list long, score long, id long").distinct()
    place = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k)


def _least(bound: np.ndarray, dtype) -> np.ndarray:
    """Bounds in the type of the scores, so that comparing copies nothing."""
    return np.clip(bound, np.iinfo(dtype).min, np.iinfo(dtype).max).astype(dtype)


def _same(chunk, lane, bound, scores, ids, label):
    """Rows of the anchor's label."""
    wanted = scores >= _least(bound[lane], scores.dtype)[None, :]
    wanted &= chunk["label"][lane][None, :] == label[:, None]
    wanted &= chunk["id"][lane][None, :] != ids[:, None]
    yield np.nonzero(wanted)


def _other(chunk, lane, bound, scores, ids, label):
    """Rows of other labels inside the band of each positive."""
    width = chunk["low"].shape[1]
    least = _least(np.maximum(chunk["low"][lane], bound.reshape(-1, width)[lane]), scores.dtype)
    most = _least(chunk["high"][lane], scores.dtype)
    wanted = scores >= least.min(axis=1)[None, :]
    wanted &= scores <= most.max(axis=1)[None, :]
    wanted &= chunk["label"][lane][None, :] != label[:, None]
    wanted &= chunk["id"][lane][None, :] != ids[:, None]
    r, c = np.nonzero(wanted)
    s = scores[r, c]
    for j in range(width):
        hit = (s >= least[c, j]) & (s <= most[c, j])
        yield r[hit], c[hit]


def mined(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", every: int = EVERY,
          positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for every anchor and positive, the best ``negatives``
    rows of other labels with low% * positive <= 100 * score <= high% * positive."""
    spark = vectors.sparkSession
    rows = quantised(vectors, key, vector, label)
    size = rows.agg(F.max(F.size("q")).alias("d"), F.min(F.array_min("q")).alias("low"), F.max(F.array_max("q")).alias("high")).first()
    layout = Layout(size["d"] or 0, size["low"] or 0, size["high"] or 0)
    every_row = staged(packed(rows, layout), "negatives-planes")
    asked = staged(every_row.where(F.pmod("id", F.lit(every)) == 0).distinct(), "negatives-anchors")
    chunks = -(-asked.count() // (ANCHORS * 9 // 10))
    found = []
    for c in range(chunks):
        part = asked.where(F.pmod(F.xxhash64("id", "label", "planes"), F.lit(chunks)) == c).toArrow()
        if part.num_rows:
            found.append(_chunk(every_row, layout, part, positives, negatives, low, high))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = spark.createDataFrame([], schema)
    for f in found:
        out = out.unionByName(f)
    return out


def _chunk(rows: DataFrame, layout: Layout, part: pa.Table, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = rows.sparkSession
    ids, names = part["id"].to_numpy(), part["label"].to_pylist()
    place = {x: i for i, x in enumerate(dict.fromkeys(names))}
    chunk = {"id": ids, "names": place, "label": np.array([place[x] for x in names], np.int32),
             "q": layout.unpack(_planes(part["planes"], layout))}
    best = _scan(rows, layout, chunk, 1, positives, _same).toArrow()
    lists, score = best["list"].to_numpy(), best["score"].to_numpy()
    at = best["rank"].to_numpy() - 1
    lowest = np.full((len(ids), positives), np.iinfo(np.int64).max)
    highest = np.full((len(ids), positives), np.iinfo(np.int64).min)
    # the band in whole numbers, rounded inwards
    exact = [int(s) for s in score]
    lowest[lists, at] = [-(-low * s // 100) for s in exact]
    highest[lists, at] = [high * s // 100 for s in exact]
    more = chunk | {"low": lowest, "high": highest}
    hard = _scan(rows, layout, more, positives, negatives, _other)
    known = spark.createDataFrame(pa.table({
        "list": pa.array(lists * positives + at), "anchor_id": pa.array(ids[lists]), "positive_id": best["id"],
        "positive_score": best["score"]}))
    out = hard.join(F.broadcast(known), "list").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    return staged(out, "negatives-found")
