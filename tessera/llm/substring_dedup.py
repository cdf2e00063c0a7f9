"""Substring dedup on a compacted De Bruijn graph of token k-mers.

The words of a text are a walk: every window of ``k`` (50) words is an edge.
The graph is never stored edge by edge.  A window's *anchor* is its smallest
20-word k-mer by hash, so windows with the same words have the same anchor
wherever they stand, and the consecutive windows of one anchor form a short
path; on average some sixteen windows are one row (anchor, 128-bit digest of
the path's words, document, start, length).  An anchor only says what to
compare: whether two paths or two windows are equal is always decided by the
digests of their words, taken from the text at their coordinates, so a weak
or colliding anchor costs time and changes nothing.  Then, in Spark:

1. Per anchor, partial aggregation gives the smallest and largest document
   and whether the paths' words differ (the digests' minima and maxima, so a
   hot anchor is six numbers per task, never a gathered group).
   Anchors of one document only cannot repeat across documents and end here.
2. Where all occurrences of an anchor spell the same path, the node does not
   branch: the whole path is compacted and belongs to the smallest document.
3. Where paths differ (at the borders of a passage, around an edit), the path
   is expanded to its windows, once for each different path, from the text at
   the source coordinates of the smallest document that has it; windows meet
   by the digests of their words, with the smallest document for each.
4. Back at the coordinates of every occurrence, adjoining ranges of repeated
   windows merge into spans, the words they cover go, and what stays is
   assembled from the text.

Rows carry digests and coordinates.  Only texts with a branching path
are shuffled, and all texts once more if the merged spans exceed a measured
broadcast bound.  A text beyond ``PIECE`` words is cut into pieces that overlap by
k - 1 words, which loses no window.

Cases: null and empty texts, and texts shorter than k words, lose nothing; a
null id neither loses words nor makes others lose any; rows that share an id
never make each other lose words (the smaller id must be another document);
repeats inside one document stay; an empty table stays empty; other columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged
from tessera.llm.tokens import Rolling, digests, encoded, word_hashes, word_spans

WINDOW = 50
ANCHOR = 20
PIECE = 1 << 20
#: Rows of a batch handed back to Spark at a time.
BATCH = 50_000
#: Largest lists that are broadcast: ids (16 bytes each) and merged spans.
BROADCAST_IDS = 2_000_000
BROADCAST_SPANS = 1_000_000
_ROW = ["doc_id", "text_hash"]


def _window_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys, in log(width) passes."""
    have, span = keys, 1
    while 2 * span <= width:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    rest = width - span
    return np.minimum(have[:len(have) - rest], have[rest:]) if rest else have


def _paths(h: np.ndarray, k: int, anchor: int):
    """Anchor hash, first window, window count and the anchor's place in the
    path, for every path of a piece of a text (word hashes ``h``)."""
    kmers = Rolling(h).windows(anchor)
    # the upper bits order k-mers, the lower ones make the leftmost win a tie
    keys = (kmers >> np.uint64(24) << np.uint64(24)) | np.arange(len(kmers), dtype=np.uint64)
    at = (_window_minimum(keys, k - anchor + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[first, len(at)])
    where = at[first]
    return kmers[where], first, count, where - first


def _emitted(rows, names):
    """Numpy blocks (one tuple of equally long arrays each) -> record batches."""
    held, n = [], 0
    for block in rows:
        held.append(block)
        n += len(block[0])
        if n >= BATCH:
            yield _batch(held, names)
            held, n = [], 0
    if held:
        yield _batch(held, names)


def _batch(held, names):
    columns = [np.concatenate(c) for c in zip(*held)]
    return pa.RecordBatch.from_arrays(
        [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=names)


def paths(docs: DataFrame, k: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """All paths of all documents (columns doc_id, text_hash, text)."""
    def rows(batch):
        for d, x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            data = encoded(t.as_py())
            h = word_hashes(data)
            if len(h) < k:
                continue
            plain, starts, ends = word_spans(data)
            for p in range(0, len(h) - k + 1, PIECE):
                a, first, count, place = _paths(h[p:p + PIECE + k - 1], k, anchor)
                first = first + p
                path = digests(plain, starts[first], ends[first + count + k - 2]).copy()
                path[0] ^= place.astype(np.uint64)      # where the anchor stands belongs to the path
                yield (a, *path, np.full(len(a), d, np.int64), np.full(len(a), x, np.int64),
                       first.astype(np.int32), count.astype(np.int32))

    def run(batches):
        for batch in batches:
            yield from _emitted(rows(batch), ["anchor", "path", "path2", "doc_id", "text_hash", "start", "windows"])
    return (docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text_hash", "text")
            .mapInArrow(run, "anchor long, path long, path2 long, doc_id long, text_hash long, start int, windows int"))


def _expanded(texts: DataFrame, k: int) -> DataFrame:
    """The windows of the listed paths ``ps`` of every text."""
    def rows(batch):
        for d, t, ps in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            plain, starts, ends = word_spans(encoded(t.as_py()))
            for p in ps.as_py():
                off = np.arange(p["windows"])
                at = off + p["start"]
                yield (*digests(plain, starts[at], ends[at + k - 1]), np.full(len(off), p["anchor"], np.int64),
                       np.full(len(off), p["path"], np.int64), np.full(len(off), p["path2"], np.int64), np.full(len(off), d, np.int64),
                       off.astype(np.int32))

    def run(batches):
        for batch in batches:
            yield from _emitted(rows(batch), ["window", "window2", "anchor", "path", "path2", "doc_id", "offset"])
    return texts.select("doc_id", "text", "ps").mapInArrow(
        run, "window long, window2 long, anchor long, path long, path2 long, doc_id long, offset int")


def repeated_ranges(docs: DataFrame, k: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text_hash, start, end): word ranges [start, end) of windows
    whose words also start in a smaller document; one range per path."""
    per_anchor = paths(docs, k, anchor).groupBy("anchor").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
        *[f(c).alias(f"{c}_{n}") for c in ("path", "path2") for n, f in (("min", F.min), ("max", F.max))])
    # written, so that the join below reads plain shuffles, which AQE can split at a hot anchor
    repeated = staged(per_anchor.where("low < high").select(
        "anchor", "low", F.expr("path_min != path_max OR path2_min != path2_max").alias("branches")), "dedup-anchors")
    seen = staged(paths(docs, k, anchor).join(repeated, "anchor"), "dedup-repeated")

    # nonbranching: the path as a whole comes from the smallest document
    whole = (seen.where("NOT branches AND low < doc_id")
             .select(*_ROW, "start", (F.col("start") + F.col("windows") + (k - 1)).alias("end")))

    # branching: every different path once, at its smallest document
    key, window = ["anchor", "path", "path2"], ["anchor", "window", "window2"]
    forks = (seen.where("branches").groupBy(*key)
             .agg(F.min(F.struct(*_ROW, "start", "windows")).alias("at")))
    wanted = staged(forks.groupBy("at.doc_id", "at.text_hash")
                    .agg(F.collect_list(F.struct(*key, "at.start", "at.windows")).alias("ps")), "dedup-forks")
    ids = wanted.select(*_ROW)
    texts = docs.where("text IS NOT NULL").select(*_ROW, "text")
    if wanted.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), _ROW, "left_semi")
    windows = staged(_expanded(texts.join(wanted, _ROW), k), "dedup-windows")
    source = staged(windows.groupBy(*window).agg(F.min("doc_id").alias("source")), "dedup-sources")
    per_path = staged(windows.drop("doc_id").join(source, window)
                      .groupBy(*key).agg(F.collect_set(F.struct("offset", "source")).alias("sources")), "dedup-resolved")
    # windows of a path are fewer than k apart, so theirs is one range
    earlier = F.transform(F.filter("sources", lambda s: s["source"] < F.col("doc_id")), lambda s: s["offset"])
    forked = (seen.where("branches").select(*key, *_ROW, "start").join(per_path, key)
              .select(*_ROW, "start", earlier.alias("o")).where("size(o) > 0")
              .select(*_ROW, (F.col("start") + F.array_min("o")).alias("start"),
                      (F.col("start") + F.array_max("o") + k).alias("end")))
    return whole.unionByName(forked)


def _clean(batches):
    """(doc_id, text, starts, ends) -> counts, hash and kept words."""
    for batch in batches:
        n_words, n_gone, digests, texts = [], [], [], []
        for t, s, e in zip(batch.column(1), batch.column(2), batch.column(3)):
            ws, s, e = encoded(t.as_py()).split(), s.as_py(), e.as_py()
            kept = ws
            if s:
                edge = np.zeros(len(ws) + 1, np.int64)
                np.add.at(edge, s, 1)
                np.add.at(edge, e, -1)
                kept = [ws[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            left = b" ".join(kept)
            n_words.append(len(ws))
            n_gone.append(len(ws) - len(kept))
            digests.append(hashlib.sha256(left).hexdigest())
            texts.append(left.decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(digests, pa.string()),
             pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "text"])


def _own(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = docs[f"`{text}`"]
    return docs.select(docs[f"`{key}`"].try_cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("text"))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text_hash, spans): per document the merged ranges [start, end)
    of words that repeat an earlier document."""
    found = (repeated_ranges(_own(docs, key, text), k, anchor)
             .groupBy(*_ROW).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("r")))
    # a range opens a span where no earlier range reaches it; a span ends where the next one opens
    reach = F.transform("r", lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.coalesce(
        F.get("r", i - 1)["end"] < x["start"], F.lit(True)).alias("opens")))
    merged = F.transform(F.filter(reach, lambda x: x["opens"]), lambda x: x["start"])
    ends = F.transform(F.filter(F.transform("r", lambda x, i: F.struct(x["end"].alias("end"), F.coalesce(
        F.get("r", i + 1)["start"] > x["end"], F.lit(True)).alias("last"))), lambda x: x["last"]), lambda x: x["end"])
    return found.select(*_ROW, F.arrays_zip(merged.alias("start"), ends.alias("end")).alias("spans"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and the
    text that stays (its words joined by single spaces)."""
    gone = staged(spans(docs, key, text, k, anchor), "dedup-spans")
    if (gone.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST_SPANS:
        gone = F.broadcast(gone)
    return (_own(docs, key, text).join(gone, _ROW, "left")
            .select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
            .mapInArrow(_clean, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"))
