"""Spelling variants: the words of a vocabulary that one edit turns into a
much commoner one, and the word at the end of that chain.

1. The runs of letters of whole texts are counted, in each task first.
2. The vocabulary becomes split-block Bloom filters, one for each word length:
   every word sets eight bits of one 32-byte block, and Spark ORs the blocks.
   All filters together take ``BLOOM_BYTES`` at most, whatever the vocabulary:
   beyond that they hold fewer bits a word and let more wrong edits through,
   which changes the cost and never the result.
3. Every word's deletions and replacements are generated as hashes (a word's
   hash is the XOR of one number for each place and letter, so an edit costs
   two XORs) and probed against the filter of the edit's length.  Insertions
   are the deletions read backwards, and a replacement is tried from the
   smaller letter only, so each pair is met once.
4. Only positive edits are spelled out and shuffled to an exact join with the
   vocabulary, which removes the false ones.
5. Forms are followed to the last by pointer doubling: a form is at least
   twice as common as its word, so a chain has at most log2(largest count)
   steps and the doubling some six rounds.

Nothing but the filter, bounded as said, is collected or broadcast.

Cases: null and empty texts have no words; a null id has no damage (see
``word_counts``); repeated rows count each time; of words equally common the
smallest in code-point order is the form; words of any length go the same way
(an edit is spelled out only if it is positive); a letter outside
``ALPHABET`` never stands in a word; an empty table gives an empty one; other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import UPPER, staged
from tessera.llm.tokens import mix

#: Letters of words: a run is what stands between other characters.
RUN = "[A-Za-zÀ-ÿ]+"
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
MIN_CHARS, MIN_COUNT = 5, 3
BLOOM_BYTES = 32 << 20
BITS_PER_WORD = 16
#: Entries of a task's table of counts, and cells of a block of edits.
HELD, CELLS = 300_000, 1 << 20
_LOW = str.maketrans(UPPER, UPPER.lower())


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                min_count: int = MIN_COUNT, damage: int | None = None) -> DataFrame:
    """(word, n) of the words of ``min_chars`` letters and ``min_count``
    occurrences or more; only A-Z are lower-cased.  ``damage`` plants typing
    errors: where it divides the crc32 of ``<key>:<run>``, the run loses the
    letter at that number modulo its length (rows with a null key keep all)."""
    def run(batches):
        find, counts, low = re.compile(RUN).findall, {}, {}

        def flushed():
            whole = {w: n for w, n in counts.items() if len(w) >= min_chars}
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(whole.keys(), pa.string()), pa.array(whole.values(), pa.int64())],
                                              names=["word", "n"])
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = None if k is None or not damage else crc32(f"{k}:".encode())
                for raw, n in Counter(find(t.as_py() or "")).items():
                    have = low.get(raw)
                    if have is None:
                        if len(low) >= HELD:
                            low.clear()
                        w = raw.translate(_LOW)
                        have = low[raw] = w, w.encode()
                    w, data = have
                    if start is not None:
                        h = crc32(data, start)
                        if h % damage == 0:
                            w = w[:h % len(w)] + w[h % len(w) + 1:]
                    counts[w] = counts.get(w, 0) + n
                if len(counts) >= HELD:
                    yield flushed()
        if counts:
            yield flushed()
    own = docs.select(docs[f"`{key}`"].cast("string").alias("key"), docs[f"`{text}`"].alias("text")).where("text IS NOT NULL")
    return own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---- Bloom filters -------------------------------------------------------

_LANES = 8
#: One odd 32-bit multiplier for each lane of a block.
_SALT = (mix(np.arange(1, _LANES + 1, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)) | np.uint64(1)
_LONG = 64                  # lengths beyond share a filter with similar ones


def shard(length):
    """Filter of a word length: its own up to 64, 16 for each doubling beyond."""
    length = np.asarray(length)
    return np.where(length <= _LONG, length, _LONG + np.floor(16 * np.log2(np.maximum(length, 1) / _LONG)).astype(np.int64) + 1)


def spot(place, letter) -> np.ndarray:
    """The number that ``letter`` adds to a word's hash at ``place``."""
    return mix((np.asarray(place, np.uint64) << np.uint64(21) | np.asarray(letter, np.uint64)) + np.uint64(1))


class Blocks:
    """Where the filter of each length lies: shard -> (first block, blocks)."""

    def __init__(self, sizes: dict[int, int], most: int = BLOOM_BYTES, bits: int = BITS_PER_WORD):
        want = {s: n * bits / 256 for s, n in sizes.items()}
        room = max(1, most // 32 - len(want))
        share = min(1.0, room / max(1.0, sum(want.values())))
        self.at, self.total = {}, 0
        for s in sorted(want):
            n = 1 + int(want[s] * share)
            self.at[s] = (self.total, n)
            self.total += n

    def of(self, length: int):
        return self.at.get(int(shard(length)))


def _bits(h: np.ndarray, lane: int) -> np.ndarray:
    return np.uint32(1) << (((h & np.uint64(0xFFFFFFFF)) * _SALT[lane] & np.uint64(0xFFFFFFFF)) >> np.uint64(27)).astype(np.uint32)


def _block(h: np.ndarray, at: tuple[int, int]) -> np.ndarray:
    return at[0] + ((h >> np.uint64(32)) * np.uint64(at[1]) >> np.uint64(32)).astype(np.int64)


def letters(ws: list[str]) -> np.ndarray:
    """Code points of equally long words, one row each."""
    return np.frombuffer("".join(ws).encode("utf-32-le"), np.uint32).reshape(len(ws), -1)


def _hash(codes: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(spot(np.arange(codes.shape[1]), codes), axis=1)


def _by_length(ws: list[str]):
    """(length, places of up to ``CELLS`` letters of words of that length)."""
    n = np.fromiter(map(len, ws), np.int64, len(ws))
    for length in np.unique(n):
        at = np.flatnonzero(n == length)
        step = max(1, CELLS // (int(length) * 64))
        for i in range(0, len(at), step):
            yield int(length), at[i:i + step]


def bloom(vocabulary: DataFrame, most: int = BLOOM_BYTES) -> tuple[Blocks, np.ndarray]:
    """The filters of all lengths as one table of blocks (rows of 8 x 32 bits)."""
    sizes = vocabulary.groupBy(F.char_length("word").alias("l")).agg(F.count(F.lit(1)).alias("n"))
    sized: dict[int, int] = {}
    for row in _shards(sizes).collect():
        sized[row["s"]] = row["n"]
    blocks = Blocks(sized, most)

    def run(batches):
        for batch in batches:
            ws = batch.column(0).to_pylist()
            for length, at in _by_length(ws):
                h = _hash(letters([ws[i] for i in at]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_block(h, blocks.of(length)))] + [pa.array(_bits(h, j).view(np.int32)) for j in range(_LANES)],
                    names=["block"] + [f"b{j}" for j in range(_LANES)])
    rows = vocabulary.select("word").mapInArrow(run, "block long, " + ", ".join(f"b{j} int" for j in range(_LANES)))
    rows = rows.groupBy("block").agg(*[F.bit_or(f"b{j}").alias(f"b{j}") for j in range(_LANES)]).toArrow()
    table = np.zeros((blocks.total, _LANES), np.uint32)
    for j in range(_LANES):
        table[rows["block"].to_numpy(), j] = rows[f"b{j}"].to_numpy().view(np.uint32)
    return blocks, table


def _shards(sizes: DataFrame) -> DataFrame:
    """Word counts by shard: some hundreds of rows, however long words get."""
    def run(batches):
        for batch in batches:
            s = shard(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int64)), batch.column(1)], names=["s", "n"])
    return sizes.mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))


def _inside(h: np.ndarray, at, table: np.ndarray) -> np.ndarray:
    """Flat places of the hashes that the filter holds; each lane is read for
    what the lanes before let through."""
    h = h.ravel()
    left = np.arange(h.size)
    block = _block(h, at)
    for lane in range(_LANES):
        bit = _bits(h[left], lane)
        left = left[(table[block[left], lane] & bit) != 0]
        if not len(left):
            break
    return left


def _positives(codes: np.ndarray, alphabet: np.ndarray, blocks: Blocks, table: np.ndarray):
    """(row, place, letter or -1) of every edit of ``codes`` that the filters
    may hold: replacements by a larger letter, deletions of a run's first."""
    n, length = codes.shape
    whole = _hash(codes)
    same, shorter = blocks.of(length), blocks.of(length - 1)
    if same:
        for i in range(length):
            bare = whole ^ spot(i, codes[:, i])
            hit = _inside(bare[:, None] ^ spot(i, alphabet)[None, :], same, table)
            row, letter = hit // len(alphabet), alphabet[hit % len(alphabet)]
            up = letter > codes[row, i]
            yield row[up], np.full(int(up.sum()), i), letter[up].astype(np.int64)
    if shorter:
        place = np.arange(length)
        before = np.zeros((n, length), np.uint64)
        before[:, 1:] = np.bitwise_xor.accumulate(spot(place, codes), axis=1)[:, :-1]
        after = np.zeros((n, length), np.uint64)
        moved = spot(place[:-1], codes[:, 1:])       # what stands behind moves one place forward
        after[:, :-1] = np.bitwise_xor.accumulate(moved[:, ::-1], axis=1)[:, ::-1]
        hit = _inside(before ^ after, shorter, table)
        row, i = hit // length, hit % length
        first = (i == 0) | (codes[row, i] != codes[row, np.maximum(i - 1, 0)])
        yield row[first], i[first], np.full(int(first.sum()), -1)


def near_pairs(vocabulary: DataFrame, alphabet: str = ALPHABET, most: int = BLOOM_BYTES) -> DataFrame:
    """(word, n, near, near_n): each two words of ``vocabulary`` (word, n) that
    differ by one edit, once."""
    blocks, table = bloom(vocabulary, most)
    held = vocabulary.sparkSession.sparkContext.broadcast((blocks, table))
    chars = np.array(sorted(map(ord, alphabet)), np.uint32)

    def run(batches):
        blocks, table = held.value
        for batch in batches:
            ws, ns = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for length, at in _by_length(ws):
                codes = letters([ws[i] for i in at])
                out, n, edits = [], [], []
                for rows, places, new in _positives(codes, chars, blocks, table):
                    for r, i, c in zip(rows.tolist(), places.tolist(), new.tolist()):
                        w = ws[at[r]]
                        out.append(w)
                        n.append(ns[at[r]])
                        edits.append(w[:i] + (chr(c) if c >= 0 else "") + w[i + 1:])
                    if len(out) >= 1000 or sum(map(len, edits[-50:])) > CELLS:
                        yield _edits(out, n, edits)
                        out, n, edits = [], [], []
                if out:
                    yield _edits(out, n, edits)
    found = vocabulary.select("word", "n").mapInArrow(run, "word string, n long, near string")
    return found.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")


def _edits(words, n, edits):
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64()), pa.array(edits, pa.string())],
                                      names=["word", "n", "near"])


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of ``forms`` (word, form)."""
    now = staged(forms.select("word", F.col("form").alias("root")), "spelling-root")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(now.join(step, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-root")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def grouped(vocabulary: DataFrame, ratio: int = 2, alphabet: str = ALPHABET, most: int = BLOOM_BYTES) -> DataFrame:
    """Per word of ``vocabulary`` (word, n): form, root, n_near, form_n.  The
    form is the commonest near word, if ``ratio`` times as common as the word."""
    pairs = near_pairs(vocabulary, alphabet, most)
    ways = F.inline(F.array(F.struct("word", "n", "near", "near_n"),
                            F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"),
                                     F.col("word").alias("near"), F.col("n").alias("near_n"))))
    best = (pairs.select(ways).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("top")))
    enough = -F.col("top.m") >= ratio * F.col("n")
    linked = staged(vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("top.near")).alias("form"), F.when(enough, -F.col("top.m")).alias("form_n")), "spelling-forms")
    roots = _roots(linked.where("form IS NOT NULL"))
    return linked.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = 2, **how) -> DataFrame:
    """Spelling variants of the words of ``docs``: ``grouped`` over ``word_counts``."""
    return grouped(staged(word_counts(docs, key, text, **how), "spelling-words"), ratio)
