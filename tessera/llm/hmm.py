"""Language-model scores from a hidden Markov model of words.

Training and scoring are Spark jobs over whole texts:

1. Words of the training texts are counted, all of them.  Those common enough
   that at most ``SYMBOLS`` words are as common have a symbol of their own;
   the cut is a count, found from a histogram, so no word is ranked.  All
   others share one symbol, and inside it every word has the probability
   (c + 1) / (n + v + 1) from its exact count c; their counts stay in a
   table, and the few such tokens meet it in a join.  What is broadcast is
   bounded by ``SYMBOLS`` words of ``SYMBOL_BYTES`` bytes; the counts are not.
2. Texts become arrays of symbols, written once.
3. Baum-Welch: every task runs the scaled forward-backward recursion over its
   texts, all of them to their ends, and hands on expected counts; Spark adds
   them per symbol; the driver normalises tables of ``SYMBOLS`` x states.
   Counts travel as whole numbers (units of 2^-20), so sums do not depend on
   the order of tasks.
4. The scaled forward recursion gives the log10 probability of a text: the
   product of its scale factors times its rare words' shares.

Words are split, counted and looked up by Arrow's kernels, without a Python
object a word.  Texts run side by side, sorted by length, one step for all,
and are scaled every few steps and at their ends; a long text is walked in
pieces whose first state distribution is kept, so memory stays
bounded and the recursion exact.  A text ends in one end symbol.

Cases: null and empty texts are the end symbol alone; words never seen in
training score as rare words of count 0; rows with a null key and repeated
rows each count and each have a score; without training texts every word is
rare and the states are the initial ones; an empty table gives an empty one;
other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged

SYMBOLS = 1 << 17
SYMBOL_BYTES = 64
STATES = 8
ROUNDS = 6
STAY = 0.9                  # first probability of staying in a state
#: Texts side by side, tokens of a piece, tokens whose expected counts are added at a time.
LANES, PIECE, GATHER = 4096, 1 << 17, 1 << 17
#: Steps between two scalings.  A step scales a distribution by no less than
#: the least emission, 0.02 / STATES of a token of the whole corpus: 8 steps
#: stay within the range of a double for any corpus below 10^35 tokens.
SCALED = 8
#: Tokens of the texts that a task walks together: the longest texts are few,
#: and each step of theirs costs as much as one of thousands of texts.
TOGETHER = 8 << 20
#: Bytes of text whose words are split at a time, and counted at a time.
SPLIT, HELD = 4 << 20, 16 << 20
_UNIT = float(1 << 20)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space of UTF-8 ``texts`` (bytes), A-Z
    lower-cased: those of all texts in one array, and how many each text has."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    # the kernels are for strings, but go byte by byte and do not decode
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words, sizes = lists.flatten().view(pa.binary()), lists.value_lengths().to_numpy().astype(np.int64)
    whole = pc.binary_length(words).to_numpy() > 0           # outer white space leaves empty strings
    if not whole.all():
        sizes -= np.bincount(lists.value_parent_indices().to_numpy()[~whole], minlength=len(sizes))
        words = words.filter(pa.array(whole))
    return words, sizes


def _slices(batch: pa.RecordBatch, size: int):
    """``batch`` in runs of rows whose first column has some ``size`` bytes."""
    run = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy().astype(np.int64)) // size
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def _let_go():
    """Free memory that Arrow keeps goes back, as the worker lives on."""
    pa.default_memory_pool().release_unused()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all words of ``texts`` (text), one row each."""
    def counted(parts):
        found = pc.value_counts(pa.chunked_array(parts, pa.binary()))
        return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "n"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for piece in _slices(batch, SPLIT):
                parts.append(tokens(piece.column(0))[0])
                held += parts[-1].nbytes
                if held >= HELD:
                    yield counted(parts)
                    parts, held = [], 0
        if held:
            yield counted(parts)
        _let_go()
    return texts.select(F.col("text").cast("binary")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Symbols and counts.  Symbol ``len(words)`` is any rare word, the next one the end."""
    words: list
    counts: np.ndarray          # of the symbols, rare words and the end included
    table: DataFrame            # (word, n) of all words
    rare_types: int

    @property
    def total(self) -> int:
        return int(self.counts.sum())

    @property
    def types(self) -> int:
        return len(self.words) + self.rare_types + int(self.counts[-1] > 0)


def lexicon(texts: DataFrame, symbols: int = SYMBOLS, symbol_bytes: int = SYMBOL_BYTES) -> Lexicon:
    """Counts of the training ``texts`` (text)."""
    table = staged(word_counts(texts), "hmm-counts")
    ends = texts.count()
    short = F.octet_length("word") <= symbol_bytes
    # an eighth of a doubling a bucket: some 500 rows at most
    grade = F.floor(8 * F.log2(F.col("n").cast("double")))
    found = table.groupBy(F.when(short, grade).alias("g")).agg(
        F.count(F.lit(1)).alias("types"), F.sum("n").alias("n"), F.min("n").alias("least")).collect()
    least, room = None, symbols
    for r in sorted((r for r in found if r["g"] is not None), key=lambda r: -r["g"]):
        if r["types"] > room:
            break
        least, room = r["least"], room - r["types"]
    kept = [] if least is None else table.where(short & (F.col("n") >= least)).orderBy(F.desc("n"), "word").collect()
    words = [bytes(r["word"]) for r in kept]
    own = [r["n"] for r in kept]
    rare = sum(r["n"] for r in found) - sum(own)
    return Lexicon(words, np.array(own + [rare, ends], np.int64), table, sum(r["types"] for r in found) - len(words))


def encoded_texts(docs: DataFrame, known: Lexicon) -> DataFrame:
    """``docs`` (text and further columns) with text replaced by symbols:
    row, symbols, n_known and base of the common words, and rare (word, n)."""
    held = docs.sparkSession.sparkContext.broadcast((known.words, known.counts))
    total, types = known.total, known.types
    others = [c for c in docs.columns if c != "text"]

    def counted(words, sizes):
        """List array of the distinct (word, n) of each text."""
        coded = words.dictionary_encode()
        types = max(1, len(coded.dictionary))
        both, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * types + coded.indices.to_numpy(), return_counts=True)
        ends = np.cumsum(np.bincount(both // types, minlength=len(sizes)))
        pairs = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(both % types)), pa.array(n)], names=["word", "n"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pairs)

    def run(batches):
        words, counts = held.value
        rare = len(words)
        own = pa.array(words, pa.binary())
        share = np.log10((counts + 1) / (total + types + 1))
        share[rare] = 0.0
        for batch in batches:
            for piece in _slices(batch, SPLIT):
                ws, sizes = tokens(piece.column(0))
                found = pc.index_in(ws, value_set=own)
                ends = np.cumsum(sizes + 1)
                starts = ends - sizes - 1
                symbols = np.full(int(ends[-1]), rare + 1, np.int32)
                word = np.ones(len(symbols), bool)
                word[ends - 1] = False
                symbols[word] = pc.fill_null(found, rare).to_numpy()
                odd = np.add.reduceat(symbols == rare, starts, dtype=np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(symbols))
                yield pa.RecordBatch.from_arrays(
                    [flat, pa.array(sizes + 1 - odd - int(counts[-1] == 0)), pa.array(np.add.reduceat(share[symbols], starts)),
                     counted(ws.filter(found.is_null()), odd)] + piece.columns[1:],
                    names=["symbols", "n_known", "base", "rare"] + others)
        _let_go()
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    out = docs.select(F.col("text").cast("binary"), *others).mapInArrow(
        run, "symbols array<int>, n_known long, base double, rare array<struct<word: binary, n: bigint>>" + kinds)
    return staged(out.withColumn("row", F.monotonically_increasing_id()), "hmm-symbols")


@dataclass
class Model:
    start: np.ndarray           # (state)
    step: np.ndarray            # (state, next state)
    emit: np.ndarray            # (symbol, state): probability of the symbol in the state


def first_model(counts: np.ndarray, states: int = STATES, seed: int = 42) -> Model:
    """States that differ at random around the words' shares, and tend to stay."""
    rng = np.random.default_rng(seed)
    emit = (counts[:, None] + 1 / states) * rng.uniform(0.2, 1.8, (len(counts), states))
    step = np.full((states, states), (1 - STAY) / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    np.fill_diagonal(step, STAY if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), step, emit / emit.sum(axis=0))


# ---- recursions over texts side by side ----------------------------------

def _side_by_side(flat: np.ndarray, sizes: np.ndarray):
    """Groups of up to ``LANES`` texts, longest first: (places, first token, length)."""
    first = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    for i in range(0, len(order), LANES):
        at = order[i:i + LANES]
        yield at, first[at], sizes[at]


def _active(sizes: np.ndarray) -> np.ndarray:
    """Number of texts that have a token at each step (sizes fall)."""
    return np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")


def _pieces(active: np.ndarray) -> list[int]:
    """Steps at which a group of texts is cut: pieces of ``PIECE`` tokens or a
    little more, so most groups are one piece."""
    piece = (np.cumsum(active) - 1) // PIECE
    return [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(active)]


def _forward(model: Model, flat, first, active, t0, t1, entry, log=None, keep=None):
    """Steps t0..t1 from the state distribution ``entry`` (None: the start).
    Every ``SCALED`` steps, and where a text ends, distributions are scaled to
    a sum of one; adds the logs of the scale factors to ``log``, keeps
    (symbols, emission, alpha, scale of the last lanes) in ``keep``."""
    now, ones = entry, np.ones(len(model.start))
    for t in range(t0, t1):
        n = active[t]
        x = flat.take(first[:n] + t)
        e = model.emit.take(x, axis=0)
        now = (model.start if now is None else now[:n] @ model.step) * e
        # lanes from here on are scaled: all of them, or those whose text ends
        lane = 0 if (t + 1) % SCALED == 0 else active[t + 1] if t + 1 < len(active) else 0
        scale = None
        if lane < n:
            scale = now[lane:] @ ones                    # far quicker than a sum over short rows
            now[lane:] /= scale[:, None]
            if log is not None:
                log[lane:n] += np.log(scale)
        if keep is not None:
            keep.append((x, e, now, scale))
    return now


def log_probabilities(model: Model, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log of the probability of every text (scaled forward recursion)."""
    out = np.zeros(len(sizes))
    for at, first, size in _side_by_side(flat, sizes):
        log = np.zeros(len(at))
        _forward(model, flat, first, _active(size), 0, int(size[0]), None, log)
        out[at] = log
    return out


class Expected:
    """Expected counts under a model, added text by text."""

    def __init__(self, model: Model):
        self.model = model
        self.start = np.zeros_like(model.start)
        self.step = np.zeros_like(model.step)
        self._emit = np.zeros(model.emit.shape[::-1])    # state by state, as the shares are summed
        self.log = 0.0
        self.symbols, self.shares, self.held = None, None, 0

    @property
    def emit(self) -> np.ndarray:
        return self._emit.T

    def add(self, flat: np.ndarray, sizes: np.ndarray):
        for _, first, size in _side_by_side(flat, sizes):
            self._group(flat, first, _active(size), len(size))
        self._gather()

    def _group(self, flat, first, active, lanes):
        model, back = self.model, np.ascontiguousarray(self.model.step.T)
        entries, log, cuts = [None], np.zeros(lanes), _pieces(active)
        for a, b in zip(cuts[:-2], cuts[1:]):            # the distribution before each piece
            entries.append(_forward(model, flat, first, active, a, b, entries[-1], None))
        ahead = None                                     # emission x beta / scale of the next step
        for p in range(len(entries) - 1, -1, -1):
            a, kept = cuts[p], []
            _forward(model, flat, first, active, a, cuts[p + 1], entries[p], log, kept)
            for t in range(cuts[p + 1] - 1, a - 1, -1):
                x, e, alpha, scale = kept.pop()          # not needed again: changed in place
                if ahead is not None:
                    m = len(ahead)
                    beta = ahead @ back
                    self.step += alpha[:m].T @ ahead
                    alpha[:m] *= beta                    # a text's last alpha is its share as it is
                    e[:m] *= beta
                if scale is not None:
                    e[len(e) - len(scale):] /= scale[:, None]
                ahead = e
                self._share(x, alpha)
                if t == 0:
                    self.start += alpha.sum(axis=0)
        self.log += float(log.sum())

    def _share(self, x, share):
        """Holds the state shares of symbols, state by state, until there are
        enough of them for a sum."""
        if self.symbols is None or self.held + len(x) > len(self.symbols):
            self._gather()
            size = max(GATHER, len(x))
            if self.symbols is None or len(self.symbols) < size:
                self.symbols, self.shares = np.empty(size, np.int64), np.empty((share.shape[1], size))
        to = self.held + len(x)
        self.symbols[self.held:to] = x
        self.shares[:, self.held:to] = share.T
        self.held = to

    def _gather(self):
        if self.held:
            x = self.symbols[:self.held]
            for k, share in enumerate(self.shares):
                self._emit[k] += np.bincount(x, weights=share[:self.held], minlength=self._emit.shape[1])
        self.held = 0

    def rows(self):
        """(slot, state counts): symbols, then steps, start and log in negative slots."""
        seen = np.flatnonzero(self.emit.sum(axis=1))
        k = len(self.start)
        slots = np.concatenate([seen, -1 - np.arange(k), [-1 - k, -2 - k]])
        log = np.zeros((1, k))
        log[0, 0] = self.log
        return slots, np.concatenate([self.emit[seen], self.step * self.model.step, self.start[None], log])


def _arrays(column):
    return column.flatten().to_numpy(), column.value_lengths().to_numpy().astype(np.int64)


def expected_counts(texts: DataFrame, model: Model):
    """Sums over all ``texts`` (symbols): (start, step, emit, log probability)."""
    held = texts.sparkSession.sparkContext.broadcast(model)
    k = len(model.start)

    def run(batches):
        sums, waiting, tokens_waiting = Expected(held.value), [], 0

        def joined():
            """What waits, as one; the batches it came in are let go."""
            out = [np.concatenate(a) for a in zip(*waiting)]
            waiting.clear()
            return out
        for batch in batches:
            waiting.append(_arrays(batch.column(0)))
            tokens_waiting += len(waiting[-1][0])
            del batch
            if tokens_waiting >= TOGETHER:
                sums.add(*joined())
                tokens_waiting = 0
        if tokens_waiting:
            sums.add(*joined())
        slots, counts = sums.rows()
        whole = np.rint(counts * _UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(slots)] + [pa.array(np.ascontiguousarray(whole[:, j])) for j in range(k)],
                                         names=["slot"] + [f"s{j}" for j in range(k)])
        _let_go()
    parts = texts.select("symbols").mapInArrow(run, "slot long, " + ", ".join(f"s{j} long" for j in range(k)))
    got = parts.groupBy("slot").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)]).toArrow()
    held.destroy()
    slots = got["slot"].to_numpy()
    counts = np.stack([got[f"s{j}"].to_numpy() for j in range(k)], axis=1) / _UNIT
    emit, special = np.zeros_like(model.emit), np.zeros((k + 2, k))
    emit[slots[slots >= 0]] = counts[slots >= 0]
    special[-1 - slots[slots < 0]] = counts[slots < 0]
    return special[k], special[:k], emit, special[k + 1, 0]


def reestimated(start, step, emit) -> Model:
    """Shares from expected counts.  Every state keeps a little of every
    symbol, and one unseen word's worth of the rare ones."""
    k = len(start)
    emit = emit + 0.02 / k
    emit[-2] += 1 / k
    step, start = step + 0.1, start + 0.1
    return Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def baum_welch(texts: DataFrame, known: Lexicon, states: int = STATES, rounds: int = ROUNDS, seed: int = 42):
    """The model after ``rounds`` passes over all ``texts`` (symbols), and the
    texts' log probability before each pass."""
    model, logs = first_model(known.counts, states, seed), []
    if known.counts[-1]:
        # splits of some TOGETHER tokens each, and enough of them for every core
        tasks = max(texts.sparkSession.sparkContext.defaultParallelism, -(-known.total // TOGETHER))
        texts = texts.coalesce(tasks)
        for _ in range(rounds):
            start, step, emit, log = expected_counts(texts, model)
            logs.append(log)
            model = reestimated(start, step, emit)
    return model, logs


def scored(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", states: int = STATES,
           rounds: int = ROUNDS, symbols: int = SYMBOLS) -> DataFrame:
    """Per row of ``docs``: doc_id, train, n_tokens, n_known, train_tokens,
    base_score (add-one word frequencies) and score (the model), both log10,
    learned from the rows where ``train`` is true."""
    own = docs.select(docs[f"`{text}`"].alias("text"), docs[f"`{key}`"].alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"))
    known = lexicon(own.where("train"), symbols)
    texts = encoded_texts(own, known)
    model, _ = baum_welch(texts.where("train"), known, states, rounds)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            logs = log_probabilities(held.value, *_arrays(batch.column(1))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).value_lengths().cast(pa.int64()), pa.array(logs / math.log(10))]
                                             + batch.columns[2:], names=["row", "n_tokens", "log10", "doc_id", "train", "n_known", "base"])
    key_type = texts.schema["doc_id"].dataType.simpleString()
    forward = texts.select("row", "symbols", "doc_id", "train", "n_known", "base").mapInArrow(
        run, f"row long, n_tokens long, log10 double, doc_id {key_type}, train boolean, n_known long, base double")

    total, types = known.total, known.types
    rare_total = int(known.counts[-2]) + known.rare_types + 1
    c = F.coalesce("c", F.lit(0))
    rare = (texts.where("size(rare) > 0").select("row", F.inline("rare")).withColumnRenamed("n", "times")
            .join(known.table.select("word", F.col("n").alias("c")), "word", "left").groupBy("row")
            .agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more"),
                 F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(total + types + 1)))).alias("rare_base"),
                 F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(rare_total)))).alias("rare_log")))
    out = forward.join(rare, "row", "left")
    return out.select("doc_id", "train", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                      F.lit(total).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
                      (F.col("log10") + F.coalesce("rare_log", F.lit(0.0))).alias("score"))
