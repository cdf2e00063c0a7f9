"""Secret scan: fixed patterns plus two character Markov models.

Random strings (keys, tokens, hashes) and ordinary identifiers follow
different letter-to-letter statistics.  Both models are first-order Markov
chains over one alphabet, trained from labelled samples: strings known to be
random (the values that the fixed patterns find, and any others the caller
has) against the remaining text.  Training counts letter pairs inside Arrow
batches and adds the two 69 x 69 tables up with Spark, so all text counts and
what reaches the driver has a fixed size.  A candidate, a long run of key
characters outside the pattern spans, is reported when its log-likelihood
ratio per character exceeds the threshold.

Offsets are code points, end exclusive.  Cases: a null text is empty; texts
without samples train on the smoothing alone (a uniform random model); very
long runs are scored whole; spans of the fixed patterns are never changed, a
candidate that touches one is not reported again; repeated rows give equal
results; a null id passes through; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MIN_VALUE = 6                       # characters of an assigned value

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 2            # 0: any other character, last: the border of a string
_CODE = np.zeros(256, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)
#: The random model adds this to every pair's count, as if it had also seen
#: uniform strings; the ordinary model adds so many pairs spread by the plain
#: frequency of the second character (plus one each).
SMOOTH_RANDOM, SMOOTH_ORDINARY = 20.0, 50.0
THRESHOLD = 2.0                     # nats a character


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted.  A short value ends
    its match all the same: what it covers is not searched again."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def base_values(text: str) -> list[str]:
    """The random strings themselves: values, not the names before them."""
    found = [m[2] for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE] if "=" in text or ":" in text else []
    return found + [m[0] for p in (_ACCESS, _HEX) for m in p.finditer(text)]


def _classes(text: str) -> np.ndarray:
    """The models' class of every character (byte): its place in the alphabet from 1, or 0."""
    return _CODE[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]


def pair_counts(texts) -> np.ndarray:
    """SIZE x SIZE counts of neighbouring characters, borders included."""
    total = np.zeros(SIZE * SIZE, np.int64)
    for t in texts:
        c = np.concatenate([[SIZE - 1], _classes(t), [SIZE - 1]])
        total += np.bincount(c[:-1] * SIZE + c[1:], minlength=SIZE * SIZE)
    return total.reshape(SIZE, SIZE)


def _counted(batches):
    """Pair counts of a task: of the sample strings, and of the rest."""
    both = np.zeros((2, SIZE * SIZE), np.int64)
    for batch in batches:
        for t, given in zip(batch.column(0), batch.column(1)):
            text = t.as_py() or ""
            own = base_values(text) if given.as_py() is None else ([text] if given.as_py() else [])
            values = pair_counts(own).ravel()
            both[1] += values
            both[0] += pair_counts([text]).ravel() - (values if given.as_py() is None else 0) if not given.as_py() else 0
    for label in (0, 1):
        pairs = np.flatnonzero(both[label])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(pairs), label, np.int32)), pa.array(pairs.astype(np.int32)), pa.array(both[label][pairs])],
            names=["label", "pair", "n"])


def trained(texts: DataFrame, text: str = "text", label: str | None = None) -> np.ndarray:
    """Log-likelihood ratio (random against ordinary) of every pair of
    characters.  ``label`` names a column: 1 for samples that are random as a
    whole, 0 for ordinary ones, null (or no such column) for texts whose
    pattern matches are the random samples."""
    given = F.lit(None).cast("int") if label is None else texts[f"`{label}`"].cast("int")
    counts = (texts.select(texts[f"`{text}`"].alias("t"), given.alias("l"))
              .mapInArrow(_counted, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")))
    table = np.zeros((2, SIZE * SIZE))
    for r in counts.collect():                  # at most 2 x 69 x 69 rows
        table[r["label"], r["pair"]] = max(0, r["n"])
    inner = slice(1, SIZE - 1)                  # candidates have alphabet characters only
    ordinary, random = table.reshape(2, SIZE, SIZE)[:, inner, inner]
    plain = ordinary.sum(axis=0) + 1
    ordinary = ordinary + SMOOTH_ORDINARY * plain / plain.sum()
    random = random + SMOOTH_RANDOM
    return np.log(random / random.sum(axis=1, keepdims=True)) - np.log(ordinary / ordinary.sum(axis=1, keepdims=True))


def likelihood_ratio(run: str, model: np.ndarray) -> float:
    """Mean log-likelihood ratio of a run of alphabet characters."""
    c = _classes(run) - 1
    return float(model[c[:-1], c[1:]].mean())


def markov_spans(text: str, base, model: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """Runs whose ratio exceeds ``threshold`` and that touch no base span:
    both lists are walked once, side by side."""
    out, taken, at = [], [], 0
    for start, _, end in sorted(base):                   # base spans of different kinds may overlap
        if taken and start < taken[-1][1]:
            taken[-1][1] = max(end, taken[-1][1])
        else:
            taken.append([start, end])
    for m in _RUN.finditer(text):
        s, e = m.span()
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if at < len(taken) and taken[at][0] < e:
            continue
        if likelihood_ratio(m[0], model) > threshold:
            out.append((s, 3, e))
    return out


def _listed(found) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scanned(docs: DataFrame, model: np.ndarray, key: str = "doc_id", text: str = "text",
            threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, n_markov, spans."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "n_markov", "spans"]

    def run(batches):
        for batch in batches:
            counts, digests, spans = [], [], []
            for t in batch.column(1):
                t = t.as_py() or ""
                base = base_spans(t)
                more = markov_spans(t, base, model, threshold)
                kinds = [k for _, k, _ in base]
                counts.append([kinds.count(0), kinds.count(1), kinds.count(2), len(more)])
                digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                spans.append(_listed(sorted(base + more)))
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(n[:, i]) for i in range(3)], pa.array(digests, pa.string()), pa.array(n[:, 3]),
                 pa.array(spans, pa.string())], names=names)
    return docs.select(docs[f"`{key}`"].try_cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, n_markov long, spans string")
