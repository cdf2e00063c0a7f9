"""Word hashes and rolling fingerprints of word sequences, as numpy arrays
inside Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the two rolling hashes, and their inverses modulo 2^64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_powers: dict[tuple[int, bool], np.ndarray] = {}
def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(which: int, inverse: bool, n: int) -> np.ndarray:
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        base = (_INVERSES if inverse else _BASES)[which]
        steps = np.full(size, np.uint64(base), np.uint64)
        steps[0] = 1
        have = _powers[which, inverse] = np.multiply.accumulate(steps)
    return have[:n]


class Rolling:
    """Fingerprints of any spans of a sequence of 64-bit numbers; equal spans
    have equal fingerprints wherever they stand.  ``which`` picks one of two
    independent fingerprints; together they have 128 bits."""

    def __init__(self, h: np.ndarray, which: int = 0):
        h = mix(h ^ np.uint64(0x2545F4914F6CDD1D)) if which else h
        self.which, self.n = which, len(h)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * _power(which, False, len(h)), out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _power(self.which, True, self.n + 1)[start]
                   + (end - start).astype(np.uint64))

    def windows(self, k: int) -> np.ndarray:
        at = np.arange(max(0, self.n - k + 1))
        return self.spans(at, at + k)


#: Bytes of a text that are split at a time, and of known words held.
BLOCK, HELD_BYTES = 1 << 20, 64 << 20


def encoded(text: str | None) -> bytes:
    """UTF-8; lone surrogates survive."""
    return (text or "").encode("utf-8", "surrogatepass")


def _blocks(data: bytes):
    """``data`` in blocks that end behind a whole word."""
    at = 0
    while at < len(data):
        end = at + BLOCK
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end]
        at = end


def word_digest(word: bytes) -> bytes:
    """128 bits of a word, hashed as a whole."""
    return xxhash.xxh3_128_digest(word, seed=0x5EED)


class _Known(dict):
    """Word -> place of its two 64-bit hashes, which are made when a word is
    first met."""

    def __init__(self):
        self.hashes, self.fresh, self.bytes = np.empty((2, 1 << 12), np.uint64), [], 0

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        self.fresh.append(word_digest(word))
        self.bytes += len(word) + 100
        return place

    def settled(self) -> np.ndarray:
        """The hashes of all places."""
        if self.fresh:
            new = np.frombuffer(b"".join(self.fresh), np.uint64).reshape(-1, 2).T
            while self.hashes.shape[1] < len(self):
                self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)], axis=1)
            self.hashes[:, len(self) - len(self.fresh):len(self)] = new
            self.fresh = []
        return self.hashes


_known = [_Known()]


def word_hashes(data: bytes, both: bool = False):
    """64-bit hashes of the words between ASCII white space (``both``: and
    second, independent ones).  A word is hashed as a whole, so no two words
    of related spelling are likelier to be equal than any others."""
    parts = [[np.empty(0, np.uint64)], [np.empty(0, np.uint64)]]
    for block in _blocks(data):
        if _known[0].bytes > HELD_BYTES:
            _known[0] = _Known()
        ws = block.split()
        at = np.fromiter(map(_known[0].__getitem__, ws), np.int64, len(ws))
        for out, row in zip(parts[:1 + both], _known[0].settled()):
            out.append(row.take(at))
    first, second = (p[-1] if len(p) == 2 else np.concatenate(p) for p in parts)
    return (first, second) if both else first


def word_spans(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of ``data`` joined by single spaces, and where each starts
    and ends in that."""
    plain = b" ".join(data.split())
    gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
    if not plain:
        return plain, gaps, gaps
    return plain, np.r_[0, gaps + 1], np.r_[gaps, len(plain)]


def digests(plain: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(2, n) numbers: 128 bits of each span [start, end) of bytes."""
    view = memoryview(plain)
    joined = b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())])
    return np.frombuffer(joined, np.uint64).reshape(-1, 2).T
