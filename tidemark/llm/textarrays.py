"""Batches of texts as flat code-point arrays, with constant-time span hashes.

A batch is one ``uint32`` array of all code points plus offsets.  Prefix sums of
``mixed(code point) * B**i`` modulo 2**64 give the 64-bit fingerprint of any
span with two look-ups, so k-grams, words and word sequences of millions of
characters are hashed without a Python loop.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _symbol_codes() -> np.ndarray:
    return mix(np.arange(sys.maxunicode + 1, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))


@lru_cache(maxsize=1)
def letters_and_digits() -> np.ndarray:
    """For every code point, whether its category is L or N."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, np.uint64(base), dtype=np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


class TextBatch:
    """Code points of a list of texts (null counts as empty)."""

    def __init__(self, texts: list[str | None]):
        texts = [t or "" for t in texts]
        self.n = len(texts)
        self.lengths = np.fromiter(map(len, texts), np.int64, self.n)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self._prefix: np.ndarray | None = None

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            terms = _symbol_codes()[self.cp]
            terms *= _powers(_BASE, len(terms))
            self._prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        return self._prefix

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit fingerprints of the spans [start, end) of the flat array."""
        p = self.prefix
        return mix((p[end] - p[start]) * _powers(_INVERSE, len(self.cp) + 1)[start] + (end - start).astype(np.uint64))

    def gram_hash(self, k: int) -> np.ndarray:
        """Fingerprints of all k-grams of the flat array, those across texts included."""
        p, n = self.prefix, len(self.cp) - k + 1
        return mix((p[k:] - p[:-k]) * _powers(_INVERSE, max(n, 1))[: max(n, 0)]) if n > 0 else np.zeros(0, np.uint64)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends in the flat array of the runs of letters and digits, and the text each is in."""
        inside = letters_and_digits()[self.cp]
        edge = np.ones(len(inside), bool)
        edge[1:] = ~inside[:-1]
        edge[self.offsets[:-1][self.lengths > 0]] = True
        start = np.flatnonzero(inside & edge)
        last = np.ones(len(inside), bool)
        last[:-1] = ~inside[1:]
        last[self.offsets[1:][self.lengths > 0] - 1] = True
        end = np.flatnonzero(inside & last) + 1
        return start, end, np.searchsorted(self.offsets, start, side="right") - 1


def successive(hashes: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k successive entries of one owner, and the index of the first entry of each."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(n, np.uint64)
    for i in range(k):
        acc = acc * np.uint64(_BASE) + hashes[i : i + n]
    first = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return mix(acc[first]), first


def window_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest of every w successive hashes, the leftmost of equal ones.

    The lowest bits of a hash give way to its place, so hashes that only differ in
    them count as equal; which place is meant still depends on the values alone.
    """
    mask = np.uint64((1 << max(1, len(values)).bit_length()) - 1)
    have, out = 1, (values & ~mask) | np.arange(len(values), dtype=np.uint64)
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return (out & mask).astype(np.int64)


def common_prefixes(texts: list[str]) -> np.ndarray:
    """Number of characters that every text and the next one begin with alike."""
    batch, width = TextBatch(texts), 32
    if batch.n < 2:
        return np.zeros(0, np.int64)
    cp = np.concatenate([batch.cp, np.zeros(width, np.uint32)])
    one, two = batch.offsets[:-2], batch.offsets[1:-1]
    most, out, going_on = np.minimum(batch.lengths[:-1], batch.lengths[1:]), np.zeros(batch.n - 1, np.int64), np.arange(batch.n - 1)
    steps = np.arange(width)
    while len(going_on):
        have = out[going_on]
        equal = cp[(one[going_on] + have)[:, None] + steps] == cp[(two[going_on] + have)[:, None] + steps]
        more = np.minimum(np.where(equal.all(axis=1), width, equal.argmin(axis=1)), most[going_on] - have)
        out[going_on] += more
        going_on = going_on[(more == width) & (have + more < most[going_on])]
    return out


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of half-open intervals of each owner as disjoint, non-touching intervals."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    out_o, out_s, out_e = [], [], []
    new_owner = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    for a, b in zip(new_owner, [*new_owner[1:], len(owner)]):
        reach = np.maximum.accumulate(end[a:b])
        cut = np.concatenate([[0], np.flatnonzero(start[a + 1 : b] > reach[:-1]) + 1])
        out_s.append(start[a:b][cut])
        out_e.append(reach[np.concatenate([cut[1:], [b - a]]) - 1])
        out_o.append(np.full(len(cut), owner[a]))
    return np.concatenate(out_o), np.concatenate(out_s), np.concatenate(out_e)
