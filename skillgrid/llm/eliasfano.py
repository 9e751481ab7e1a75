"""Elias-Fano sequences and an n-gram trie of them, in memory maps of their own.

A monotone sequence keeps the low bits of its values side by side and the high bits as a unary bit string.
Queries are vectorised: they take and give arrays.
"""

from __future__ import annotations

import mmap

import numpy as np

_BATCH = 1 << 16


def mapped(a: np.ndarray) -> np.ndarray:
    """A copy of an array in an anonymous memory map, which the system may page."""
    out = np.frombuffer(mmap.mmap(-1, max(1, a.nbytes)), dtype=a.dtype, count=len(a))
    out[:] = a
    return out


#: Place of the i-th set bit of each byte.
_PLACES = np.zeros((256, 8), dtype=np.uint8)
for _byte in range(256):
    for _i, _bit in enumerate(x for x in range(8) if _byte >> x & 1):
        _PLACES[_byte, _i] = _bit


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) set bit of little-endian 64-bit words; before: set bits before each word."""
    out = np.empty(len(k), dtype=np.int64)
    for lo in range(0, len(k), _BATCH):
        part = k[lo : lo + _BATCH]
        w = np.searchsorted(before, part, side="right") - 1
        octets = words[w].view(np.uint8).reshape(-1, 8)
        seen = np.cumsum(np.bitwise_count(octets), axis=1, dtype=np.uint8)
        rest = (part - before[w]).astype(np.uint8)
        octet = (seen <= rest[:, None]).sum(axis=1)
        row = np.arange(len(part))
        rest -= np.where(octet > 0, seen[row, octet - 1], 0).astype(np.uint8)
        out[lo : lo + _BATCH] = w * 64 + octet * 8 + _PLACES[octets[row, octet], rest]
    return out


class EliasFano:
    """A non-decreasing sequence of whole numbers under `universe`."""

    def __init__(self, values: np.ndarray, universe: int):
        n = len(values)
        self.n = n
        self.shift = max(0, (universe // max(1, n)).bit_length() - 1)
        kind = next(t for t, b in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if self.shift <= b)
        self.low = mapped((values & ((1 << self.shift) - 1)).astype(kind))
        self.buckets = (universe >> self.shift) + 1
        bits = np.zeros(-(-(n + self.buckets + 1) // 64) * 64, dtype=np.uint8)
        bits[(values >> self.shift) + np.arange(n)] = 1
        self.size = n + self.buckets
        self.high = mapped(np.packbits(bits, bitorder="little").view("<u8"))
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.ones = mapped(np.concatenate([[0], np.cumsum(ones)[:-1]]))
        self.zeros = mapped(np.arange(len(ones), dtype=np.int64) * 64 - self.ones)

    def bytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.ones.nbytes + self.zeros.nbytes

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        high = _select(self.high, self.ones, i) - i
        return (high << self.shift) | self.low[i].astype(np.int64)

    def find(self, q: np.ndarray) -> np.ndarray:
        """The place of each value of q, or -1 where the sequence, which must be increasing, lacks it."""
        out = np.full(len(q), -1, dtype=np.int64)
        if not self.n or not len(q):
            return out
        bucket, low = q >> self.shift, (q & ((1 << self.shift) - 1)).astype(self.low.dtype)
        zeros = ~self.high
        first = np.zeros(len(q), dtype=np.int64)
        later = bucket > 0
        first[later] = _select(zeros, self.zeros, bucket[later] - 1) + 1 - bucket[later]
        end = _select(zeros, self.zeros, bucket) - bucket
        stop = end.copy()
        while (open_ := np.flatnonzero(first < stop)).size:  # the low bits of a bucket are in order
            middle = (first[open_] + stop[open_]) >> 1
            less = self.low[middle] < low[open_]
            first[open_[less]] = middle[less] + 1
            stop[open_[~less]] = middle[~less]
        there = np.flatnonzero(first < end)
        there = there[self.low[first[there]] == low[there]]
        out[there] = first[there]
        return out


class Quantised:
    """Numbers in 16 bits over their own range."""

    def __init__(self, x: np.ndarray):
        self.least = float(x.min()) if len(x) else 0.0
        self.step = (float(x.max()) - self.least) / 65535 if len(x) else 0.0
        self.codes = mapped(np.round((x - self.least) / self.step if self.step else np.zeros(len(x))).astype(np.uint16))

    def at(self, i: np.ndarray) -> np.ndarray:
        return self.least + self.step * self.codes[i]


class Trie:
    """Smoothed log10 probabilities of words, pairs and triples of local words 0..n_words-1.

    Level 2 lists each word's successors; level 3 lists those of each pair (a, b), as their places among the
    successors of b: every successor of (a, b) is one of b's, so these numbers are small. A level is one
    increasing sequence: the successors of a context are offset by where its context's span begins (monotone
    pointers). A query finds its context first, then its successor relative to it.

    Probabilities: Dirichlet smoothing, P(w|h) = (c(hw) + mu P(w|h')) / (c(h) + mu), down to
    P(w) = (c(w) + 1) / (tokens + types + 1)."""

    def __init__(self, counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], pair_counts: np.ndarray, triples: tuple[np.ndarray, np.ndarray], triple_counts: np.ndarray, total: float, mu: tuple[float, float]):
        """pairs: sorted (a, b) with counts; triples: sorted (place of (a, b) among pairs, c) with counts."""
        self.n = n = len(counts)
        single = (counts + 1) / total
        a, b = pairs
        self.level2 = EliasFano(a * n + b, max(1, n * n))
        self.pointers = EliasFano(np.searchsorted(a, np.arange(n + 1)), len(a) + 1)
        p2 = (pair_counts + mu[0] * single[b]) / (counts[a] + mu[0])
        self.single, self.back1 = Quantised(np.log10(single)), Quantised(np.log10(mu[0] / (counts + mu[0])))
        self.pair, self.back2 = Quantised(np.log10(p2)), Quantised(np.log10(mu[1] / (pair_counts + mu[1])))
        k, c = triples
        start = np.searchsorted(a, np.arange(n + 1))
        spans = np.concatenate([[0], np.cumsum(start[b + 1] - start[b])]) if len(a) else np.zeros(1, np.int64)
        self.spans = EliasFano(spans, int(spans[-1]) + 1)
        tail = self.level2.find(b[k] * n + c)
        self.level3 = EliasFano(spans[k] + tail - start[b[k]], int(spans[-1]) + 1)
        self.triple = Quantised(np.log10((triple_counts + mu[1] * p2[tail]) / (pair_counts[k] + mu[1])))

    def word(self, w: np.ndarray) -> np.ndarray:
        return self.single.at(w)

    def after_word(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P(b|a), and the places of the pairs (-1: unseen)."""
        at = self.level2.find(a * self.n + b)
        out = self.back1.at(a) + self.single.at(b)
        seen = at >= 0
        out[seen] = self.pair.at(at[seen])
        return out, at

    def after_pair(self, ab: np.ndarray, b: np.ndarray, bc: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """log10 P(c|a, b), from the places of (a, b) and (b, c) and log10 P(c|b)."""
        out = shorter.copy()
        known = np.flatnonzero(ab >= 0)
        out[known] += self.back2.at(ab[known])
        both = known[bc[known] >= 0]
        at = self.level3.find(self.spans.at(ab[both]) + bc[both] - self.pointers.at(b[both]))
        seen = at >= 0
        out[both[seen]] = self.triple.at(at[seen])
        return out
