"""Cost-balanced packing of token sequences.

A document's tokens may be cut anywhere. Tasks tokenise their own rows and pack them in windows of a fixed
number of tokens, so nothing is shuffled and memory doesn't grow with the input: a window's whole sequences'
worth of tokens fills its sequences exactly, and the few tokens left over fill sequences whose lengths are
powers of two, which need no padding.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE_TOKENS = 4096
WINDOW_TOKENS = 1 << 22
END_ID = 2
#: Estimated cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n (attention stays within a piece).
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
CACHED_CHUNKS = 1_000_000

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def plan(lengths: np.ndarray, capacity: int = SEQUENCE_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Packs documents of the given lengths: (document, start, length, sequence, offset) of each piece.

    Whole multiples of the capacity become sequences of their own. What remains is taken in descending
    length; each goes to the sequence of least estimated cost that has room for it, or is cut to fill the
    cheapest sequences that have any room. The last tokens, fewer than the capacity, fill sequences of
    power-of-two lengths."""
    out, rest, sequences = [], [], 0
    for d, n in enumerate(lengths.tolist()):
        for at in range(0, n - n % capacity, capacity):
            out.append((d, at, capacity, sequences, 0))
            sequences += 1
        if n % capacity:
            rest.append((n % capacity, d, n - n % capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    left = sum(x[0] for x in rest)
    n_open = left // capacity
    room = np.full(n_open, capacity, dtype=np.int64)
    cost = np.zeros(n_open)
    tail = []
    for n, d, at in rest:
        while n and n_open:
            fits = room >= n
            if fits.any():
                s = int(np.argmin(np.where(fits, cost, np.inf)))
            else:
                some = room > 0
                if not some.any():
                    n_open = 0
                    break
                s = int(np.argmin(np.where(some, cost, np.inf)))
            t = min(n, int(room[s]))
            out.append((d, at, t, sequences + s, capacity - int(room[s])))
            room[s] -= t
            cost[s] += linear * t + quadratic * t * t
            n, at = n - t, at + t
        if n:
            tail.append((n, d, at))
    sequences += len(room)
    left = sum(x[0] for x in tail)
    size, used = (1 << (left.bit_length() - 1) if left else 0), 0
    for n, d, at in tail:
        while n:
            t = min(n, size - used)
            out.append((d, at, t, sequences, used))
            n, at, used, left = n - t, at + t, used + t, left - t
            if used == size:
                size, used, sequences = (1 << (left.bit_length() - 1) if left else 0), 0, sequences + 1
    return out


class Encoder:
    """Ids of whole texts. The tokenizer drops white space and never joins across a space or line feed, so
    each chunk between them is encoded once and looked up afterwards. New chunks are encoded as one text between
    marks, special tokens that the tokenizer cuts out first. A worker keeps its table of chunks from task to task
    and empties it when full."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().items()
        plain = [(t.content, i) for i, t in added if t.special and not (t.normalized or t.single_word or t.lstrip or t.rstrip)]
        self.mark, self.mark_id = plain[0] if plain else (None, None)
        self.clear()

    def clear(self) -> None:
        self.at: defaultdict[str, int] = defaultdict(count().__next__)  # numbers chunks as they come
        self.begin, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.known, self.flat, self.used = 0, np.zeros(1 << 14, np.uint32), 0

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks and how many each has."""
        if self.mark:
            ids = np.array(self.tokenizer.encode(self.mark.join(chunks), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(ids == self.mark_id)
            if len(ends) == len(chunks) - 1:  # else a chunk holds the mark
                return np.delete(ids, ends), np.diff(ends, prepend=-1, append=len(ids)) - 1
        each = [e.ids for e in self.tokenizer.encode_batch(chunks, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(each)), np.uint32), np.array([len(x) for x in each], np.int64)

    def learn(self, chunks: list[str]) -> None:
        ids, n = self.encode(chunks)
        k, used = self.known + len(chunks), self.used + len(ids)
        while k > len(self.begin):
            self.begin, self.count = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.count, 2 * len(self.count))
        while used > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.begin[self.known : k], self.count[self.known : k] = self.used + np.cumsum(n) - n, n
        self.flat[self.used : used] = ids
        self.known, self.used = k, used

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.at) > CACHED_CHUNKS:
            self.clear()
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        k = np.fromiter(map(self.at.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        if fresh := list(islice(reversed(self.at), len(self.at) - self.known)):
            self.learn(fresh[::-1])
        n = self.count[k]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.begin[k] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = ends[np.cumsum([len(p) for p in parts]) - 1]
        return np.split(ids, cuts[:-1])


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's own encoder: tasks carry copies of what they refer to, a function of this module finds the
    module's."""
    return _encoders.get(path) or _encoders.setdefault(path, Encoder(path))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID, window: int = WINDOW_TOKENS) -> DataFrame:
    """Packs docs (doc_id, text) into sequences of at most `capacity` tokens; a row for each piece, with its
    ids as little-endian unsigned 32-bit numbers.

    A null or empty text is one token, the end. Repeated rows are packed as often as they appear, ties keep
    the input's order, an empty table gives no rows, other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        encoder = encoder_of(tokenizer_path)
        held: list[tuple[int | None, np.ndarray]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, held, tokens
            pieces = plan(np.array([len(x) for _, x in held], dtype=np.int64), capacity)
            d, start, length, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*pieces, strict=True))
            cols = [
                pa.array([held[i][0] for i in d.tolist()], pa.int64()), pa.array(start), pa.array(length),
                pa.array([held[i][1][a : a + n].tobytes() for i, a, n, _, _ in pieces], pa.binary()),
                pa.array([len(held[i][1]) for i in d.tolist()], pa.int64()), pa.array(sequence + base), pa.array(offset),
            ]
            base += int(sequence.max()) + 1
            held, tokens = [], 0
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 128):
                encoded = encoder([t or "" for t in texts.slice(lo, 128).to_pylist()])
                for i, x in zip(ids[lo : lo + 128], encoded, strict=True):
                    held.append((i, np.concatenate([x.astype("<u4"), end])))
                    tokens += len(x) + 1
                    if tokens >= window:
                        yield flush()
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, SCHEMA)
