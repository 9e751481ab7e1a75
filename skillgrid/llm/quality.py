"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few numbers; each number falls into one of some bins. The model adds a lookup table for
each number and for the pairs that interact most; the tables are grown by cyclic gradient boosting of shallow
trees over a bounded sample of labelled rows. A score is the logistic of a sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.llm import sampling
from skillgrid.llm.vectext import mix, prefix_sums, powers, shingles, slices, words

NAMES = (
    "bytes", "words", "word_bytes", "upper", "digits", "punctuation", "symbols", "marks", "line_ends", "other_bytes",
    "distinct_words", "top_word", "short_words", "long_words", "repeated_shingles", "repeated_lines", "line_bytes", "stops",
)
#: Rows of each label that the model is fitted on, at most about as many.
SAMPLE_PER_LABEL = 10_000
BINS = 32
PAIRS = 8
ROUNDS = 150
RATE = 0.1
_PART = 1 << 22
_P_INVERSE = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_FOLD = np.uint64(0x2545F4914F6CDD1D)

_CLASS = np.zeros(256, dtype=np.uint8)  # 1 upper, 2 lower, 3 digit, 4 full stop and comma, 5 other punctuation, 6 space, 7 line end, 8 from 128
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 8
_CLASS[[i for i in range(33, 127) if not chr(i).isalnum()]] = 5
_CLASS[[44, 46]], _CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 4, 6, 7
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "|#$%&*<>=^~_\\{}[]@/+"]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in "!?"]] = True


def _lines(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the lines that lie at these places, over segments of at most _PART bytes. A longer line's is
    made of its pieces' hashes, so that equal lines hash alike wherever they lie."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + _PART, side="right")))
        for lo in range(at, int(ends[j - 1]), _PART):
            part = data[lo : min(lo + _PART, int(ends[j - 1]))]
            sums, s = prefix_sums(part), np.maximum(starts[i:j] - lo, 0)
            e = np.minimum(ends[i:j] - lo, len(part))
            out[i:j] = mix(out[i:j] * _FOLD + (sums[e] - sums[s]) * powers(_P_INVERSE, len(part) + 1)[s])
        i = j
    return out


def describe(data: np.ndarray, hashes: np.ndarray) -> list[float]:
    """The numbers NAMES of one text: its bytes and its words' hashes."""
    n, w = len(data), len(hashes)
    if not n:
        return [0.0] * len(NAMES)
    kinds = np.bincount(_CLASS[data], minlength=9)
    letters = max(1, int(kinds[1] + kinds[2]))
    spaces = int(kinds[6] + kinds[7])
    _, counts = np.unique(hashes, return_counts=True) if w else (None, np.zeros(1))
    runs = np.diff(np.flatnonzero(np.concatenate([[True], np.isin(_CLASS[data], (0, 6, 7)), [True]]))) - 1
    runs = runs[runs > 0]
    pieces = shingles(hashes)
    ends = np.concatenate([np.flatnonzero(data == 10), [n]])
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = ends - starts
    lines = _lines(data, starts[length > 0], ends[length > 0])
    return [
        float(np.log1p(n)), float(np.log1p(w)), (n - spaces) / max(1, w), kinds[1] / letters, kinds[3] / n,
        kinds[5] / n, float(np.count_nonzero(_SYMBOL[data])) / n, float(np.count_nonzero(_MARK[data])) / n, kinds[7] / n, kinds[8] / n,
        len(counts) / max(1, w), float(counts.max()) / max(1, w), float(np.count_nonzero(runs <= 3)) / max(1, w), float(np.count_nonzero(runs >= 12)) / max(1, w),
        1 - len(np.unique(pieces)) / max(1, len(pieces)), 1 - len(np.unique(lines)) / max(1, len(lines)), float(np.log1p(length.mean())), kinds[4] / n,
    ]


def matrix(column: pa.Array) -> np.ndarray:
    """describe() of every text of a column; null counts as empty."""
    out = []
    for lo, hi, data, offsets in slices(column):
        hashes, at = words(data, offsets)
        out += [describe(data[offsets[i] : offsets[i + 1]], hashes[at[i] : at[i + 1]]) for i in range(hi - lo)]
    return np.array(out, dtype=np.float64).reshape(-1, len(NAMES))


@dataclass(frozen=True)
class Model:
    edges: tuple[np.ndarray, ...]
    base: float
    tables: np.ndarray  # (features, bins)
    pairs: tuple[tuple[int, int], ...]
    pair_tables: np.ndarray  # (pairs, bins, bins)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = self.base + self.tables[np.arange(len(self.edges)), b].sum(axis=1)
        for k, (f, g) in enumerate(self.pairs):
            z = z + self.pair_tables[k, b[:, f], b[:, g]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A regression tree over bins in order: the step to add to each bin."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    if not depth or len(g) < 2:
        return out
    left, right = (g.cumsum()[:-1], h.cumsum()[:-1]), (g[::-1].cumsum()[::-1][1:], h[::-1].cumsum()[::-1][1:])
    gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1)
    gain[(left[1] < 1) | (right[1] < 1)] = -1
    k = int(gain.argmax())
    if gain[k] <= g.sum() ** 2 / (h.sum() + 1) + 1e-9:
        return out
    return np.concatenate([_tree(g[: k + 1], h[: k + 1], depth - 1), _tree(g[k + 1 :], h[k + 1 :], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree with one cut of either feature: its gain and its steps, as a table."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, c = cg[:-1, :-1], ch[:-1, :-1]
    gs = (a, cg[:-1, -1:] - a, cg[-1:, :-1] - a, cg[-1, -1] - cg[:-1, -1:] - cg[-1:, :-1] + a)
    hs = (c, ch[:-1, -1:] - c, ch[-1:, :-1] - c, ch[-1, -1] - ch[:-1, -1:] - ch[-1:, :-1] + c)
    gain = sum(x**2 / (y + 1) for x, y in zip(gs, hs, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    step = np.zeros_like(g)
    for q, (rows, cols) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        step[rows, cols] = _leaf(gs[q][i, j], hs[q][i, j])
    return float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)), step


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Fits to numbers x and labels y (0 or 1)."""
    n_features = len(NAMES)
    edges = tuple(np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(n_features))
    tables, none = np.zeros((n_features, BINS)), np.zeros((0, BINS, BINS))
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    model = Model(edges, base, tables, (), none)
    if len(y) == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    z = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(n_features):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b[:, f], g, BINS), np.bincount(b[:, f], h, BINS))
            tables[f] += step
            z += step[b[:, f]]
    g, h = slopes()
    cells = {(f, k): b[:, f] * BINS + b[:, k] for f in range(n_features) for k in range(f + 1, n_features)}
    grid = lambda v, c: np.bincount(c, v, BINS * BINS).reshape(BINS, BINS)
    gains = {p: _quadrants(grid(g, c), grid(h, c))[0] for p, c in cells.items()}
    pairs = tuple(sorted(sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]))
    pair_tables = np.zeros((len(pairs), BINS, BINS))
    for _ in range(ROUNDS // 3):
        for k, p in enumerate(pairs):
            g, h = slopes()
            step = RATE * _quadrants(grid(g, cells[p]), grid(h, cells[p]))[1]
            pair_tables[k] += step
            z += step.ravel()[cells[p]]
    return Model(edges, base, tables, pairs, pair_tables)


def _numbers(docs: DataFrame, label: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array(list(matrix(batch.column(2))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x], ["doc_id", "label", "x"])

    return docs.select("doc_id", F.col(label).cast("int").alias("label"), "text").mapInArrow(run, "doc_id long, label int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = SAMPLE_PER_LABEL) -> Model:
    """Fits on the texts of docs (doc_id, text) that labels (doc_id, <label>: 0 or 1) marks. A document with
    several marks counts with the lower; null marks and ids teach nothing."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    chosen = F.broadcast(sampling.at_most(marks, "doc_id", "label", per_label, 2))  # its size is bounded by per_label
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    rows = sorted((r["doc_id"], r["label"], r["x"]) for r in _numbers(texts, "label").collect())
    return train(np.array([r[2] for r in rows], dtype=np.float64).reshape(-1, len(NAMES)), np.array([r[1] for r in rows], dtype=np.float64))


def score(model: Model, docs: DataFrame, text: str = "text") -> Column:
    """A column with the score (0 to 1) of docs' texts; null and empty texts score as an empty one. Nothing
    but the text is looked at, so equal texts score alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            yield pa.array(shared.value.score(matrix(column)), pa.float64())

    return F.arrow_udf(run, "double")(F.col(text))
