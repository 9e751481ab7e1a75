"""Language identification: averaged embeddings of hashed byte n-grams and a linear softmax.

The model is fitted by stochastic gradient descent in numpy on a bounded sample of labelled texts. Its scores
are calibrated with a temperature. Two thresholds, calibrated on texts held aside, reject the rest: one on the
score, for texts between languages, and one on how rare a text's n-grams are among the learned ones, for texts of
no learned language, whose best score can be high since some language must win.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.llm import sampling
from skillgrid.llm.scratch import without_names
from skillgrid.llm.vectext import slices

WIDTHS = (3, 4)
BUCKETS = 1 << 15  # for each width
DIMENSION = 16
#: Rows of each language that the model is fitted on, at most about as many.
SAMPLE_PER_LANGUAGE = 800
#: Rows of all languages together, at most about as many; more languages than fit share them equally.
SAMPLE_ROWS = 20_000
EPOCHS = 4
RATE = 0.5
#: Share of calibration texts that each threshold may reject.
REJECTED = 0.002
#: Share of the calibration texts, taken for texts of a language not learned, that the threshold on rarity should reject.
CAUGHT = 0.99
#: Calibration texts with which both thresholds stand half way from rejecting nothing.
FEW = 10
UNKNOWN = "und"
_PART = 1 << 20

_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[65:91] += 32
_CLEAN[[9, 10, 11, 12, 13]] = 32


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # (buckets, at most DIMENSION + 1): embeddings, times weights if that is narrower; last the bucket's rarity
    weights: np.ndarray  # (columns of the table but for the last, languages)
    bias: np.ndarray
    temperature: float
    threshold: float  # least score
    usual: np.ndarray  # mean rarity of each language's n-grams
    between: float  # variance of a text's mean rarity, besides
    within: float  # this over its n-grams
    strange: float  # most deviations from the usual rarity

    def judge(self, sums: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all languages, and how far each text's rarity lies above the best one's, in deviations; of
        the sums of the rows of `table` over n n-grams of each text."""
        mean = sums / np.maximum(n, 1)[:, None]
        p = _softmax((mean[:, :-1] @ self.weights + self.bias) / self.temperature)
        above = mean[:, -1] - self.usual[p.argmax(1)]
        return p, np.where(n > 0, above / np.sqrt(self.between + self.within / np.maximum(n, 1)), 0.0)


def buckets(text: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's n-grams, in parts of bounded size that count each once. The text counts as if
    spaces stood around it."""
    edge = np.array([32], np.uint8)
    whole = len(text) + 2
    for at in range(0, whole, _PART):
        before = min(at, max(WIDTHS) - 1)  # bytes that an n-gram of this part may begin in
        part = text[max(0, at - before - 1) : at + _PART - 1]
        part = np.concatenate([edge if at == before else edge[:0], _CLEAN[part], edge if at + _PART >= whole else edge[:0]]).astype(np.uint32)
        out = []
        for i, n in enumerate(WIDTHS):
            own = part[before - min(before, n - 1) :]  # n-grams that end in this part
            h = np.zeros(max(0, len(own) - n + 1), dtype=np.uint32)
            for k in range(n):
                h = h * np.uint32(0x01000193) + own[k : len(own) - n + 1 + k] * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            out.append((h >> np.uint32(17)).astype(np.int64) + i * BUCKETS)
        yield np.concatenate(out)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, ids, counts): the distinct buckets of each text as packed 32-bit numbers; their number is
    bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for lo, hi, data, offsets in slices(batch.column(2)):
                for i in range(hi - lo):
                    total = sum(np.bincount(b, minlength=BUCKETS * len(WIDTHS)) for b in buckets(data[offsets[i] : offsets[i + 1]]))
                    some = np.flatnonzero(total)
                    ids.append(some.astype("<i4").tobytes())
                    counts.append(total[some].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "lang", "ids", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(run, "doc_id long, lang string, ids binary, counts binary")


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 0) -> Model:
    """Fits on rows (language, buckets, counts); a fifth is held aside to calibrate on."""
    languages = tuple(sorted({r[0] for r in rows}))
    if not languages:
        return Model((), np.zeros((BUCKETS * len(WIDTHS), 1), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0, np.zeros(0), 1.0, 1.0, np.inf)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.3, (BUCKETS * len(WIDTHS), DIMENSION)).astype(np.float32)
    weights, bias = rng.normal(0, 0.3, (DIMENSION, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    number = {a: i for i, a in enumerate(languages)}
    data = [(number[a], ids, (c / c.sum()).astype(np.float32)) for a, ids, c in rows if len(ids)]
    totals = [int(c.sum()) for _, ids, c in rows if len(ids)]
    order = rng.permutation(len(data))
    aside, fit = order[: len(data) // 5], order[len(data) // 5 :]
    steps, done = max(1, EPOCHS * len(fit)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(fit):
            y, ids, share = data[k]
            x = share @ vectors[ids]
            g = _softmax(x @ weights + bias)
            g[y] -= 1
            rate = RATE * (1 - done / steps)
            back = weights @ g
            weights -= rate * np.outer(x, g)
            bias -= 0.1 * rate * g
            vectors[ids] -= (20 * rate) * share[:, None] * back[None, :]
            done += 1
    known = [data[k] for k in (fit if len(fit) else order)]
    rarity, usual, within = _rarity(known, len(languages))
    if len(languages) <= DIMENSION:
        vectors, weights = vectors @ weights, np.eye(len(languages), dtype=np.float32)
    table = np.concatenate([vectors, rarity[:, None]], axis=1).astype(np.float32)
    model = Model(languages, table, weights, bias, 1.0, 0.0, usual, 0.0, within, np.inf)
    if not len(aside):
        return model
    truth = np.array([data[k][0] for k in aside])
    n = np.array([totals[k] for k in aside], dtype=np.float64)
    sums = np.array([data[k][2].astype(np.float64) @ table[data[k][1]] for k in aside]) * n[:, None]
    loss = lambda t: -np.log(np.maximum(replace(model, temperature=t).judge(sums, n)[0][np.arange(len(truth)), truth], 1e-12)).mean()
    model = replace(model, temperature=float(min(np.geomspace(0.25, 8, 41), key=loss)))
    off = sums[:, -1] / n - usual[model.judge(sums, n)[0].argmax(1)]
    model = replace(model, between=float(max(1e-4, (off**2 - within / n).mean())))
    scores, far = model.judge(sums, n)
    least, sure = 0.0, len(n) / (len(n) + FEW)
    if len(languages) > 1:  # midway, in log odds, between chance and what nearly all texts' scores reach
        odds = np.log(scores.max(1)) - np.log(np.maximum(1 - scores.max(1), 0.001))
        chance = -np.log(len(languages) - 1)
        reach = max(chance, -_exceeded(-odds, REJECTED))
        least = float(1 / (1 + np.exp(-(chance + sure * (reach - chance) / 2))))
    usual_far = _exceeded(far, REJECTED)
    foreign = _foreign(known, [data[k] for k in aside], n, model)
    # Midway, in ratio, between what few texts of learned languages exceed and what most of others do.
    strange = max(usual_far, np.sqrt(max(usual_far, 0) * max(_exceeded(foreign, CAUGHT), 0))) if len(foreign) else usual_far
    return replace(model, threshold=least, strange=float(max(strange, 0) / sure))


def _exceeded(values: np.ndarray, share: float) -> float:
    """What this share of values like these exceed, interpolated between two of them; at most the largest."""
    down = np.sort(values)[::-1]
    return float(np.interp(share * (len(values) + 1) - 1, np.arange(len(down)), down))


def _foreign(known: list, aside: list, n: np.ndarray, model: Model) -> np.ndarray:
    """How far the texts held aside would lie above the usual rarity, in deviations, had their own language not
    been learned."""
    sums, size, n_languages = _shares(known, len(model.languages)), BUCKETS * len(WIDTHS), len(model.languages)
    if n_languages < 2:
        return np.zeros(0)
    out, total = np.zeros(len(aside)), sums.sum(0)
    for y in {row[0] for row in aside}:
        rarity = -np.log((total - sums[y]) / (n_languages - 1) + 0.1 / size)
        usual = sums @ rarity
        for i, (own, ids, share) in enumerate(aside):
            if own == y:
                scores = (share @ model.table[ids, :-1]) @ model.weights + model.bias
                scores[y] = -np.inf
                out[i] = (share @ rarity[ids] - usual[scores.argmax()]) / np.sqrt(model.between + model.within / n[i])
    return out


def _shares(rows: list[tuple[int, np.ndarray, np.ndarray]], n_languages: int) -> np.ndarray:
    """The share of each bucket in each language."""
    shares = np.zeros((n_languages, BUCKETS * len(WIDTHS)), np.float32)
    for y, ids, share in rows:
        shares[y, ids] += share
    return shares / np.maximum(shares.sum(1, keepdims=True), 1e-12)


def _rarity(rows: list[tuple[int, np.ndarray, np.ndarray]], n_languages: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Of rows (language, buckets, shares): each bucket's rarity, the negative logarithm of its share where all
    languages weigh alike, with a share for the unseen; its mean in each language; and its variance in a language,
    as n-grams vary that overlap each other."""
    shares = _shares(rows, n_languages)
    rarity = -np.log(shares.mean(0) + 0.1 / shares.shape[1])
    usual = shares @ rarity
    spread = np.maximum(shares @ rarity**2 - usual**2, 0)
    return rarity, usual, float(max(1e-4, spread.max() * sum(WIDTHS)))


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fits on docs (doc_id, text, lang); rows without text or lang teach nothing. Every value of lang is
    learned that the sample holds a row of; more than sampling.MOST_GROUPS values are an error. With few rows both
    thresholds move towards rejecting less; with one language only rarity rejects. One task fits to the sample, whose rows are bounded; only the model
    reaches the driver."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")

    def learn(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        rows.sort(key=lambda r: (r["lang"], -1 if r["doc_id"] is None else r["doc_id"], r["ids"]))
        model = train([(r["lang"], np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["counts"], "<i4")) for r in rows])
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    sample = features(sampling.at_most(known, "doc_id", "lang", per_language, None, SAMPLE_ROWS))
    fitted = sample.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(learn, "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else train([])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, lang_score (calibrated probability, 0 to 1) and lang_accepted to docs; text is the only
    column that is looked at; all others pass through, but for any of these three names.

    Texts that are null or have no letter get `und` and 0 and aren't accepted, nor are texts whose score lies
    under the model's threshold or whose n-grams are too rare; these keep the best language's name. Without any
    learned language every text is `und`. Texts of any length are read whole. Equal texts get equal results, an
    empty table an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for column in parts:
            best, score, usual = [], [], []
            for lo, hi, data, offsets in slices(column):
                sums, n = np.zeros((hi - lo, m.table.shape[1])), np.zeros(hi - lo)
                for i in range(hi - lo):
                    for b in buckets(data[offsets[i] : offsets[i + 1]]):
                        sums[i] += m.table[b].sum(axis=0, dtype=np.float64)
                        n[i] += len(b)
                if len(m.languages):
                    p, far = m.judge(sums, n)
                    best += [m.languages[k] for k in p.argmax(1)]
                    score += p.max(1).tolist()
                    usual += (far <= m.strange).tolist()
                else:
                    best += [UNKNOWN] * (hi - lo)
                    score += [0.0] * (hi - lo)
                    usual += [False] * (hi - lo)
            yield pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(usual, pa.bool_())], ["lang", "score", "usual"])

    guess = F.arrow_udf(run, "lang string, score double, usual boolean")
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    named = docs.withColumn("__sg_guess", guess(F.col("text")))
    name = F.when(letters, F.col("__sg_guess.lang")).otherwise(UNKNOWN)
    score = F.when(letters, F.col("__sg_guess.score")).otherwise(0.0)
    kept = without_names(docs.columns, ("lang_pred", "lang_score", "lang_accepted"))
    return named.select(*kept, name.alias("lang_pred"), score.alias("lang_score"), ((name != UNKNOWN) & (score >= model.threshold) & F.col("__sg_guess.usual")).alias("lang_accepted"))
