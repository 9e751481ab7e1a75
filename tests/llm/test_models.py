from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skillgrid.llm import language, lmscore, quality, sampling
from skillgrid.llm.eliasfano import EliasFano
from skillgrid.llm.queries import table

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 1), (5, 1000), (400, 500), (3000, 1 << 40)])
def test_elias_fano_round_trip(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.choice(universe, n, replace=False)) if universe < 1 << 20 else np.unique(rng.integers(0, universe, n))
    seq = EliasFano(values.astype(np.int64), universe)
    assert (seq.at(np.arange(len(values))) == values).all()
    queries = np.concatenate([values, rng.integers(0, universe, 200)]).astype(np.int64)
    place = {v: i for i, v in enumerate(values.tolist())}
    assert seq.find(queries).tolist() == [place.get(q, -1) for q in queries.tolist()]


def test_elias_fano_keeps_repeats():
    values = np.array([0, 0, 3, 3, 3, 9], dtype=np.int64)
    assert EliasFano(values, 10).at(np.arange(6)).tolist() == values.tolist()


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def test_scores_equal_counts_by_hand(spark):
    rng = random.Random(1)
    vocabulary = ["a", "B", "b", "cé", "dd", "Zz", "."]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(60, None), (61, ""), (62, "unseen words only"), (62, "unseen words only"), (None, "a b")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block int, score string")
    docs = docs.withColumn("held_out", sampling.remainder("doc_id", 7) == 2)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = [Counter() for _ in range(4)]
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            for k in (1, 2, 3):
                count[k].update(zip(*[w[j:] for j in range(k)], strict=False))
    n, v = sum(count[1].values()), len(count[1])
    mu = lmscore.MU
    p1 = lambda a: (count[1][a,] + 1) / (n + v + 1)
    p2 = lambda a, b: (count[2][a, b] + mu[0] * p1(b)) / (count[1][a,] + mu[0])
    p3 = lambda a, b, c: (count[3][a, b, c] + mu[1] * p2(b, c)) / (count[2][a, b] + mu[1])
    out = lmscore.score(docs).collect()
    assert len(out) == len(rows)
    want = {}
    for i, t in rows:
        w = tokens(t)
        score = sum(math.log10(p1(w[0]) if j == 0 else p2(*w[:2]) if j == 1 else p3(*w[j - 2 : j + 1])) for j in range(len(w)))
        want[i] = (held(i), len(w), sum(count[1][x,] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), score)
    for r in out:
        a = want[r["doc_id"]]
        assert (bool(r["held_out"]), r["n_tokens"], r["n_known"], r["train_tokens"]) == a[:4]
        assert abs(r["base_score"] - a[4]) < 1e-9 and abs(r["score"] - a[5]) < 1e-3 * max(1, r["n_tokens"])


def test_probabilities_of_a_context_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "a b a c a b"), (2, "b a")], "doc_id long, text string")
    seen = ["a", "b", "c", None]
    rows = [(i, f"a {w}" if w else "a", True) for i, w in enumerate(seen + ["new"], start=10)]
    both = docs.selectExpr("doc_id", "text", "false AS held_out").unionByName(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"))
    out = {r["doc_id"]: r for r in lmscore.score(both).collect() if r["held_out"]}
    ends = out[13]["score"]  # a, end
    assert ends < 0 and all(r["score"] < 0 for r in out.values())


def test_scores_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, held_out boolean")
    assert lmscore.score(empty).collect() == []
    only = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held_out boolean")
    r = lmscore.score(only).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)


def test_language_on_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").withColumn("held_out", sampling.remainder("doc_id", 4) == 2)
    model = language.fit(docs.filter("NOT held_out"), 200)
    out = language.identify(docs.filter("held_out"), model).select("lang", "lang_pred", "lang_score", "lang_accepted").collect()
    assert sum(r[0] == r[1] for r in out) >= 0.98 * len(out) and all(0 <= r[2] <= 1 for r in out)
    assert sum(not r[3] for r in out) <= 0.01 * len(out)


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "fr"), (4, "some", None), (5, "", "en")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == ("en", "fr")
    asked = spark.createDataFrame([(1, None, "x", 1.0), (2, "123 .", "x", 1.0), (3, "", "x", 1.0), (4, "the cat", "x", 1.0), (4, "the cat", "x", 1.0), (5, "ж" * 200_000, "x", 1.0)], "doc_id long, text string, Lang_Pred string, `odd.name` double")
    out = language.identify(asked, model)
    assert out.columns == ["doc_id", "text", "odd.name", "lang_pred", "lang_score", "lang_accepted"]
    got = [(r["doc_id"], r["lang_pred"], r["lang_accepted"]) for r in out.collect()]
    assert [g for g in got if g[0] < 4] == [(i, "und", False) for i in (1, 2, 3)] and len({g for g in got if g[0] == 4}) == 1
    assert {g[2] for g in got if g[0] == 4} == {True} and {g[2] for g in got if g[0] == 5} == {False}
    assert language.identify(asked.limit(0), model).collect() == []
    blank = language.fit(docs.filter("doc_id = 3"))
    assert {r["lang_pred"] for r in language.identify(asked, blank).collect()} == {"und"}


def test_thresholds_move_steadily_with_the_rows():
    rng = np.random.default_rng(4)

    def text(k):  # words of syllables that two neighbouring languages share half of
        syllables = [chr(97 + (5 * k + i) % 26) + chr(97 + (11 * k + 7 * j) % 26) for i in range(6) for j in range(5)]
        return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(8, 80)))

    def row(k, t):
        counts = sum(np.bincount(b, minlength=2 * language.BUCKETS) for b in language.buckets(np.frombuffer(t.encode(), np.uint8)))
        return (f"l{k}", np.flatnonzero(counts), counts[counts > 0])

    rows = [row(i % 3, text(i % 3)) for i in range(3000)]
    other = [row(9, text(3 + i % 4)) for i in range(100)] + [row(9, "".join(chr(0x431 + c) for c in rng.integers(0, 30, 200))) for _ in range(100)]
    own = [row(i % 3, text(i % 3)) for i in range(300)]
    sums = lambda m, some: np.array([c.astype(float) @ m.table[ids] for _, ids, c in some])
    least = []
    for size in (100, 600, 1000, 2400, 2600, 3000):
        m = language.train(rows[:size])
        kept = []
        for some in (other, own):
            p, far = m.judge(sums(m, some), np.array([c.sum() for _, _, c in some], float))
            kept.append(np.mean((p.max(1) >= m.threshold) & (far <= m.strange)))
        least.append(m.threshold)
        assert kept[0] <= 0.1 and kept[1] >= 0.98, (size, kept, m.threshold, m.strange)
    assert max(abs(a - b) for a, b in zip(least, least[1:], strict=False)) < 0.35 and abs(least[3] - least[4]) < 0.05, least


def test_many_languages_share_a_bounded_table(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        k = i % 40
        ids = np.unique(np.concatenate([rng.integers(0, 100, 5), 1000 + 50 * k + rng.integers(0, 50, 30)]))
        rows.append((f"l{k:02d}", ids, np.ones(len(ids), np.int64)))
    m = language.train(rows)
    assert m.table.shape[1] == language.DIMENSION + 1 and m.weights.shape == (language.DIMENSION, 40)
    docs = spark.range(3000).selectExpr("id AS doc_id", "'some text' AS text", "CAST(id AS string) AS lang")
    with pytest.raises(ValueError, match="2000 values"):
        language.fit(docs)


def test_quality_on_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").filter("doc_id < 4000").select("doc_id", "text", (sampling.remainder("doc_id", 3) == 1).alias("held_out"))
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    model = quality.fit(docs.filter("NOT held_out"), labels, per_label=600)
    out = docs.filter("held_out").join(labels, "doc_id").select("quality", quality.score(model, docs)).collect()
    good, bad = [s for q, s in out if q == 1], [s for q, s in out if q == 0]
    rank = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert rank > 0.97 and len(model.pairs) == quality.PAIRS


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "x" * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (4, 2, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    out = docs.select("doc_id", quality.score(model, docs).alias("s")).collect()
    assert len(out) == 6 and all(0 <= r["s"] <= 1 for r in out) and out[0]["s"] == out[1]["s"] and out[2]["s"] == out[3]["s"]
    nothing = quality.fit(docs.limit(0), labels.limit(0))
    assert {r[0] for r in docs.select(quality.score(nothing, docs)).collect()} == {0.5}


def test_samples_are_bounded_and_repeatable(spark):
    rows = spark.range(20_000).selectExpr("id", "CASE WHEN id % 100 = 0 THEN 'b' WHEN id % 101 = 0 THEN NULL ELSE 'a' END AS g")
    one = sampling.at_most(rows.filter("g IS NOT NULL"), "id", "g", 500)
    n = {r["g"]: r["count"] for r in one.groupBy("g").count().collect()}
    assert n["b"] == 200 and 350 < n["a"] < 650
    again = sampling.at_most(rows.filter("g IS NOT NULL").repartition(7), "id", "g", 500)
    assert {r["id"] for r in one.collect()} == {r["id"] for r in again.collect()}


def test_quality_counts_lines_of_long_texts():
    repeated = lambda text: quality.describe(np.frombuffer(text, np.uint8), np.zeros(0, np.uint64))[quality.NAMES.index("repeated_lines")]
    some = b"\n".join(b"line %015d" % i for i in range(250_000))
    assert len(some) > 5 << 20 and repeated(some) == 0
    assert repeated(some + b"\n" + some) == 0.5 and repeated(some + b"\n\nline %015d" % 3) == 1 - 250_000 / 250_001
    wide = b"x" * (5 << 20)
    assert repeated(b"a\n" + wide + b"\nb\n" + wide) == 1 - 3 / 4 and repeated(wide + b"\n" + wide[:-1] + b"y\n" + b"y" + wide[1:]) == 0


def test_every_language_is_learned(spark):
    rows = spark.range(1200).selectExpr("id AS doc_id", "concat('some text ', id) AS text", "concat('l', id % 300) AS lang")
    assert len(language.fit(rows).languages) == 300
    assert 300 < sampling.at_most(rows, "doc_id", "lang", 800, None, 600).count() < 900


def test_texts_of_no_learned_language_are_rejected(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").withColumn("held_out", sampling.remainder("doc_id", 4) == 2)
    model = language.fit(docs.filter("NOT held_out"))
    strange = [
        "Жизнь прекрасна и удивительна, особенно весной, когда цветут сады", "これは日本語の文章です。モデルは知りません。", "Ez egy magyar mondat, amelyet a nyelvi modell nem ismer, és nem is tanult soha",
        "To jest zdanie po polsku, którego model nigdy nie widział ani nie czytał", "xqzv kjwq zzxv qqkj vbnm wxyz jjkq xvzq qzkx",
    ]
    asked = spark.createDataFrame([(t,) for t in strange + ["the hand of the other and that is for the", "Ж" * 100_000]], "text string")
    assert [r[0] for r in language.identify(asked, model).select("lang_accepted").collect()] == [False] * len(strange) + [True, False]
    one = language.fit(docs.filter("NOT held_out AND lang = 'en'"))
    got = language.identify(docs.filter("held_out AND lang = 'en' AND text IS NOT NULL").select("text"), one).select("lang_accepted").collect()
    assert sum(not r[0] for r in got) <= 0.02 * len(got)
    assert not any(r[0] for r in language.identify(asked.limit(2), one).select("lang_accepted").collect())


def test_long_texts_count_each_gram_once(monkeypatch):
    text = np.frombuffer(("Some Text über " * 50).encode(), np.uint8)
    count = lambda t: np.bincount(np.concatenate(list(language.buckets(t))), minlength=2 * language.BUCKETS)
    for some in (text, text[:0], text[:1], text[:2], text[:5]):
        monkeypatch.setattr(language, "_PART", 1 << 20)
        whole = count(some)
        for part in (1, 2, 3, 5, 64, len(some) + 1, len(some) + 2):
            monkeypatch.setattr(language, "_PART", part)
            assert (count(some) == whole).all()
