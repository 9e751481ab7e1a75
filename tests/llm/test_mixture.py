from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import pairwise

import pytest

from conftest import SMALL
from skillgrid.llm import fim, importance, mixing
from skillgrid.llm.queries import ORACLE_SQL, QUERIES


def table(found, columns):
    return sorted(repr(tuple(r[c] for c in columns)) for r in found)


@pytest.mark.parametrize("name", ["op11_fim", "op12_mixing", "op13_resampling"])
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    found = duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    assert table(df.collect(), columns) == table([dict(zip(found.columns, r, strict=True)) for r in found.fetchall()], columns)


def draws(seed, doc_id):
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]


TEXTS = [None, "", "one", "\n", "\n\n\n", "a\nb\nc", "a\r\nb c\x85d\n", "with <S> inside\nand more", "é😀\n" * 40, "<P", "S>\n<", "<\n<P\nM>", "x" * 5_000_000 + "\n" + "y\n" * 200_000, "a\nb\nc", " \t\n"]


def docs_of(spark, texts):
    rows = [(i if i != 1 else None, t, "x", "y") for i, t in enumerate(texts)] + [(3, "\n", "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, form string, `a.b` string"), rows


def test_middles_are_filled_from_whole_units(spark):
    docs, rows = docs_of(spark, TEXTS)
    out = fim.rearrange(docs).withColumn("restored", fim.restored())
    assert out.columns == ["doc_id", "text", "a.b", *fim.NEW, "restored"]
    want = []
    for i, text, *_ in rows:
        t = text or ""
        units = re.findall(fim.LINES, t)
        assert "".join(units) == t
        h1, h2, _, h4 = draws(7, i)
        low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
        if not t or re.search("<[PSM]>", t):
            want.append((i, len(units), "plain", None, None, t, t))
        elif h4 % 100 < 50:
            want.append((i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t))
        else:
            want.append((i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t))
    got = [tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {w[2] for w in want} == {"plain", "spm", "psm"}
    assert fim.rearrange(docs.limit(0)).count() == 0
    assert fim.rearrange(docs, rate=0).filter("form <> 'plain'").isEmpty()
    words = fim.rearrange(docs.filter("doc_id = 5"), unit=r"\s*\S+\s*", sentinels=("[pre]", "[suf]", "[mid]"))
    assert words.select(fim.restored(sentinels=("[pre]", "[suf]", "[mid]"))).first()[0] == "a\nb\nc"


def test_sentinels_that_overlap_are_refused(spark):
    docs, _ = docs_of(spark, ["a"])
    for wrong in (("", "b", "c"), ("aba", "x", "y"), ("ab", "bc", "d"), ("a", "a", "b"), ("xay", "a", "b")):
        with pytest.raises(ValueError):
            fim.rearrange(docs, sentinels=wrong)


def test_two_passes_hold_no_units():
    seen = []

    class Watched:
        def finditer(self, text):
            for m in re.finditer(fim.LINES, text):
                seen.append(m.end())
                yield m

    assert fim.cut_points("a\n" * 100, Watched(), 10, 3) == (100, 6, 20)
    assert len(seen) == 100 + 10  # the second pass goes no further than the greater rank


def shares(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets in the order of the sizes, by rounds."""
    total, w, out = share * sum(sizes), [weights[i % len(weights)] for i in range(len(sizes))], {}
    while True:
        free = [i for i in range(len(sizes)) if i not in out]
        level = (total - sum(out.values())) / sum(w[i] for i in free) if free else 0
        above = [i for i in free if w[i] * level > most * sizes[i]]
        if not above:
            return [out.get(i, w[i] * level) for i in range(len(sizes))]
        out |= {i: most * sizes[i] for i in above}


def test_sources_reach_their_targets(spark):
    rng = random.Random(5)
    rows = []
    for source, n in (("b", 400), ("a", 60), (None, 90), ("é", 30), ("Z", 1), ("empty", 5)):
        for _ in range(n):
            size = 0 if source == "empty" else rng.choice([0, 1, 5, 60, 64, 200, 700])
            rows.append((len(rows), " ".join(["wört"] * size) + rng.choice(["", " ", "\n"]), source, 1, 2))
    rows += [(None, None, "a", 1, 2), (None, "three words here", "a", 1, 2), (None, "three words here", "a", 1, 2), (0, rows[0][1], "b", 1, 2), (len(rows), "long " * 30_000, "b", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key int, size int")
    out = mixing.mix(docs)
    got = out.collect()
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"] and len(got) == len(rows)
    assert sorted((repr(r["doc_id"]), r["size"]) for r in got) == sorted((repr(r[0]), len((r[1] or "").split())) for r in rows)
    sources = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sizes = {s: sum(len((r[1] or "").split()) for r in rows if r[2] == s) for s in sources}
    want = dict(zip(sources, shares([sizes[s] for s in sources]), strict=True))
    by_source, source_of = Counter(), {(r[0], len((r[1] or "").split())): r[2] for r in rows}
    for r in got:
        s = source_of[r["doc_id"], r["size"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        by_source[s] += r["taken"]
    assert all(abs(by_source[s] - want[s]) <= 2 * mixing.BLOCK_WORDS for s in sources)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix(docs.filter("source = 'empty'")).collect()} == {0}


def highest(votes, seats, most):
    """Seats one by one."""
    won = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if won[i] < most[i]]
        if not open_:
            break
        best = max(open_, key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def test_quotas_are_those_of_seat_by_seat(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for g in range(60):
        n = rng.randint(1, 12)
        votes = [rng.choice([0, 1, 1, 2, rng.randint(1, 9), rng.randint(1, 10_000)]) for _ in range(n)]
        seats = rng.choice([0, 1, rng.randint(0, 40), rng.randint(0, 2 * sum(votes)) % 3_000])
        most = [10**6 if g % 2 else v * 2 for v in votes]
        if not g % 2:
            seats = min(seats, sum(most))
        if not sum(votes):
            continue
        want |= {(g, i): w for i, w in enumerate(highest(votes, seats, most))}
        rows += [(g, i, v, seats, m) for i, (v, m) in enumerate(zip(votes, most, strict=True))]
    df = spark.createDataFrame(rows, "g int, i int, v long, seats long, most long")
    got = {(r["g"], r["i"]): r["quota"] for r in mixing.apportion(df, "v", "seats", "most", ["g"], "i").collect()}
    assert got == want


def resampled(docs, target, percent, min_words, longest, buckets, seed):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    runs = lambda ws: [" ".join(ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = Counter(bucket(x) for _, d in docs for x in runs(words(d))), Counter(bucket(x) for d in target for x in runs(words(d)))
    ns, nt = sum(s.values()), sum(t.values())
    rows = []
    for i, (doc_id, d) in enumerate(docs):
        fs = runs(words(d))
        weight = sum(math.floor(1000 * math.log(((t[b] + 1) * (ns + buckets)) / ((s[b] + 1) * (nt + buckets)))) for b in map(bucket, fs))
        score = weight + math.floor(-1000 * math.log(-math.log((draws(seed, doc_id)[0] + 0.5) / 4294967296)))
        rows.append([doc_id, len(fs), weight, score, None, i, len(words(d))])
    fit = sorted((r for r in rows if r[6] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[5]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("longest", [1, 2])
def test_draws_equal_those_of_all_counts_at_once(spark, longest):
    rng = random.Random(3)
    vocabulary = ["The", "of", "naïve", "ÉTÉ", "x1", "42", "İ", "ſ", "K", "word", "日本", "a_b", "don't"] + [f"w{i}" for i in range(200)]
    texts = [None, "", "...", "one", "The " * 30_000] + [" ".join(rng.choices(vocabulary, k=rng.choice([1, 19, 20, 21, 80]))) for _ in range(300)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, texts[7]), (None, "some words " * 12), (None, None)]
    target = [" ".join(rng.choices(vocabulary[:20], k=30)) for _ in range(10)] + [None, ""]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, bucket int, score int").repartition(5)
    aim = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    got = importance.resample(frame, aim, 30, 20, longest, 50, 11).collect()
    assert sorted(map(tuple, got), key=repr) == resampled(docs, target, 30, 20, longest, 50, 11)
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert all(b - a == 1 for a, b in pairwise(ranks)) and ranks[0] == 1
    empty = importance.resample(frame.limit(0), aim)
    assert empty.columns == ["doc_id", "n_features", "weight", "score", "rank"] and empty.count() == 0
    none = importance.resample(frame, aim.limit(0), 30, 20, longest, 50, 11).collect()
    assert sorted(map(tuple, none), key=repr) == resampled(docs, [], 30, 20, longest, 50, 11)
