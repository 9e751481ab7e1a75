from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from skillgrid.llm import graph, lines, neardup

SCHEMA = "doc_id long, text string, id long, key string, h long, n int, component string"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingle_set(text, k=5):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes(sets, percent=75):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in sets}


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    base = [[word() for _ in range(rng.choice((1, 3, 5, 12, 60, 200)))] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base[:25]:
        for _ in range(rng.randint(1, 5)):
            c = list(b)
            for _ in range(rng.randint(0, 3)):
                c[rng.randrange(len(c))] = word()
            texts.append(" ".join(c))
    crowd = [word() for _ in range(120)]
    for _ in range(60):  # one large group, in which many pairs aren't similar
        c = list(crowd)
        for _ in range(rng.randint(0, 4)):
            c[rng.randrange(len(c))] = word()
        texts.append(" ".join(c))
    texts += [None, "", " \t\n", "ONE", "one", "É x", "é x"] + [" ".join(crowd)] * 20
    rng.shuffle(texts)
    return list(enumerate(texts, start=10))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "k", 1, 2, "c") for i, t in rows], SCHEMA)


def test_components_equal_brute_force(spark):
    rows = corpus()
    sets = {i: shingle_set(t) for i, t in rows}
    want = classes(sets)
    out = {r["doc_id"]: r for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in out.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_edges_of_the_input(spark):
    assert neardup.near_duplicates(frame(spark, [])).collect() == []
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (4, None)]
    out = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in neardup.near_duplicates(frame(spark, rows)).collect())
    assert out == [(-1, None, True), (3, 3, True), (4, 4, True), (5, 3, False), (5, 3, False)]


def test_long_text_of_one_word_and_long_documents(spark):
    long = "x" * 3_000_000 + " y"
    rows = [(1, long), (2, long), (3, " ".join(str(i) for i in range(200_000)))]
    out = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert out == {1: (1, 1), 2: (1, 1), 3: (3, 199_996)}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(2, 1), (3, 2), (9, 8)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 60)], [(5, None), (None, 5)]])
def test_components(spark, edges):
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for x in sorted(near):
        if x not in want:
            todo = [x]
            while todo:
                y = todo.pop()
                if y not in want:
                    want[y] = x
                    todo += near[y]
    assert got == want


def line_set(line, k=6):
    padded = "\n" * (k - 1) + line + "\n" * (k - 1)
    return {padded[i : i + k] for i in range(len(padded) - k + 1)}


def line_truth(rows, percent=75, least=20):
    seen = defaultdict(list)
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if i is not None and len(line) >= least and line.strip():
                seen[line].append((i, k))
    group = classes({line: line_set(line) for line in seen}, percent)
    whole = defaultdict(list)
    for line, where in seen.items():
        whole[group[line]] += where
    return {x for where in whole.values() for x in where if x != min(where)}


def test_lines_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    pool = [[word() for _ in range(rng.randint(4, 60))] for _ in range(30)]

    def line():
        w = list(rng.choice(pool))
        for _ in range(rng.choice((0, 0, 1, 2))):
            w[rng.randrange(len(w))] = word()
        return " ".join(w)

    rows = [(i, "\n".join([line() for _ in range(rng.randint(1, 4))] + ["short", "", "  "])) for i in range(60)] + [(70, None), (71, ""), (72, "ñandú áéíóú " * 4)]
    gone = line_truth(rows)
    docs = spark.createDataFrame([(i, t, "x", 5, 6) for i, t in rows], "doc_id long, text string, line string, h long, N_Lines long")
    out = lines.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "line", "h", "n_lines", "n_removed"]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()}
    for i, t in rows:
        all_lines = t.split("\n") if t is not None else []
        kept = [x for k, x in enumerate(all_lines) if (i, k) not in gone]
        assert got[i] == ("\n".join(kept) if t is not None else None, len(all_lines), len(all_lines) - len(kept))
    assert len(gone) > 30


def test_lines_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_lines(docs).collect() == []
    same = "the very same line of words"
    docs = spark.createDataFrame([(None, same), (2, same), (2, same), (3, same)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["text"], r["n_removed"]) for r in lines.dedup_lines(docs).collect()) == [(-1, same, 0), (2, same, 0), (2, same, 0), (3, "", 1)]


def test_lines_that_share_prefixes_stay(spark):
    block = "QUJDREVGR0hJSktM"
    texts = [
        "https://example.org/a/1", "https://example.org/b/2", block + "x1" * 20, block + "y2" * 20,
        "第一章これは長い文章の始まりです" + "春夏秋冬" * 5, "第一章これは長い文章の始まりです" + "東西南北" * 5,
        "The responsible department: procurement", "The responsible department: bookkeeping",
        "😀 one two three four five six " * 4 + "a", "😀 one two three four five six " * 4 + "a",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in lines.dedup_lines(docs).collect() if r["n_removed"]} == {9}


def test_shingles_of_lines(spark):
    texts = ["", "abc", "abcdefghi", "one two  three\tfour_and_more_letters five", "a😀b😀cd é 😀😀😀😀😀😀😀😀😀😀 x", "第一章 これはabc長いdefghijklmn文章", "x" * 40]
    df = spark.createDataFrame([(t,) for t in texts], "line string").withColumn("code", lines.coded())
    got = {r["line"]: r["s"] for r in df.select("line", lines.F.transform(lines.places(lines.F.col("code")), lambda i: lines.F.decode(lines.shingle(lines.F.col("code"), i), "UTF-32")).alias("s"), lines.elements("code")).collect()}
    assert {t: set(x) for t, x in got.items()} == {t: line_set(t) for t in texts}


def test_lines_that_differ_stay_and_small_edits_go(spark):
    base = "Every visitor has to sign the register at the front desk before going up to the offices."
    pairs = [
        ("https://www.example.com/about-us", "https://www.example.com/report/alpha/one", False), ("Total revenue in 2023: 1,999", "Total revenue in 2023: 1,234", False), ("Chapter seventeen: 4", "Chapter seventeen: 9", False),
        ("吾輩は猫である名前はまだ無いどこで生れたか", "吾輩は猫である名前はまだ無いどこで死んだか", False), (base, base.replace("visitor", "visjtor"), True), (base, base.replace("desk", "door"), True), (base, base.replace("register", "logbook"), True), (base, base.replace("offices", "kitchens"), True), (base, base.replace("register", "logbook").replace("desk", "door"), False),
        ("All rights reserved. Last updated on Monday, page 12 of 30", "All rights reserved. Last updated on Monday, page 13 of 30", True), ("Copyright 2023 Example Ltd, page 4 of 12", "Copyright 2023 Example Ltd, page 7 of 12", True),
        ("Copyright 2023 Example Limited, page 14 of 12", "Copyright 2023 Example Limited, page 27 of 12", True), ("Copyright 2023 Example, page 4 of 12", "Copyright 2021 Example, page 9 of 12", False),
    ]
    for first, second, gone in pairs:
        docs = spark.createDataFrame([(1, first), (2, second)], "doc_id long, text string")
        assert [r["n_removed"] for r in lines.dedup_lines(docs).orderBy("doc_id").collect()] == [0, int(gone)], (first, second)


def test_bands_find_similar_lines(spark):
    rng = random.Random(12)
    rows, similar = [], 0
    for i in range(1500):  # pairs of their own alphabet, just above the threshold
        letters = [chr(0x4E00 + 12 * i + k) for k in range(12)]
        line = [rng.choice(letters) for _ in range(rng.randint(24, 200))]
        first, last = "".join(line), line
        while True:
            more = list(last)
            more[rng.randrange(len(more))] = rng.choice(letters)
            a, b = line_set(first), line_set("".join(more))
            if 100 * len(a & b) < 75 * len(a | b):
                break
            last = more
        if last != line:
            similar += 1
            rows += [(2 * i, first), (2 * i + 1, "".join(last))]
    gone = lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert similar > 1000 and 0.99 * similar <= gone <= similar


def test_crowds_of_mixed_lines_lose_no_pair(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    template = [word() for _ in range(40)]

    def variant():
        w = list(template)
        for k in rng.sample(range(40), 8):
            w[k] = word()
        return w

    rows = []
    for i in range(200):  # strangers of one template, and pairs among them
        w = variant()
        rows.append((2 * i, " ".join(w)))
        w[rng.randrange(36)] = word()
        rows.append((2 * i + 1, " ".join(w)))
    gone = line_truth(rows)
    got = {(r["doc_id"], r["line_no"]) for r in lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(gone) > 150 and got <= gone and len(got) >= 0.99 * len(gone)


def test_crowds_of_mixed_documents_lose_no_pair(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    template = [word() for _ in range(120)]
    rows = []
    for i in range(300):
        own = [word() for _ in range(30)]
        rows.append((2 * i, " ".join(template + own)))
        own[rng.randrange(30)] = word()
        rows.append((2 * i + 1, " ".join(template + own)))
    sets = {i: shingle_set(t) for i, t in rows}
    want = classes(sets)
    out = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert len(set(want.values())) == 300 and sum(out[i] == want[i] for i in want) >= 0.99 * len(want)


def test_many_repeated_lines_of_one_text_go_in_linear_time(spark):
    """Ninety thousand removed lines of one text: comparing each with each would take minutes."""
    import time

    text = "\n".join(f"the line that is said again and again {k % 7} {'x' * (k % 3)}" for k in range(90_000))
    began = time.time()
    row = lines.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_removed"] >= 89_900 and row["n_lines"] == 90_000 and time.time() - began < 60


def test_superseded_tables_are_deleted(spark, tmp_path):
    from skillgrid.llm.scratch import cut, drop

    df = cut(spark.range(5))
    assert df.count() == 5
    files = df.inputFiles()
    drop(df)
    drop(spark.range(5))  # not one of ours
    import os

    assert files and not any(os.path.exists(f.removeprefix("file:")) for f in files)


def test_unlike_lines_of_a_region_are_not_written(spark):
    """Lines that meet by chance in a band are told apart where they meet, before their pair is shuffled."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(40)]
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(120)]
    texts += [t[:70] + "x" + t[71:] for t in texts[:30]]
    marks = lines.signatures(lines.split_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).cache()
    every = lines.forest.regions(marks, lines.ORDERS, 2)
    met = lines.forest._candidates(every.drop("sketch"), 12, None).filter("near")
    near = lines.forest._candidates(every, 12, lines.SKETCH_AGREE).filter("near")
    alike = lines.likely(met.select("a", "b"), marks)
    assert near.count() < met.count()
    assert alike.count() >= 30 and alike.exceptAll(near.select("a", "b")).isEmpty()


def test_crowds_are_sorted_where_no_table_is_broadcast(spark):
    """The orders' regions are a union; its parts must not be taken for one shuffle (Spark: "Can't zip RDDs")."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    template = [word() for _ in range(40)]
    rows = []
    for i in range(60):
        w = list(template)
        for k in rng.sample(range(40), 8):
            w[k] = word()
        rows.append((2 * i, " ".join(w)))
        w[rng.randrange(36)] = word()
        rows.append((2 * i + 1, " ".join(w)))
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    try:
        for name in names:
            spark.conf.set(name, "-1")
        got = {(r["doc_id"], r["line_no"]) for r in lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        for name in names:
            spark.conf.unset(name)
    gone = line_truth(rows)
    assert len(gone) > 40 and got <= gone and len(got) >= 0.99 * len(gone)


def test_shuffles_of_written_tables_are_deleted(spark):
    import glob
    import time

    from skillgrid.llm.scratch import cut

    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before = files()
    df = spark.range(1000).selectExpr("id % 100 AS k").groupBy("k").count()
    df.collect()
    assert files() - before, "a shuffle's files are seen"
    before = files()
    assert cut(df).count() == 100
    for _ in range(50):
        left = files() - before
        if len(left) <= 1:  # that of count() above
            break
        time.sleep(0.1)
    assert len(left) <= 1


def test_passes_over_orders_make_all_regions(spark):
    rng = random.Random(2)
    orders = lines.ORDERS
    marks = spark.createDataFrame([(i, [rng.randrange(9) for _ in range(32)], i) for i in range(40)], "id long, signature array<int>, sketch long")
    every = lines.forest.regions(marks, orders, 4)
    parts = [lines.forest.regions(marks, orders, 4, k, k + lines.forest.ORDERS_AT_ONCE) for k in range(0, len(orders), lines.forest.ORDERS_AT_ONCE)]
    assert [p.count() for p in parts] == [40 * lines.forest.ORDERS_AT_ONCE] * len(parts)
    rows = lambda df: {(r["id"], r["t"], r["key"]) for r in df.collect()}
    assert set().union(*map(rows, parts)) == rows(every)


def similar_sets(seed=6):
    """Sets over few elements, some of them frequent, others in one set only, and the pairs at 0.75."""
    rng = random.Random(seed)
    sets, often = {}, rng.sample(range(1 << 40), 30)
    rare = iter(rng.sample(range(1 << 40, 1 << 41), 9000))
    for i in range(80):
        if i % 2 and i > 1:
            s = set(sets[i - 1])
            for x in rng.sample(sorted(s), rng.randint(0, len(s) // 5)):
                s.remove(x)
        else:
            s = set(rng.sample(often, rng.randint(4, 25))) | {next(rare) for _ in range(rng.randint(1, 60))}
        sets[i] = s
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    return sets, want


@pytest.mark.parametrize("frequent", [250_000, 10, 0])
def test_exact_join_loses_no_pair_in_any_order(spark, monkeypatch, frequent):
    """Elements' counts are known only of the most frequent ones: the others' order is by chance."""
    monkeypatch.setattr(lines.forest, "FREQUENT", frequent)
    sets, want = similar_sets()
    df = spark.createDataFrame([(i, i, sorted(s)) for i, s in sets.items()], "id long, part long, elements array<long>")
    got = {(r["a"], r["b"]) for r in lines.forest.across(lines.forest.dealt(df), 75).collect()}
    assert len(want) > 20 and want <= got and len(got) < 3 * len(want)
    marked = lines.F.array(*[lines.F.lit(0).cast("long")] * lines.forest.MINIMA)
    got = {(r["a"], r["b"]) for r in lines.forest.across(lines.forest.dealt(df).withColumn("minima", marked), 75, lines.AGREE).collect()}
    assert want <= got


def test_packed_minima_tell_what_likely_tells(spark):
    rng = random.Random(9)
    base = [[rng.randrange(-(1 << 31), 1 << 31) for _ in range(32)] for _ in range(30)]
    rows = []
    for i, m in enumerate(base):
        other = [x if rng.random() < 0.45 else rng.randrange(-(1 << 31), 1 << 31) for x in m]
        rows += [(2 * i, m), (2 * i + 1, other)]
    marks = spark.createDataFrame(rows, "id long, signature array<int>")
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(30)], "a long, b long")
    want = {r["a"] for r in lines.likely(pairs, marks).collect()}
    of = lambda k: marks.select(lines.F.col("id").alias(k), lines.minima().alias(f"m_{k}"))
    apart = sum(lines.F.bit_count(lines.forest._bytes(lines.F.get("m_a", lines.F.lit(k)).bitwiseXOR(lines.F.get("m_b", lines.F.lit(k))))) for k in range(4))
    got = {r["a"] for r in pairs.join(of("a"), "a").join(of("b"), "b").filter(apart <= 32 - lines.AGREE).collect()}
    assert 0 < len(want) < 30 and got == want
