"""Questions: folding, intents, and the index of name fragments against comparing everything."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from skillgrid.functions import text
from skillgrid.operators import questions, resolver

NFKD = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
plain = lambda t: " ".join(re.sub("[^a-z0-9]+", " ", NFKD(t)).split())


def test_folding_equals_decomposition_over_the_latin_blocks(spark):
    letters = [chr(c) for c in text.LATIN if unicodedata.category(chr(c))[0] in "LNM"]
    samples = [f"x{c}y {c}" for c in letters] + ["".join(letters), "Ⅷ", "ő̈ş̌", "Ǆ ǅ ŉ ﬁ", "İstanbul ıI", "ÁÉÍÓÚ ñÑ üÜ", "éö", None, "", "  ¿Cuántas?  "]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", text.clean("t").alias("c")).collect()}
    inside = lambda s: all(ord(c) < 0x80 or ord(c) in text.LATIN or unicodedata.combining(c) for c in s)
    for i, s in enumerate(samples):
        assert (got[i] is None) if s is None else (got[i] == plain(s) or not inside(s)), s


def test_intents_take_the_highest_priority(spark):
    asked = ["cuantos cursos tiene la carrera de Derecho", "cursos de Derecho", "¿Cu ntas carreras hay?", "herramientas de la carrera y ademas ofertas", "top empresas dirigidas", None, "", "hola Mundo", "competencias mas demandadas para Derecho"]
    df = spark.createDataFrame(list(enumerate(asked)), "question_id int, text string")
    got = {r.question_id: (r.template, r.label, r.terms) for r in questions.intents(df, every=True).collect()}
    assert got[0] == ("contar_cursos_de_carrera", "carrera", ["derecho"]) and got[1] == ("cursos_de_carrera", "carrera", ["derecho"])
    assert got[2][0] == "contar_carreras" and got[3][0] is None and got[4][0] is None
    assert got[5] == got[6] == (None, None, []) and got[7] == (None, None, ["hola", "mundo"]) and got[8] == ("top_competencias_ofertas", None, ["derecho"])
    assert {r.question_id for r in questions.intents(df).collect()} == {0, 1, 2, 8}


def resolved(asked, names):
    """By comparing every question with every name."""
    out = []
    for key, label, terms in asked:
        terms = [t for t in terms or [] if t]
        for tried in [label] if label else resolver.LABELS:
            fits = [(len(n), n, i) for x, i, n in names if x == tried and n is not None and terms and all(t in plain(n) for t in terms)]
            if fits:
                out.append((key, tried, min(fits)[2], min(fits)[1]))
                break
    return sorted(out)


def sample(n, seed):
    rng = random.Random(seed)
    syllables = ["ba", "na", "é", "ri", "to", "x", "que", "lo", "mí", "ns", "7"]
    name = lambda: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 3)))
    names = [(rng.choice(resolver.LABELS), f"I{i % (n // 2)}", name() if i % 17 else rng.choice([None, "", "--"])) for i in range(n)]
    asked = []
    for k in range(n):
        _, _, base = rng.choice(names)
        parts = plain(base or "zz").split() or [""]
        terms = rng.choice([[rng.choice(parts)[: rng.randint(1, 5)]], [p[rng.randint(0, 1) :] for p in parts], ["qzq"], [], None, [None, "na", "na"], ["a"]])
        asked.append((k, rng.choice([None, *resolver.LABELS, "nothing"]), terms))
    return names, asked


@pytest.mark.parametrize("seed", [1, 2])
def test_names_are_found_as_by_comparing_all(spark, seed):
    names, asked = sample(400, seed)
    got = resolver.resolve(spark.createDataFrame(asked, "question_id int, label string, terms array<string>"), spark.createDataFrame(names, "label string, id string, nombre string"))
    assert sorted(map(tuple, got.collect())) == resolved(asked, names)
    nobody = resolver.resolve(spark.createDataFrame([], "question_id int, label string, terms array<string>"), spark.createDataFrame(names, "label string, id string, nombre string"))
    assert nobody.count() == 0


def test_no_join_is_on_the_label_alone(spark):
    names, asked = sample(50, 3)
    df = resolver.resolve(spark.createDataFrame(asked, "question_id int, label string, terms array<string>"), spark.createDataFrame(names, "label string, id string, nombre string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "fragment" in plan
    keys = [line for line in plan.splitlines() if "Join " in line]
    assert keys and all("fragment" in k or "terms" in k for k in keys)


def test_candidates_grow_with_names_and_questions(spark):
    """Names of random letters: each question meets about as many names as share its rarest fragment, not all."""
    rng, share = random.Random(4), []
    for n in (200, 400, 800):
        word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8))
        names = [("empresa", str(i), word()) for i in range(n)]
        asked = [("empresa", [x[2][1:7]]) for x in names]
        pool = resolver.index(spark.createDataFrame(names, "label string, id string, nombre string"))
        found = resolver.candidates(spark.createDataFrame(asked, "label string, terms array<string>"), pool).count()
        share.append(found / n)
    assert max(share) < 1.2 and share[2] <= share[0] * 1.2


def test_mentions_keep_the_first_place(spark):
    turns = spark.createDataFrame([(1, 1, "Banco, banco de Arte y Derecho"), (1, 2, None), (None, 1, "ARTE"), (2, 1, "")], "conv_id int, turn int, text string")
    names = spark.createDataFrame([("empresa", "E", "El Banco"), ("carrera", "A", "Arte"), ("carrera", "D", "Derecho"), ("curso", "X", "Banco de arte")], "label string, id string, nombre string")
    got = questions.mentions(turns, names).select("conv_id", "turn", "place", "label", "id").orderBy(F.asc_nulls_last("conv_id"), "place").collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, "curso", "X"), (1, 1, 2, "carrera", "A"), (1, 1, 3, "carrera", "D"), (None, 1, 0, "carrera", "A")]
