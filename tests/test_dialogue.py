"""The memory of conversations against a plain replay, in batch and as a stream, and what turns refer to."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from skillgrid.operators import dialogue
from skillgrid.streaming import memory

SCHEMA = "conv_id long, turn long, place int, at long, label string, id string, nombre string"
OUT = [f.split()[0] for f in memory.OUT.split(", ")]
key = lambda r: [(x is not None, str(type(x)), x if x is not None else 0) for x in r]


def said(seed=0, n=400, ids=True):
    rng = random.Random(seed)
    rows, at = [], {}
    for _ in range(n):
        c = rng.choice([1, 2, 3, 3, 3, None])
        turn, now = at.get(c, (0, 0))
        now += rng.choice([0, 1, 60, 900, 1799, 1800, 1801, 4000])
        at[c] = turn + 1, now
        for place in range(rng.randint(1, 3)):
            e = rng.choice("ABCDEFGHIJKL"[: rng.choice([2, 12])])
            rows.append((c, turn, place, now, rng.choice(["carrera", "empresa", "curso"]), e if ids or rng.random() < 0.5 else rng.choice([None, ""]), f"{rng.choice(['', ' '])}{e.lower() if rng.random() < 0.3 else e}"))
    return rows + [(9, 1, 0, 5, None, "A", "A"), (9, 2, 0, 5, "", "A", "A"), (9, 3, 0, 6, "carrera", "A", None), (9, 3, 0, 6, "carrera", "A", None)]


def replay(rows, history=dialogue.HISTORY, ttl=dialogue.TTL):
    """Mention by mention, with lists."""
    out, by = [], {}
    for r in rows:
        if r[4]:
            by.setdefault(r[0], []).append(r)
    for said_here in by.values():
        since = updated = None
        lists, counts = {}, {}
        for r in sorted(said_here, key=lambda r: key((r[3], r[1], r[2], *r[4:]))):
            if updated is None or r[3] - updated > ttl:
                since, lists, counts = r[3], {}, {}
            updated = r[3]
            mine = lists.setdefault(r[4], [])
            sign = lambda e: e[0] or "~" + (e[1] or "").strip().lower()
            if mine and sign(mine[-1]) == sign(r[5:]):
                mine[-1] = r[5:]
            else:
                mine.append(r[5:])
                del mine[:-history]
                counts[r[4]] = counts.get(r[4], 0) + 1
            out.append((*r, since, counts[r[4]], *(mine[-2] if len(mine) > 1 else (None, None)), *mine[0]))
    return sorted(out, key=key)


def test_memory_equals_a_replay(spark):
    for seed, ids, history, ttl in ((0, True, 8, 1800), (1, False, 8, 1800), (2, True, 3, 1800), (3, False, 2, 60), (4, True, 1, 10**9)):
        rows = said(seed, 300, ids)
        got = dialogue.memory(spark.createDataFrame(rows, SCHEMA).repartition(3), history, ttl)
        assert got.columns == OUT
        assert sorted(map(tuple, got.collect()), key=key) == replay(rows, history, ttl), seed
    assert dialogue.memory(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_stream_remembers_as_the_table_does(spark, tmp_path):
    rows = [r for r in said(5, 250, False) if r[0] is not None]
    rows.sort(key=lambda r: r[3])  # as they arrive
    for i in range(0, len(rows), 150):  # turns stay whole
        part = [r for k, r in enumerate(rows) if k // 150 == i // 150]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = memory.remembered(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), lateness="100000 seconds")
    query = stream.writeStream.outputMode("append").format("memory").queryName("remembered").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((tuple(r) for r in spark.table("remembered").select(*OUT).collect()), key=key)
    assert got == replay(rows)


def test_forgotten_state_is_dropped():
    state: dict = {}
    first = memory.advance(state, {"at": 0, "label": "carrera", "id": "A", "nombre": "A"})
    again = memory.advance(state, {"at": 1800, "label": "empresa", "id": "E", "nombre": "E"})
    late = memory.advance(state, {"at": 3601, "label": "carrera", "id": "B", "nombre": "B"})
    assert (first["since"], again["since"], late["since"]) == (0, 0, 3601) and late["previous"] is None and set(state["labels"]) == {"carrera"}


def test_turns_mean_what_was_in_mind_before_them(spark):
    mentions = [(1, 1, 0, 10, "carrera", "A", "Arte"), (1, 2, 0, 20, "carrera", "B", "Banca"), (1, 3, 0, 30, "carrera", "C", "Cine"), (1, 3, 1, 30, "empresa", "E", "Empresa"), (1, 8, 0, 9000, "curso", "K", "Curso"), (None, 1, 0, 5, "carrera", "N", "Nada")]
    turns = [
        (1, 1, 10, "esa carrera"), (1, 3, 30, "y la anterior de Cine"), (1, 4, 40, "¿Y LA ANTERIOR?"), (1, 5, 50, "la primera mencionada"), (1, 6, 60, "esta y el primero"), (1, 7, 1831, "ESO"), (1, 9, 9001, "dicha"), (1, 10, 9002, "establo o presente, cueste"),
        (1, 11, 9003, None), (2, 1, 1, "esa"), (None, 2, 6, "la última"), (1, 4, 40, "nada"), (1, 12, 9004, "la últimaa"), (1, 13, 9005, "la anterior"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, at long, text string")
    got = dialogue.references(df, dialogue.memory(spark.createDataFrame(mentions, SCHEMA)))
    assert got.columns == ["conv_id", "turn", "kind", "label", "id", "nombre"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(
        [
            (1, 3, "previous", "carrera", "A", "Arte"), (1, 4, "previous", "carrera", "B", "Banca"), (1, 5, "first", "carrera", "A", "Arte"), (1, 5, "first", "empresa", "E", "Empresa"), (1, 6, "first", "carrera", "A", "Arte"), (1, 6, "first", "empresa", "E", "Empresa"),
            (1, 9, "active", "curso", "K", "Curso"), (None, 2, "active", "carrera", "N", "Nada"),
        ],
        key=key,
    )
    assert dialogue.references(df.limit(0), dialogue.memory(spark.createDataFrame(mentions, SCHEMA))).count() == 0
    assert dialogue.references(df, dialogue.memory(spark.createDataFrame([], SCHEMA))).count() == 0
    more = spark.createDataFrame([(1, 4, 40, "what about THAT one"), (1, 5, 50, "le précédent"), (1, 6, 60, "die erste")], "conv_id long, turn long, at long, text string")
    kinds = more.select(dialogue.reference("text", (dialogue.REFERENCES, dialogue.MORE_REFERENCES)))
    assert [r[0] for r in kinds.collect()] == ["active", "previous", "first"]


def test_blocks_are_summarised_or_kept(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(10)] + [(1, 0, "system", "s"), (2, 1, "user", "a"), (2, 2, "user", None), (2, 3, "assistant", None), (3, 1, "assistant", "x"), (None, 1, "user", "n"), (None, 2, "assistant", "m")]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    assert sorted((r.conv_id, r.turn, r.line) for r in dialogue.exchanges(df).filter("conv_id = 2").collect()) == [(2, 1, "P: a | R: "), (2, 2, "P:  | R: ")]
    got = sorted(map(tuple, dialogue.summaries(df, lambda lines: F.array_join(lines, "+"), 2).collect()), key=key)
    assert got == sorted([(1, 0, 2, "P: t0 | R: t1+P: t2 | R: t3", None), (1, 1, 2, "P: t4 | R: t5+P: t6 | R: t7", None), (1, 2, 1, None, "P: t8 | R: t9"), (2, 0, 2, "P: a | R: +P:  | R: ", None), (None, 0, 1, None, "P: n | R: m")], key=key)
    failed = dialogue.summaries(df, lambda lines: F.lit(None).cast("string"), 2).filter("conv_id = 1 AND block = 0").first()
    assert failed.summary is None and failed.pending == "P: t0 | R: t1\nP: t2 | R: t3"
    assert dialogue.summaries(df.limit(0)).count() == 0


def test_the_clock_runs_with_what_is_said(spark):
    turns = spark.createDataFrame([(1, 2, "abc"), (1, 1, "x" * 10), (1, 2, "é"), (1, 3, None), (2, 1, "")], "conv_id long, turn long, text string")
    assert sorted(map(tuple, dialogue.clock(turns).collect())) == [(1, 1, 10), (1, 2, 14), (1, 3, 14), (2, 1, 0)]
    assert dialogue.clock(turns.filter(F.lit(False))).count() == 0
