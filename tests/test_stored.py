"""A graph as tables: written and read back, its faults, what it holds, and reports of runs."""

from __future__ import annotations

from dataclasses import replace

import minigraph
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from skillgrid.plans import metadata, registry
from skillgrid.plans.catalog import BY_SLUG
from skillgrid.sinks import report
from skillgrid.sources import stored
from skillgrid.sources.graph import from_tables


@pytest.fixture(scope="module")
def g(spark):
    return minigraph.build(spark)


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("graph"))
    stored.write(from_tables(spark, SMALL), folder)
    return stored.read(spark, folder)


LEFT_OUT = {"metadatos_propiedades", "grafo_integridad", "metadatos_topologia"}


@pytest.mark.parametrize("name", sorted(set(registry.plans()) - LEFT_OUT))
def test_a_stored_graph_answers_alike(spark, kept, name):
    build = registry.plans()[name]
    got, want = build(kept), build(from_tables(spark, SMALL))
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_what_a_graph_holds_survives_too(spark, kept):
    for name in LEFT_OUT:
        build = registry.plans()[name]
        assert sorted(map(repr, build(kept).collect())) == sorted(map(repr, build(from_tables(spark, SMALL)).collect()))


def test_periods_are_read_from_their_months(kept):
    def scan(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()

    for df in (kept.between("1998-01-01", "1998-03-01"), kept.recent()):
        assert "PartitionFilters: [isnotnull(mes" in scan(df)
    assert "orders" not in kept.cutoff()._jdf.queryExecution().optimizedPlan().toString() and "hasta" in kept.cutoff()._jdf.queryExecution().optimizedPlan().toString()


def test_other_names_are_found_by_rule(spark, g, tmp_path):
    folder = str(tmp_path / "g")
    stored.write(g, folder)
    spark.read.parquet(f"{folder}/carrera").select(F.col("carrera").alias("id_carrera"), F.lit("x").alias("nombre_norm"), F.col("carrera_nombre").alias("nombre_carrera")).write.parquet(f"{folder}/c2")
    spark.read.parquet(f"{folder}/dirige").select(F.col("carrera").alias("id_carrera"), F.col("oferta").alias("id_oferta")).write.parquet(f"{folder}/d2")
    (tmp_path / "g" / "carrera").rename(tmp_path / "old_c")
    (tmp_path / "g" / "dirige").rename(tmp_path / "old_d")
    (tmp_path / "g" / "c2").rename(tmp_path / "g" / "carrera")
    (tmp_path / "g" / "d2").rename(tmp_path / "g" / "dirige")
    h = stored.read(spark, folder)
    assert sorted(h.carrera.collect()) == sorted(g.carrera.collect()) and sorted(h.dirige.collect()) == sorted(g.dirige.collect())
    (tmp_path / "g" / "publica").rename(tmp_path / "old_p")
    spark.range(3).write.parquet(f"{folder}/empresa", mode="overwrite")
    with pytest.raises(stored.Malformed, match=r"empresa has no empresa_nombre, tipo.*publica can't be read"):
        stored.read(spark, folder)
    assert stored.id_property(["x", "id"]) == "id" and stored.id_property(["a"]) is None and stored.name_property(["nombre_norm", "nombre_x"]) == "nombre_x" and stored.name_property(["nombre_x", "nombre"]) == "nombre" and stored.name_property(["nombre_norm"]) is None


def test_a_graph_without_months_reads_as_well(spark, g, tmp_path):
    folder = str(tmp_path / "g")
    stored.write(g, folder)
    (tmp_path / "g" / "meses").rename(tmp_path / "meses")
    h = stored.read(spark, folder)
    assert h.meses is None and h.oferta.columns == ["oferta", "fecha"] and h.recent().count() == g.recent().count() == 10
    spark.createDataFrame([("O99", None)], "oferta string, fecha timestamp_ntz").withColumn("mes", F.lit("sin fecha")).write.mode("append").partitionBy("mes").parquet(f"{folder}/oferta")
    stored.refresh_months(spark, folder)
    assert {r.mes: r.n for r in stored.read(spark, folder).meses.collect()}["sin fecha"] == 2


def test_faults_are_named_by_triple(spark, g):
    assert {(r.problema.split()[-1]) for r in stored.integrity(g).filter("n > 0").collect()} == {"frecuente"}
    bad = replace(
        g,
        carrera=g.carrera.unionByName(spark.createDataFrame([("C1", "Otra"), (None, "Nula"), (None, "Nula")], g.carrera.schema)),
        dirige=g.dirige.unionByName(spark.createDataFrame([("O1", "C9"), ("O98", "C9"), (None, "C1"), ("O2", None)], g.dirige.schema)),
        publica=g.publica.unionByName(g.publica.filter("oferta IN ('O1', 'O2')")).unionByName(g.publica.filter("oferta = 'O1'")),
    )
    found = {(r.objeto, r.problema): (r.n, r.ejemplo) for r in stored.integrity(bad).filter("n > 0 AND problema NOT LIKE '%frecuente'").collect()}
    assert found == {
        ("carrera", "repetido"): (1, "C1"), ("carrera", "nulo"): (2, None), ("oferta-DIRIGE_A-carrera", "destino inexistente"): (1, "C9"), ("oferta-DIRIGE_A-carrera", "origen inexistente"): (1, "O98"), ("oferta-DIRIGE_A-carrera", "origen nulo"): (1, None),
        ("oferta-DIRIGE_A-carrera", "destino nulo"): (1, None), ("empresa-PUBLICA-oferta", "repetida"): (2, "EA O1"),
    }
    hot = {(r.objeto, r.problema): r.n for r in stored.integrity(g, 0.5).collect() if "frecuente" in r.problema}
    assert hot["empresa-PUBLICA-oferta", "origen muy frecuente"] == 0 and hot["industria-AGRUPA-empresa", "origen muy frecuente"] == 0 and hot["facultad-OFRECE-carrera", "origen muy frecuente"] == 1
    none = replace(g, **{k: df.limit(0) for k, df in g.frames().items()})
    assert {r.n for r in stored.integrity(none).collect()} == {0}


def test_sketches_add_up(spark):
    """Distinct counts stay within four standard errors, and parts add up to the whole."""
    g = from_tables(spark, SMALL.replace("sf0.001", "sf0.1"))
    true = {(label, c): getattr(g, label).agg(F.count_distinct(c)).first()[0] for label, c in (("oferta", "oferta"), ("oferta", "fecha"), ("empresa", "empresa"), ("conocimiento", "dimension"))}
    whole = {(r.label, r.propiedad): r.d for r in metadata.sketches(g).withColumn("d", metadata.distinct()).collect()}
    parts = [metadata.sketches(replace(g, oferta=g.oferta.filter(f"oferta % 3 = {k}"), empresa=g.empresa.filter(f"empresa % 3 = {k}"))) for k in range(3)]
    added = {(r.label, r.propiedad): (r.d, r.filas) for r in metadata.merged(*parts).withColumn("d", metadata.distinct()).collect()}
    for k, n in true.items():
        assert abs(whole[k] - n) <= 4 * 0.0163 * n + 1 and abs(added[k][0] - n) <= 4 * 0.0163 * n + 1, k
    assert added["oferta", "oferta"][1] == g.oferta.count()


def test_the_schema_names_ids_names_and_samples(g):
    out = metadata.schema_text(g)
    assert "- carrera: carrera string*, carrera_nombre string'" in out and "- oferta REQUIERE conocimiento (17)" in out and "- carrera: Arte | Derecho | Sistemas" in out


def test_runs_are_reported_once(spark, g, tmp_path):
    folder = str(tmp_path / "out")
    params = {"brechas_demanda_alta": {"carrera_id": "C1", "industria_id": "I1", "tipo_conocimiento": "competencia", "desde": "2025-01-01", "hasta": "2026-01-01"}}
    views = {k: v for k, v in report.catalogue(g, params).items() if k[0] in ("brechas_demanda_alta", "tendencia_ofertas", "cobertura_curricular")}
    views["rota", "general"] = (g.carrera.select(F.expr("raise_error('no')")), {})
    for _ in range(2):  # the second run replaces the first
        first = report.run(spark, folder, "r1", views)
    report.run(spark, folder, "r2", {k: v for k, v in views.items() if k[0] == "tendencia_ofertas"})
    rows = {(r.run_id, r.slug, r.vista): r for r in report.reports(spark, folder).collect()}
    assert len(rows) == 6 == report.reports(spark, folder).count()
    assert rows["r1", "rota", "general"].estado == "error" and "no" in rows["r1", "rota", "general"].error and rows["r1", "rota", "general"].total_resultados is None
    for (slug, vista), (df, about) in views.items():
        if slug != "rota":
            r = rows["r1", slug, vista]
            back = report.results(spark, folder, "r1", slug, vista, df)
            assert r.estado == "ok" and r.total_resultados == back.count() == df.count() and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
            assert r.pregunta == BY_SLUG[slug].question and r.columnas == df.columns and r.duracion_segundos > 0 and ("C1" in r.parametros) == ("parametros" in about)
    assert {r.slug for r in first.collect()} == {k[0] for k in views}
    for wrong in ("", "a/b", "..", "a b"):
        with pytest.raises(ValueError):
            report.run(spark, folder, wrong, {})
