"""Coverage counted by programmes, without the relation of courses and records that it stands for."""

from __future__ import annotations

from dataclasses import replace

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from skillgrid.plans import audit, registry
from skillgrid.sources.graph import from_tables


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The small tables with courses and parts twice, a course of two careers, negative and missing keys."""
    folder = str(tmp_path_factory.mktemp("odd"))
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        df = spark.read.parquet(f"{SMALL}/{name}.parquet")
        if name == "supplier":
            kinds = dict(df.dtypes)
            more = [df, df.filter("s_suppkey < 4").withColumn("s_nationkey", F.lit(12).cast(kinds["s_nationkey"])), df.withColumn("s_nationkey", F.lit(3).cast(kinds["s_nationkey"])), df.withColumn("s_suppkey", F.col("s_suppkey") + 700).withColumn("s_nationkey", F.lit(12).cast(kinds["s_nationkey"]))]
            more += [df.withColumn("s_suppkey", F.col("s_suppkey") + 1400).withColumn("s_nationkey", F.lit(6).cast(kinds["s_nationkey"])), df.withColumn("s_suppkey", -F.col("s_suppkey") - 100), df.limit(1).withColumn("s_suppkey", F.lit(None).cast("long")).withColumn("s_nationkey", F.lit(3).cast(kinds["s_nationkey"]))]
        elif name == "part":
            more = [df, df.filter("p_partkey < 50"), df.filter("p_partkey < 30").withColumn("p_name", F.lit("otra")), df.withColumn("p_partkey", -F.col("p_partkey") - 100), df.limit(1).withColumn("p_partkey", F.lit(None).cast("long"))]
        else:
            more = [df]
        for i, part in enumerate(more):
            part.coalesce(1).write.mode("append" if i else "error").parquet(f"{folder}/{name}.parquet")
    return from_tables(spark, folder)


PLANS = ["cobertura_curricular", "brechas_demanda_alta", "senales_revision_vigencia", "cursos_con_mayor_correspondencia"]
NAMES = sorted(
    [f"{p}__{view}" for p in PLANS for view in ("general", "especifica")] + [f"dash_{p}_{d}" for p in ("cobertura", "brechas") for d in ("competencia", "habilidad", "herramienta")]
    + ["tpl_herramientas_de_carrera", "tpl_cursos_para_competencia", "op_interseccion", "op_diferencia", "op_union", "op_conocimientos_comunes", "op_silabos_de_competencia", "catalogo_conteos", "grafo_integridad", "metadatos_topologia"]
)

#: They ask for an element that no course covers in these tables.
UNCOVERED = ("op_silabos_de_competencia", "tpl_cursos_para_competencia")


@pytest.mark.parametrize("name", NAMES)
def test_programmes_count_what_the_relation_counts(odd, name):
    build = registry.plans()[name]
    got, want = build(odd), build(replace(odd, programas=None))
    assert got.dtypes == want.dtypes
    rows = sorted(map(repr, got.collect()))
    assert rows == sorted(map(repr, want.collect())) and (rows or name in UNCOVERED)


def test_courses_that_cover_an_element(odd):
    known = odd.cubre.select("conocimiento").distinct().orderBy("conocimiento").first()[0]
    got, want = odd.covering(known), replace(odd, programas=None).covering(known)
    assert sorted(got.collect()) == sorted(want.collect()) != []


@pytest.mark.parametrize("name", NAMES)
def test_no_plan_makes_the_relation(spark, name):
    """Its rows grow with courses times parts: they are an error here."""
    g = from_tables(spark, SMALL)
    broken = g.cubre.select(*[F.raise_error(F.lit("made")).cast(t).alias(c) for c, t in g.cubre.dtypes])
    registry.plans()[name](replace(g, cubre=broken, programas=replace(g.programas, cubre=broken))).collect()


def test_programmes_pass_the_audit_and_go_with_their_relation(spark):
    g = from_tables(spark, SMALL)
    assert audit.audit(g, registry.plans(), registry.PERIODS) == {}
    assert g.shared() is g.programas and replace(g, cubre=g.cubre.limit(0)).shared() is None
    assert replace(g, cubre=g.cubre.limit(0)).rows("cubre").first().n == 0 < g.rows("cubre").first().n == g.cubre.count()
