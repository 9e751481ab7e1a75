"""Guards on plans: ad-hoc SQL, the meaning of joins, and the audit of all registered plans."""

from __future__ import annotations

import minigraph
import pytest
from conftest import SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from skillgrid.operators import adhoc, topology
from skillgrid.plans import audit, metadata, registry


@pytest.fixture(scope="module")
def g(spark):
    return minigraph.build(spark)


@pytest.fixture(scope="module")
def guard(g, spark):
    @udtf(returnType="x string")
    class Shell:
        def eval(self, _):
            yield ("ran",)

    spark.udtf.register("shell", Shell)
    spark.udf.register("mine", lambda x: x)
    spark.range(5).createOrReplaceTempView("other")
    return adhoc.Guard(g, "mini_")


WRONG = (
    "DROP VIEW mini_carrera", "SELECT 1; SELECT 2", "SET spark.x=1", "INSERT INTO mini_carrera VALUES (1)", "EXPLAIN SELECT 1", "DESCRIBE mini_carrera", "EXECUTE IMMEDIATE 'SELECT 1'", "", "SELECT FROM WHERE",
    "SELECT * FROM nothing_here", "SELECT * FROM other", "SELECT carrera FROM mini_carrera WHERE carrera IN (SELECT id FROM other)", "SELECT (WITH q AS (SELECT * FROM other) SELECT max(id) FROM q)", "SELECT * FROM mini_carrera) UNION ALL (SELECT * FROM other", "SELECT nothing FROM mini_carrera",
    "SELECT * FROM parquet.`/etc`", "SELECT * FROM parquet/**/.`/etc`", f"SELECT * FROM `parquet`.`{SMALL}/region.parquet`", "SELECT * FROM spark_catalog.default.mini_carrera",
    "SELECT * FROM shell(1)", "SELECT a.carrera FROM mini_carrera a, LATERAL shell(a.carrera)", "SELECT mine(carrera) FROM mini_carrera", "SELECT * FROM range(10)", "SELECT * FROM explode(array(1))",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT reflect('java.util.UUID', 'randomUUID')", "SELECT upper(java_method('java.lang.System', 'lineSeparator')) FROM mini_carrera", "SELECT (SELECT first(x) FROM (SELECT java_method('java.lang.System', 'lineSeparator') AS x FROM mini_carrera)) AS x",
    "SELECT TRANSFORM(carrera) USING 'cat' AS (y string) FROM mini_carrera", "SELECT input_file_name() FROM mini_carrera", "SELECT current_user()", "SELECT rand()", "SELECT raise_error('x')", "SELECT explode(sequence(1, 1000000000))", "SELECT * FROM mini_carrera TABLESAMPLE (10 PERCENT)",
    "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 5) SELECT * FROM t",
    "SELECT count(*) FROM mini_oferta a, mini_oferta b, mini_oferta c", "SELECT count(*) FROM mini_oferta a JOIN mini_oferta b ON a.fecha < b.fecha",
)


@pytest.mark.parametrize("query", WRONG)
def test_adhoc_sql_reads_the_graph_only(guard, query):
    with pytest.raises(adhoc.Rejected):
        guard.checked(query)


RIGHT = (
    "WITH c AS (SELECT carrera, count(*) AS n FROM mini_ensenia GROUP BY carrera) SELECT carrera, n, rank() OVER (ORDER BY n DESC) AS k FROM c WHERE carrera IN (SELECT carrera FROM mini_carrera) UNION ALL SELECT 'x', 0, 0 ORDER BY carrera",
    "SELECT e.empresa_nombre, count(DISTINCT p.oferta) AS n, coalesce(max(o.fecha), timestamp_ntz'2020-01-01') AS f FROM mini_empresa e LEFT JOIN mini_publica p USING (empresa) LEFT JOIN mini_oferta o ON o.oferta = p.oferta GROUP BY ALL HAVING count(*) > 0 ORDER BY n DESC, 1",
    "SELECT date_trunc('month', fecha) AS m, date_format(fecha, 'yyyy-MM') AS s, count(*) FILTER (WHERE oferta <> 'x') AS n, percentile_approx(length(oferta), 0.5) AS p FROM mini_oferta GROUP BY GROUPING SETS ((fecha), ())",
    "SELECT DISTINCT k.conocimiento_nombre, try_divide(1, 0) AS d, extract(YEAR FROM date'2020-01-01') AS y, trim(' a ') AS t FROM mini_requiere r JOIN mini_conocimiento k USING (conocimiento) WHERE EXISTS (SELECT 1 FROM mini_dirige d WHERE d.oferta = r.oferta)",
    "SELECT dimension, array_join(sort_array(collect_set(conocimiento_nombre)), ', ') AS x FROM mini_conocimiento GROUP BY dimension",
    "SELECT c.carrera, t.n FROM mini_carrera c, LATERAL (SELECT count(*) AS n FROM mini_ensenia e WHERE e.carrera = c.carrera) t",
    "SELECT * FROM (SELECT dimension AS d, conocimiento FROM mini_conocimiento) PIVOT (count(conocimiento) FOR d IN ('competencia', 'habilidad'))",
    "SELECT * FROM mini_oferta, (SELECT max(fecha) AS last FROM mini_oferta) WHERE fecha = last",
    "SELECT * FROM mini_carrera CROSS JOIN (SELECT count(*) AS n FROM mini_oferta)",
)


@pytest.mark.parametrize("query", RIGHT)
def test_queries_over_the_graph_run(guard, query):
    assert guard.checked(query).count() > 0


def test_values_are_bound_and_rows_bounded(guard):
    assert [r.n for r in guard.checked("SELECT count(*) AS n FROM mini_carrera WHERE carrera <> :x", {"x": "C3' OR '1' = '1"}).collect()] == [3]
    assert guard.checked("SELECT oferta FROM mini_oferta", limit=2).count() == 2


def test_joins_follow_the_graph(guard):
    """Pairs are named; self-joins, common tables, subqueries and joins written as conditions are looked through."""
    wrong = {
        "SELECT * FROM mini_publica p JOIN mini_carrera c ON p.oferta = c.carrera": "publica.oferta and carrera.carrera",
        "SELECT * FROM mini_publica p, mini_ensenia e WHERE p.empresa = e.curso": "publica.empresa and ensenia.curso",
        "WITH a AS (SELECT oferta AS x, empresa AS y FROM mini_publica) SELECT * FROM a JOIN a b ON a.x = b.y": "publica.oferta and publica.empresa",
        "SELECT * FROM mini_empresa e WHERE EXISTS (SELECT 1 FROM mini_ensenia x WHERE x.curso = e.empresa)": "ensenia.curso and empresa.empresa",
        "SELECT * FROM mini_empresa WHERE empresa NOT IN (SELECT industria FROM mini_agrupa)": "empresa.empresa and agrupa.industria",
        "SELECT * FROM mini_curso a JOIN mini_puesto b ON a.curso_nombre = b.puesto_nombre": "curso.curso_nombre and puesto.puesto_nombre",
        "SELECT * FROM (SELECT max(oferta) AS m FROM mini_publica GROUP BY empresa) a JOIN mini_dirige d ON a.m = d.carrera": "publica.oferta and dirige.carrera",
        "SELECT * FROM (SELECT curso AS k FROM mini_ensenia UNION ALL SELECT carrera FROM mini_carrera) u JOIN mini_curso c ON u.k = c.curso": "carrera.carrera, ensenia.curso and curso.curso",
        "SELECT * FROM mini_empresa e LEFT JOIN (SELECT empresa, count(oferta) AS n FROM mini_publica GROUP BY empresa) p ON p.n = e.empresa": "publica.oferta and empresa.empresa",
    }
    for query, pair in wrong.items():
        with pytest.raises(adhoc.Rejected, match=pair):
            guard.checked(query)
    for query in (
        "SELECT * FROM mini_publica p JOIN mini_dirige d USING (oferta) JOIN mini_ensenia e USING (carrera) JOIN mini_cubre k USING (curso) JOIN mini_requiere r ON r.conocimiento = k.conocimiento AND r.oferta = p.oferta",
        "WITH n AS (SELECT carrera, count(*) AS n FROM mini_dirige GROUP BY carrera) SELECT * FROM n a JOIN n b ON a.n = b.n AND a.carrera < b.carrera",
        "SELECT * FROM (SELECT max(oferta) AS m FROM mini_publica GROUP BY empresa) a JOIN mini_dirige d ON a.m = d.oferta",
        "SELECT * FROM mini_publica a JOIN mini_publica b ON a.empresa = b.empresa AND a.oferta <> b.oferta",
    ):
        guard.checked(query)


@pytest.mark.parametrize(
    ("query", "why"),
    [
        ("SELECT empresa FROM mini_empresa WHERE empresa_nombre LIKE '%a%'", "names are searched"),
        ("SELECT e.empresa FROM (SELECT empresa, lower(empresa_nombre) AS n FROM mini_empresa) e WHERE contains(n, 'a')", "names are searched"),
        ("SELECT lower(empresa_nombre) AS n FROM mini_empresa", "a folded name is shown"),
        ("SELECT n FROM (SELECT upper(empresa_nombre) AS n, empresa FROM mini_empresa) JOIN mini_publica USING (empresa)", "a folded name is shown"),
        ("SELECT collect_list(empresa) AS x FROM mini_empresa", "x isn't a plain value"),
        ("SELECT named_struct('a', empresa) AS x FROM mini_empresa", "x isn't a plain value"),
    ],
)
def test_generated_sql_is_linted(guard, query, why):
    with pytest.raises(adhoc.Rejected, match=why):
        guard.checked(query, generated=True)
    guard.checked(query)  # only generated queries are held to these rules


def test_generated_sql_may_try_twice(guard, g):
    seen = []

    def generate(question, schema, error):
        seen.append(error)
        return "SELECT * FROM nothing_here" if error is None else "SELECT empresa_nombre FROM mini_empresa WHERE empresa_nombre = 'Casa'"

    assert [tuple(r) for r in guard.answered("uno", metadata.schema_text(g), generate).collect()] == [("Casa",)] and len(seen) == 2
    with pytest.raises(adhoc.Rejected):
        guard.answered("uno", "", lambda *_: "SELECT 1 AS uno, array(1) AS dos")


def test_every_registered_plan_passes_the_audit(g):
    plans = registry.plans()
    assert len(plans) >= 72 and registry.PERIODS <= set(plans) and len(registry.PERIODS) >= 20
    assert audit.audit(g, plans, registry.PERIODS) == {}


def test_the_audit_finds_planted_faults(g):
    bad = {
        "product": lambda g: g.publica.crossJoin(g.requiere.select("conocimiento")),
        "topology": lambda g: g.publica.join(g.carrera, g.publica.oferta == g.carrera.carrera),
        "window": lambda g: g.oferta.withColumn("k", F.row_number().over(Window.orderBy("fecha"))),
        "period": lambda g: g.oferta.join(g.dirige, "oferta").groupBy("carrera").agg(F.max("fecha")),
        "period above a sum": lambda g: g.oferta.groupBy("oferta").agg(F.max("fecha").alias("f")).filter("f > '2025-01-01'"),
        "column": lambda g: g.oferta.select("nothing"),
    }
    out = audit.audit(g, bad, frozenset(("period", "period above a sum")))
    assert set(out) == set(bad) and out["period"] == out["period above a sum"] == ["offers are read without their period"]
    fine = {"picked": lambda g: g.publica.crossJoin(g.carrera.filter("carrera = 'C1'")), "total": lambda g: g.publica.crossJoin(g.oferta.agg(F.max("fecha"))), "ranked": lambda g: g.oferta.orderBy("fecha").limit(9).withColumn("k", F.row_number().over(Window.orderBy("fecha")))}
    assert audit.audit(g, fine) == {}
    assert topology.KEYS["cubre", "curso"] == "curso" and ("conocimiento", "dimension") not in topology.KEYS
