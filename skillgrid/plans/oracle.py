"""The catalogue's queries once more, as DuckDB SQL over the sales tables, written apart from the plans."""

from __future__ import annotations

from skillgrid.operators.dialogue import MORE_REFERENCES, REFERENCES
from skillgrid.operators.questions import STOP_WORDS
from skillgrid.plans.alignment import NO_CURRICULUM, NO_DIMENSION, NOT_ALL_DIMENSIONS
from skillgrid.plans.alignment import NO_OFFERS as NO_CONTEXT
from skillgrid.plans.companies import NO_DIFFERENCE, NO_OFFERS, NOT_FOUND
from skillgrid.plans.templates import TEMPLATES

_GRAPH = """
oferta AS (SELECT o_orderkey AS oferta, o_orderdate AS fecha FROM orders),
publica AS (SELECT o_custkey AS empresa, o_orderkey AS oferta FROM orders),
empresa AS (SELECT c_custkey AS empresa, c_name AS empresa_nombre, c_mktsegment AS tipo FROM customer),
agrupa AS (SELECT c_nationkey AS industria, c_custkey AS empresa FROM customer),
industria AS (SELECT n_nationkey AS industria, n_name AS industria_nombre FROM nation),
carrera AS (SELECT n_nationkey AS carrera, n_name AS carrera_nombre FROM nation WHERE n_nationkey < 14),
facultad AS (SELECT r_regionkey AS facultad, r_name AS facultad_nombre FROM region),
ofrece AS (SELECT n_regionkey AS facultad, n_nationkey AS carrera FROM nation WHERE n_nationkey < 14),
proveedor AS (SELECT * FROM supplier WHERE s_nationkey < 14 AND s_nationkey % 3 = 0),
curso AS (SELECT s_suppkey AS curso, s_name AS curso_nombre FROM proveedor),
silabo AS (SELECT s_suppkey AS curso, 'SIL-' || s_suppkey AS codigo, s_name AS sumilla FROM proveedor),
ensenia AS (SELECT s_nationkey AS carrera, s_suppkey AS curso FROM proveedor),
pieza AS (SELECT p_partkey, p_name, CASE WHEN p_type LIKE 'ECONOMY%' OR p_type LIKE 'STANDARD%' THEN 'competencia' WHEN p_type LIKE 'PROMO%' OR p_type LIKE 'SMALL%' THEN 'habilidad' ELSE 'herramienta' END AS dimension FROM part),
conocimiento AS (SELECT DISTINCT dimension || '|' || p_name AS conocimiento, p_name AS conocimiento_nombre, dimension FROM pieza),
cubre AS (SELECT DISTINCT s_suppkey AS curso, s_suppkey || '|' || p_partkey AS cobertura, dimension || '|' || p_name AS conocimiento FROM proveedor JOIN pieza ON p_partkey % 100 = s_suppkey % 100 WHERE s_suppkey % 4 <> 1 AND NOT (s_nationkey = 12 AND dimension = 'herramienta')),
dirige AS (SELECT DISTINCT l_orderkey AS oferta, s_nationkey AS carrera FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey < 14),
requiere AS (SELECT DISTINCT l_orderkey AS oferta, dimension || '|' || p_name AS conocimiento FROM lineitem JOIN pieza ON l_partkey = p_partkey),
primera AS (SELECT l_orderkey, min(l_partkey) AS p_partkey FROM lineitem GROUP BY l_orderkey),
puesto AS (SELECT o_orderkey AS puesto, CASE left(o_orderpriority, 1) WHEN '1' THEN 'Jefe de ' || p_name WHEN '2' THEN 'GERENTE ' || p_name WHEN '3' THEN 'Analista ' || p_name WHEN '4' THEN CASE WHEN o_orderkey % 2 = 0 THEN '  ' END WHEN '5' THEN 'Asistente de directorio ' || p_name END AS puesto_nombre
  FROM orders LEFT JOIN primera ON l_orderkey = o_orderkey LEFT JOIN part USING (p_partkey)),
ofrece_puesto AS (SELECT o_orderkey AS oferta, o_orderkey AS puesto FROM orders),
corte AS (SELECT max(fecha) AS corte, date_trunc('month', max(fecha)) - INTERVAL 11 MONTH AS inicio FROM oferta),
reciente AS (SELECT oferta, fecha FROM oferta, corte WHERE fecha >= inicio AND fecha <= corte),
cobertura AS (SELECT carrera, curso, cobertura, conocimiento, conocimiento_nombre, dimension FROM ensenia JOIN cubre USING (curso) JOIN conocimiento USING (conocimiento)),
total_carreras AS (SELECT count(*) AS total_carreras FROM carrera),
lider AS (SELECT oferta FROM ofrece_puesto JOIN puesto USING (puesto) WHERE regexp_matches(lower(puesto_nombre), '(^|[^a-z0-9])(jefe|gerente|director|directora|lider|supervisor|supervisora|chief|head of|team lead)($|[^a-z0-9])'))
"""
_N = "CAST(NULL AS BIGINT)"


def _sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([_GRAPH, *more])} {body}"


def _context(desde: str, hasta: str, carrera: object = None, industria: object = None) -> str:
    where = [f"fecha >= TIMESTAMP '{desde}'", f"fecha < TIMESTAMP '{hasta}'"]
    if carrera is not None:
        where.append(f"oferta IN (SELECT oferta FROM dirige WHERE carrera = {carrera})")
    if industria is not None:
        where.append(f"oferta IN (SELECT oferta FROM publica JOIN agrupa USING (empresa) WHERE industria = {industria})")
    return f"contexto AS (SELECT oferta, fecha FROM oferta WHERE {' AND '.join(where)})"


def _d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def catalogue(p: dict) -> dict[str, str]:
    """SQL of the 24 views; p holds the parameters of the specific ones."""
    ca, ind, fac, a, b, dim, desde, hasta, tdesde, thasta = (p[k] for k in ("carrera_id", "industria_id", "facultad_id", "empresa_a_id", "empresa_b_id", "tipo_conocimiento", "desde", "hasta", "tendencia_desde", "tendencia_hasta"))
    out: dict[str, str] = {}
    series = "strftime(periodo, '%Y-%m-%d') AS periodo_id, strftime(periodo, '%Y-%m-%d') AS periodo, n AS value, n AS ofertas, n AS numerator_n, CAST(NULL AS BIGINT) AS denominator_n, CASE WHEN n = 0 THEN 'no_data' ELSE 'available' END AS availability"
    out["tendencia_ofertas__general"] = _sql(
        f"SELECT {series} FROM serie", "meses AS (SELECT unnest(range(0, 12)) AS k)", "serie AS (SELECT inicio + to_months(CAST(k AS INTEGER)) AS periodo, (SELECT count(DISTINCT oferta) FROM oferta WHERE fecha >= inicio + to_months(CAST(k AS INTEGER)) AND fecha < inicio + to_months(CAST(k + 1 AS INTEGER))) AS n FROM corte, meses)"
    )
    out["tendencia_ofertas__especifica"] = _sql(
        f"SELECT {ca} AS carrera_id, {ind} AS industria_id, {series} FROM serie", _context(tdesde, thasta, ca, ind),
        f"meses AS (SELECT unnest(generate_series(date_trunc('month', TIMESTAMP '{tdesde}'), TIMESTAMP '{thasta}' - INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS periodo)",
        "serie AS (SELECT periodo, (SELECT count(DISTINCT oferta) FROM contexto WHERE date_trunc('month', fecha) = periodo) AS n FROM meses)",
    )
    ranked = f"value, value AS ofertas, {_d('value')} / total AS assignment_share, rank, value AS numerator_n, total AS denominator_n, total AS total_assignments, 'available' AS availability"

    def careers(offers: str) -> str:
        return f"filas AS (SELECT carrera AS carrera_id, carrera_nombre, value, CAST(sum(value) OVER () AS BIGINT) AS total, row_number() OVER (ORDER BY value DESC, carrera_nombre, carrera) AS rank FROM (SELECT carrera, carrera_nombre, count(DISTINCT oferta) AS value FROM {offers} GROUP BY ALL))"

    out["carreras_con_mayor_demanda__general"] = _sql(f"SELECT carrera_id, carrera_nombre AS carrera, {ranked} FROM filas WHERE rank <= 14", careers("reciente JOIN dirige USING (oferta) JOIN carrera USING (carrera)"))
    out["carreras_con_mayor_demanda__especifica"] = _sql(
        f"SELECT f.facultad AS facultad_id, facultad_nombre AS facultad, i.industria AS industria_id, industria_nombre AS industria, carrera_id, carrera_nombre AS carrera, {ranked} FROM filas, facultad f, industria i WHERE rank <= 14 AND f.facultad = {fac} AND i.industria = {ind}",
        _context(desde, hasta, None, ind), careers(f"contexto JOIN dirige USING (oferta) JOIN carrera USING (carrera) JOIN (SELECT carrera FROM ofrece WHERE facultad = {fac}) USING (carrera)"),
    )
    ind_cols = f"carrera AS carrera_id, carrera_nombre AS carrera, industria AS industria_id, industria_nombre AS industria, value, value AS ofertas, empresas, {_d('value')} / total AS assignment_share, rank, value AS numerator_n, total AS denominator_n, total AS total_assignments, 'available' AS availability"
    per = "SELECT carrera, carrera_nombre, industria, industria_nombre, count(DISTINCT oferta) AS value, count(DISTINCT empresa) AS empresas FROM {} JOIN dirige USING (oferta) JOIN carrera USING (carrera) JOIN publica USING (oferta) JOIN agrupa USING (empresa) JOIN industria USING (industria) {} GROUP BY ALL"
    out["industrias_por_carrera__general"] = _sql(
        f"SELECT {ind_cols}, industrias_activas FROM (SELECT *, row_number() OVER (ORDER BY total DESC, carrera_nombre, carrera) AS rank FROM filas WHERE k = 1) WHERE rank <= 14",
        f"filas AS (SELECT *, CAST(sum(value) OVER (PARTITION BY carrera) AS BIGINT) AS total, count(*) OVER (PARTITION BY carrera) AS industrias_activas, row_number() OVER (PARTITION BY carrera ORDER BY value DESC, industria_nombre, industria) AS k FROM ({per.format('reciente', '')}))",
    )
    out["industrias_por_carrera__especifica"] = _sql(
        f"SELECT {ind_cols} FROM filas WHERE rank <= 10", _context(desde, hasta, ca),
        f"filas AS (SELECT *, CAST(sum(value) OVER () AS BIGINT) AS total, row_number() OVER (ORDER BY value DESC, industria_nombre, industria) AS rank FROM ({per.format('contexto', f'WHERE carrera = {ca}')}))",
    )
    known = f"conocimiento AS conocimiento_id, conocimiento_nombre AS conocimiento, dimension, value, value AS ofertas, {_d('value')} / total AS percentage, rank, value AS numerator_n, total AS denominator_n, 'available' AS availability"
    asked = "SELECT conocimiento, conocimiento_nombre, dimension, count(DISTINCT oferta) AS value FROM {} JOIN requiere USING (oferta) JOIN conocimiento USING (conocimiento) {} GROUP BY ALL"
    out["conocimientos_mas_demandados__general"] = _sql(
        f"SELECT {known} FROM (SELECT *, (SELECT count(*) FROM reciente) AS total, row_number() OVER (PARTITION BY dimension ORDER BY value DESC, conocimiento_nombre, conocimiento) AS rank FROM ({asked.format('reciente', '')})) WHERE rank <= 5"
    )
    named = f"c.carrera AS carrera_id, carrera_nombre AS carrera, i.industria AS industria_id, industria_nombre AS industria"
    out["conocimientos_mas_demandados__especifica"] = _sql(
        f"SELECT {named}, {known} FROM carrera c, industria i, (SELECT *, (SELECT count(*) FROM contexto) AS total, row_number() OVER (ORDER BY value DESC, conocimiento_nombre, conocimiento) AS rank FROM ({asked.format('contexto', '')}) WHERE dimension = '{dim}') WHERE rank <= 20 AND c.carrera = {ca} AND i.industria = {ind}",
        _context(desde, hasta, ca, ind),
    )
    dims = ("competencia", "habilidad", "herramienta")
    out["cobertura_curricular__general"] = _sql(
        f"""SELECT carrera AS carrera_id, carrera_nombre AS carrera, CASE WHEN s = 'available' THEN n END AS value, n AS numerator_n, {_N} AS denominator_n, {', '.join(f'n_{d} AS coberturas_{d}' for d in dims)}, {', '.join(f'n_{d} > 0 AS {d}_comparable' for d in dims)}, s AS availability, alguna AS has_any_comparable_dimension,
        CASE s WHEN 'unavailable' THEN '{NO_CURRICULUM}' WHEN 'incomplete' THEN '{NOT_ALL_DIMENSIONS}' END AS warning FROM (SELECT *, CASE WHEN n = 0 THEN 'unavailable' WHEN n_competencia = 0 OR n_habilidad = 0 OR n_herramienta = 0 THEN 'incomplete' ELSE 'available' END AS s, n_competencia + n_habilidad + n_herramienta > 0 AS alguna FROM filas) ORDER BY alguna DESC, n DESC, carrera_nombre, carrera_id LIMIT 14""",
        f"filas AS (SELECT carrera, carrera_nombre, (SELECT count(DISTINCT curso) FROM ensenia e WHERE e.carrera = c.carrera) AS n, {', '.join(f'''(SELECT count(DISTINCT cobertura) FROM cobertura k WHERE k.carrera = c.carrera AND dimension = '{d}') AS n_{d}''' for d in dims)} FROM carrera c)",
    )

    def status(market: bool) -> str:
        return f"""estado AS (SELECT *, CASE WHEN cursos = 0 THEN 'unavailable' WHEN coberturas = 0 THEN 'incomplete' {"WHEN ofertas = 0 THEN 'no_market_data'" if market else ''} ELSE 'available' END AS s FROM (SELECT c.carrera, carrera_nombre, {'i.industria, industria_nombre, (SELECT count(*) FROM contexto) AS ofertas,' if market else ''} (SELECT count(DISTINCT curso) FROM ensenia WHERE carrera = {ca}) AS cursos, (SELECT count(DISTINCT cobertura) FROM cobertura WHERE carrera = {ca} AND dimension = '{dim}') AS coberturas FROM carrera c{', industria i' if market else ''} WHERE c.carrera = {ca}{f' AND i.industria = {ind}' if market else ''}))"""

    warning = f"CASE s WHEN 'unavailable' THEN '{NO_CURRICULUM}' WHEN 'incomplete' THEN '{NO_DIMENSION}' WHEN 'no_market_data' THEN '{NO_CONTEXT}' END AS warning"
    out["cobertura_curricular__especifica"] = _sql(
        f"SELECT carrera AS carrera_id, carrera_nombre AS carrera, conocimiento AS conocimiento_id, conocimiento_nombre AS conocimiento, '{dim}' AS dimension, v AS value, {_d('v')} / cursos AS percentage, rank, v AS numerator_n, CASE WHEN s = 'available' THEN cursos END AS denominator_n, coberturas AS dimension_coverage_n, s AS availability, s = 'available' AS is_comparable, {warning} FROM estado LEFT JOIN filas ON s = 'available'",
        status(False), f"filas AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY v DESC, conocimiento_nombre, conocimiento) AS rank FROM (SELECT conocimiento, conocimiento_nombre, count(DISTINCT curso) AS v FROM cobertura WHERE carrera = {ca} AND dimension = '{dim}' GROUP BY ALL)) WHERE rank <= 20)",
    )
    demand = "demanda AS (SELECT carrera, conocimiento, count(DISTINCT oferta) AS od FROM reciente JOIN dirige USING (oferta) JOIN requiere USING (oferta) GROUP BY ALL)"
    taught = "ensenado AS (SELECT carrera, conocimiento, count(DISTINCT curso) AS cc FROM cobertura GROUP BY ALL)"
    totals = "totales AS (SELECT carrera, carrera_nombre, (SELECT count(DISTINCT curso) FROM ensenia e WHERE e.carrera = c.carrera) AS tc, (SELECT count(DISTINCT oferta) FROM reciente JOIN dirige d USING (oferta) WHERE d.carrera = c.carrera) AS tot FROM carrera c)"
    gap = "carrera AS carrera_id, carrera_nombre AS carrera, conocimiento AS conocimiento_id, conocimiento_nombre AS conocimiento, dimension, v AS value, dp AS demand_percentage, cp AS coverage_percentage, CASE WHEN s = 'available' THEN od END AS demand_numerator_n, CASE WHEN s = 'available' THEN tot END AS demand_denominator_n, CASE WHEN s = 'available' THEN cc END AS coverage_numerator_n, CASE WHEN s = 'available' THEN tc END AS coverage_denominator_n, CASE WHEN s = 'available' THEN rank END AS rank, s AS availability, s = 'available' AS is_comparable, total_carreras"
    universe = "universo AS (SELECT t.*, k.*, coalesce(od, 0) AS od, coalesce(cc, 0) AS cc FROM totales t JOIN conocimiento k ON EXISTS (SELECT 1 FROM cobertura x WHERE x.carrera = t.carrera AND x.dimension = k.dimension) LEFT JOIN demanda d ON d.carrera = t.carrera AND d.conocimiento = k.conocimiento LEFT JOIN ensenado e ON e.carrera = t.carrera AND e.conocimiento = k.conocimiento WHERE {})"
    out["brechas_demanda_alta__general"] = _sql(
        f"SELECT {gap} FROM total_carreras, (SELECT *, 'available' AS s, row_number() OVER (ORDER BY v DESC, od DESC, carrera_nombre, conocimiento_nombre, carrera, conocimiento) AS rank FROM (SELECT *, dp - cp AS v FROM (SELECT *, {_d('od')} / tot AS dp, {_d('cc')} / tc AS cp FROM universo))) WHERE rank <= 20",
        demand, taught, totals, universe.format("tc > 0 AND tot > 0 AND (od > 0 OR cc > 0)"),
    )
    out["senales_revision_vigencia__general"] = _sql(
        f"SELECT {gap} FROM total_carreras, (SELECT *, CASE WHEN tot = 0 THEN 'no_market_data' ELSE 'available' END AS s, row_number() OVER (ORDER BY v DESC NULLS FIRST, cc DESC, carrera_nombre, conocimiento_nombre, carrera, conocimiento) AS rank FROM (SELECT *, cp - dp AS v FROM (SELECT *, CASE WHEN tot > 0 THEN {_d('od')} / tot END AS dp, {_d('cc')} / tc AS cp FROM universo))) WHERE rank <= 20",
        demand, taught, totals, universe.format("tc > 0 AND cc > 0"),
    )

    def difference(keep: str, value: str) -> str:
        when = lambda x, y: f"CASE WHEN s = 'available' THEN {x} END AS {y}"
        return _sql(
            f"SELECT carrera AS carrera_id, carrera_nombre AS carrera, industria AS industria_id, industria_nombre AS industria, conocimiento AS conocimiento_id, conocimiento_nombre AS conocimiento, '{dim}' AS dimension, v AS value, dp AS demand_percentage, cp AS coverage_percentage, {when('od', 'demand_numerator_n')}, {when('ofertas', 'demand_denominator_n')}, {when('cc', 'coverage_numerator_n')}, {when('cursos', 'coverage_denominator_n')}, rank, coberturas AS dimension_coverage_n, s AS availability, s = 'available' AS is_comparable, {warning} FROM estado LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY v DESC, od DESC, conocimiento_nombre, conocimiento) AS rank FROM medido) WHERE rank <= 20) ON s = 'available'",
            _context(desde, hasta, ca, ind), status(True),
            "demanda AS (SELECT conocimiento, count(DISTINCT oferta) AS od FROM contexto JOIN requiere USING (oferta) GROUP BY ALL)", f"ensenado AS (SELECT conocimiento, count(DISTINCT curso) AS cc FROM cobertura WHERE carrera = {ca} GROUP BY ALL)",
            f"medido AS (SELECT conocimiento, conocimiento_nombre, od, cc, dp, cp, {value} AS v FROM (SELECT conocimiento, conocimiento_nombre, coalesce(od, 0) AS od, coalesce(cc, 0) AS cc, {_d('coalesce(od, 0)')} / ofertas AS dp, {_d('coalesce(cc, 0)')} / cursos AS cp FROM estado, conocimiento LEFT JOIN demanda USING (conocimiento) LEFT JOIN ensenado USING (conocimiento) WHERE dimension = '{dim}' AND ({keep})))",
        )

    out["brechas_demanda_alta__especifica"] = difference("od > 0 OR cc > 0", "dp - cp")
    out["senales_revision_vigencia__especifica"] = difference("cc > 0", "cp - dp")
    out["cursos_con_mayor_correspondencia__general"] = _sql(
        f"SELECT carrera AS carrera_id, carrera_nombre AS carrera, curso AS curso_id, curso_nombre AS curso, n AS value, n AS ofertas, x AS conocimientos_compartidos, {_d('n')} / total AS assignment_share, rank, n AS numerator_n, total AS denominator_n, total AS total_assignments, perfiladas AS carreras_perfiladas, total_carreras, 'available' AS availability, {_d('perfiladas')} / total_carreras AS coverage_percentage, true AS is_comparable FROM total_carreras, (SELECT count(DISTINCT carrera) AS perfiladas FROM carrera JOIN ensenia USING (carrera)), (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total, row_number() OVER (ORDER BY n DESC, x DESC, curso_nombre, carrera, curso) AS rank FROM filas) WHERE rank <= 20",
        "filas AS (SELECT k.carrera, carrera_nombre, k.curso, curso_nombre, count(DISTINCT k.conocimiento) AS x, count(DISTINCT oferta) AS n FROM cobertura k JOIN requiere r USING (conocimiento) JOIN reciente USING (oferta) JOIN dirige d USING (oferta) JOIN curso USING (curso) JOIN carrera c ON c.carrera = k.carrera WHERE d.carrera = k.carrera GROUP BY ALL)",
    )
    out["cursos_con_mayor_correspondencia__especifica"] = _sql(
        f"SELECT carrera AS carrera_id, carrera_nombre AS carrera, industria AS industria_id, industria_nombre AS industria, curso AS curso_id, curso_nombre AS curso, '{dim}' AS dimension, n AS value, n AS numerator_n, CASE WHEN s = 'available' THEN ofertas END AS denominator_n, x AS conocimientos_compartidos, rank, coberturas AS dimension_coverage_n, s AS availability, s = 'available' AS is_comparable, {warning} FROM estado LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY n DESC, x DESC, curso_nombre, curso) AS rank FROM filas) WHERE rank <= 20) ON s = 'available'",
        _context(desde, hasta, ca, ind), status(True),
        f"filas AS (SELECT k.curso, curso_nombre, count(DISTINCT CASE WHEN oferta IS NOT NULL THEN k.conocimiento END) AS x, count(DISTINCT oferta) AS n FROM cobertura k JOIN curso USING (curso) LEFT JOIN (SELECT * FROM requiere JOIN contexto USING (oferta)) r ON r.conocimiento = k.conocimiento WHERE carrera = {ca} AND dimension = '{dim}' GROUP BY ALL)",
    )
    led = f"empresa AS empresa_id, empresa_nombre AS empresa, conocimiento AS conocimiento_id, conocimiento_nombre AS conocimiento_lider, n AS value, n AS ofertas, m AS ofertas_con_conocimiento_lider, {_d('n')} / total AS assignment_share, rank, n AS numerator_n, total AS denominator_n, total AS total_assignments, 'available' AS availability"

    def leaders(offers: str, publica: str) -> tuple[str, ...]:
        return (
            f"cuenta AS (SELECT empresa, count(DISTINCT oferta) AS n FROM {offers} JOIN {publica} USING (oferta) GROUP BY ALL)",
            f"pares AS (SELECT empresa, conocimiento, conocimiento_nombre, count(DISTINCT oferta) AS m FROM {offers} JOIN {publica} USING (oferta) JOIN requiere USING (oferta) JOIN conocimiento USING (conocimiento) GROUP BY ALL)",
            "filas AS (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total, row_number() OVER (ORDER BY n DESC, empresa_nombre, empresa) AS rank FROM cuenta JOIN (SELECT * FROM pares QUALIFY row_number() OVER (PARTITION BY empresa ORDER BY m DESC, conocimiento_nombre, conocimiento) = 1) USING (empresa) JOIN empresa USING (empresa))",
        )

    out["empresas_y_conocimientos__general"] = _sql(f"SELECT {led} FROM filas WHERE rank <= 20", *leaders("reciente", "publica"))
    out["empresas_y_conocimientos__especifica"] = _sql(
        f"SELECT c.carrera AS carrera_id, carrera_nombre AS carrera, i.industria AS industria_id, industria_nombre AS industria, {led} FROM carrera c, industria i, filas WHERE rank <= 20 AND c.carrera = {ca} AND i.industria = {ind}",
        _context(desde, hasta, ca, ind), *leaders("contexto", f"(SELECT * FROM publica WHERE empresa IN (SELECT empresa FROM agrupa WHERE industria = {ind}))"),
    )
    out["diferenciadores_empresas__general"] = _sql(
        "SELECT empresa AS empresa_id, empresa_nombre AS empresa, conocimiento AS conocimiento_id, conocimiento_nombre AS conocimiento, lift AS value, lift, m AS numerator_n, n AS denominator_n, g AS global_numerator_n, t AS global_denominator_n, rank, 'available' AS availability, CAST(5 AS BIGINT) AS minimum_support_n FROM (SELECT *, row_number() OVER (ORDER BY lift DESC, m DESC, empresa_nombre, conocimiento_nombre, empresa, conocimiento) AS rank FROM filas) WHERE rank <= 20",
        *leaders("reciente", "publica")[:2], "mundo AS (SELECT conocimiento, count(DISTINCT oferta) AS g FROM reciente JOIN requiere USING (oferta) GROUP BY ALL)",
        f"filas AS (SELECT *, ({_d('m')} / n) / ({_d('g')} / t) AS lift FROM pares JOIN cuenta USING (empresa) JOIN mundo USING (conocimiento) JOIN empresa USING (empresa), (SELECT count(*) AS t FROM reciente) WHERE n >= 5 AND m >= 2)",
    )
    out["diferenciadores_empresas__especifica"] = _sql(
        f"""SELECT {a} AS empresa_a_id, na AS empresa_a, {b} AS empresa_b_id, nb AS empresa_b, conocimiento AS conocimiento_id, conocimiento_nombre AS conocimiento, dimension, v AS value, pa AS empresa_a_percentage, pb AS empresa_b_percentage, v AS difference_pp, xa AS numerator_n_a, da AS denominator_n_a, xb AS numerator_n_b, CASE WHEN nb IS NOT NULL THEN db END AS denominator_n_b, rank, s2 AS availability,
        CASE s2 WHEN 'company_not_found' THEN '{NOT_FOUND}' WHEN 'no_market_data' THEN '{NO_OFFERS}' WHEN 'no_positive_difference' THEN '{NO_DIFFERENCE}' END AS warning FROM (SELECT *, CASE WHEN s = 'available' AND conocimiento IS NULL THEN 'no_positive_difference' ELSE s END AS s2 FROM estado LEFT JOIN filas ON s = 'available')""",
        _context(desde, hasta),
        f"estado AS (SELECT *, CASE WHEN nb IS NULL THEN 'company_not_found' WHEN da = 0 OR db = 0 THEN 'no_market_data' ELSE 'available' END AS s FROM (SELECT empresa_nombre AS na, (SELECT empresa_nombre FROM empresa WHERE empresa = {b}) AS nb, (SELECT count(*) FROM contexto JOIN publica USING (oferta) WHERE empresa = {a}) AS da, (SELECT count(*) FROM contexto JOIN publica USING (oferta) WHERE empresa = {b}) AS db FROM empresa WHERE empresa = {a}))",
        f"filas AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY v DESC, xa DESC, conocimiento_nombre, conocimiento) AS rank FROM (SELECT *, pa - pb AS v FROM (SELECT conocimiento, conocimiento_nombre, dimension, xa, xb, {_d('xa')} / da AS pa, {_d('xb')} / db AS pb FROM (SELECT conocimiento, conocimiento_nombre, dimension, count(DISTINCT oferta) FILTER (WHERE empresa = {a}) AS xa, count(DISTINCT oferta) FILTER (WHERE empresa = {b}) AS xb FROM contexto JOIN publica USING (oferta) JOIN requiere USING (oferta) JOIN conocimiento USING (conocimiento) WHERE empresa IN ({a}, {b}) GROUP BY ALL), (SELECT da, db FROM estado))) WHERE v > 0) WHERE rank <= 20)",
    )
    out["conocimientos_liderazgo__general"] = _sql(
        f"SELECT industria AS industria_id, industria_nombre AS industria, n AS value, n AS titulos_con_senal_liderazgo, {_d('n')} / t AS percentage, rank, n AS numerator_n, t AS denominator_n, CASE WHEN t IS NULL THEN 'no_data' ELSE 'available' END AS availability FROM (SELECT 1) LEFT JOIN (SELECT *, row_number() OVER (ORDER BY n DESC, industria_nombre, industria) AS rank FROM filas WHERE n > 0) ON rank <= 20",
        "filas AS (SELECT industria, industria_nombre, count(DISTINCT oferta) AS t, count(DISTINCT oferta) FILTER (WHERE oferta IN (SELECT oferta FROM lider)) AS n FROM reciente JOIN publica USING (oferta) JOIN agrupa USING (empresa) JOIN industria USING (industria) GROUP BY ALL)",
    )
    out["conocimientos_liderazgo__especifica"] = _sql(
        f"SELECT industria AS industria_id, industria_nombre AS industria, conocimiento AS conocimiento_id, conocimiento_nombre AS conocimiento, dimension, v AS value, v AS ofertas, {_d('v')} / t AS percentage, rank, v AS numerator_n, CASE WHEN s = 'available' THEN t END AS denominator_n, s AS availability FROM estado LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY v DESC, conocimiento_nombre, conocimiento) AS rank FROM (SELECT conocimiento, conocimiento_nombre, dimension, count(DISTINCT oferta) AS v FROM propias JOIN requiere USING (oferta) JOIN conocimiento USING (conocimiento) GROUP BY ALL)) WHERE rank <= 10) ON s = 'available'",
        _context(desde, hasta, None, ind), "propias AS (SELECT DISTINCT oferta FROM contexto JOIN lider USING (oferta))", f"estado AS (SELECT *, CASE WHEN t = 0 THEN 'no_data' ELSE 'available' END AS s FROM (SELECT industria, industria_nombre, (SELECT count(*) FROM propias) AS t FROM industria WHERE industria = {ind}))",
    )

    def titles(offers: str) -> tuple[str, ...]:
        return (
            f"titulos AS (SELECT tipo, lower(trim(puesto_nombre)) AS titulo, count(DISTINCT oferta) AS n FROM {offers} JOIN publica USING (oferta) JOIN empresa USING (empresa) JOIN ofrece_puesto USING (oferta) JOIN puesto USING (puesto) WHERE tipo IS NOT NULL AND trim(puesto_nombre) <> '' GROUP BY ALL)",
            "tipos AS (SELECT tipo, CAST(sum(n) AS BIGINT) AS total FROM titulos GROUP BY tipo ORDER BY total DESC, tipo LIMIT 4)",
            "filas AS (SELECT *, row_number() OVER (PARTITION BY tipo ORDER BY n DESC, titulo) AS rank FROM titulos JOIN tipos USING (tipo))",
        )

    title_cols = f"tipo AS tipo_empresa_id, tipo AS tipo_empresa, titulo AS titulo_publicado, n AS value, n AS ofertas, {_d('n')} / total AS assignment_share, rank, n AS numerator_n, total AS denominator_n, total AS total_assignments, 'available' AS availability"
    out["funciones_por_tipo_empresa__general"] = _sql(f"SELECT {title_cols} FROM filas WHERE rank <= 5", *titles("reciente"))
    out["funciones_por_tipo_empresa__especifica"] = _sql(f"SELECT carrera AS carrera_id, carrera_nombre AS carrera, {title_cols} FROM carrera, filas WHERE rank <= 5 AND carrera = {ca}", _context(desde, hasta, ca), *titles("contexto"))
    return out


def dashboard(p: dict) -> dict[str, str]:
    """SQL of the 17 dashboard queries."""
    ca, desde, hasta = p["carrera_id"], p["desde"], p["hasta"]
    ctx, own = _context(desde, hasta), _context(desde, hasta, ca)
    months = "SELECT year(fecha) AS anio, month(fecha) AS mes, count(DISTINCT oferta) AS ofertas FROM contexto GROUP BY ALL"
    courses = "(SELECT count(DISTINCT curso) FROM ensenia e WHERE e.carrera = c.carrera)"
    out = {
        "dash_carreras": _sql(f"SELECT carrera AS id, carrera_nombre AS nombre, {courses} AS cursos_conectados FROM carrera c"),
        "dash_carrera": _sql(f"SELECT carrera AS id, carrera_nombre AS nombre, {courses} AS cursos_conectados FROM carrera c WHERE carrera = {ca}"),
        "dash_tendencia_global": _sql(months, ctx),
        "dash_rango_ofertas": _sql("SELECT min(fecha) AS desde, max(fecha) AS hasta FROM oferta"),
        "dash_tendencia_carrera": _sql(months, own),
    }
    for dim in ("competencia", "habilidad", "herramienta"):
        element = f"{dim}|{p['elemento']}"
        out[f"dash_demanda_{dim}"] = _sql(f"SELECT conocimiento AS id, conocimiento_nombre AS elemento, count(DISTINCT oferta) AS ofertas FROM contexto JOIN requiere USING (oferta) JOIN conocimiento USING (conocimiento) WHERE dimension = '{dim}' GROUP BY ALL ORDER BY ofertas DESC, elemento, id LIMIT 25", own)
        out[f"dash_cobertura_{dim}"] = _sql(f"SELECT conocimiento AS id, conocimiento_nombre AS elemento, count(DISTINCT curso) AS cursos_con_cobertura, (SELECT count(DISTINCT curso) FROM ensenia WHERE carrera = {ca}) AS total_cursos FROM cobertura WHERE carrera = {ca} AND dimension = '{dim}' GROUP BY ALL ORDER BY cursos_con_cobertura DESC, elemento, id LIMIT 25")
        out[f"dash_brechas_{dim}"] = _sql(
            f"SELECT *, demanda - cobertura AS brecha FROM (SELECT *, CASE WHEN total_cursos = 0 THEN 0.0 ELSE {_d('cursos_con_cobertura')} / total_cursos END AS cobertura, CASE WHEN total_ofertas = 0 THEN 0.0 ELSE {_d('ofertas_que_requieren')} / total_ofertas END AS demanda FROM filas) ORDER BY brecha DESC, ofertas_que_requieren DESC, elemento, id LIMIT 25",
            own, f"filas AS (SELECT k.conocimiento AS id, k.conocimiento_nombre AS elemento, (SELECT count(DISTINCT curso) FROM cobertura x WHERE x.carrera = {ca} AND x.conocimiento = k.conocimiento) AS cursos_con_cobertura, (SELECT count(DISTINCT curso) FROM ensenia WHERE carrera = {ca}) AS total_cursos, (SELECT count(DISTINCT oferta) FROM contexto JOIN requiere r USING (oferta) WHERE r.conocimiento = k.conocimiento) AS ofertas_que_requieren, (SELECT count(*) FROM contexto) AS total_ofertas FROM conocimiento k WHERE dimension = '{dim}' AND (cursos_con_cobertura > 0 OR ofertas_que_requieren > 0))",
        )
        out[f"dash_industrias_{dim}"] = _sql(f"SELECT industria_nombre AS industria, count(DISTINCT oferta) AS ofertas FROM contexto JOIN requiere USING (oferta) JOIN publica USING (oferta) JOIN agrupa USING (empresa) JOIN industria USING (industria) WHERE conocimiento = '{element}' GROUP BY ALL ORDER BY ofertas DESC, industria LIMIT 25", ctx)
    return out


def templates(p: dict) -> dict[str, str]:
    """SQL of the 20 question templates."""
    ca, emp, pu, ind, cu, comp = (p[k] for k in ("carrera_id", "empresa_a_id", "puesto_id", "industria_id", "curso_id", "competencia_id"))
    asked = "SELECT conocimiento_nombre AS {0}, count(DISTINCT oferta) AS ofertas FROM requiere JOIN conocimiento USING (conocimiento) {1} WHERE dimension = '{0}' GROUP BY conocimiento, conocimiento_nombre ORDER BY ofertas DESC, {0}, conocimiento LIMIT 25"
    body = {
        "contar_carreras": "SELECT count(*) AS total FROM carrera",
        "listar_carreras": "SELECT carrera_nombre AS carrera FROM carrera ORDER BY carrera LIMIT 25",
        "cursos_de_carrera": f"SELECT DISTINCT curso_nombre AS curso FROM ensenia JOIN curso c USING (curso) WHERE carrera = {ca} ORDER BY 1 LIMIT 25",
        "contar_cursos_de_carrera": f"SELECT count(DISTINCT curso) AS total FROM ensenia WHERE carrera = {ca}",
        "facultad_de_carrera": f"SELECT DISTINCT facultad_nombre AS facultad FROM ofrece JOIN facultad f USING (facultad) WHERE carrera = {ca} ORDER BY 1 LIMIT 25",
        "top_empresas_ofertas": "SELECT empresa_nombre AS empresa, count(DISTINCT oferta) AS ofertas FROM publica JOIN empresa e USING (empresa) GROUP BY e.empresa, empresa_nombre ORDER BY ofertas DESC, empresa_nombre, e.empresa LIMIT 25",
        "ofertas_de_empresa": f"SELECT count(DISTINCT oferta) AS ofertas FROM publica WHERE empresa = {emp}",
        "puestos_de_empresa": f"SELECT DISTINCT puesto_nombre AS puesto FROM publica JOIN ofrece_puesto USING (oferta) JOIN puesto p USING (puesto) WHERE empresa = {emp} AND puesto_nombre IS NOT NULL ORDER BY 1 LIMIT 25",
        "listar_empresas": "SELECT empresa_nombre AS empresa FROM empresa ORDER BY 1 LIMIT 25",
        "competencias_demandadas_carrera": asked.format("competencia", f"JOIN (SELECT oferta FROM dirige WHERE carrera = {ca}) USING (oferta)"),
        "top_competencias_ofertas": asked.format("competencia", ""),
        "habilidades_para_puesto": f"SELECT DISTINCT conocimiento_nombre AS habilidad FROM requiere JOIN conocimiento USING (conocimiento) WHERE oferta = {pu} AND dimension = 'habilidad' ORDER BY 1 LIMIT 25",
        "herramientas_mas_requeridas": asked.format("herramienta", ""),
        "herramientas_de_carrera": f"SELECT DISTINCT conocimiento_nombre AS herramienta FROM cobertura WHERE carrera = {ca} AND dimension = 'herramienta' ORDER BY 1 LIMIT 25",
        "puestos_mas_demandados": "SELECT puesto_nombre AS puesto, count(DISTINCT oferta) AS ofertas FROM ofrece_puesto JOIN puesto p USING (puesto) WHERE puesto_nombre IS NOT NULL GROUP BY puesto_nombre ORDER BY ofertas DESC, puesto_nombre LIMIT 25",
        "industrias_con_mas_ofertas": "SELECT industria_nombre AS industria, count(DISTINCT oferta) AS ofertas FROM publica JOIN agrupa USING (empresa) JOIN industria i USING (industria) GROUP BY i.industria, industria_nombre ORDER BY ofertas DESC, industria_nombre LIMIT 25",
        "empresas_de_industria": f"SELECT DISTINCT empresa_nombre AS empresa FROM agrupa JOIN empresa e USING (empresa) WHERE industria = {ind} ORDER BY 1 LIMIT 25",
        "silabo_de_curso": f"SELECT codigo, sumilla FROM silabo WHERE curso = {cu} ORDER BY 1, 2 LIMIT 25",
        "carreras_que_tienen_curso": f"SELECT DISTINCT carrera_nombre AS carrera FROM ensenia JOIN carrera c USING (carrera) WHERE curso = {cu} ORDER BY 1 LIMIT 25",
        "cursos_para_competencia": f"SELECT DISTINCT curso_nombre AS curso FROM cubre JOIN curso c USING (curso) WHERE conocimiento = '{comp}' AND conocimiento LIKE 'competencia|%' ORDER BY 1 LIMIT 25",
    }
    return {f"tpl_{k}": _sql(v) for k, v in body.items()}


def examples(p: dict) -> dict[str, str]:
    """SQL of the set operations and further questions."""
    ca, other = p["carrera_id"], p["carrera_b_id"]
    cols = "conocimiento, conocimiento_nombre, dimension"
    taught = "SELECT DISTINCT " + cols + " FROM cobertura WHERE carrera = {}"
    asked = f"SELECT DISTINCT {cols} FROM requiere JOIN dirige USING (oferta) JOIN conocimiento USING (conocimiento) WHERE carrera = {ca}"
    return {
        "op_interseccion": _sql(f"{taught.format(ca)} INTERSECT {asked}"),
        "op_diferencia": _sql(f"{asked} EXCEPT {taught.format(ca)}"),
        "op_union": _sql(f"{taught.format(ca)} UNION {asked}"),
        "op_conocimientos_comunes": _sql(f"{taught.format(ca)} INTERSECT {taught.format(other)}"),
        "op_carrera_con_mas_cursos": _sql("SELECT carrera, carrera_nombre, count(DISTINCT curso) AS cursos FROM ensenia JOIN carrera USING (carrera) GROUP BY ALL ORDER BY cursos DESC, carrera_nombre, carrera LIMIT 1"),
        "op_ofertas_por_carrera": _sql("SELECT carrera, carrera_nombre, count(DISTINCT oferta) AS ofertas FROM dirige JOIN carrera USING (carrera) GROUP BY ALL"),
        "op_media_por_industria": _sql("SELECT industria, industria_nombre, avg(n) AS media FROM (SELECT empresa, count(DISTINCT oferta) AS n FROM publica GROUP BY empresa) JOIN agrupa USING (empresa) JOIN industria USING (industria) GROUP BY ALL"),
        "op_empresas_para_carrera": _sql(f"SELECT empresa, empresa_nombre, count(DISTINCT oferta) AS ofertas FROM publica JOIN dirige USING (oferta) JOIN empresa USING (empresa) WHERE carrera = {ca} GROUP BY ALL ORDER BY ofertas DESC, empresa_nombre, empresa LIMIT 10"),
        "op_carreras_de_facultad": _sql(f"SELECT DISTINCT carrera, carrera_nombre FROM ofrece JOIN carrera USING (carrera) WHERE facultad = {p['facultad_id']}"),
        "op_silabos_de_competencia": _sql(f"SELECT DISTINCT codigo, sumilla FROM silabo WHERE curso IN (SELECT curso FROM cubre WHERE conocimiento = '{p['competencia_id']}')"),
    }


_CLEAN = "trim(regexp_replace(translate(lower({}), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy'), '[^a-z0-9]+', ' ', 'g'))"


def conversations() -> dict[str, str]:
    """SQL of what conversations ask for and name."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    phrases = ", ".join(f"('{t.id}', {i}, {t.priority}, {_text(t.label)}, '{p}', [{', '.join(map(_text, t.vetoes))}]::VARCHAR[])" for i, t in enumerate(TEMPLATES) for p in t.phrases)
    useful = "list_filter(string_split({}, ' '), lambda w: len(w) > 1 AND NOT list_contains([" + stop + "], w))"
    turns = f"turnos AS (SELECT conv_id, turn, row_number() OVER () AS fila, coalesce({_CLEAN.format('text')}, '') AS q FROM conversations WHERE role = 'user')"
    labels = ["carrera", "facultad", "curso", "empresa", "industria", "puesto"]
    nodes = " UNION ALL ".join(f"SELECT '{x}' AS label, {i} AS orden, CAST({x} AS VARCHAR) AS id, {x}_nombre AS nombre FROM {x}" for i, x in enumerate(labels))
    nodes += " UNION ALL SELECT dimension, CASE dimension WHEN 'competencia' THEN 6 WHEN 'habilidad' THEN 7 ELSE 8 END, conocimiento, conocimiento_nombre FROM conocimiento"
    nombres = f"nombres AS MATERIALIZED (SELECT label, orden, {_CLEAN.format('nombre')} AS c, arg_min(id, (length(nombre), nombre, id)) AS id, arg_min(nombre, (length(nombre), nombre, id)) AS nombre FROM ({nodes}) WHERE nombre IS NOT NULL GROUP BY label, orden, c)"
    palabras = f"palabras AS MATERIALIZED (SELECT conv_id, turn, texto, min(place) AS place FROM (SELECT conv_id, turn, unnest(w) AS texto, unnest(range(0, len(w))) AS place FROM (SELECT *, {useful.format('q')} AS w FROM turnos)) GROUP BY ALL)"
    mencion = "mencion AS MATERIALIZED (SELECT conv_id, turn, CAST(place AS INTEGER) AS place, texto, label, id, nombre FROM palabras JOIN (SELECT texto, label, id, nombre FROM (SELECT texto, n.*, row_number() OVER (PARTITION BY texto ORDER BY orden, length(nombre), nombre, id) AS k FROM (SELECT DISTINCT texto FROM palabras) JOIN nombres n ON contains(n.c, texto)) WHERE k = 1) USING (texto))"
    named = [turns, nombres, palabras, mencion]
    en_orden = "ORDER BY hora, turn, place, label, id"
    memoria = [
        "reloj AS (SELECT conv_id, turn, CAST(sum(sum(length(text))) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS hora FROM conversations GROUP BY conv_id, turn)",
        f"con_hora AS (SELECT *, lag(hora) OVER (PARTITION BY conv_id {en_orden}) AS antes FROM mencion JOIN reloj USING (conv_id, turn))",
        f"con_inicio AS (SELECT *, max(CASE WHEN antes IS NULL OR hora - antes > 1800 THEN hora END) OVER (PARTITION BY conv_id {en_orden} ROWS UNBOUNDED PRECEDING) AS since FROM con_hora)",
        f"marcado AS (SELECT *, CASE WHEN id = lag(id) OVER (PARTITION BY conv_id, since, label {en_orden}) THEN 0 ELSE 1 END AS cambia FROM con_inicio)",
        f"contado AS (SELECT *, CAST(sum(cambia) OVER (PARTITION BY conv_id, since, label {en_orden} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS changes FROM marcado)",
        "cambio AS (SELECT conv_id, since, label, changes, any_value(id) AS id, any_value(nombre) AS nombre FROM contado GROUP BY ALL)",
        """memoria AS MATERIALIZED (SELECT m.conv_id, m.turn, m.place, m.hora, m.label, m.id, m.nombre, m.since, m.changes, p.id AS previous_id, p.nombre AS previous, f.id AS first_id, f.nombre AS first
        FROM contado m LEFT JOIN cambio p ON (p.conv_id, p.since, p.label, p.changes) = (m.conv_id, m.since, m.label, m.changes - 1) JOIN cambio f ON (f.conv_id, f.since, f.label, f.changes) = (m.conv_id, m.since, m.label, greatest(1, m.changes - 7)))""",
    ]
    kinds = " ".join(rf"WHEN regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_])({REFERENCES[k]}|{MORE_REFERENCES[k]})($|[^\p{{L}}\p{{N}}_])', 'i') THEN '{k}'" for k in REFERENCES)
    refiere = f"refiere AS (SELECT conv_id, turn, hora, CASE {kinds} END AS kind FROM conversations JOIN reloj USING (conv_id, turn) WHERE role = 'user')"
    hallada = """hallada AS (SELECT r.conv_id, r.turn, r.kind, m.*, row_number() OVER (PARTITION BY r.conv_id, r.turn, m.label ORDER BY m.hora DESC, m.t DESC, m.place DESC) AS k FROM refiere r
        JOIN (SELECT conv_id AS c, turn AS t, * EXCLUDE (conv_id, turn) FROM memoria) m ON m.c = r.conv_id AND m.t < r.turn
        WHERE r.kind IS NOT NULL AND (r.hora - (SELECT max(x.hora) FROM memoria x WHERE x.conv_id = r.conv_id AND x.turn < r.turn)) <= 1800 AND m.since = (SELECT max(x.since) FROM memoria x WHERE x.conv_id = r.conv_id AND x.turn < r.turn))"""
    meant = "CASE kind WHEN 'previous' THEN {p} WHEN 'first' THEN {f} ELSE {a} END"
    return {
        "preguntas_intencion": f"WITH {turns}, frases(template, orden, prioridad, label, frase, vetos) AS (VALUES {phrases}), "
        "hallado AS (SELECT fila, f.*, row_number() OVER (PARTITION BY fila ORDER BY prioridad DESC, orden, length(frase) DESC, frase) AS k FROM turnos JOIN frases f ON contains(' ' || q || ' ', ' ' || frase || ' ') AND len(list_filter(vetos, lambda v: contains(q, v))) = 0) "
        f"SELECT conv_id, turn, template, label, array_to_string({useful.format("CASE WHEN frase IS NULL THEN q ELSE replace(q, frase, ' ') END")}, ' ') AS terms FROM turnos LEFT JOIN (SELECT * FROM hallado WHERE k = 1) USING (fila)",
        "preguntas_entidad": _sql("SELECT * FROM mencion", *named),
        "conversaciones_memoria": _sql('SELECT * EXCLUDE (hora), hora AS "at" FROM memoria', *named, *memoria),
        "conversaciones_referencias": _sql(f"SELECT conv_id, turn, kind, label, {meant.format(p='previous_id', f='first_id', a='id')} AS id, {meant.format(p='previous', f='first', a='nombre')} AS nombre FROM hallada WHERE k = 1 AND NOT (kind = 'previous' AND changes < 2)", *named, *memoria, refiere, hallada),
    }


def _text(x: str | None) -> str:
    return "NULL" if x is None else f"'{x}'"


#: Relations whose both ends are nodes or coverage records, with the frame of each.
_RELATIONS = (
    ("ofrece", "facultad", "OFRECE", "carrera"), ("ensenia", "carrera", "ENSENIA", "curso"), ("cubre", "curso", "TIENE", "cobertura"), ("cubre", "cobertura", "CUBRE", "conocimiento"), ("dirige", "oferta", "DIRIGE_A", "carrera"),
    ("publica", "empresa", "PUBLICA", "oferta"), ("agrupa", "industria", "AGRUPA", "empresa"), ("requiere", "oferta", "REQUIERE", "conocimiento"), ("ofrece_puesto", "oferta", "OFRECE", "puesto"), ("define", "puesto", "DEFINE", "conocimiento"),
)
_DEFINE = "define AS (SELECT oferta AS puesto, conocimiento FROM requiere)"


def graph() -> dict[str, str]:
    """SQL of what the graph holds and of what is wrong with it."""
    labels = ["carrera", "facultad", "curso", "conocimiento", "oferta", "empresa", "industria", "puesto"]
    checks = []
    for x in labels:
        checks += [f"SELECT '{x}' AS objeto, 'nulo' AS problema, count(*) AS n, CAST(NULL AS VARCHAR) AS ejemplo FROM {x} WHERE {x} IS NULL", f"SELECT '{x}', 'repetido', count(*), min(id) FROM (SELECT CAST({x} AS VARCHAR) AS id FROM {x} WHERE {x} IS NOT NULL GROUP BY {x} HAVING count(*) > 1)"]
    for frame, a, relation, b in _RELATIONS:
        triple = f"{a}-{relation}-{b}"
        for side, end in (("origen", a), ("destino", b)):
            if end in labels:
                ids = f"(SELECT CAST({end} AS VARCHAR) AS id, count(*) AS k FROM {frame} WHERE {end} IS NOT NULL GROUP BY {end})"
                checks += [
                    f"SELECT '{triple}', '{side} nulo', count(*), NULL FROM {frame} WHERE {end} IS NULL", f"SELECT '{triple}', '{side} inexistente', count(*), min(id) FROM {ids} WHERE id NOT IN (SELECT CAST({end} AS VARCHAR) FROM {end} WHERE {end} IS NOT NULL)",
                    f"SELECT '{triple}', '{side} muy frecuente', count(*), min(id) FROM {ids} WHERE k > 0.05 * (SELECT count(*) FROM {frame})",
                ]
        if frame != "cubre":
            checks.append(f"SELECT '{triple}', 'repetida', count(*), min(id) FROM (SELECT concat_ws(' ', {a}, {b}) AS id FROM {frame} GROUP BY {a}, {b} HAVING count(*) > 1)")
    kinds = {"carrera": "int", "facultad": "int", "curso": "bigint", "conocimiento": "string", "oferta": "bigint", "empresa": "bigint", "industria": "int", "puesto": "bigint"}
    more = {"conocimiento": [("dimension", "string")], "oferta": [("fecha", "timestamp_ntz")], "empresa": [("tipo", "string")]}
    each = []
    for x in labels:
        named = [] if x == "oferta" else [(f"{x}_nombre", "string", "'nombre'", f"(SELECT string_agg(v, ' | ' ORDER BY v) FROM (SELECT DISTINCT {x}_nombre AS v FROM {x} WHERE {x}_nombre <> '' ORDER BY v LIMIT 5))")]
        for name, kind, rol, some in [(x, kinds[x], "'id'", "NULL"), *named, *[(c, k, "NULL", "NULL") for c, k in more.get(x, [])]]:
            each.append(f"SELECT '{x}' AS label, '{name}' AS propiedad, '{kind}' AS tipo, {rol} AS rol, count(*) AS filas, count({name}) AS presentes, {some} AS ejemplos FROM {x}")
    return {
        "grafo_integridad": _sql(" UNION ALL ".join(checks), _DEFINE),
        "metadatos_propiedades": _sql(" UNION ALL ".join(each)),
        "metadatos_topologia": _sql(" UNION ALL ".join(f"SELECT '{a}' AS origen, '{r}' AS relacion, '{b}' AS destino, count(*) AS n FROM {f} WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for f, a, r, b in _RELATIONS), _DEFINE),
    }


def further(p: dict) -> dict[str, str]:
    """SQL of the catalogue's counts and of the conversations and events."""
    frames = ["carrera", "facultad", "curso", "conocimiento", "oferta", "empresa", "industria", "puesto", "silabo", "ofrece", "ensenia", "cubre", "dirige", "publica", "agrupa", "requiere", "ofrece_puesto"]
    counts = " UNION ALL ".join([f"SELECT '{f}' AS frame, count(*) AS n FROM {f}" for f in frames] + ["SELECT 'define' AS frame, count(*) AS n FROM requiere"])
    clean = "trim(regexp_replace(translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy'), '[^a-z0-9]+', ' ', 'g'))"
    return {
        "catalogo_conteos": _sql(counts),
        "conversaciones_bloques": "SELECT conv_id, CAST(p // 12 AS BIGINT) AS block, count(*) AS n_turns, count(*) = 12 AS complete, string_agg(role || ': ' || text, ' | ' ORDER BY p) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS p FROM conversations) GROUP BY ALL",
        "conversaciones_resumenes": """WITH par AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, line) - 1 AS p FROM (SELECT conv_id, turn, role, 'P: ' || text || ' | R: ' || CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w ELSE '' END AS line
            FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) WHERE role = 'user')
            SELECT conv_id, CAST(p // 2 AS BIGINT) AS block, count(*) AS n, CASE WHEN count(*) = 2 THEN string_agg(line[1:80], E'\\n' ORDER BY p) END AS summary, CASE WHEN count(*) < 2 THEN string_agg(line, E'\\n' ORDER BY p) END AS pending FROM par GROUP BY conv_id, p // 2""",
        "conversaciones_guarda": f"SELECT conv_id, turn, role, {clean} AS limpio, length(text) <= 500 AND NOT regexp_matches({clean}, 'ignora\\s+|olvida\\s+|ahora\\s+eres|jailbreak') AS aceptable, length(trim(text, E' \\t\\n\\r')) >= 10 AND length(text) <= 2000 AND NOT regexp_matches(text, '[一-鿿]') AS presentable FROM conversations",
        "eventos_por_dia": "SELECT strftime(ts, '%Y-%m-%d') AS dia, event_type, count(*) AS n FROM events GROUP BY ALL",
    }
