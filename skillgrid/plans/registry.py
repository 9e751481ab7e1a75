"""All queries of the engine by name, with the parameters that the driver tables are asked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgrid.operators import dialogue, questions, resolver
from skillgrid.plans import dashboard, examples, metadata, oracle, service
from skillgrid.plans.catalog import CATALOGUE
from skillgrid.plans.templates import TEMPLATES
from skillgrid.sources import stored
from skillgrid.sources.graph import DIMENSIONS, GraphContext, from_tables
from skillgrid.streaming import monthly

PARAMS = {
    "carrera_id": 3, "carrera_b_id": 6, "industria_id": 5, "facultad_id": 3, "empresa_a_id": 7, "empresa_b_id": 11, "tipo_conocimiento": "habilidad",
    "desde": "1998-01-01", "hasta": "2001-06-01", "tendencia_desde": "2000-01-01", "tendencia_hasta": "2001-06-01",
    "puesto_id": 3, "curso_id": 10, "elemento": "small ring", "competencia_id": "competencia|small ring",
}

#: Exchanges of a summary in the registered query; the given conversations have four at most.
SUMMARY_TURNS = 2
#: Plans that are asked for a period, which must reach the scan of the offers.
PERIODS = frozenset(
    [f"{spec.slug}__especifica" for spec in CATALOGUE if "desde" in spec.params] + ["dash_tendencia_global", "dash_tendencia_carrera"] + [f"dash_{view}_{d}" for view in ("demanda", "brechas", "industrias") for d in DIMENSIONS]
)


def plans() -> dict[str, Callable[[GraphContext], DataFrame]]:
    """Every query over a graph, as a function of the graph."""
    p, period = PARAMS, {"desde": PARAMS["desde"], "hasta": PARAMS["hasta"]}
    out: dict[str, Callable[[GraphContext], DataFrame]] = {}
    for spec in CATALOGUE:
        out[f"{spec.slug}__general"] = spec.run
        own = {k: p[k] for k in spec.params}
        if spec.slug == "tendencia_ofertas":
            own |= {"desde": p["tendencia_desde"], "hasta": p["tendencia_hasta"]}
        out[f"{spec.slug}__especifica"] = lambda g, spec=spec, own=own: spec.run(g, **own)
    out |= {
        "dash_carreras": dashboard.career_list,
        "dash_carrera": lambda g: dashboard.one_career(g, p["carrera_id"]),
        "dash_tendencia_global": lambda g: dashboard.monthly(g, **period),
        "dash_rango_ofertas": dashboard.date_range,
        "dash_tendencia_carrera": lambda g: dashboard.monthly_of(g, p["carrera_id"], **period),
    }
    for d in DIMENSIONS:
        out[f"dash_demanda_{d}"] = lambda g, d=d: dashboard.demand(g, d, p["carrera_id"], **period)
        out[f"dash_cobertura_{d}"] = lambda g, d=d: dashboard.coverage(g, d, p["carrera_id"])
        out[f"dash_brechas_{d}"] = lambda g, d=d: dashboard.gaps(g, d, p["carrera_id"], **period)
        out[f"dash_industrias_{d}"] = lambda g, d=d: dashboard.industries(g, d, f"{d}|{p['elemento']}", **period)
    ids = {"carrera": p["carrera_id"], "empresa": p["empresa_a_id"], "puesto": p["puesto_id"], "industria": p["industria_id"], "curso": p["curso_id"], "competencia": p["competencia_id"]}
    for t in TEMPLATES:
        out[f"tpl_{t.id}"] = lambda g, t=t: t.build(g, *([ids[t.label]] if t.label else []))
    out |= {
        "op_interseccion": lambda g: examples.taught_and_asked(g, p["carrera_id"]),
        "op_diferencia": lambda g: examples.asked_not_taught(g, p["carrera_id"]),
        "op_union": lambda g: examples.taught_or_asked(g, p["carrera_id"]),
        "op_conocimientos_comunes": lambda g: examples.shared_by_careers(g, p["carrera_id"], p["carrera_b_id"]),
        "op_carrera_con_mas_cursos": examples.career_with_most_courses,
        "op_ofertas_por_carrera": examples.offers_by_career,
        "op_media_por_industria": examples.mean_offers_of_companies,
        "op_empresas_para_carrera": lambda g: examples.companies_for_career(g, p["carrera_id"]),
        "op_carreras_de_facultad": lambda g: examples.faculty_careers(g, p["facultad_id"]),
        "op_silabos_de_competencia": lambda g: examples.syllabi_of_competence(g, p["competencia_id"]),
    }
    out |= {"catalogo_conteos": service.frame_counts, "grafo_integridad": stored.integrity, "metadatos_propiedades": metadata.properties, "metadatos_topologia": metadata.topology}
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: (lambda spark, folder, build=build: build(from_tables(spark, folder))) for name, build in plans().items()}
    turns = lambda spark, folder: spark.read.parquet(f"{folder}/conversations.parquet")
    asked = lambda spark, folder: turns(spark, folder).filter("role = 'user'")
    named = lambda spark, folder: questions.mentions(asked(spark, folder), resolver.entities(from_tables(spark, folder)))
    out["preguntas_intencion"] = lambda spark, folder: _intents(asked(spark, folder))
    out["preguntas_entidad"] = named
    timed = lambda spark, folder: named(spark, folder).join(dialogue.clock(turns(spark, folder)), ["conv_id", "turn"])
    out["conversaciones_memoria"] = lambda spark, folder: dialogue.memory(timed(spark, folder))
    out["conversaciones_referencias"] = lambda spark, folder: dialogue.references(
        asked(spark, folder).join(dialogue.clock(turns(spark, folder)), ["conv_id", "turn"]), dialogue.memory(timed(spark, folder)), patterns=(dialogue.REFERENCES, dialogue.MORE_REFERENCES)
    )
    out["conversaciones_bloques"] = lambda spark, folder: dialogue.blocks(turns(spark, folder))
    out["conversaciones_resumenes"] = lambda spark, folder: dialogue.summaries(turns(spark, folder), size=SUMMARY_TURNS)
    out["conversaciones_guarda"] = lambda spark, folder: turns(spark, folder).select("conv_id", "turn", "role", questions.normalised("text").alias("limpio"), questions.acceptable("text").alias("aceptable"), questions.presentable("text").alias("presentable"))
    out["eventos_por_dia"] = lambda spark, folder: monthly.counts(spark.read.parquet(f"{folder}/events.parquet"), "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("dia"), "event_type", "n")
    return out


def _intents(turns: DataFrame) -> DataFrame:
    found = questions.intents(turns.select(F.struct("conv_id", "turn").alias("question_id"), "text"), every=True)
    return found.select("question_id.conv_id", "question_id.turn", "template", "label", F.array_join("terms", " ").alias("terms"))


def oracle_sql() -> dict[str, str]:
    return oracle.catalogue(PARAMS) | oracle.dashboard(PARAMS) | oracle.templates(PARAMS) | oracle.examples(PARAMS) | oracle.further(PARAMS) | oracle.conversations() | oracle.graph()
