"""Questions with a fixed answer: what each recognises, what entity it needs, and its query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.operators.algebra import asc, distinct_offers
from skillgrid.sources.graph import GraphContext

MAX_ROWS = 25


@dataclass(frozen=True)
class Template:
    """phrases are whole phrases of a normalised question; vetoes are fragments that rule the template out;
    label is the entity whose id `build` takes besides the graph."""

    id: str
    priority: int
    phrases: tuple[str, ...]
    build: Callable[..., DataFrame]
    label: str | None = None
    vetoes: tuple[str, ...] = ()


def _names(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.select(F.col(column).alias(name)).distinct().orderBy(asc(name)).limit(MAX_ROWS)


def _ranking(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """By offers, then name, then id."""
    rows = distinct_offers(df, *keys).orderBy(F.desc("ofertas"), *[asc(k) for k in keys]).limit(MAX_ROWS)
    return rows.select(F.col(keys[0]).alias(name), "ofertas")


def _of(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def _dimension(g: GraphContext, dimension: str) -> DataFrame:
    return g.conocimiento.filter(F.col("dimension") == dimension)


def _asked(g: GraphContext, dimension: str, offers: DataFrame | None = None) -> DataFrame:
    rows = g.requiere if offers is None else g.requiere.join(offers, "oferta", "left_semi")
    return rows.join(_dimension(g, dimension), "conocimiento")


def _listed(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.select(F.col(column).alias(name)).orderBy(asc(name)).limit(MAX_ROWS)


# Ids, priorities and phrases.
TEMPLATES: tuple[Template, ...] = (
    Template("contar_carreras", 20, ("cuantas carreras", "total de carreras", "numero de carreras"), lambda g: g.carrera.agg(F.count("carrera").alias("total"))),
    Template("listar_carreras", 20, ("que carreras hay", "listar carreras", "lista de carreras"), lambda g: _listed(g.carrera, "carrera_nombre", "carrera")),
    Template("cursos_de_carrera", 30, ("cursos de", "cursos tiene", "que cursos"), lambda g, x: _names(_of(g.ensenia, "carrera", x).join(g.curso, "curso"), "curso_nombre", "curso"), "carrera"),
    Template("contar_cursos_de_carrera", 40, ("cuantos cursos", "total de cursos"), lambda g, x: _of(g.ensenia, "carrera", x).agg(F.countDistinct("curso").alias("total")), "carrera"),
    Template("facultad_de_carrera", 35, ("facultad pertenece", "a que facultad pertenece", "que facultad ofrece la carrera"), lambda g, x: _names(_of(g.ofrece, "carrera", x).join(g.facultad, "facultad"), "facultad_nombre", "facultad"), "carrera"),
    Template("top_empresas_ofertas", 30, ("top empresas", "empresas con mas ofertas", "empresas publican mas"), lambda g: _ranking(g.publica.join(g.empresa, "empresa"), "empresa", "empresa_nombre", "empresa"), None, ("dirigid",)),
    Template("ofertas_de_empresa", 40, ("ofertas publico", "ofertas laborales publico", "ofertas de la empresa"), lambda g, x: _of(g.publica, "empresa", x).agg(F.countDistinct("oferta").alias("ofertas")), "empresa"),
    Template("puestos_de_empresa", 35, ("puestos ofrece", "puestos de", "cargos de la empresa"), lambda g, x: _names(_of(g.publica, "empresa", x).join(g.ofrece_puesto, "oferta").join(g.puesto.filter("puesto_nombre IS NOT NULL"), "puesto"), "puesto_nombre", "puesto"), "empresa"),
    Template("listar_empresas", 20, ("que empresas hay", "listar empresas", "lista de empresas"), lambda g: _listed(g.empresa, "empresa_nombre", "empresa")),
    Template("competencias_demandadas_carrera", 35, ("competencias para", "competencias demandadas", "competencias de"), lambda g, x: _ranking(_asked(g, "competencia", _of(g.dirige, "carrera", x)), "competencia", "conocimiento_nombre", "conocimiento"), "carrera"),
    Template("top_competencias_ofertas", 45, ("competencias mas demandadas", "top competencias", "competencias requeridas"), lambda g: _ranking(_asked(g, "competencia"), "competencia", "conocimiento_nombre", "conocimiento")),
    Template("habilidades_para_puesto", 35, ("habilidades para", "habilidades de un puesto", "habilidades del puesto"), lambda g, x: _names(_of(g.define, "puesto", x).join(_dimension(g, "habilidad"), "conocimiento"), "conocimiento_nombre", "habilidad"), "puesto"),
    Template("herramientas_mas_requeridas", 45, ("herramientas mas requeridas", "top herramientas", "herramientas demandadas"), lambda g: _ranking(_asked(g, "herramienta"), "herramienta", "conocimiento_nombre", "conocimiento"), None, ("dirigid",)),
    Template("herramientas_de_carrera", 35, ("herramientas ensena", "herramientas se ensenan", "herramientas de la carrera"), lambda g, x: _names(g.taught(x, "herramienta"), "conocimiento_nombre", "herramienta"), "carrera", ("ademas", "ofertas", "piden")),
    Template("puestos_mas_demandados", 40, ("puestos mas demandados", "top puestos", "puestos con mas ofertas"), lambda g: _ranking(g.ofrece_puesto.join(g.puesto.filter("puesto_nombre IS NOT NULL"), "puesto"), "puesto", "puesto_nombre")),
    Template("industrias_con_mas_ofertas", 40, ("industrias con mas ofertas", "top industrias", "sectores con mas ofertas"), lambda g: _ranking(g.publica.join(g.agrupa, "empresa").join(g.industria, "industria"), "industria", "industria_nombre", "industria")),
    Template("empresas_de_industria", 35, ("empresas del sector", "empresas de la industria", "empresas de"), lambda g, x: _names(_of(g.agrupa, "industria", x).join(g.empresa, "empresa"), "empresa_nombre", "empresa"), "industria"),
    Template("silabo_de_curso", 35, ("silabo de", "silabo del curso", "sumilla de"), lambda g, x: _of(g.silabo, "curso", x).select("codigo", "sumilla").orderBy(asc("codigo"), asc("sumilla")).limit(MAX_ROWS), "curso"),
    Template("carreras_que_tienen_curso", 35, ("carreras tienen", "carreras que tienen", "carreras ensenan"), lambda g, x: _names(_of(g.ensenia, "curso", x).join(g.carrera, "carrera"), "carrera_nombre", "carrera"), "curso"),
    Template("cursos_para_competencia", 35, ("cursos que desarrollan", "cursos para", "cursos de competencia"), lambda g, x: _names(g.covering(x).join(_dimension(g, "competencia"), "conocimiento", "left_semi").join(g.curso, "curso"), "curso_nombre", "curso"), "competencia"),
)
