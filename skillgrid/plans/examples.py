"""Set operations and further questions that an ad-hoc query must be able to express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.operators.algebra import asc, common, distinct_offers, union_of, without
from skillgrid.sources.graph import GraphContext


def _taught(g: GraphContext, carrera_id: object) -> DataFrame:
    return g.taught(carrera_id).select("conocimiento", "conocimiento_nombre", "dimension")


def _asked(g: GraphContext, carrera_id: object) -> DataFrame:
    offers = g.dirige.filter(F.col("carrera") == F.lit(carrera_id))
    return g.requiere.join(offers, "oferta", "left_semi").select("conocimiento").distinct().join(g.conocimiento, "conocimiento").select("conocimiento", "conocimiento_nombre", "dimension")


def taught_and_asked(g: GraphContext, carrera_id: object) -> DataFrame:
    return common(_taught(g, carrera_id), _asked(g, carrera_id))


def asked_not_taught(g: GraphContext, carrera_id: object) -> DataFrame:
    return without(_asked(g, carrera_id), _taught(g, carrera_id), ["conocimiento"])


def taught_or_asked(g: GraphContext, carrera_id: object) -> DataFrame:
    return union_of(_taught(g, carrera_id), _asked(g, carrera_id))


def shared_by_careers(g: GraphContext, carrera_a: object, carrera_b: object) -> DataFrame:
    return common(_taught(g, carrera_a), _taught(g, carrera_b))


def career_with_most_courses(g: GraphContext) -> DataFrame:
    n = g.ensenia.groupBy("carrera").agg(F.countDistinct("curso").alias("cursos")).join(g.carrera, "carrera")
    return n.orderBy(F.desc("cursos"), asc("carrera_nombre"), asc("carrera")).limit(1).select("carrera", "carrera_nombre", "cursos")


def offers_by_career(g: GraphContext) -> DataFrame:
    return distinct_offers(g.dirige, "carrera").join(g.carrera, "carrera").select("carrera", "carrera_nombre", "ofertas")


def mean_offers_of_companies(g: GraphContext) -> DataFrame:
    """Mean offers of the companies of each industry."""
    rows = distinct_offers(g.publica, "empresa").join(g.agrupa, "empresa")
    return rows.groupBy("industria").agg(F.avg("ofertas").alias("media")).join(g.industria, "industria").select("industria", "industria_nombre", "media")


def companies_for_career(g: GraphContext, carrera_id: object) -> DataFrame:
    rows = g.publica.join(g.dirige.filter(F.col("carrera") == F.lit(carrera_id)), "oferta")
    rows = distinct_offers(rows, "empresa").join(g.empresa, "empresa").orderBy(F.desc("ofertas"), asc("empresa_nombre"), asc("empresa")).limit(10)
    return rows.select("empresa", "empresa_nombre", "ofertas")


def faculty_careers(g: GraphContext, facultad_id: object) -> DataFrame:
    return g.ofrece.filter(F.col("facultad") == F.lit(facultad_id)).join(g.carrera, "carrera").select("carrera", "carrera_nombre").distinct()


def syllabi_of_competence(g: GraphContext, conocimiento_id: object) -> DataFrame:
    return g.silabo.join(g.covering(conocimiento_id), "curso", "left_semi").select("codigo", "sumilla").distinct()
