"""The fixed dashboard queries: five of their own and four families over the knowledge dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.operators.algebra import asc, distinct_offers
from skillgrid.sources.graph import GraphContext

MAX_ROWS = 25


def career_list(g: GraphContext) -> DataFrame:
    """Named careers with their connected courses."""
    n = g.ensenia.groupBy("carrera").agg(F.countDistinct("curso").alias("n"))
    rows = g.carrera.filter("carrera IS NOT NULL AND carrera_nombre IS NOT NULL").join(n, "carrera", "left")
    return rows.select(F.col("carrera").alias("id"), F.col("carrera_nombre").alias("nombre"), F.coalesce("n", F.lit(0)).cast("long").alias("cursos_conectados")).orderBy("nombre", "id")


def one_career(g: GraphContext, carrera_id: object) -> DataFrame:
    n = g.ensenia.filter(F.col("carrera") == F.lit(carrera_id)).agg(F.countDistinct("curso").alias("cursos_conectados"))
    return g.carrera.filter(F.col("carrera") == F.lit(carrera_id)).select(F.col("carrera").alias("id"), F.col("carrera_nombre").alias("nombre")).crossJoin(n)


def _monthly(offers: DataFrame) -> DataFrame:
    rows = distinct_offers(offers.select("oferta", F.year("fecha").cast("long").alias("anio"), F.month("fecha").cast("long").alias("mes")), "anio", "mes")
    return rows.orderBy("anio", "mes")


def monthly(g: GraphContext, desde: str, hasta: str) -> DataFrame:
    """Offers of the months that have any."""
    return _monthly(g.between(desde, hasta))


def monthly_of(g: GraphContext, carrera_id: object, desde: str, hasta: str) -> DataFrame:
    return _monthly(g.context(desde, hasta, carrera_id))


def date_range(g: GraphContext) -> DataFrame:
    return g.oferta.agg(F.min("fecha").alias("desde"), F.max("fecha").alias("hasta"))


def _element(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({"conocimiento": "id", "conocimiento_nombre": "elemento"})


def demand(g: GraphContext, dimension: str, carrera_id: object, desde: str, hasta: str, limite: int = MAX_ROWS) -> DataFrame:
    """Elements of a dimension by offers for a career."""
    rows = distinct_offers(g.context(desde, hasta, carrera_id).join(g.requiere, "oferta"), "conocimiento").join(g.conocimiento.filter(F.col("dimension") == dimension), "conocimiento")
    return _element(rows).select("id", "elemento", "ofertas").orderBy(F.desc("ofertas"), asc("elemento"), asc("id")).limit(limite)


def coverage(g: GraphContext, dimension: str, carrera_id: object, limite: int = MAX_ROWS) -> DataFrame:
    """Elements of a dimension by courses of a career that cover them."""
    total = g.ensenia.filter(F.col("carrera") == F.lit(carrera_id)).agg(F.countDistinct("curso").alias("total_cursos"))
    rows = g.taught(carrera_id, dimension).select("conocimiento", "conocimiento_nombre", F.col("cursos").alias("cursos_con_cobertura"))
    rows = _element(rows).orderBy(F.desc("cursos_con_cobertura"), asc("elemento"), asc("id")).limit(limite)
    return rows.crossJoin(F.broadcast(total)).select("id", "elemento", "cursos_con_cobertura", "total_cursos").orderBy(F.desc("cursos_con_cobertura"), asc("elemento"), asc("id"))


def gaps(g: GraphContext, dimension: str, carrera_id: object, desde: str, hasta: str, limite: int = MAX_ROWS) -> DataFrame:
    """Demand less coverage of every element that has either; a share of nothing is 0."""
    offers = g.context(desde, hasta, carrera_id)
    whole = g.carrera.filter(F.col("carrera") == F.lit(carrera_id)).crossJoin(offers.agg(F.countDistinct("oferta").alias("total_ofertas")))
    whole = whole.crossJoin(g.ensenia.filter(F.col("carrera") == F.lit(carrera_id)).agg(F.countDistinct("curso").alias("total_cursos"))).select("total_ofertas", "total_cursos")
    asked = distinct_offers(offers.join(g.requiere, "oferta"), "conocimiento", name="ofertas_que_requieren")
    taught = g.taught(carrera_id, dimension).select("conocimiento", F.col("cursos").alias("cursos_con_cobertura"))
    rows = asked.join(taught, "conocimiento", "full").join(g.conocimiento.filter(F.col("dimension") == dimension), "conocimiento").crossJoin(F.broadcast(whole))
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("ofertas_que_requieren", "cursos_con_cobertura")})
    rate = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.try_divide(F.col(a).cast("double"), F.col(b)))
    rows = rows.withColumn("cobertura", rate("cursos_con_cobertura", "total_cursos")).withColumn("demanda", rate("ofertas_que_requieren", "total_ofertas"))
    rows = _element(rows).withColumn("brecha", F.col("demanda") - F.col("cobertura"))
    rows = rows.select("id", "elemento", "cursos_con_cobertura", "total_cursos", "ofertas_que_requieren", "total_ofertas", "cobertura", "demanda", "brecha")
    return rows.orderBy(F.desc("brecha"), F.desc("ofertas_que_requieren"), asc("elemento"), asc("id")).limit(limite)


def industries(g: GraphContext, dimension: str, elemento_id: object, desde: str, hasta: str, limite: int = MAX_ROWS) -> DataFrame:
    """Industries by offers that ask for one element."""
    wanted = g.requiere.filter(F.col("conocimiento") == F.lit(elemento_id)).join(g.conocimiento.filter(F.col("dimension") == dimension), "conocimiento", "left_semi").select("oferta")
    rows = g.between(desde, hasta).join(wanted, "oferta", "left_semi").join(g.publica, "oferta").join(g.agrupa, "empresa").join(g.industria, "industria")
    return distinct_offers(rows, "industria_nombre").select(F.col("industria_nombre").alias("industria"), "ofertas").orderBy(F.desc("ofertas"), asc("industria")).limit(limite)
