"""Catalogue, section three: companies and what they look for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.functions.text import is_leadership, tidy
from skillgrid.operators.algebra import asc, desc, distinct_offers, gate, only_if_available, share, top, top_of_each, with_total
from skillgrid.sources.graph import GraphContext

_available = lambda: F.lit("available").alias("availability")
#: Least offers of a company and least offers of a pair for a lift.
COMPANY_SUPPORT, PAIR_SUPPORT = 5, 2
# What a status row says.
NOT_FOUND = "Una empresa no existe."
NO_OFFERS = "Ambas empresas necesitan ofertas en el período."
NO_DIFFERENCE = "No hay conocimientos con diferencia positiva para Empresa A."


def _leaders(g: GraphContext, offers: DataFrame) -> DataFrame:
    """Companies of (oferta) with their offers and leading knowledge; those whose offers ask for nothing are
    left out, and of the total too."""
    own = offers.join(g.publica, "oferta")
    counts = distinct_offers(own, "empresa")
    asked = distinct_offers(own.join(g.requiere, "oferta"), "empresa", "conocimiento", name="ofertas_con_conocimiento_lider").join(g.conocimiento, "conocimiento")
    lead = top_of_each(asked, 1, ["empresa"], desc("ofertas_con_conocimiento_lider"), asc("conocimiento_nombre"), asc("conocimiento"), rank="first")
    return counts.join(lead, "empresa").join(g.empresa, "empresa")


def _led(rows: DataFrame, *first: str) -> DataFrame:
    rows = top(with_total(rows, "ofertas"), 20, desc("ofertas"), asc("empresa_nombre"), asc("empresa"))
    return rows.orderBy("rank").select(
        *first, F.col("empresa").alias("empresa_id"), F.col("empresa_nombre").alias("empresa"), F.col("conocimiento").alias("conocimiento_id"), F.col("conocimiento_nombre").alias("conocimiento_lider"), F.col("ofertas").alias("value"), "ofertas",
        "ofertas_con_conocimiento_lider", share("ofertas", "total_assignments").alias("assignment_share"), "rank", F.col("ofertas").alias("numerator_n"), F.col("total_assignments").alias("denominator_n"), "total_assignments", _available(),
    )


def companies(g: GraphContext) -> DataFrame:
    return _led(_leaders(g, g.recent()))


def companies_of(g: GraphContext, carrera_id: object, industria_id: object, desde: str, hasta: str) -> DataFrame:
    rows = _leaders(g, g.context(desde, hasta, carrera_id, industria_id))
    rows = rows.join(g.agrupa.filter(F.col("industria") == F.lit(industria_id)).select("empresa"), "empresa", "left_semi")
    named = g.carrera.filter(F.col("carrera") == F.lit(carrera_id)).crossJoin(g.industria.filter(F.col("industria") == F.lit(industria_id)))
    named = named.select(F.col("carrera").alias("carrera_id"), F.col("carrera_nombre").alias("carrera"), F.col("industria").alias("industria_id"), F.col("industria_nombre").alias("industria"))
    return _led(rows.crossJoin(F.broadcast(named)), "carrera_id", "carrera", "industria_id", "industria")


def distinctive(g: GraphContext) -> DataFrame:
    """Lift of an element in a company's offers over all offers, where both counts are large enough."""
    recent = g.recent()
    total = recent.agg(F.countDistinct("oferta").alias("global_denominator_n"))
    asked = recent.join(g.requiere, "oferta")
    everywhere = distinct_offers(asked, "conocimiento", name="global_numerator_n").join(g.conocimiento, "conocimiento")
    whole = distinct_offers(recent.join(g.publica, "oferta"), "empresa", name="denominator_n").filter(F.col("denominator_n") >= COMPANY_SUPPORT)
    pairs = distinct_offers(asked.join(g.publica, "oferta"), "empresa", "conocimiento", name="numerator_n").filter(F.col("numerator_n") >= PAIR_SUPPORT)
    rows = pairs.join(whole, "empresa").join(everywhere, "conocimiento").join(g.empresa, "empresa").crossJoin(F.broadcast(total))
    lift = share("numerator_n", "denominator_n") / share("global_numerator_n", "global_denominator_n")
    rows = top(rows.withColumn("lift", lift), 20, desc("lift"), desc("numerator_n"), asc("empresa_nombre"), asc("conocimiento_nombre"), asc("empresa"), asc("conocimiento"))
    return rows.orderBy("rank").select(
        F.col("empresa").alias("empresa_id"), F.col("empresa_nombre").alias("empresa"), F.col("conocimiento").alias("conocimiento_id"), F.col("conocimiento_nombre").alias("conocimiento"), F.col("lift").alias("value"), "lift",
        "numerator_n", "denominator_n", "global_numerator_n", "global_denominator_n", "rank", _available(), F.lit(COMPANY_SUPPORT).cast("long").alias("minimum_support_n"),
    )


def distinctive_of(g: GraphContext, empresa_a_id: object, empresa_b_id: object, desde: str, hasta: str) -> DataFrame:
    """What company A asks for in a larger share of its offers than company B. A must exist; if B doesn't, one
    row says so."""
    period = g.between(desde, hasta)
    ids = {"a": empresa_a_id, "b": empresa_b_id}
    own = period.join(g.publica.filter(F.col("empresa").isin(empresa_a_id, empresa_b_id)), "oferta")
    of = lambda k: F.countDistinct(F.when(F.col("empresa") == F.lit(ids[k]), F.col("oferta")))
    name = {k: g.empresa.filter(F.col("empresa") == F.lit(v)).select(F.lit(1).alias(f"is_{k}"), F.col("empresa_nombre").alias(f"empresa_{k}")) for k, v in ids.items()}
    status = name["a"].join(name["b"], F.lit(True), "left").crossJoin(own.agg(of("a").alias("n_a"), of("b").alias("n_b")))
    status = status.withColumn("availability", F.when(F.col("is_b").isNull(), "company_not_found").when((F.col("n_a") == 0) | (F.col("n_b") == 0), "no_market_data").otherwise("available"))
    rows = own.join(g.requiere, "oferta").groupBy("conocimiento").agg(of("a").alias("numerator_n_a"), of("b").alias("numerator_n_b")).join(g.conocimiento, "conocimiento")
    rows = rows.crossJoin(F.broadcast(status.select("n_a", "n_b")))
    rows = rows.withColumn("empresa_a_percentage", share("numerator_n_a", "n_a")).withColumn("empresa_b_percentage", share("numerator_n_b", "n_b")).drop("n_a", "n_b")
    rows = rows.withColumn("difference_pp", F.col("empresa_a_percentage") - F.col("empresa_b_percentage")).filter("difference_pp > 0")
    rows = top(rows, 20, desc("difference_pp"), desc("numerator_n_a"), asc("conocimiento_nombre"), asc("conocimiento"))
    out = gate(status, rows)
    out = out.withColumn("availability", F.when((F.col("availability") == "available") & F.col("conocimiento").isNull(), "no_positive_difference").otherwise(F.col("availability")))
    s = F.col("availability")
    warning = F.when(s == "company_not_found", NOT_FOUND).when(s == "no_market_data", NO_OFFERS).when(s == "no_positive_difference", NO_DIFFERENCE)
    return out.orderBy(asc("rank")).select(
        F.lit(empresa_a_id).alias("empresa_a_id"), "empresa_a", F.lit(empresa_b_id).alias("empresa_b_id"), "empresa_b", F.col("conocimiento").alias("conocimiento_id"), F.col("conocimiento_nombre").alias("conocimiento"), "dimension",
        F.col("difference_pp").alias("value"), "empresa_a_percentage", "empresa_b_percentage", "difference_pp", "numerator_n_a", F.col("n_a").alias("denominator_n_a"), "numerator_n_b",
        F.when(F.col("is_b").isNotNull(), F.col("n_b")).alias("denominator_n_b"), "rank", "availability", warning.alias("warning"),
    )


def _leading_offers(g: GraphContext, offers: DataFrame) -> DataFrame:
    titled = g.ofrece_puesto.join(g.puesto.filter(is_leadership("puesto_nombre")), "puesto").select("oferta")
    return offers.join(titled, "oferta", "left_semi")


def _with_industry(g: GraphContext, offers: DataFrame) -> DataFrame:
    return offers.join(g.publica, "oferta").join(g.agrupa, "empresa")


def leadership(g: GraphContext) -> DataFrame:
    """Industries by recent offers whose title is a leading one; one no_data row without any."""
    recent = g.recent()
    whole = distinct_offers(_with_industry(g, recent), "industria", name="denominator_n")
    rows = distinct_offers(_with_industry(g, _leading_offers(g, recent)), "industria").join(whole, "industria").join(g.industria, "industria")
    rows = top(rows, 20, desc("ofertas"), asc("industria_nombre"), asc("industria"))
    dated = g.cutoff().filter("corte IS NOT NULL").select(F.lit(1).alias("one"))
    out = dated.join(rows, F.lit(True), "left")
    return out.orderBy(asc("rank")).select(
        F.col("industria").alias("industria_id"), F.col("industria_nombre").alias("industria"), F.col("ofertas").alias("value"), F.col("ofertas").alias("titulos_con_senal_liderazgo"), share("ofertas", "denominator_n").alias("percentage"),
        "rank", F.col("ofertas").alias("numerator_n"), "denominator_n", F.when(F.col("denominator_n").isNull(), "no_data").otherwise("available").alias("availability"),
    )


def leadership_of(g: GraphContext, industria_id: object, desde: str, hasta: str) -> DataFrame:
    """What an industry's leading offers ask for, as shares of those offers."""
    offers = _leading_offers(g, g.context(desde, hasta, industria=industria_id))
    status = g.industria.filter(F.col("industria") == F.lit(industria_id)).crossJoin(offers.agg(F.countDistinct("oferta").alias("total")))
    status = status.withColumn("availability", F.when(F.col("total") == 0, "no_data").otherwise("available"))
    rows = distinct_offers(offers.join(g.requiere, "oferta"), "conocimiento").join(g.conocimiento, "conocimiento")
    out = gate(status, top(rows, 10, desc("ofertas"), asc("conocimiento_nombre"), asc("conocimiento")))
    # available offers that ask for nothing are one row that counts none of them
    out = out.withColumn("ofertas", F.when(F.col("availability") == "available", F.coalesce("ofertas", F.lit(0)).cast("long")))
    out = out.withColumn("rank", F.when(F.col("availability") == "available", F.coalesce("rank", F.lit(1)).cast("long")))
    return out.orderBy(asc("rank")).select(
        F.col("industria").alias("industria_id"), F.col("industria_nombre").alias("industria"), F.col("conocimiento").alias("conocimiento_id"), F.col("conocimiento_nombre").alias("conocimiento"), "dimension",
        F.col("ofertas").alias("value"), "ofertas", share("ofertas", "total").alias("percentage"), "rank", F.col("ofertas").alias("numerator_n"), *only_if_available("total"), "availability",
    ).withColumnRenamed("total", "denominator_n")


def _functions(g: GraphContext, offers: DataFrame, first: list[Column | str], named: DataFrame | None = None) -> DataFrame:
    rows = offers.join(g.publica, "oferta").join(g.empresa.filter("tipo IS NOT NULL"), "empresa").join(g.ofrece_puesto, "oferta").join(g.puesto, "puesto")
    rows = distinct_offers(rows.withColumn("titulo_publicado", tidy("puesto_nombre")).filter("titulo_publicado <> ''"), "tipo", "titulo_publicado")
    kinds = rows.groupBy("tipo").agg(F.sum("ofertas").alias("total_assignments")).orderBy(F.desc("total_assignments"), asc("tipo")).limit(4)
    rows = top_of_each(rows.join(F.broadcast(kinds), "tipo"), 5, ["tipo"], desc("ofertas"), asc("titulo_publicado"))
    if named is not None:
        rows = rows.crossJoin(F.broadcast(named))
    rows = rows.orderBy(F.desc("total_assignments"), asc("tipo"), "rank").limit(20)
    return rows.select(
        *first, F.col("tipo").alias("tipo_empresa_id"), F.col("tipo").alias("tipo_empresa"), "titulo_publicado", F.col("ofertas").alias("value"), "ofertas", share("ofertas", "total_assignments").alias("assignment_share"), "rank",
        F.col("ofertas").alias("numerator_n"), F.col("total_assignments").alias("denominator_n"), "total_assignments", _available(),
    )


def job_titles(g: GraphContext) -> DataFrame:
    """Five titles of each of the four kinds of company that publish most."""
    return _functions(g, g.recent(), [])


def job_titles_of(g: GraphContext, carrera_id: object, desde: str, hasta: str) -> DataFrame:
    named = g.carrera.filter(F.col("carrera") == F.lit(carrera_id)).select(F.col("carrera").alias("carrera_id"), F.col("carrera_nombre").alias("carrera"))
    return _functions(g, g.context(desde, hasta, carrera_id), ["carrera_id", "carrera"], named)
