"""Catalogue, section one: the labour market at large."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.operators.algebra import asc, desc, distinct_offers, nothing, share, top, top_of_each, with_total
from skillgrid.sources.graph import GraphContext

_available = lambda: F.lit("available").alias("availability")


def _series(months: DataFrame, offers: DataFrame, *first: str) -> DataFrame:
    """Counts of each listed month, 0 where it has none."""
    monthly = distinct_offers(offers.withColumn("mes", F.trunc(F.to_date("fecha"), "MM")), "mes")
    rows = months.join(monthly, F.col("periodo") == F.col("mes"), "left").withColumn("ofertas", F.coalesce("ofertas", F.lit(0)).cast("long"))
    label = F.date_format("periodo", "yyyy-MM-dd")
    status = F.when(F.col("ofertas") == 0, "no_data").otherwise("available")
    return rows.orderBy(asc("periodo")).select(
        *first, label.alias("periodo_id"), label.alias("periodo"), F.col("ofertas").alias("value"), "ofertas", F.col("ofertas").alias("numerator_n"), nothing("denominator_n"), status.alias("availability")
    )


def trend(g: GraphContext) -> DataFrame:
    """Offers of each of the twelve months up to the last publication; one row without a month if no offer is
    dated."""
    months = F.when(F.col("corte").isNotNull(), F.sequence("inicio", F.trunc(F.to_date("corte"), "MM"), F.expr("INTERVAL 1 MONTH")))
    return _series(g.cutoff().select(F.explode_outer(months).alias("periodo")), g.recent())


def months_before(desde: str, hasta: str, most: int = 20) -> list[date]:
    """First days of the months of a period, at most the last `most`; one that ends on a first day at whatever
    hour doesn't include that month."""
    day = lambda x: datetime.fromisoformat(x.replace("Z", "+00:00")).astimezone(timezone.utc).date() if "T" in x else date.fromisoformat(x)
    start, end = day(desde), day(hasta)
    n = end.year * 12 + end.month - 1 - (end.day == 1)
    out = []
    for k in range(n - most + 1, n + 1):
        if date((k + 1) // 12, (k + 1) % 12 + 1, 1) > start:
            out.append(date(k // 12, k % 12 + 1, 1))
    return out


def trend_of(g: GraphContext, carrera_id: object, industria_id: object, desde: str, hasta: str) -> DataFrame:
    """Monthly offers for a career by companies of an industry."""
    months = months_before(desde, hasta)
    listed = F.explode(F.array(*[F.lit(m) for m in months])) if months else F.explode(F.array().cast("array<date>"))
    frame = g.oferta.sparkSession.range(1).select(F.lit(carrera_id).alias("carrera_id"), F.lit(industria_id).alias("industria_id"), listed.alias("periodo"))
    return _series(frame, g.context(desde, hasta, carrera_id, industria_id), "carrera_id", "industria_id")


def _ranked_careers(df: DataFrame, *first: str) -> DataFrame:
    rows = top(with_total(df, "ofertas"), 14, desc("ofertas"), asc("carrera_nombre"), asc("carrera"))
    return rows.orderBy("rank").select(
        *first, F.col("carrera").alias("carrera_id"), F.col("carrera_nombre").alias("carrera"), F.col("ofertas").alias("value"), "ofertas", share("ofertas", "total_assignments").alias("assignment_share"),
        "rank", F.col("ofertas").alias("numerator_n"), F.col("total_assignments").alias("denominator_n"), "total_assignments", _available(),
    )


def careers(g: GraphContext) -> DataFrame:
    """Careers by recent offers; shares are of the sum of all careers' counts."""
    return _ranked_careers(distinct_offers(g.recent().join(g.dirige, "oferta"), "carrera").join(g.carrera, "carrera"))


def careers_of(g: GraphContext, facultad_id: object, industria_id: object, desde: str, hasta: str) -> DataFrame:
    """Careers of a faculty by offers of an industry's companies."""
    offers = g.context(desde, hasta, industria=industria_id).join(g.dirige, "oferta")
    own = g.facultad.filter(F.col("facultad") == F.lit(facultad_id)).join(g.ofrece, "facultad")
    place = g.industria.filter(F.col("industria") == F.lit(industria_id))
    rows = distinct_offers(offers.join(own.select("carrera"), "carrera", "left_semi"), "carrera").join(g.carrera, "carrera")
    named = g.facultad.filter(F.col("facultad") == F.lit(facultad_id)).crossJoin(place).select(F.col("facultad").alias("facultad_id"), F.col("facultad_nombre").alias("f"), F.col("industria").alias("industria_id"), F.col("industria_nombre").alias("i"))
    out = _ranked_careers(rows.crossJoin(F.broadcast(named)), "facultad_id", "f", "industria_id", "i")
    return out.withColumnsRenamed({"f": "facultad", "i": "industria"})


def _by_industry(g: GraphContext, offers: DataFrame, *keys: str) -> DataFrame:
    rows = offers.join(g.publica, "oferta").join(g.agrupa, "empresa")
    return rows.groupBy(*keys, "industria").agg(F.countDistinct("oferta").alias("ofertas"), F.countDistinct("empresa").alias("empresas")).join(g.industria, "industria")


def industries(g: GraphContext) -> DataFrame:
    """The leading industry of each career, and how many are active; careers by their total."""
    rows = _by_industry(g, g.recent().join(g.dirige, "oferta"), "carrera")
    totals = rows.groupBy("carrera").agg(F.sum("ofertas").alias("total_assignments"), F.count("*").alias("industrias_activas"))
    lead = top_of_each(rows, 1, ["carrera"], desc("ofertas"), asc("industria_nombre"), asc("industria"), rank="first").join(totals, "carrera").join(g.carrera, "carrera")
    rows = top(lead, 14, desc("total_assignments"), asc("carrera_nombre"), asc("carrera"))
    return rows.orderBy("rank").select(
        F.col("carrera").alias("carrera_id"), F.col("carrera_nombre").alias("carrera"), F.col("industria").alias("industria_id"), F.col("industria_nombre").alias("industria"),
        F.col("ofertas").alias("value"), "ofertas", "empresas", share("ofertas", "total_assignments").alias("assignment_share"), "rank",
        F.col("ofertas").alias("numerator_n"), F.col("total_assignments").alias("denominator_n"), "total_assignments", _available(), "industrias_activas",
    )


def industries_of(g: GraphContext, carrera_id: object, desde: str, hasta: str) -> DataFrame:
    """A career's first ten industries; shares are of all its industries' counts."""
    rows = with_total(_by_industry(g, g.context(desde, hasta, carrera_id)), "ofertas")
    rows = top(rows, 10, desc("ofertas"), asc("industria_nombre"), asc("industria")).crossJoin(F.broadcast(g.carrera.filter(F.col("carrera") == F.lit(carrera_id))))
    return rows.orderBy("rank").select(
        F.col("carrera").alias("carrera_id"), F.col("carrera_nombre").alias("carrera"), F.col("industria").alias("industria_id"), F.col("industria_nombre").alias("industria"),
        F.col("ofertas").alias("value"), "ofertas", "empresas", share("ofertas", "total_assignments").alias("assignment_share"), "rank",
        F.col("ofertas").alias("numerator_n"), F.col("total_assignments").alias("denominator_n"), "total_assignments", _available(),
    )


def _known(rows: DataFrame, *first: str) -> DataFrame:
    return rows.select(
        *first, F.col("conocimiento").alias("conocimiento_id"), F.col("conocimiento_nombre").alias("conocimiento"), "dimension", F.col("ofertas").alias("value"), "ofertas",
        share("ofertas", "total").alias("percentage"), "rank", F.col("ofertas").alias("numerator_n"), F.col("total").alias("denominator_n"), _available(),
    )


def knowledge(g: GraphContext) -> DataFrame:
    """Five elements of each dimension by recent offers, as shares of all recent offers."""
    total = g.recent().agg(F.countDistinct("oferta").alias("total"))
    rows = distinct_offers(g.recent().join(g.requiere, "oferta"), "conocimiento").join(g.conocimiento, "conocimiento")
    rows = top_of_each(rows, 5, ["dimension"], desc("ofertas"), asc("conocimiento_nombre"), asc("conocimiento")).crossJoin(F.broadcast(total))
    return _known(rows.orderBy("dimension", "rank"))


def knowledge_of(g: GraphContext, carrera_id: object, industria_id: object, tipo_conocimiento: str, desde: str, hasta: str) -> DataFrame:
    """Twenty elements of a dimension by offers of a career and industry, as shares of those offers."""
    offers = g.context(desde, hasta, carrera_id, industria_id)
    total = offers.agg(F.countDistinct("oferta").alias("total"))
    rows = distinct_offers(offers.join(g.requiere, "oferta"), "conocimiento").join(g.conocimiento.filter(F.col("dimension") == tipo_conocimiento), "conocimiento")
    rows = top(rows, 20, desc("ofertas"), asc("conocimiento_nombre"), asc("conocimiento")).crossJoin(F.broadcast(total))
    named = g.carrera.filter(F.col("carrera") == F.lit(carrera_id)).crossJoin(g.industria.filter(F.col("industria") == F.lit(industria_id)))
    named = named.select(F.col("carrera").alias("carrera_id"), F.col("carrera_nombre").alias("carrera"), F.col("industria").alias("industria_id"), F.col("industria_nombre").alias("industria"))
    return _known(rows.crossJoin(F.broadcast(named)).orderBy("rank"), "carrera_id", "carrera", "industria_id", "industria")
