"""Catalogue, section two: how far curricula cover what offers ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillgrid.operators.algebra import asc, desc, distinct_offers, gate, nothing, only_if_available, share, top, with_total
from skillgrid.sources.graph import DIMENSIONS, GraphContext

# What a status row says.
NO_CURRICULUM = "Cobertura curricular no disponible en el grafo."
NOT_ALL_DIMENSIONS = "La carrera no tiene cobertura válida en las tres dimensiones."
NO_DIMENSION = "No hay cobertura válida para la dimensión seleccionada."
NO_OFFERS = "No hay ofertas en el contexto seleccionado."


def _warning() -> Column:
    s = F.col("availability")
    return F.when(s == "unavailable", NO_CURRICULUM).when(s == "incomplete", NO_DIMENSION).when(s == "no_market_data", NO_OFFERS).alias("warning")


def _courses(g: GraphContext) -> DataFrame:
    return g.ensenia.groupBy("carrera").agg(F.countDistinct("curso").alias("total_cursos"))


def coverage(g: GraphContext) -> DataFrame:
    """Every career's courses and coverage records of each dimension, and whether they can be compared."""
    counts = g.records().groupBy("carrera").agg(*[F.sum(F.when(F.col("dimension") == d, F.col("coberturas"))).alias(f"coberturas_{d}") for d in DIMENSIONS])
    rows = g.carrera.join(_courses(g), "carrera", "left").join(counts, "carrera", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("total_cursos", *(f"coberturas_{d}" for d in DIMENSIONS))})
    some = {d: F.col(f"coberturas_{d}") > 0 for d in DIMENSIONS}
    a, b, c = some.values()
    status = F.when(F.col("total_cursos") == 0, "unavailable").when(~(a & b & c), "incomplete").otherwise("available")
    rows = rows.withColumn("availability", status).withColumn("has_any_comparable_dimension", a | b | c)
    rows = rows.orderBy(F.desc("has_any_comparable_dimension"), F.desc("total_cursos"), asc("carrera_nombre"), asc("carrera")).limit(14)
    warning = F.when(F.col("availability") == "unavailable", NO_CURRICULUM).when(F.col("availability") == "incomplete", NOT_ALL_DIMENSIONS)
    return rows.select(
        F.col("carrera").alias("carrera_id"), F.col("carrera_nombre").alias("carrera"), F.when(F.col("availability") == "available", F.col("total_cursos")).alias("value"), F.col("total_cursos").alias("numerator_n"), nothing("denominator_n"),
        *[f"coberturas_{d}" for d in DIMENSIONS], *[x.alias(f"{d}_comparable") for d, x in some.items()], "availability", "has_any_comparable_dimension", warning.alias("warning"),
    )


def _status(g: GraphContext, carrera_id: object, dimension: str, industria_id: object = None, offers: DataFrame | None = None) -> DataFrame:
    """One row of the career (and industry), its totals and what is available; none if either doesn't exist."""
    row = g.carrera.filter(F.col("carrera") == F.lit(carrera_id))
    if industria_id is not None:
        row = row.crossJoin(g.industria.filter(F.col("industria") == F.lit(industria_id)))
    row = row.crossJoin(g.ensenia.filter(F.col("carrera") == F.lit(carrera_id)).agg(F.countDistinct("curso").alias("total_cursos")))
    row = row.crossJoin(g.records(carrera_id, dimension).agg(F.coalesce(F.sum("coberturas"), F.lit(0)).alias("dimension_coverage_n")))
    status = F.when(F.col("total_cursos") == 0, "unavailable").when(F.col("dimension_coverage_n") == 0, "incomplete")
    if offers is not None:
        row = row.crossJoin(offers.agg(F.countDistinct("oferta").alias("total_ofertas")))
        status = status.when(F.col("total_ofertas") == 0, "no_market_data")
    return row.withColumn("availability", status.otherwise("available"))


def coverage_of(g: GraphContext, carrera_id: object, tipo_conocimiento: str) -> DataFrame:
    """A career's twenty most covered elements of a dimension, or one status row."""
    rows = g.taught(carrera_id, tipo_conocimiento).select("conocimiento", "conocimiento_nombre", "cursos")
    rows = top(rows, 20, desc("cursos"), asc("conocimiento_nombre"), asc("conocimiento"))
    out = gate(_status(g, carrera_id, tipo_conocimiento), rows)
    return out.orderBy(asc("rank")).select(
        F.col("carrera").alias("carrera_id"), F.col("carrera_nombre").alias("carrera"), F.col("conocimiento").alias("conocimiento_id"), F.col("conocimiento_nombre").alias("conocimiento"), F.lit(tipo_conocimiento).alias("dimension"),
        F.col("cursos").alias("value"), share("cursos", "total_cursos").alias("percentage"), "rank", F.col("cursos").alias("numerator_n"), F.when(F.col("availability") == "available", F.col("total_cursos")).alias("denominator_n"),
        "dimension_coverage_n", "availability", (F.col("availability") == "available").alias("is_comparable"), _warning(),
    )


def _pairs(g: GraphContext, offers: DataFrame, taught: DataFrame, covered_only: bool, dimension: str | None = None) -> DataFrame:
    """(carrera, conocimiento, ofertas, cursos): demand and coverage, each counted on its own and joined once;
    pairs that are only asked for are left out with covered_only."""
    known = g.conocimiento if dimension is None else g.conocimiento.filter(F.col("dimension") == dimension)
    asked = distinct_offers(offers.join(g.requiere, "oferta"), "carrera", "conocimiento")
    both = taught.select("carrera", "conocimiento", "cursos").join(asked, ["carrera", "conocimiento"], "left" if covered_only else "full")
    both = both.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("ofertas", "cursos")})
    return both.join(known, "conocimiento")


def _compared(rows: DataFrame, first: list[Column | str], last: list[Column | str]) -> DataFrame:
    return rows.orderBy(asc("rank")).select(
        *first, F.col("conocimiento").alias("conocimiento_id"), F.col("conocimiento_nombre").alias("conocimiento"), "dimension", "value", "demand_percentage", "coverage_percentage",
        *only_if_available("demand_numerator_n", "demand_denominator_n", "coverage_numerator_n", "coverage_denominator_n", "rank"), *last,
    )


def _measured(rows: DataFrame, sign: int) -> DataFrame:
    """Adds the percentages and value = sign * (demand - coverage)."""
    rows = rows.withColumn("demand_percentage", share("ofertas", "total_ofertas")).withColumn("coverage_percentage", share("cursos", "total_cursos"))
    gap = F.col("demand_percentage") - F.col("coverage_percentage") if sign > 0 else F.col("coverage_percentage") - F.col("demand_percentage")
    return rows.withColumn("value", gap).withColumnsRenamed({"ofertas": "demand_numerator_n", "total_ofertas": "demand_denominator_n", "cursos": "coverage_numerator_n", "total_cursos": "coverage_denominator_n"})


def _difference(g: GraphContext, covered_only: bool, sign: int) -> DataFrame:
    offers = g.recent().join(g.dirige, "oferta")
    taught = g.taught()
    totals = _courses(g).join(distinct_offers(offers, "carrera", name="total_ofertas"), "carrera", "left" if covered_only else "inner")
    totals = totals.withColumn("total_ofertas", F.coalesce("total_ofertas", F.lit(0)).cast("long"))
    rows = _pairs(g, offers, taught, covered_only)
    if not covered_only:
        rows = rows.join(taught.select("carrera", "dimension").distinct(), ["carrera", "dimension"], "left_semi")
    rows = rows.join(F.broadcast(totals), "carrera").join(F.broadcast(g.carrera), "carrera")
    status = F.when(F.col("demand_denominator_n") == 0, "no_market_data").otherwise("available")
    rows = _measured(rows, sign).withColumn("availability", status)
    second = "coverage_numerator_n" if covered_only else "demand_numerator_n"
    rows = top(rows, 20, desc("value"), desc(second), asc("carrera_nombre"), asc("conocimiento_nombre"), asc("carrera"), asc("conocimiento"))
    total = g.carrera.agg(F.countDistinct("carrera").alias("total_carreras"))
    first = [F.col("carrera").alias("carrera_id"), F.col("carrera_nombre").alias("carrera")]
    out = _compared(rows.crossJoin(F.broadcast(total)), first, ["availability", (F.col("availability") == "available").alias("is_comparable"), "total_carreras"])
    return out.orderBy(asc("rank"))


def _difference_of(g: GraphContext, covered_only: bool, sign: int, carrera_id: object, industria_id: object, dimension: str, desde: str, hasta: str) -> DataFrame:
    offers = g.context(desde, hasta, carrera_id, industria_id)
    mine = offers.withColumn("carrera", F.lit(carrera_id))
    status = _status(g, carrera_id, dimension, industria_id, offers)
    totals = status.select("total_cursos", "total_ofertas")
    rows = _pairs(g, mine, g.taught(carrera_id, dimension), covered_only, dimension).drop("carrera").crossJoin(F.broadcast(totals))
    rows = top(_measured(rows, sign), 20, desc("value"), desc("demand_numerator_n"), asc("conocimiento_nombre"), asc("conocimiento"))
    out = gate(status, rows.drop("dimension")).withColumn("dimension", F.lit(dimension))
    first = [F.col("carrera").alias("carrera_id"), F.col("carrera_nombre").alias("carrera"), F.col("industria").alias("industria_id"), F.col("industria_nombre").alias("industria")]
    return _compared(out, first, ["dimension_coverage_n", "availability", (F.col("availability") == "available").alias("is_comparable"), _warning()])


def gaps(g: GraphContext) -> DataFrame:
    """Where demand exceeds coverage most, over careers with courses and recent offers."""
    return _difference(g, covered_only=False, sign=1)


def gaps_of(g: GraphContext, carrera_id: object, industria_id: object, tipo_conocimiento: str, desde: str, hasta: str) -> DataFrame:
    return _difference_of(g, False, 1, carrera_id, industria_id, tipo_conocimiento, desde, hasta)


def currency(g: GraphContext) -> DataFrame:
    """Where coverage exceeds demand most. Careers without recent offers come first, unranked."""
    return _difference(g, covered_only=True, sign=-1)


def currency_of(g: GraphContext, carrera_id: object, industria_id: object, tipo_conocimiento: str, desde: str, hasta: str) -> DataFrame:
    return _difference_of(g, True, -1, carrera_id, industria_id, tipo_conocimiento, desde, hasta)


def _offers_by_programme(asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(carrera, programa, ofertas): how many offers of asked (carrera, oferta, conocimiento) ask for anything that a
    programme of pairs (carrera, programa, conocimiento) covers.

    A career's programmes are numbered; 64 of them are the bits of a word. What teaches an element is a few words,
    an offer's words are joined by "or" before they are shuffled, and each bit is counted where the words lie, so that
    nothing grows with offers times courses."""
    numbers = pairs.select("carrera", "programa").distinct().withColumn("k", F.row_number().over(Window.partitionBy("carrera").orderBy("programa")) - 1)
    numbers = numbers.select("carrera", "programa", F.expr("k div 64").alias("palabra"), (F.col("k") % 64).alias("bit"))
    taught = pairs.join(numbers, ["carrera", "programa"]).groupBy("carrera", "conocimiento", "palabra").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    answered = asked.join(taught, ["carrera", "conocimiento"]).groupBy("carrera", "oferta", "palabra").agg(F.bit_or("bits").alias("bits"))
    counts = answered.groupBy("carrera", "palabra").agg(*[F.sum(F.shiftright("bits", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)])
    each = counts.select("carrera", "palabra", F.posexplode(F.array(*[f"b{b}" for b in range(64)])).alias("bit", "ofertas"))
    return each.filter("ofertas > 0").join(numbers, ["carrera", "palabra", "bit"]).select("carrera", "programa", "ofertas")


def courses(g: GraphContext) -> DataFrame:
    """Courses by recent offers for their own career that ask for what they cover."""
    asked = g.recent().join(g.dirige, "oferta").join(g.requiere, "oferta").select("oferta", "carrera", "conocimiento")
    enrolled, keys = g.enrolled().distinct(), ["carrera", "programa"]
    pairs = enrolled.select(*keys).distinct().join(g.contents(), "programa").select(*keys, "conocimiento")
    shared = pairs.join(asked.select("carrera", "conocimiento").distinct(), ["carrera", "conocimiento"], "left_semi").groupBy(*keys).agg(F.count("*").alias("conocimientos_compartidos"))
    rows = _offers_by_programme(asked, pairs).join(shared, keys).join(enrolled, keys).drop("programa")
    rows = with_total(rows.join(g.curso, "curso").join(g.carrera, "carrera"), "ofertas")
    rows = top(rows, 20, desc("ofertas"), desc("conocimientos_compartidos"), asc("curso_nombre"), asc("carrera"), asc("curso"))
    careers = g.carrera.agg(F.countDistinct("carrera").alias("total_carreras")).crossJoin(g.carrera.join(g.ensenia, "carrera", "left_semi").agg(F.countDistinct("carrera").alias("carreras_perfiladas")))
    return rows.crossJoin(F.broadcast(careers)).orderBy("rank").select(
        F.col("carrera").alias("carrera_id"), F.col("carrera_nombre").alias("carrera"), F.col("curso").alias("curso_id"), F.col("curso_nombre").alias("curso"), F.col("ofertas").alias("value"), "ofertas", "conocimientos_compartidos",
        share("ofertas", "total_assignments").alias("assignment_share"), "rank", F.col("ofertas").alias("numerator_n"), F.col("total_assignments").alias("denominator_n"), "total_assignments", "carreras_perfiladas", "total_carreras",
        F.lit("available").alias("availability"), share("carreras_perfiladas", "total_carreras").alias("coverage_percentage"), F.lit(True).alias("is_comparable"),
    )


def courses_of(g: GraphContext, carrera_id: object, industria_id: object, tipo_conocimiento: str, desde: str, hasta: str) -> DataFrame:
    """A career's courses of a dimension by offers of an industry; courses that no offer asks for stay."""
    offers = g.context(desde, hasta, carrera_id, industria_id)
    enrolled = g.enrolled(carrera_id).select("curso", "programa").distinct()
    pairs = enrolled.select("programa").distinct().join(g.contents(tipo_conocimiento), "programa").select(F.lit(carrera_id).alias("carrera"), "programa", "conocimiento")
    asked = offers.join(g.requiere, "oferta").select(F.lit(carrera_id).alias("carrera"), "oferta", "conocimiento")
    shared = pairs.join(asked.select("conocimiento").distinct().withColumn("asked", F.lit(1)), "conocimiento", "left").groupBy("programa").agg(F.count("asked").alias("conocimientos_compartidos"))
    counts = shared.join(_offers_by_programme(asked, pairs).drop("carrera"), "programa", "left").withColumn("ofertas", F.coalesce("ofertas", F.lit(0)).cast("long"))
    rows = counts.join(enrolled, "programa").drop("programa").join(g.curso, "curso")
    rows = top(rows, 20, desc("ofertas"), desc("conocimientos_compartidos"), asc("curso_nombre"), asc("curso"))
    out = gate(_status(g, carrera_id, tipo_conocimiento, industria_id, offers), rows)
    return out.orderBy(asc("rank")).select(
        F.col("carrera").alias("carrera_id"), F.col("carrera_nombre").alias("carrera"), F.col("industria").alias("industria_id"), F.col("industria_nombre").alias("industria"), F.col("curso").alias("curso_id"), F.col("curso_nombre").alias("curso"),
        F.lit(tipo_conocimiento).alias("dimension"), F.col("ofertas").alias("value"), F.col("ofertas").alias("numerator_n"), F.when(F.col("availability") == "available", F.col("total_ofertas")).alias("denominator_n"),
        "conocimientos_compartidos", "rank", "dimension_coverage_n", "availability", (F.col("availability") == "available").alias("is_comparable"), _warning(),
    )
