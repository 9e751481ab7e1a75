"""The property graph as typed node and edge DataFrames.

A node frame has its id under the label's name and its name under <label>_nombre; an edge frame has the ids of
its two ends. Relations that join different labels are separate frames, whatever they are called. Edge frames
hold no repeated rows. Ids may be of any type; both ends of an edge must use the same.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = ("competencia", "habilidad", "herramienta")
#: Edge triples (source label, relation, target label) and the frame that holds each.
TRIPLES = {
    ("facultad", "OFRECE", "carrera"): "ofrece",
    ("carrera", "ENSENIA", "curso"): "ensenia",
    ("curso", "TIENE", "cobertura"): "cubre",
    ("cobertura", "CUBRE", "conocimiento"): "cubre",
    ("curso", "TIENE", "silabo"): "silabo",
    ("oferta", "DIRIGE_A", "carrera"): "dirige",
    ("empresa", "PUBLICA", "oferta"): "publica",
    ("industria", "AGRUPA", "empresa"): "agrupa",
    ("oferta", "REQUIERE", "conocimiento"): "requiere",
    ("oferta", "OFRECE", "puesto"): "ofrece_puesto",
    ("puesto", "DEFINE", "conocimiento"): "define",
}


def moment(value: str | datetime) -> Column:
    """A literal point in time without zone, from an ISO text or a datetime; zones are turned to UTC."""
    t = value if isinstance(value, datetime) else datetime.fromisoformat(value.replace("Z", "+00:00"))
    if t.tzinfo:
        t = t.astimezone(timezone.utc).replace(tzinfo=None)
    return F.expr(f"TIMESTAMP_NTZ '{t.isoformat(sep=' ')}'")


def month_of(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


@dataclass(frozen=True)
class Programmes:
    """The relation cubre by programmes, where many courses cover alike: cursos has curso and programa, one for each
    course, contenido has programa, registro and conocimiento without repeated rows. Each course of a programme has
    a coverage record of its own for each registro, so that cubre has as many rows as the join of the two by programa,
    which grows with courses times records; what is counted here is counted without making it."""

    cubre: DataFrame
    cursos: DataFrame
    contenido: DataFrame

    def sizes(self, end: str) -> DataFrame:
        """(id, n): the rows of cubre that each course or each element has."""
        if end == "curso":
            each = self.contenido.groupBy("programa").agg(F.count("*").alias("n"))
            return self.cursos.join(each, "programa").select(F.col("curso").alias("id"), "n")
        each = self.contenido.groupBy("programa", "conocimiento").agg(F.count("*").alias("m"))
        courses = self.cursos.groupBy("programa").agg(F.count("*").alias("k"))
        return each.join(courses, "programa").groupBy(F.col("conocimiento").alias("id")).agg(F.sum(F.col("m") * F.col("k")).alias("n"))


@dataclass(frozen=True)
class GraphContext:
    """carrera, facultad, curso, conocimiento (with dimension), oferta (with fecha), empresa (with tipo),
    industria and puesto are nodes; silabo has curso, codigo and sumilla; cubre has curso, cobertura and
    conocimiento. The requirement between an offer and what it requires is contracted: counts are of distinct
    offers."""

    carrera: DataFrame
    facultad: DataFrame
    curso: DataFrame
    conocimiento: DataFrame
    oferta: DataFrame
    empresa: DataFrame
    industria: DataFrame
    puesto: DataFrame
    silabo: DataFrame
    ofrece: DataFrame
    ensenia: DataFrame
    cubre: DataFrame
    dirige: DataFrame
    publica: DataFrame
    agrupa: DataFrame
    requiere: DataFrame
    ofrece_puesto: DataFrame
    define: DataFrame
    #: Months of the offers (mes, n, desde, hasta), where the graph keeps them: oferta then has mes as well.
    meses: DataFrame | None = None
    #: Courses that cover alike, where the graph knows them; they hold for the cubre that they were made with.
    programas: Programmes | None = None

    def frames(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("meses", "programas")}

    def shared(self) -> Programmes | None:
        """The programmes, unless cubre was replaced since."""
        return self.programas if self.programas is not None and self.programas.cubre is self.cubre else None

    def register(self, prefix: str = "") -> None:
        """Makes the frames views for SQL."""
        for name, df in self.frames().items():
            df.createOrReplaceTempView(prefix + name)

    def cutoff(self) -> DataFrame:
        """One row: corte, the last publication (null without dated offers), and inicio, the first day of the
        month eleven months before it."""
        corte = self.oferta.agg(F.max("fecha").alias("corte")) if self.meses is None else self.meses.agg(F.max("hasta").alias("corte"))
        return corte.withColumn("inicio", F.add_months(F.trunc(F.to_date("corte"), "MM"), -11))

    def recent(self) -> DataFrame:
        """Offers from inicio to the cut-off, both included. The bounds are scalar subqueries, which Spark
        runs first and hands to the scan as values."""
        inicio, corte = self.cutoff().select(F.col("inicio").cast("timestamp_ntz")).scalar(), self.cutoff().select("corte").scalar()
        out = self.oferta.filter((F.col("fecha") >= inicio) & (F.col("fecha") <= corte))
        return self._in_months(out, inicio, corte).select("oferta", "fecha")

    def between(self, desde: str | datetime, hasta: str | datetime) -> DataFrame:
        """Offers published from desde on and before hasta."""
        return self._in_months(self.oferta.filter((F.col("fecha") >= moment(desde)) & (F.col("fecha") < moment(hasta))), moment(desde), moment(hasta))

    def _in_months(self, offers: DataFrame, first: Column, last: Column) -> DataFrame:
        """The same offers, read from the folders of their months only where they are kept by month."""
        if self.meses is None:
            return offers
        return offers.filter((F.col("mes") >= month_of(first)) & (F.col("mes") <= month_of(last))).drop("mes")

    def context(self, desde: str | datetime, hasta: str | datetime, carrera: object = None, industria: object = None) -> DataFrame:
        """Distinct offers of a period, directed to a career and published by companies of an industry."""
        out = self.between(desde, hasta)
        if carrera is not None:
            out = out.join(self.dirige.filter(F.col("carrera") == F.lit(carrera)).select("oferta"), "oferta", "left_semi")
        if industria is not None:
            out = out.join(self.publica.join(self.agrupa.filter(F.col("industria") == F.lit(industria)), "empresa").select("oferta"), "oferta", "left_semi")
        return out

    def _known(self, dimension: str | None = None) -> DataFrame:
        return self.conocimiento if dimension is None else self.conocimiento.filter(F.col("dimension") == dimension)

    def enrolled(self, carrera: object = None) -> DataFrame:
        """(carrera, curso, programa) of courses that careers teach. A course is its own programme where the graph
        doesn't know which cover alike."""
        taught = self.ensenia if carrera is None else self.ensenia.filter(F.col("carrera") == F.lit(carrera))
        shared = self.shared()
        if shared is None:
            return taught.select("carrera", "curso", F.col("curso").alias("programa"))
        return taught.join(shared.cursos, "curso").select("carrera", "curso", "programa")

    def contents(self, dimension: str | None = None) -> DataFrame:
        """(programa, conocimiento, conocimiento_nombre, dimension): what every course of a programme covers."""
        shared = self.shared()
        pairs = self.cubre.select(F.col("curso").alias("programa"), "conocimiento") if shared is None else shared.contenido.select("programa", "conocimiento")
        return pairs.distinct().join(self._known(dimension), "conocimiento")

    def taught(self, carrera: object = None, dimension: str | None = None) -> DataFrame:
        """(carrera, conocimiento, conocimiento_nombre, dimension, cursos): how many courses of a career cover an
        element; courses of a programme are counted before they meet what they cover."""
        courses = self.enrolled(carrera).groupBy("carrera", "programa").agg(F.countDistinct("curso").alias("k"))
        keys = ["carrera", "conocimiento", "conocimiento_nombre", "dimension"]
        return courses.join(self.contents(dimension), "programa").groupBy(*keys).agg(F.sum("k").alias("cursos"))

    def records(self, carrera: object = None, dimension: str | None = None) -> DataFrame:
        """(carrera, dimension, coberturas): the coverage records of a career's courses."""
        shared = self.shared()
        if shared is None:
            taught = self.enrolled(carrera).select("carrera", "curso").join(self.cubre, "curso").join(self._known(dimension), "conocimiento")
            return taught.groupBy("carrera", "dimension").agg(F.countDistinct("cobertura").alias("coberturas"))
        each = shared.contenido.join(self._known(dimension), "conocimiento").groupBy("programa", "dimension").agg(F.countDistinct("registro").alias("m"))
        courses = self.enrolled(carrera).groupBy("carrera", "programa").agg(F.countDistinct("curso").alias("k"))
        return courses.join(each, "programa").groupBy("carrera", "dimension").agg(F.sum(F.col("m") * F.col("k")).alias("coberturas"))

    def covering(self, conocimiento: object) -> DataFrame:
        """(curso, conocimiento): courses that cover one element."""
        shared, one = self.shared(), F.col("conocimiento") == F.lit(conocimiento)
        if shared is None:
            return self.cubre.filter(one).select("curso", "conocimiento").distinct()
        return shared.cursos.join(shared.contenido.filter(one).select("programa", "conocimiento").distinct(), "programa").select("curso", "conocimiento")

    def ends(self, frame: str, end: str) -> DataFrame:
        """(id, n): ids at one end of a relation with the rows they stand for; an id may have several rows here."""
        shared = self.shared()
        if shared is not None and frame == "cubre":
            return shared.sizes(end)
        return getattr(self, frame).select(F.col(end).alias("id"), F.lit(1).cast("long").alias("n"))

    def rows(self, frame: str, *present: str) -> DataFrame:
        """One row: n, the rows of a frame where none of the columns is null."""
        shared = self.shared()
        if shared is not None and frame == "cubre":  # made of keys, none of which is null
            return shared.sizes("curso").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        df = getattr(self, frame)
        for c in present:
            df = df.filter(F.col(c).isNotNull())
        return df.agg(F.count("*").alias("n"))


def from_tables(spark: SparkSession, folder: str) -> GraphContext:
    """The graph that sales tables play: orders are offers, customers companies, nations industries and (the
    first fourteen) careers, regions faculties, suppliers courses, parts knowledge."""
    t = {k: spark.read.parquet(f"{folder}/{k}.parquet") for k in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    nation, orders, part = t["nation"], t["orders"], t["part"]
    career = nation.filter("n_nationkey < 14")
    kind = F.split_part("p_type", F.lit(" "), F.lit(1))
    dimension = F.when(kind.isin("ECONOMY", "STANDARD"), "competencia").when(kind.isin("PROMO", "SMALL"), "habilidad").otherwise("herramienta")
    known = part.select("p_partkey", F.concat_ws("|", dimension, "p_name").alias("conocimiento"), F.col("p_name").alias("conocimiento_nombre"), dimension.alias("dimension"))
    lines = t["lineitem"].select(F.col("l_orderkey").alias("oferta"), "l_partkey", "l_suppkey")
    course = t["supplier"].filter("s_nationkey < 14 AND s_nationkey % 3 = 0")
    teaching = course.filter("s_suppkey % 4 <> 1")
    covered = teaching.join(known, F.expr("p_partkey % 100 = s_suppkey % 100")).filter("NOT (s_nationkey = 12 AND dimension = 'herramienta')")
    cubre = covered.select(F.col("s_suppkey").alias("curso"), F.concat_ws("|", F.col("s_suppkey").cast("string"), F.col("p_partkey").cast("string")).alias("cobertura"), "conocimiento").distinct()
    # Courses cover alike by the last two digits of their key, and by whether they belong to career 12 alone.
    cursos = teaching.groupBy("s_suppkey").agg(F.expr("bool_and(s_nationkey = 12)").cast("long").alias("solo")).select(F.col("s_suppkey").alias("curso"), F.expr("s_suppkey % 100 * 2 + solo").alias("programa"))
    parts = known.filter("p_partkey IS NOT NULL").select("p_partkey", "conocimiento", "dimension").distinct().withColumn("solo", F.explode(F.array(F.lit(0), F.lit(1)))).filter("NOT (solo = 1 AND dimension = 'herramienta')")
    contenido = parts.select(F.expr("p_partkey % 100 * 2 + solo").alias("programa"), F.col("p_partkey").alias("registro"), "conocimiento")
    first = lines.groupBy("oferta").agg(F.min("l_partkey").alias("p_partkey")).join(part.select("p_partkey", "p_name"), "p_partkey")
    titled = orders.select(F.col("o_orderkey").alias("oferta"), F.substring("o_orderpriority", 1, 1).alias("k")).join(first, "oferta", "left")
    title = (
        F.when(F.col("k") == "1", F.concat(F.lit("Jefe de "), "p_name"))
        .when(F.col("k") == "2", F.concat(F.lit("GERENTE "), "p_name"))
        .when(F.col("k") == "3", F.concat(F.lit("Analista "), "p_name"))
        .when((F.col("k") == "4") & (F.col("oferta") % 2 == 0), F.lit("  "))
        .when(F.col("k") == "5", F.concat(F.lit("Asistente de directorio "), "p_name"))
    )
    requires = lines.join(known.select("p_partkey", "conocimiento"), F.col("l_partkey") == F.col("p_partkey")).select("oferta", "conocimiento").distinct()
    return GraphContext(
        carrera=career.select(F.col("n_nationkey").alias("carrera"), F.col("n_name").alias("carrera_nombre")),
        facultad=t["region"].select(F.col("r_regionkey").alias("facultad"), F.col("r_name").alias("facultad_nombre")),
        curso=course.select(F.col("s_suppkey").alias("curso"), F.col("s_name").alias("curso_nombre")),
        conocimiento=known.select("conocimiento", "conocimiento_nombre", "dimension").distinct(),
        oferta=orders.select(F.col("o_orderkey").alias("oferta"), F.col("o_orderdate").alias("fecha")),
        empresa=t["customer"].select(F.col("c_custkey").alias("empresa"), F.col("c_name").alias("empresa_nombre"), F.col("c_mktsegment").alias("tipo")),
        industria=nation.select(F.col("n_nationkey").alias("industria"), F.col("n_name").alias("industria_nombre")),
        puesto=titled.select(F.col("oferta").alias("puesto"), title.alias("puesto_nombre")),
        silabo=course.select(F.col("s_suppkey").alias("curso"), F.concat(F.lit("SIL-"), F.col("s_suppkey").cast("string")).alias("codigo"), F.col("s_name").alias("sumilla")),
        ofrece=career.select(F.col("n_regionkey").alias("facultad"), F.col("n_nationkey").alias("carrera")),
        ensenia=course.select(F.col("s_nationkey").alias("carrera"), F.col("s_suppkey").alias("curso")),
        cubre=cubre,
        dirige=lines.join(t["supplier"].filter("s_nationkey < 14").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select("oferta", F.col("s_nationkey").alias("carrera")).distinct(),
        publica=orders.select(F.col("o_custkey").alias("empresa"), F.col("o_orderkey").alias("oferta")),
        agrupa=t["customer"].select(F.col("c_nationkey").alias("industria"), F.col("c_custkey").alias("empresa")),
        requiere=requires,
        ofrece_puesto=orders.select(F.col("o_orderkey").alias("oferta"), F.col("o_orderkey").alias("puesto")),
        define=requires.select(F.col("oferta").alias("puesto"), "conocimiento"),
        programas=Programmes(cubre, cursos, contenido),
    )
