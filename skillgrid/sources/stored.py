"""A graph kept as tables: one for each kind of node and each relation, offers by month.

What a graph holds is declared by its triples; tables may name their columns after the labels or in the form
id_<label> and nombre or nombre_<label>. integrity() says what is wrong with a graph before anything counts on it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgrid.sources.graph import TRIPLES, GraphContext, month_of

MONTHS = "meses"
#: Properties of nodes besides their id and name.
MORE = {"conocimiento": ("dimension",), "oferta": ("fecha",), "empresa": ("tipo",)}
UNNAMED = frozenset(("oferta",))
LABELS = ("carrera", "facultad", "curso", "conocimiento", "oferta", "empresa", "industria", "puesto")
#: Columns of the relations' tables: the labels of their ends, and what hangs on them.
ENDS = {
    "silabo": ("curso", "codigo", "sumilla"), "ofrece": ("facultad", "carrera"), "ensenia": ("carrera", "curso"), "cubre": ("curso", "cobertura", "conocimiento"), "dirige": ("oferta", "carrera"), "publica": ("empresa", "oferta"),
    "agrupa": ("industria", "empresa"), "requiere": ("oferta", "conocimiento"), "ofrece_puesto": ("oferta", "puesto"), "define": ("puesto", "conocimiento"),
}
#: A node is hot where it has more than this share of a relation's rows.
HOT_SHARE = 0.05


class Malformed(ValueError):
    """Tables or columns that the triples declare are missing."""


def id_property(names: list[str]) -> str | None:
    """The property that tells nodes apart: the first id_*, else id."""
    return next((n for n in names if n.startswith("id_")), "id" if "id" in names else None)


def name_property(names: list[str]) -> str | None:
    """The property that people read: nombre, else the first nombre_* that isn't the normalised one."""
    return "nombre" if "nombre" in names else next((n for n in names if n.startswith("nombre_") and n != "nombre_norm"), None)


def columns_of(frame: str) -> tuple[str, ...]:
    if frame in ENDS:
        return ENDS[frame]
    return (frame, *(() if frame in UNNAMED else (f"{frame}_nombre",)), *MORE.get(frame, ()))


def _named(df: DataFrame, frame: str) -> DataFrame:
    """The frame's columns under their names here."""
    names, out, missing = df.columns, [], []
    for want in columns_of(frame):
        found = want if want in names else None
        if found is None and frame not in ENDS and want in (frame, f"{frame}_nombre"):
            found = id_property(names) if want == frame else name_property(names)
        elif found is None and f"id_{want}" in names:
            found = f"id_{want}"
        if found is None:
            missing.append(want)
        else:
            out.append(F.col(found).alias(want))
    if missing:
        raise Malformed(f"{frame} has no {', '.join(missing)} among {', '.join(names)}")
    extra = [F.col("mes")] if frame == "oferta" and "mes" in names else []
    return df.select(*out, *extra)


def write(g: GraphContext, folder: str, mode: str = "error") -> None:
    """Keeps a graph: a Parquet table for each frame, offers in a folder for each month of publication (undated ones
    apart), and the months' counts and bounds, which tell the last publication without reading the offers."""
    for name, df in g.frames().items():
        if name == "oferta":
            dated = df.withColumn("mes", F.coalesce(month_of(F.col("fecha")), F.lit("sin fecha")))
            dated.repartition("mes").write.mode(mode).partitionBy("mes").parquet(f"{folder}/oferta")
        else:
            df.write.mode(mode).parquet(f"{folder}/{name}")
    refresh_months(g.oferta.sparkSession, folder, mode)


def refresh_months(spark: SparkSession, folder: str, mode: str = "overwrite") -> None:
    """Counts the offers of each month anew, after some were added."""
    offers = spark.read.parquet(f"{folder}/oferta")
    months = offers.groupBy(F.col("mes").cast("string").alias("mes")).agg(F.count("*").alias("n"), F.min("fecha").alias("desde"), F.max("fecha").alias("hasta"))
    months.coalesce(1).write.mode(mode).parquet(f"{folder}/{MONTHS}")  # a row for each month


def read(spark: SparkSession, folder: str) -> GraphContext:
    """The graph that a folder keeps. Where it has its months, periods are read from their own folders only. Missing
    tables and columns are Malformed, all named at once."""
    frames, wrong = {}, []
    for name in (n for n in GraphContext.__dataclass_fields__ if n != "programas"):
        try:
            df = spark.read.parquet(f"{folder}/{name}")
            frames[name] = df if name == MONTHS else _named(df, name)
        except Malformed as e:
            wrong.append(str(e))
        except Exception as e:
            if name != MONTHS:
                wrong.append(f"{name} can't be read: {str(e).splitlines()[0][:200]}")
    if wrong:
        raise Malformed("; ".join(wrong))
    if "mes" in frames["oferta"].columns:
        months = frames.get(MONTHS)
        frames["oferta"] = frames["oferta"].withColumn("mes", F.col("mes").cast("string")) if months is not None else frames["oferta"].drop("mes")
    else:
        frames[MONTHS] = None
    return GraphContext(**frames)


def relations() -> list[tuple[str, str, str, str]]:
    """(frame, relation, source, target) of the triples whose both ends a table holds."""
    return [(f, relation, s, t) for (s, relation, t), f in TRIPLES.items() if {s, t} <= set(columns_of(f))]


def integrity(g: GraphContext, hot_share: float = HOT_SHARE) -> DataFrame:
    """(objeto, problema, n, ejemplo): how many ids of each label are null or shared by several nodes, and of each
    triple how many ends are null, how many ids at either end have no node, how many pairs are there more than once and
    how many nodes have more than `hot_share` of the rows; with the least id or pair of each. Every check has a
    row, 0 where nothing is wrong.

    Nodes and ends meet by label and id in one pass, a column for the nodes and one for each end of a label. Rows are
    added up where they lie first, so that a node that has a third of all relations arrives as one row from each task.
    Pairs are counted relation by relation, by the keys that the relation was made by."""
    text = lambda c: F.col(c).cast("string")
    union = lambda dfs: dfs[0] if len(dfs) == 1 else union(dfs[: len(dfs) // 2]).unionByName(union(dfs[len(dfs) // 2 :]))
    checks: list[tuple[str, str, str, int, str]] = []
    seen: dict[str, list[DataFrame]] = {}
    for label in LABELS:
        seen[label] = [getattr(g, label).select(F.col(label).alias("id"), F.lit(1).cast("long").alias("n"))]
        checks += [(label, p, label, 0, p) for p in ("nulo", "repetido")]
    pairs = []
    for frame, relation, source, target in relations():
        triple = f"{source}-{relation}-{target}"
        for side, label in (("origen", source), ("destino", target)):
            if label in LABELS:
                checks += [(triple, f"{side} {p}", label, len(seen[label]), p) for p in ("nulo", "inexistente", "muy frecuente")]
                seen[label].append(g.ends(frame, label))
        if frame not in ("cubre", "silabo"):  # their rows hang on more than the pair
            twice = getattr(g, frame).groupBy(source, target).agg(F.count("*").alias("k")).filter("k > 1")
            pairs.append(twice.select(F.lit(triple).alias("label"), F.lit(0).alias("at"), F.lit("repetida").alias("p"), F.lit(1).cast("long").alias("n"), F.concat_ws(" ", text(source), text(target)).alias("ejemplo")))
            checks.append((triple, "repetida", triple, 0, "repetida"))
    ats = range(max(map(len, seen.values())))
    each = [df.select(F.lit(label).alias("label"), text("id").alias("id"), *[(F.col("n") if i == at else F.lit(0).cast("long")).alias(f"n{i}") for i in ats]) for label, dfs in seen.items() for at, df in enumerate(dfs)]
    degree = union(each).groupBy("label", "id").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in ats])
    whole = degree.groupBy("label").agg(*[F.sum(f"n{i}").alias(f"rows{i}") for i in ats])  # a row for each label
    problem: list[tuple[Column, int, str, Column]] = []
    for i in ats:
        n, there = F.col(f"n{i}"), F.col("id").isNotNull() & (F.col(f"n{i}") > 0)
        problem.append((F.col("id").isNull() & (n > 0), i, "nulo", n))
        if i == 0:
            problem.append((there & (n > 1), i, "repetido", F.lit(1)))
        else:
            problem += [(there & (F.col("n0") == 0), i, "inexistente", F.lit(1)), (there & (n > F.lit(hot_share) * F.col(f"rows{i}")), i, "muy frecuente", F.lit(1))]
    some = F.array(*[F.when(where, F.struct(F.lit(i).alias("at"), F.lit(name).alias("p"), n.cast("long").alias("n"))) for where, i, name, n in problem])
    found = degree.join(F.broadcast(whole), "label").filter(reduce(or_, [where for where, *_ in problem])).select("label", F.col("id").alias("ejemplo"), F.explode(F.array_compact(some)).alias("x")).select("label", "x.at", "x.p", "x.n", "ejemplo")
    found = union([found, *pairs]).groupBy("label", "at", "p").agg(F.sum("n").alias("n"), F.min("ejemplo").alias("ejemplo"))
    every = g.oferta.sparkSession.createDataFrame(checks, "objeto string, problema string, label string, at int, p string")  # a fixed list
    return every.join(found, ["label", "at", "p"], "left").select("objeto", "problema", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "ejemplo")
