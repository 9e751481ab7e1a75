"""What a graph holds: properties, counts, samples and relations, each table read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.sources.graph import GraphContext
from skillgrid.sources.stored import LABELS, id_property, name_property, relations

SAMPLES = 5
#: log2 of a sketch's registers: 4096, a relative standard error of about 1.6 % in distinct counts.
SKETCH = 12


def _union(dfs: list[DataFrame]) -> DataFrame:
    return dfs[0] if len(dfs) == 1 else _union(dfs[: len(dfs) // 2]).unionByName(_union(dfs[len(dfs) // 2 :]))


def role(label: str, names: list[str], name: str) -> str | None:
    """id or nombre where a property is one, by the label's own names or by rule."""
    if name in (label, id_property(names)):
        return "id"
    return "nombre" if name in (f"{label}_nombre", name_property(names)) else None


def sketches(g: GraphContext) -> DataFrame:
    """(label, propiedad, tipo, rol, filas, presentes, sketch) of every node table: one scan and one partial result from
    each task. sketch is a HyperLogLog binary; those of several graphs or days are added up by merged()."""
    out = []
    for label in LABELS:
        df = getattr(g, label)
        names = [c for c in df.columns if c != "mes"]
        text = lambda c: F.col(c).cast("string")
        each = [F.struct(F.count(c).alias("presentes"), F.hll_sketch_agg(text(c), SKETCH).alias("sketch")).alias(c) for c in names]
        one = df.agg(F.count("*").alias("filas"), *each)
        kinds = dict(df.dtypes)
        parts = F.array(*[F.struct(F.lit(c).alias("propiedad"), F.lit(kinds[c]).alias("tipo"), F.lit(role(label, names, c)).cast("string").alias("rol"), F.col(f"{c}.presentes").alias("presentes"), F.col(f"{c}.sketch").alias("sketch")) for c in names])
        out.append(one.select(F.lit(label).alias("label"), "filas", F.explode(parts).alias("p")).select("label", "p.propiedad", "p.tipo", "p.rol", "filas", "p.presentes", "p.sketch"))
    return _union(out)


def merged(*parts: DataFrame) -> DataFrame:
    """The sketches() of several disjoint parts of a graph as those of the whole; a property is told by label, name
    and type."""
    keys = ["label", "propiedad", "tipo", "rol"]
    return _union(list(parts)).groupBy(*keys).agg(F.sum("filas").alias("filas"), F.sum("presentes").alias("presentes"), F.hll_union_agg("sketch").alias("sketch"))


def distinct() -> Column:
    """The estimated number of distinct values; null where none are present."""
    return F.hll_sketch_estimate("sketch")


def samples(g: GraphContext) -> DataFrame:
    """(label, ejemplos): up to SAMPLES names of each label that has names, the least ones; every partition sends its own
    few."""
    out = []
    for label in LABELS:
        df = getattr(g, label)
        names = [c for c in df.columns if role(label, df.columns, c) == "nombre"]
        for c in names[:1]:
            some = df.filter(F.col(c) != "").groupBy(F.col(c).alias("v")).agg(F.lit(1)).orderBy("v").limit(SAMPLES)
            out.append(some.agg(F.array_join(F.array_sort(F.collect_list("v")), " | ").alias("ejemplos")).select(F.lit(label).alias("label"), "ejemplos"))
    return _union(out)


def properties(g: GraphContext) -> DataFrame:
    """(label, propiedad, tipo, rol, filas, presentes, ejemplos): the exact part of sketches(), with samples beside the
    names; null where a label has none."""
    few = samples(g).withColumn("rol", F.lit("nombre"))
    return sketches(g).drop("sketch").join(F.broadcast(few), ["label", "rol"], "left").select("label", "propiedad", "tipo", "rol", "filas", "presentes", F.nullif("ejemplos", F.lit("")).alias("ejemplos"))


def topology(g: GraphContext) -> DataFrame:
    """(origen, relacion, destino, n): the rows of every triple, whose both ends are there."""
    out = []
    for frame, relation, source, target in relations():
        out.append(g.rows(frame, source, target).select(F.lit(source).alias("origen"), F.lit(relation).alias("relacion"), F.lit(target).alias("destino"), "n"))
    return _union(out)


def schema_text(g: GraphContext) -> str:
    """The graph in words for whoever writes ad-hoc SQL: views and columns, which of them are ids and names, what can
    be joined, and some real names."""
    lines = ["VIEWS (columns; * id, ' name)"]
    for name, df in g.frames().items():
        mark = {"id": "*", "nombre": "'"}
        lines.append(f"- {name}: " + ", ".join(f"{c} {t}{mark.get(role(name, df.columns, c) or '', '') if name in LABELS else ''}" for c, t in df.dtypes if c != "mes"))
    lines.append("RELATIONS (rows)")
    lines += [f"- {r.origen} {r.relacion} {r.destino} ({r.n})" for r in sorted(topology(g).collect(), key=lambda r: (-r.n, r.origen, r.relacion, r.destino))]
    lines.append("SAMPLES")
    lines += [f"- {r.label}: {r.ejemplos}" for r in sorted(samples(g).collect()) if r.ejemplos]
    return "\n".join(lines)
