"""Which entity a text names, by an inverted index of name fragments.

A term names an entity if the entity's cleaned name contains it. Containment is no join key; a fragment of up to
three characters is: whatever contains the term contains each of its fragments. So every question goes to the
postings of its rarest fragment, and only what it meets there is compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.functions.text import clean
from skillgrid.sources.graph import DIMENSIONS, GraphContext

FRAGMENT = 3
#: What stands for a label where a question has none.
ANY = ""
#: Labels in the order in which a text without one is tried.
LABELS = ("carrera", "facultad", "curso", "empresa", "industria", "puesto", *DIMENSIONS)


def entities(g: GraphContext) -> DataFrame:
    """(label, id, nombre) of everything that a question can name."""
    named = [getattr(g, k).select(F.lit(k).alias("label"), F.col(k).cast("string").alias("id"), F.col(f"{k}_nombre").alias("nombre")) for k in LABELS if k not in DIMENSIONS]
    out = g.conocimiento.select(F.col("dimension").alias("label"), F.col("conocimiento").cast("string").alias("id"), F.col("conocimiento_nombre").alias("nombre"))
    for df in named:
        out = out.unionByName(df)
    return out.filter("nombre IS NOT NULL")


def _pieces(text: str, size: int) -> Column:
    """All runs of so many characters; none of a shorter text."""
    return F.expr(f"CASE WHEN char_length({text}) >= {size} THEN transform(sequence(1, char_length({text}) - {size - 1}), i -> substring({text}, i, {size})) ELSE CAST(array() AS ARRAY<STRING>) END")


def known(names: DataFrame) -> DataFrame:
    """(label, c, best) of names (label, id, nombre): each cleaned name with the entity that it stands for, the
    shortest name, then the name, then the id; and once more under ANY, where the first of LABELS that has the name
    counts. Names that are alike are one row, however many entities have them."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("label")), F.lit(0)), F.lit(len(LABELS) + 1))
    best = F.struct(place.alias("place"), "label", F.char_length("nombre").alias("length"), "nombre", "id")
    rows = names.withColumn("c", clean("nombre")).filter("c <> ''").groupBy("label", "c").agg(F.min(best).alias("best"))
    return rows.unionByName(rows.groupBy("c").agg(F.min("best").alias("best")).withColumn("label", F.lit(ANY)))


def index(names: DataFrame) -> DataFrame:
    """(label, fragment, c, best): a row for each distinct fragment of one to FRAGMENT characters of each name."""
    fragments = F.array_distinct(F.concat(*[_pieces("c", k) for k in range(1, FRAGMENT + 1)]))
    return known(names).select("label", F.explode(fragments).alias("fragment"), "c", "best")


def rarest(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """Adds fragment to distinct (label, terms): the one with the fewest postings among those of all terms. What has a
    fragment that no name has is left out, since nothing can contain it."""
    of_term = F.transform("terms", lambda t: F.when(F.char_length(t) < FRAGMENT, F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.char_length(t) - (FRAGMENT - 1)), lambda i: F.substring(t, i, F.lit(FRAGMENT)))))
    fragments = asked.select("label", "terms", F.explode(F.array_distinct(F.flatten(of_term))).alias("fragment"))
    sizes = postings.groupBy("label", "fragment").agg(F.count("*").alias("n"))
    chosen = fragments.join(sizes, ["label", "fragment"], "left").groupBy("label", "terms").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "fragment")).alias("pick"))
    return chosen.filter("pick.n > 0").select("label", "terms", F.col("pick.fragment").alias("fragment"))


def candidates(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """(label, terms, c, best): what is compared in full."""
    return rarest(asked, postings).join(postings, ["label", "fragment"]).drop("fragment")


def found(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(label, terms, best) of distinct (label, terms): the least of the label's entities whose cleaned names hold all
    terms. Partitions send one candidate a question."""
    fits = F.forall("terms", lambda t: F.col("c").contains(t))
    return candidates(asked, index(names)).filter(fits).groupBy("label", "terms").agg(F.min("best").alias("best"))


def resolve(asked: DataFrame, names: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, label, id, nombre) of asked (key, label, terms): the entity that each names. Without a label all labels
    are tried in the order of LABELS, and the first that has one counts. Null, empty and repeated terms don't matter;
    rows without terms or an entity aren't listed. Repeated questions are looked up once."""
    terms = F.array_sort(F.array_distinct(F.filter("terms", lambda t: t.isNotNull() & (t != ""))))
    wanted = asked.select(key, F.coalesce("label", F.lit(ANY)).alias("said"), terms.alias("terms")).filter("size(terms) > 0")
    answers = found(wanted.select(F.col("said").alias("label"), "terms").distinct(), names).withColumnRenamed("label", "said")
    return wanted.join(answers, ["said", "terms"]).select(key, "best.label", "best.id", "best.nombre")
