"""Questions in Spanish as a column: which template each asks for, and with which words left for a name.

Every step is a DataFrame operation, so that a log of questions of any length is answered in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.functions.text import clean
from skillgrid.operators import resolver
from skillgrid.plans.templates import TEMPLATES

# Words that say nothing about a name.
STOP_WORDS = (
    "a", "al", "cual", "cuantas", "cuantos", "carrera", "competencia", "curso", "de", "del", "el", "en", "empresa", "esa", "ese", "esta", "este", "hay", "industria",
    "la", "las", "los", "mas", "para", "por", "puesto", "que", "sector", "se", "su", "tiene", "tienen", "ensena", "ensenan", "una",
)
# Phrases of questions that try to change the assistant's role.
INJECTIONS = (
    r"ignora\s+(todas?\s+)?(tus\s+|las\s+)?instrucciones", r"olvida\s+(todo|las\s+instrucciones|el\s+contexto)", r"ahora\s+eres", r"nuevo\s+rol", r"system\s*prompt",
    r"revela\s+(tu\s+)?(prompt|instrucciones)", r"muestra\s+(tu\s+)?(prompt|clave|api\s*key)", r"jailbreak", r"act[uú]a\s+como", r"modo\s+desarrollador",
)
MAX_QUESTION = 500


def normalised(text: str) -> Column:
    """Lower case without accents; other signs are spaces, single ones; `cu ntas`, as some consoles send it, is
    mended."""
    return F.regexp_replace(clean(text), r"\bcu nt(as|os)\b", r"cuant$1")


def acceptable(text: str) -> Column:
    """Whether a question is neither too long nor an attempt to change the assistant's role."""
    return (F.char_length(F.col(text)) <= MAX_QUESTION) & ~normalised(text).rlike("|".join(INJECTIONS))


def presentable(text: str) -> Column:
    """Whether an answer has 10 characters or more without the white space around, 2000 at most, and no CJK."""
    return F.coalesce((F.char_length(F.btrim(F.col(text), F.lit(" \t\n\r"))) >= 10) & (F.char_length(F.col(text)) <= 2000) & ~F.col(text).rlike("[一-鿿]"), F.lit(False))


def words(q: Column) -> Column:
    """The words of a normalised text that can be part of a name."""
    return F.filter(F.split(q, " +"), lambda w: (F.char_length(w) > 1) & ~w.isin(*STOP_WORDS))


def _phrases() -> Column:
    """The templates' phrases as one constant, in the order in which they are to be preferred."""
    rows = [(-t.priority, i, -len(p), p, t.id, t.label, t.vetoes) for i, t in enumerate(TEMPLATES) for p in t.phrases]
    names = ("priority", "place", "length", "phrase", "template", "label")
    vetoes = lambda v: F.array(*map(F.lit, v)) if v else F.lit(None).cast("array<string>")
    return F.array(*[F.struct(*[F.lit(x).cast("string" if k > 2 else "int").alias(n) for k, (n, x) in enumerate(zip(names, r, strict=False))], vetoes(r[6]).alias("vetoes")) for r in rows])


def intents(questions: DataFrame, key: str = "question_id", every: bool = False) -> DataFrame:
    """(key, template, label, terms) of questions (key, text): the template of highest priority, the first of those,
    one of whose phrases stands whole in the question and none of whose vetoes does; then the words that are left for a
    name once its longest such phrase is taken out. Questions that match none aren't listed, or with `every` have no
    template and keep all their words. A null text is an empty one.

    The phrases are a fixed table that each question goes through where it lies: nothing is shuffled."""
    asked = questions.select(key, F.coalesce(normalised("text"), F.lit("")).alias("q"))
    padded = F.concat(F.lit(" "), F.col("q"), F.lit(" "))
    fits = lambda p: padded.contains(F.concat(F.lit(" "), p["phrase"], F.lit(" "))) & ~F.coalesce(F.exists(p["vetoes"], lambda v: F.col("q").contains(v)), F.lit(False))
    rows = asked.withColumn("best", F.array_min(F.filter(_phrases(), fits)))
    if not every:
        rows = rows.filter("best IS NOT NULL")
    rest = F.when(F.col("best").isNull(), F.col("q")).otherwise(F.replace("q", F.col("best.phrase"), F.lit(" ")))
    return rows.select(key, F.col("best.template").alias("template"), F.col("best.label").alias("label"), words(rest).alias("terms"))


def mentions(turns: DataFrame, names: DataFrame) -> DataFrame:
    """(conv_id, turn, place, texto, label, id, nombre) of turns (conv_id, turn, text): every word that names an entity,
    and where it first stands in its turn, from 0. Rows that share conv_id and turn are one turn."""
    parts = turns.select("conv_id", "turn", F.posexplode(words(F.coalesce(normalised("text"), F.lit("")))).alias("place", "texto"))
    parts = parts.groupBy("conv_id", "turn", "texto").agg(F.min("place").alias("place"))
    asked = parts.select("texto").distinct().select("texto", F.lit(None).cast("string").alias("label"), F.array("texto").alias("terms"))
    return parts.join(resolver.resolve(asked, names, "texto"), "texto").select("conv_id", "turn", "place", "texto", "label", "id", "nombre")
