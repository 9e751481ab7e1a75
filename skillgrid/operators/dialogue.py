"""Conversations as a table of turns: blocks of turns, the entities that a conversation has in mind, and what later
turns refer to.

Everything but the entities' names is windows over one conversation, which is one person's session: its rows are
sorted, never held together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillgrid.operators.resolver import LABELS

BLOCK_TURNS = 12
HISTORY = 8
#: Seconds after which a memory that nothing was added to is forgotten.
TTL = 1800
# What refers to the entity before the last one, to the first one and to the last one, in Spanish, as
# whole words.
REFERENCES = {"previous": r"(la|el)\s+anterior", "first": r"(la primera|el primero)(\s+mencionad[ao])?", "active": r"(es[aeo]|est[aeo]|dicha|dicho|la [uú]ltima|el [uú]ltimo)"}
#: The same in other languages that conversations are held in.
MORE_REFERENCES = {
    "previous": r"the previous|l[ea] précédente?|d(er|ie|as) vorige", "first": r"the first|l[ea] premi(er|ère)|d(er|ie|as) erste", "active": r"this|that|ce(t|tte)?|diese[rsmn]?",
}
_LETTER = r"[\p{L}\p{N}_]"
KINDS = tuple(REFERENCES)


def blocks(turns: DataFrame, size: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, block, n_turns, complete, text) of turns (conv_id, turn, role, text): every `size` turns
    together, in order; the last block of a conversation may be incomplete. A block is bounded by its size."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    rows = turns.withColumn("place", place).withColumn("block", F.floor(F.col("place") / size).cast("long"))
    line = F.concat_ws(": ", "role", "text")
    rows = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    return rows.select("conv_id", "block", "n_turns", (F.col("n_turns") == size).alias("complete"), F.array_join(F.col("lines.line"), " | ").alias("text"))


def exchanges(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, line) of turns (conv_id, turn, role, text): every question with the answer that follows it before
    the next question, as one line; a question without one has an empty answer."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.filter(F.col("role").isin("user", "assistant"))
    rows = rows.withColumn("next", F.lead(F.struct("role", F.coalesce("text", F.lit("")).alias("text"))).over(order))
    answer = F.when(F.col("next.role") == "assistant", F.col("next.text")).otherwise("")
    return rows.filter("role = 'user'").select("conv_id", "turn", F.concat(F.lit("P: "), F.coalesce("text", F.lit("")), F.lit(" | R: "), answer).alias("line"))


def opening_words(lines: Column, chars: int = 80) -> Column:
    """A summary that needs no model: how each exchange begins."""
    return F.array_join(F.transform(lines, lambda x: F.substring(x, 1, chars)), "\n")


def summaries(turns: DataFrame, summarise: Callable[[Column], Column] = opening_words, size: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, block, n, summary, pending) of turns: every `size` exchanges, in order, as summarise(their lines) says. A
    block that isn't full, and one whose summary is null, has its lines as pending instead: they are not lost. A block is
    bounded by its size; a null conversation is one like any other."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "line")) - 1
    rows = exchanges(turns).withColumn("place", place).withColumn("block", F.floor(F.col("place") / size).cast("long"))
    rows = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("place", "line"))).alias("held"))
    rows = rows.select("conv_id", "block", "n", F.col("held.line").alias("lines"))
    rows = rows.withColumn("summary", F.when(F.col("n") == size, summarise(F.col("lines"))))
    return rows.select("conv_id", "block", "n", "summary", F.when(F.col("summary").isNull(), F.array_join("lines", "\n")).alias("pending"))


def clock(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, at) of turns (conv_id, turn, text) that carry no time: a second passes for each character said,
    up to the turn's end. Rows that share conv_id and turn are one turn."""
    said = turns.groupBy("conv_id", "turn").agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0))).alias("said"))
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return said.select("conv_id", "turn", F.sum("said").over(so_far).cast("long").alias("at"))


def same_entity(id: str = "id", nombre: str = "nombre") -> Column:
    """What two mentions of one entity share: the id, or without one the name."""
    return F.when(F.col(id) != "", F.concat(F.lit("="), id)).otherwise(F.concat(F.lit("~"), F.lower(F.trim(F.coalesce(nombre, F.lit(""))))))


def memory(mentions: DataFrame, history: int = HISTORY, ttl: int = TTL) -> DataFrame:
    """What a conversation has in mind after each mention (conv_id, turn, place, at, label, id, nombre): since, when the
    memory began; changes, how many entities the label has had in it; the entity before the last one, and the first
    among the last `history`, as previous_id, previous, first_id and first.

    A mention of the entity that the label had last is no change, but keeps the memory alive; a memory that none has
    been added to for more than `ttl` seconds is forgotten with all its labels. Mentions follow each other by at, turn,
    place, label and id, nulls first; a null conversation is one like any other, an entity without an id is told by its
    name, and mentions without a label are left out. Repeated rows are repeated mentions."""
    rows = mentions.filter(F.col("label") != "").withColumn("same", same_entity())
    order = ["at", "turn", "place", "label", "id", "nombre"]
    conversation = Window.partitionBy("conv_id").orderBy(*order)
    begins = F.col("at") - F.lag("at").over(conversation) > ttl
    rows = rows.withColumn("begins", F.coalesce(begins, F.lit(True)))
    so_far = conversation.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("since", F.max(F.when(F.col("begins"), F.col("at"))).over(so_far))
    label = Window.partitionBy("conv_id", "since", "label").orderBy(*order)
    changed = ~F.col("same").eqNullSafe(F.lag("same").over(label))
    rows = rows.withColumn("changed", changed.cast("int")).withColumn("pos", F.row_number().over(label))
    rows = rows.withColumn("changes", F.sum("changed").over(label.rowsBetween(Window.unboundedPreceding, 0)))
    by_change = Window.partitionBy("conv_id", "since", "label").orderBy("changes")
    entity = F.struct("id", "nombre")
    # Entities as they were last mentioned before the present one: of the change before it, and of the oldest kept.
    alone = F.lit(True) if history < 2 else F.col("changes") == 1
    before = by_change.rangeBetween(min(1 - history, -1), -1)
    rows = rows.withColumn("p", F.when(~alone, F.max_by(entity, "pos").over(by_change.rangeBetween(-1, -1))))
    rows = rows.withColumn("f", F.when(alone, entity).otherwise(F.min_by(entity, F.struct(F.col("changes"), -F.col("pos"))).over(before)))
    return rows.select("conv_id", "turn", "place", "at", "label", "id", "nombre", "since", "changes", F.col("p.id").alias("previous_id"), F.col("p.nombre").alias("previous"), F.col("f.id").alias("first_id"), F.col("f.nombre").alias("first"))


def reference(text: str, patterns: tuple[dict[str, str], ...] = (REFERENCES,)) -> Column:
    """Which kind of reference a text holds; the first of KINDS if several."""
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        words = "|".join(p[kind] for p in patterns)
        out = F.when(F.col(text).rlike(f"(?iu)(?<!{_LETTER})({words})(?!{_LETTER})"), kind).otherwise(out)
    return out


def references(turns: DataFrame, remembered: DataFrame, ttl: int = TTL, patterns: tuple[dict[str, str], ...] = (REFERENCES,)) -> DataFrame:
    """(conv_id, turn, kind, label, id, nombre): what each turn (conv_id, turn, at, text) that refers back means, of each
    label in the memory() as it stood before the turn, if that is still alive; labels without such an entity aren't
    listed. Rows that share conv_id and turn are one turn; what the turn itself mentions doesn't count.

    An as-of join by windows: turns and mentions are sorted together, and each turn sees the last one before it."""
    kind = F.array_min(F.collect_set(F.array_position(F.array(*map(F.lit, KINDS)), reference("text", patterns))))
    asked = turns.groupBy("conv_id", "turn").agg(F.max("at").alias("at"), kind.alias("k")).filter("k IS NOT NULL")
    asked = asked.select("conv_id", "turn", "at", F.element_at(F.array(*map(F.lit, KINDS)), F.col("k").cast("int")).alias("kind"))
    earlier = lambda *keys: Window.partitionBy(*keys).orderBy("at", "turn", "seen").rowsBetween(Window.unboundedPreceding, 0)
    # The memory that is alive: the last one that anything was added to, if that isn't too long ago.
    added = remembered.select("conv_id", "turn", "at", F.lit(None).cast("string").alias("kind"), F.lit(1).alias("seen"), F.struct("at", "since").alias("last")).distinct()
    both = asked.withColumns({"seen": F.lit(0), "last": F.lit(None).cast(added.schema["last"].dataType)}).unionByName(added)
    alive = both.withColumn("last", F.last("last", ignorenulls=True).over(earlier("conv_id"))).filter((F.col("seen") == 0) & (F.col("at") - F.col("last.at") <= ttl))
    # In it, the last state of each label.
    wanted = alive.select("conv_id", "turn", "at", "kind", F.col("last.since").alias("since"), F.explode(F.array(*map(F.lit, LABELS))).alias("label"), F.lit(0).alias("seen"), F.lit(0).alias("place"))
    state = F.struct("changes", *[F.struct(F.col(i).alias("id"), F.col(n).alias("nombre")).alias(k) for k, i, n in (("previous", "previous_id", "previous"), ("first", "first_id", "first"), ("active", "id", "nombre"))])
    states = remembered.select("conv_id", "turn", "at", F.lit(None).cast("string").alias("kind"), "since", "label", F.lit(1).alias("seen"), F.col("place").cast("int").alias("place"), state.alias("state"))
    rows = wanted.withColumn("state", F.lit(None).cast(states.schema["state"].dataType)).unionByName(states)
    before = Window.partitionBy("conv_id", "since", "label").orderBy("at", "turn", "seen", "place", "state").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("state", F.last("state", ignorenulls=True).over(before)).filter("seen = 0 AND state IS NOT NULL")
    meant = F.when(F.col("kind") == "previous", F.when(F.col("state.changes") > 1, F.col("state.previous"))).when(F.col("kind") == "first", F.col("state.first")).otherwise(F.col("state.active"))
    return rows.withColumn("meant", meant).filter("meant IS NOT NULL").select("conv_id", "turn", "kind", "label", "meant.id", "meant.nombre")
