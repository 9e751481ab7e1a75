"""Mixtures of sources at target weights, in DataFrame and SQL functions only.

Every source's documents are laid end to end in a seeded order and cut into blocks of equally many words. The
mixture's blocks go to the sources by highest quotients (Sainte-Laguë), each source's blocks to its shards in the
same way, and each shard takes its quota of blocks in a seeded order, all of them first where it takes more than it
has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillgrid.llm.scratch import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 64
SEED = 12
#: Sources that may exist; a row of each is held together. More are refused, not dropped.
MAX_SOURCES = 100_000


def _hex(text: Column) -> Column:
    """A seeded place in 32 bits."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds target to sources (key, source_size, ...): `share` of all sizes, dealt by weights that repeat in the
    order of keys; no target is above `most` times its source's size, what it can't take goes to the others by
    weight.

    With the sources in the order of limit / weight, those that stop at their limit come first: the level, words a
    unit of weight, is the first one that the next source's limit doesn't undercut."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy("key")) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("w", w).withColumn("limit", (F.lit(most) * F.col("source_size")).cast("double"))
    earlier = Window.orderBy(F.col("limit") / F.col("w"), "key").rowsBetween(Window.unboundedPreceding, -1)
    used, gone = F.coalesce(F.sum("limit").over(earlier), F.lit(0.0)), F.coalesce(F.sum("w").over(earlier), F.lit(0.0))
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.lit(share) * F.sum("source_size").over(whole) - used) / (F.sum("w").over(whole) - gone))
    level = F.min(F.when(F.col("level") <= F.col("limit") / F.col("w"), F.struct((F.col("limit") / F.col("w")).alias("r"), "key", "level"))).over(whole)["level"]
    return rows.withColumn("target", F.least(F.col("limit"), F.coalesce(F.col("w") * level, F.col("limit")))).drop("w", "limit", "level")


def apportion(rows: DataFrame, votes: str, seats: str, most: str, per: list[str], key: str) -> DataFrame:
    """Adds quota to rows (per..., key, votes, seats, most): the group's seats by highest quotients votes / (2 s + 1),
    s from 0, no row more than its `most`; ties go to the lesser key.

    With n rows, the dividing quotient lies between that of n / 2 seats less and n / 2 more, so each row's sure seats
    follow by rounding and no more than two contested quotients a row are ranked."""
    g = Window.partitionBy(*per)
    v, n, all_votes = F.col(votes).cast("double"), F.count("*").over(g), F.sum(F.col(votes).cast("double")).over(g)
    at = lambda sign: F.least(F.col(most), F.greatest(F.lit(0), F.coalesce(F.floor(F.try_divide(v * (F.col(seats) + sign * n / 2), all_votes) + 0.5), F.lit(0)))).cast("long")
    rows = rows.withColumns({"__sure": at(-1), "__upper": at(1)}).withColumn("__open", F.col(seats) - F.sum("__sure").over(g))
    contested = rows.filter("__upper > __sure").select(*per, key, "__open", v.alias("v"), F.explode(F.expr("sequence(__sure, __upper - 1)")).alias("s"))
    place = F.row_number().over(Window.partitionBy(*per).orderBy(F.desc(F.col("v") / (2 * F.col("s") + 1)), key, "s"))
    won = contested.withColumn("place", place).filter("place <= __open").groupBy(*per, key).agg(F.count("*").alias("__won"))
    out = rows.join(won, [*per, key], "left").withColumn("quota", F.col("__sure") + F.coalesce("__won", F.lit(0)))
    return out.drop("__sure", "__upper", "__open", "__won")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of docs (doc_id, text, source): the words of its text,
    its source's words and target, and how many of its words the mixture takes, repeats counted; `most` times its
    size at most. Sources are taken in the order of their code points, null last.

    A source of d documents has about the square root of d shards, by a hash of the id, so that neither a shard nor
    a source's list of shards grows with a hot source. A source's taken words differ from its target by a few blocks.
    Null and empty texts have no words and none taken; texts of any length count whole. Repeated rows stand for
    themselves; those that are alike in id, source and size may swap their taken words. Rows without an id are dealt by
    their text. An empty table gives an empty one, a table without words takes nothing; other columns are not read. More than MAX_SOURCES
    sources are an error."""
    name = F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1"))
    text = F.coalesce("text", F.lit(""))
    salt = F.coalesce(F.col("doc_id").cast("string"), F.md5(text.cast("binary")))
    docs = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), salt).cast("binary")).alias("place")))
    sources = docs.groupBy("key").agg(F.sum("size").alias("source_size"), F.ceil(F.sqrt(F.count("*"))).cast("long").alias("shards"))
    sources = cut(targets(sources, weights, share, most))
    if sources.count() > MAX_SOURCES:
        raise ValueError(f"there are more than {MAX_SOURCES} sources")
    small = F.broadcast(sources)  # at most MAX_SOURCES rows of a name and four numbers

    # Where each document begins in its source's words: its shard's begin, and the running sum in the shard.
    shard = F.pmod(F.conv(F.substring("place", 1, 8), 16, 10).cast("long"), F.col("shards")).alias("shard")
    placed = docs.join(small, "key").select("key", shard, "doc_id", "size", "place")
    lines = Window.partitionBy("key", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = cut(placed.withColumn("inner", F.sum("size").over(lines) - F.col("size")).drop("place"))
    shards = laid.groupBy("key", "shard").agg(F.sum("size").alias("words"))
    begin = F.sum("words").over(Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    block = F.lit(block_words)
    up = lambda x: F.floor((x + block - 1) / block).cast("long")
    shards = shards.withColumn("begin", begin).withColumn("first", up(F.col("begin"))).withColumn("blocks", up(F.col("begin") + F.col("words")) - F.col("first"))

    # Blocks for each source, by its target as a number of its own blocks, whose last one is short; then for each shard.
    blocks = F.floor((F.col("source_size") + block - 1) / block)
    seats = sources.select("key", (blocks * most).cast("long").alias("most"), F.coalesce(F.try_divide(F.col("target") * blocks, F.col("source_size")), F.lit(0.0)).alias("votes"))
    seats = seats.withColumn("seats", F.round(F.sum("votes").over(Window.partitionBy())).cast("long"))
    by_source = apportion(seats, "votes", "seats", "most", [], "key").select("key", F.col("quota").alias("seats"))
    quotas = apportion(shards.join(F.broadcast(by_source), "key").withColumn("most", F.col("blocks") * most), "blocks", "seats", "most", ["key"], "shard")
    quotas = cut(quotas.select("key", "shard", "begin", "first", "blocks", "quota"))

    # Each shard's blocks in a seeded order: all of them as often as the quota holds them all, the first ones once more.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = quotas.filter("blocks > 0").repartition(n, "key", "shard").select("key", "shard", "blocks", "quota", F.explode(F.expr("sequence(first, first + blocks - 1)")).alias("block"))
    order = Window.partitionBy("key", "shard").orderBy(_hex(F.concat_ws(":", F.lit(seed), "key", F.col("block").cast("string"))), "block")
    times = F.floor(F.col("quota") / F.col("blocks")) + F.when(F.row_number().over(order) <= F.col("quota") % F.col("blocks"), 1).otherwise(0)
    chosen = each.select("key", "block", times.cast("long").alias("times"))

    whole = laid.join(quotas.select("key", "shard", "begin"), ["key", "shard"]).withColumn("start", F.col("begin") + F.col("inner"))
    whole = whole.select("key", "doc_id", "size", "start")
    pieces = whole.filter("size > 0").select("key", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    within = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    # Both sides grow with the words; a plan that judges the blocks by the shards they come from would broadcast them.
    taken = pieces.withColumn("within", within).join(chosen.hint("merge"), ["key", "block"]).groupBy("key", "start").agg(F.sum(F.col("within") * F.col("times")).alias("taken"))
    counted = whole.filter("size > 0").join(taken.hint("merge"), ["key", "start"], "left")  # a text with words begins where no other one does
    rows = counted.unionByName(whole.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return rows.join(small, "key").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
