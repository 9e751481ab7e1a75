"""Benchmark decontamination in DataFrame and SQL functions only.

A document is contaminated where one of its windows, as many words long as a benchmark item, is similar to the
item. Windows lie where a document shares a word shingle with an item, aligned on it; a window that shares none
has similarity 0, so none is missed. SimHash fingerprints of windows and items of a size are matched by
multi-index blocks: with RADIUS + 1 blocks, two fingerprints that differ in at most RADIUS bits agree on at
least one block. The matches within the radius are verified by the exact weighted Jaccard similarity of their
shingle sets; a shingle weighs as much as its words have characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.scratch import cut, join_narrow, quoted

SHINGLE_WORDS = 5
PERCENT = 75
BITS = 64
#: Two sets of similarity 0.75 differ in 11 of 64 bits on average, with a standard deviation of 3.
RADIUS = 19


def words(text: str = "text") -> Column:
    """Lower-cased words between white space; none of a null or blank text."""
    inner = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def _hash(array: str, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(array, at + i) for i in range(width)])


def _set(array: str, width: int) -> Column:
    """The distinct shingles {h, w} of words that are at least `width` many."""
    each = F.transform(F.sequence(F.lit(0), F.size(array) - width), lambda i: F.struct(_hash(array, i, width).alias("h"), sum(F.char_length(F.get(array, i + k)) for k in range(width)).alias("w")))
    return F.array_distinct(each)


def fingerprints(sets: DataFrame, key: list[str]) -> DataFrame:
    """SimHash of the sets {h, w} in column s: each bit is set where the shingles whose hash has it outweigh
    the others."""
    rows = sets.select(*key, F.explode("s").alias("x")).select(*key, F.xxhash64("x.h", F.lit("bits")).alias("h"), F.col("x.w").alias("w"))
    bit = lambda i: F.shiftright("h", i).bitwiseAND(1)
    sums = rows.groupBy(*key).agg(*[F.sum(F.when(bit(i) == 1, F.col("w")).otherwise(-F.col("w"))).alias(f"b{i}") for i in range(BITS)])
    value = F.lit(0).cast("long")
    for i in range(BITS):
        value = value.bitwiseOR(F.when(F.col(f"b{i}") > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return sums.select(*key, value.alias("print"))


def blocks(radius: int = RADIUS) -> Column:
    """{block, value}: the parts of a fingerprint of which one agrees within the radius."""
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    part = lambda a, b: F.shiftrightunsigned("print", a).bitwiseAND((1 << (b - a)) - 1 if b - a < BITS else -1)
    return F.array(*[F.struct(F.lit(i).alias("block"), part(a, b).alias("value")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def items_of(benchmark: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(item_id, size, width, words, s) of items that have words; shorter ones than a shingle are one."""
    items = benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), words().alias("words")).withColumn("size", F.size("words")).filter("size > 0")
    return items.withColumn("width", F.least("size", F.lit(width))).dropDuplicates(["item_id", "words"])


def matches(docs: DataFrame, benchmark: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start, size, shared, total): each document's best window for each item that it holds,
    from word `start`, and the weights of the shared shingles and of all.

    The best has the largest share, then the least start. A document with fewer words than an item is one
    window, if it has a shingle. Null or empty texts and items match nothing, nor do rows without an id; rows
    that repeat a doc_id are searched each. An empty table gives an empty one; other columns are not read."""
    items = cut(items_of(benchmark, width))
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # five values at most
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), words().alias("words"))
    found = None
    for k in widths:
        own = items.filter(F.col("width") == k)
        pieces = own.select("size", "words", F.explode(F.sequence(F.lit(0), F.col("size") - k)).alias("q")).select(_hash("words", F.col("q"), k).alias("h"), "size", "q").distinct()
        at = texts.filter(F.size("words") >= k).select("doc_id", "words", F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("p"))
        hits = join_narrow(at.withColumn("h", _hash("words", F.col("p"), k)), cut(pieces), "h")
        start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.size("words") - F.col("size")))
        windows = hits.select("doc_id", "size", start.alias("start"), "words").select("doc_id", "size", "start", F.slice("words", F.col("start") + 1, F.col("size")).alias("words")).distinct()
        windows = cut(windows.withColumn("window", F.xxhash64("doc_id", "size", "start", "words")).withColumn("s", _set("words", k)).drop("words"))
        own = cut(own.withColumn("s", _set("words", k)).drop("words"))
        a = fingerprints(windows, ["window", "size"]).withColumnRenamed("print", "window_print")
        b = fingerprints(own, ["item_id", "size"])
        near = a.withColumn("print", F.col("window_print")).select("window", "size", "window_print", F.inline(blocks(radius))).join(
            b.select("item_id", "size", F.col("print").alias("item_print"), F.inline(blocks(radius))), ["size", "block", "value"]
        )
        near = near.filter(F.bit_count(F.col("window_print").bitwiseXOR(F.col("item_print"))) <= radius).select("window", "item_id").distinct()
        both = near.join(windows, "window").join(own.select("item_id", F.col("s").alias("t")), "item_id")
        weigh = lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda n, x: n + x.w)
        shared = weigh(F.array_intersect("s", "t"))
        both = both.select("doc_id", "item_id", "start", "size", shared.alias("shared"), (weigh(F.col("s")) + weigh(F.col("t")) - shared).alias("total"))
        both = both.filter(100 * F.col("shared") >= percent * F.col("total"))
        found = both if found is None else found.unionByName(both)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start int, size int, shared long, total long")
    best = F.struct((-F.col("shared") / F.col("total")).alias("order"), "start", "size", "shared", "total")
    return found.groupBy("doc_id", "item_id").agg(F.min(best).alias("best")).select("doc_id", "item_id", "best.start", "best.size", "best.shared", "best.total")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without the documents that hold a benchmark item; rows without an id stay."""
    bad = cut(matches(docs, benchmark, width, percent).select(F.col("doc_id").alias("__sg_bad")).distinct())
    return join_narrow(docs.withColumn("__sg_bad", F.col("doc_id").cast("long")), bad, "__sg_bad", "left_anti").select(*quoted(docs.columns))
