"""Classes of similar rows by an LSH forest, as DataFrame jobs.

A signature holds several orders (trees) of some values each. A region of an order is the rows that share its
first `base` values; rows that agree on a longer prefix are nearer neighbours in it. Candidates come in three
steps, and pairs that are verified join their rows into classes:

1. All pairs of a region of at most SMALL rows. In a crowded one every row is paired with the region's least
   id, which links large groups of copies through one member at the cost of a row each.
2. Crowded regions that still hold several classes are sorted by all values of their order, and rows of
   different classes that follow each other there, the longest common prefixes, are candidates. Orders without
   further values skip this.
3. What is still several classes is settled exactly: a prefix-filtered set-similarity join of the rows in such
   regions. Sets are put in the order of how rare their elements are among these rows; two sets can be similar
   only if they share one of the first few. No pair of a region is lost to crowding.

No step makes all pairs of a crowded region, and none gathers one in a task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillgrid.llm import graph
from skillgrid.llm.scratch import cut, drop, join_narrow

SMALL = 12
#: Rows that are sorted together; a larger region is dealt by its ids into parts of about as many.
SORTED_ROWS = 4096
#: Words of 64 parities of a set's elements. Of sets of 340 elements, pairs below similarity 0.68 or so are told apart.
PARITIES = 8
#: Words of eight minima, seven bits of each, by which across() tells sets apart that have them.
MINIMA = 4
#: Elements at most whose counts are broadcast to put sets in order.
FREQUENT = 250_000
#: Orders whose regions are made and shuffled in one pass: the regions of all are several times the signatures' size, and
#: all in one were a method of over 8,000 bytes, which the JVM doesn't compile.
ORDERS_AT_ONCE = 5
#: Rows before it in its order that a row of a crowded region is compared with.
NEIGHBOURS = 2


def regions(signatures: DataFrame, orders: list[list[int]], base: int, first: int = 0, last: int | None = None) -> DataFrame:
    """(id, key, t) for each order t (of first to before last), a list of places in the signature, of signatures (id,
    signature: array of ints): the key of the row's region. A sketch and a part that signatures have go along. Signatures should be a table
    that was cut: of parts of a union that one shuffle made, Spark 4.1 may plan a join without a shuffle and then fail."""
    value = lambda i: F.get("signature", F.lit(i))
    one = lambda t, order: F.struct(hashed(F.lit(t), *[value(i) for i in order[:base]]).alias("key"), F.lit(t).alias("t"))
    also = [c for c in signatures.columns if c in ("sketch", "part")]
    hashed = F.hash if "sketch" in also else F.xxhash64  # rows that meet by chance in 32 bits are told apart by their sketches
    numbered = [one(t, order) for t, order in enumerate(orders)][first:last]
    parts = [signatures.select("id", *also, F.inline(F.array(*numbered[k : k + ORDERS_AT_ONCE]))) for k in range(0, len(numbered), ORDERS_AT_ONCE)]
    return reduce(DataFrame.unionByName, parts)


def _rest(rows: DataFrame, signatures: DataFrame, orders: list[list[int]], base: int) -> DataFrame:
    """Adds rest to rows (id, t, ...): the order's values after the region's."""
    places = F.array(*[F.array(*[F.lit(i) for i in order[base:]]).cast("array<int>") for order in orders])
    return rows.join(signatures, "id").withColumn("rest", F.transform(F.get(places, F.col("t")), lambda i: F.get("signature", i))).drop("signature")


def _ends(pairs: DataFrame) -> DataFrame:
    return cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())


def _near(x: Column, y: Column, agree: int) -> Column:
    """Whether sketches x and y, of 32 places of two bits, agree in so many places."""
    differ = x.bitwiseXOR(y)
    differ = differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(0x5555555555555555))
    return F.bit_count(differ) <= 32 - agree


def _candidates(rows: DataFrame, small: int, agree: int | None) -> DataFrame:
    """(a, b, star, near): the pairs of regions of rows (id, key, sketch). All of regions of at most `small` rows, in a
    crowded one the least id with every other, marked star. With agree, pairs whose sketches don't agree so often are
    left out, but for stars, which are not near then. Rows meet where they are sorted, once; rows alone in a region go
    no further, pairs that are left out are not written."""
    order = Window.partitionBy("key").orderBy("id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = ["id", "sketch"] if agree else ["id"]
    rows = rows.select("key", *names).repartition("key")  # the id goes once, not in the struct again
    rows = rows.select("*", F.count(F.lit(1)).over(whole).alias("size")).filter("size > 1")
    rows = rows.select("key", "id", "size", F.struct(*names).alias("x"))
    rows = rows.select("x", "size", F.first("x").over(whole).alias("least"), F.collect_list("x").over(order.rowsBetween(1 - small, -1)).alias("before"))
    crowded = F.col("size") > small
    pairs = rows.select("x", crowded.alias("star"), F.explode(F.when(crowded, F.array("least")).otherwise(F.col("before"))).alias("y")).filter("y.id < x.id")
    near = _near(F.col("x.sketch"), F.col("y.sketch"), agree) if agree else F.lit(True)
    pairs = pairs.select(F.col("y.id").alias("a"), F.col("x.id").alias("b"), "star", near.alias("near")).filter("star OR near")
    return _once(pairs)


def _once(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.max("star").alias("star"), F.max("near").alias("near"))


def _neighbours(rows: DataFrame) -> DataFrame:
    """(a, b): rows (id, key, rest, size, part) of different parts that follow each other in an order."""
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / SORTED_ROWS)))
    order = Window.partitionBy("key", "deal").orderBy("rest", "id")
    before = [F.struct(F.lag("id", k).over(order).alias("id"), F.lag("part", k).over(order).alias("part")) for k in range(1, NEIGHBOURS + 1)]
    pairs = rows.select("id", "part", F.array(*before).alias("before")).select("id", "part", F.explode(F.filter("before", lambda x: x.part != F.col("part"))).alias("x"))
    return pairs.select(F.least("id", "x.id").alias("a"), F.greatest("id", "x.id").alias("b")).distinct()


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt by id into as many parts as shuffles have: how large the sets made of them will be isn't seen before."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")


def across(sets: DataFrame, percent: int, agree: int | None = None) -> DataFrame:
    """(a, b): every pair of rows of sets (id, part, elements: array of distinct longs) of different parts
    whose sets may have this Jaccard similarity, and few others. Sets should come dealt by id, as dealt() does: their
    elements are put in order where they lie.

    With all elements in one order, two sets of sizes n >= m that share at least s elements share one of the
    first n - s + 1 of the one and m - s + 1 of the other. The larger set shows as many as any partner asks
    for, the smaller as many as a partner of its own size does; where the first shared element stands bounds
    how many can follow it. Any order will do; rare elements stand first: the most frequent ones, at most FREQUENT, are
    put by their counts behind all others. A pair is written only if the parities of both sets' elements, in
    64 * PARITIES classes, allow the similarity: classes that differ are as many elements at least that only one of them
    has. With agree, sets have `minima`, words of eight bytes each, and so many of a pair's bytes have to be equal."""
    kept = [F.get("minima", F.lit(k)).alias(f"q{k}") for k in range(MINIMA)] if agree else []
    rows = sets.select("id", "part", F.size("elements").alias("n"), *kept, F.explode("elements").alias("x"))
    counts = cut(sets.select(F.explode("elements").alias("x")).groupBy("x").agg(F.count("*").alias("c")).filter("c > 1"))
    # Counts by their powers of two: the least one of which and of those above it there are not too many.
    powers, known, least = dict(counts.groupBy(F.length(F.bin("c")) - 1).count().collect()), 0, 64
    while least > 1 and known + powers.get(least - 1, 0) <= FREQUENT:
        least -= 1
        known += powers.get(least, 0)
    rows = rows.join(F.broadcast(counts.filter(F.col("c") >= 1 << least)), "x", "left")
    own = Window.partitionBy("id")
    rows = rows.withColumn("at", F.row_number().over(own.orderBy(F.col("c").asc_nulls_first(), "x")) - 1)
    if not agree:
        bit, word = F.expr("shiftleft(1L, CAST(x & 63 AS INT))"), F.shiftright("x", 6).bitwiseAND(PARITIES - 1)
        rows = rows.withColumns({f"q{k}": F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).over(own) for k in range(PARITIES)})
    words = [f"q{k}" for k in range(MINIMA if agree else PARITIES)]
    show = lambda num, den: (F.col("n") - F.ceil(num * F.col("n") / den) + 1).cast("int")
    first = rows.filter(F.col("at") < show(percent, 100))
    if least == 1:
        first = first.filter("c IS NOT NULL")  # the others are elements of one row only
    first = cut(first.select("id", "part", "n", *words, "at", (F.col("at") < show(2 * percent, 100 + percent)).alias("short"), "x"))
    small = first.filter("short").select("x", *[F.col(c).alias(f"{c}_b") for c in ("id", "part", "n", "at", *words)])
    a, b = F.col("n"), F.col("n_b")
    room = F.least(a - F.col("at"), b - F.col("at_b"))
    fits = ((a > b) | ((a == b) & (F.col("id") > F.col("id_b")))) & (100 * b >= percent * a) & ((100 + percent) * room >= percent * (a + b))
    differ = [F.col(q).bitwiseXOR(F.col(f"{q}_b")) for q in words]
    if agree:
        fits = fits & (reduce(Column.__add__, [F.bit_count(_bytes(d)) for d in differ]) <= 8 * MINIMA - agree)
    else:
        fits = fits & ((100 + percent) * reduce(Column.__add__, [F.bit_count(d) for d in differ]) <= (100 - percent) * (a + b))
    pairs = first.drop("short").join(small, "x").filter(fits & (F.col("part") != F.col("part_b")))
    out = cut(pairs.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).distinct())
    for old in (counts, first):
        drop(old)
    return out


def _bytes(differ: Column) -> Column:
    """The lowest bit of each byte of a word that isn't 0."""
    for k in (4, 2, 1):
        differ = differ.bitwiseOR(F.shiftrightunsigned(differ, k))
    return differ.bitwiseAND(F.lit(0x0101010101010101))


def classes(signatures: DataFrame, orders: list[list[int]], base: int, prepare: Callable, percent: int = 75, small: int = SMALL, agree: int | None = None, together: int | None = None) -> DataFrame:
    """(id, component): the classes, by their least id, of rows that verified links connect; rows without any
    are not listed. percent is the similarity of sets that a link asks for.

    prepare(ids), called with rows that have candidates, gives verify(pairs), which keeps pairs (a, b), and
    elements(rows), which adds the rows' sets, dealt by id. With agree, signatures have a sketch, and pairs of a region
    are candidates only if theirs agree so often; with together, sets have minima, of which as many agree."""
    ordered = any(len(order) > base for order in orders)
    passes = [cut(_candidates(regions(signatures, orders, base, k, k + ORDERS_AT_ONCE), small, agree)) for k in range(0, len(orders), ORDERS_AT_ONCE)]
    found = cut(_once(reduce(DataFrame.unionByName, passes)))
    for one in passes:
        drop(one)
    star = found.filter("star").select("a", "b")
    pairs = found.filter("near").select("a", "b")
    verify, elements = prepare(_ends(pairs))
    reach = graph.components(verify(pairs))

    def mixed() -> DataFrame:
        """(id, part): the rows of crowded regions that hold several classes, by the least ids that lead them."""
        of = lambda k: reach.select(F.col("id").alias(k), F.col("component").alias(f"part_{k}"))
        led = star.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("part_a", "a").alias("part_a"), F.coalesce("part_b", "b").alias("part_b"))
        leads = led.filter("part_a != part_b").select("a").distinct()
        led = led.join(leads, "a", "left_semi").select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("part_a").alias("part")), F.struct(F.col("b").alias("id"), F.col("part_b").alias("part")))))
        return cut(led.distinct())

    def joined(more: DataFrame) -> DataFrame:
        """reach, after the links between classes in more (a, b)."""
        of = lambda k: reach.select(F.col("id").alias(k), F.col("component").alias(f"part_{k}"))
        parts = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b"))
        moved = graph.components(parts).select(F.col("id").alias("part"), F.col("component").alias("to"))
        both = reach.withColumnRenamed("component", "part").unionByName(moved.select(F.col("part").alias("id"), "part")).distinct()
        return cut(both.join(moved, "part", "left").select("id", F.coalesce("to", "part").alias("component")))

    left = mixed()
    if agree and not left.isEmpty():  # most of a crowd were no candidates so far
        verify, elements = prepare(cut(left.select("id").distinct()))
    if ordered and not left.isEmpty():
        crowd = cut(join_narrow(signatures, left, "id"))
        rows = regions(crowd, orders, base)
        sizes = rows.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > small)  # in the others all pairs met
        rows = _rest(rows.join(sizes, "key"), crowd.select("id", "signature"), orders, base)
        reach = joined(verify(cut(_neighbours(rows))))
        drop(crowd)
        left = mixed()
    if not left.isEmpty():
        reach = joined(verify(across(elements(left), percent, together)))
    drop(found)
    return reach


def similar(shared: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sets of sizes a and b with `shared` common elements have at least this Jaccard similarity."""
    return (100 + percent) * shared >= percent * (a + b)
