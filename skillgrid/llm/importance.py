"""Documents drawn by how much their n-gram buckets are at home in a target corpus.

An inverted index of buckets: every document sends (bucket, document, count) once for each of its buckets; where
a bucket's postings lie, both corpora's counts of it meet and give its gain; each posting becomes a contribution,
and contributions are added up by document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillgrid.llm.scratch import cut

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
OUT_ROWS = 1 << 12
#: Postings of one bucket that lie together, on average at most: a frequent bucket is dealt over several tasks.
SHARD_DOCS = 20_000

#: Lower-cases A-Z and makes every other ASCII character but letters and digits a space; UTF-8's further bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: bytes, longest: int, buckets: int) -> tuple[int, int, dict[int, int]]:
    """The number of words, the number of runs of up to `longest` words, and how many of them fall in each
    bucket."""
    words = text.translate(_FOLD).split()
    found: dict[int, int] = {}
    total = 0
    for k in range(1, longest + 1):
        runs = Counter(words if k == 1 else (b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)))
        for run, n in runs.items():
            bucket = zlib.crc32(run) % buckets
            found[bucket] = found.get(bucket, 0) + n
            total += n
    return len(words), total, found


def postings(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(row, doc_id, n_words, n_features, bucket, count) of docs (doc_id, text): the buckets and their counts as
    parallel arrays; row numbers the rows. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "n_words", "n_features", "bucket", "count"]
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            for lo in range(0, len(texts), OUT_ROWS):
                part = batch.slice(lo, OUT_ROWS)
                made = [features(t.as_py() or b"", longest, buckets) for t in texts.slice(lo, OUT_ROWS)]
                offsets = np.cumsum([0] + [len(f) for _, _, f in made]).astype(np.int32)
                flat = lambda pick: pa.array(np.fromiter((x for _, _, f in made for x in pick(f)), np.int64, offsets[-1]))  # noqa: B023, E731
                arrays = [pa.ListArray.from_arrays(pa.array(offsets), flat(pick).cast(kind)) for pick, kind in ((dict.keys, pa.int32()), (dict.values, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([w for w, _, _ in made], pa.int64()), pa.array([n for _, n, _ in made], pa.int64()), *arrays], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, n_words long, n_features long, bucket array<int>, count array<long>")


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket that `source` (bucket, count) or `target` has: the logarithm of how much
    likelier it is in the target, in thousandths, both smoothed by one count a bucket."""
    both = source.groupBy("bucket").agg(F.sum("count").alias("s")).join(target.groupBy("bucket").agg(F.sum("count").alias("t")), "bucket", "full")
    both = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    total = F.broadcast(both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t")))  # one row
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    return both.crossJoin(total).select("bucket", F.floor(1000 * F.log(((t + 1) * (all_s + buckets)) / ((s + 1) * (all_t + buckets)))).alias("gain"))


def noise(doc_id: str, seed: int = SEED) -> Column:
    """A standard Gumbel deviate in thousandths, rounded down, that follows from the seed and the id (null:
    empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds place, 1 for the first of all rows in the order, which must have no ties. Ranges are sorted apart and
    number their own rows; a range then begins after all rows of the earlier ones."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at + 1, at + n + 1))], [*names, "__sg_part", "__sg_at"])
            at += n

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*rows.schema.fields, T.StructField("__sg_part", T.IntegerType()), T.StructField("__sg_at", T.LongType())])
    inside = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, schema))
    sizes = inside.groupBy("__sg_part").agg(F.max("__sg_at").alias("n"))
    before = F.expr("coalesce(sum(n) OVER (ORDER BY __sg_part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")  # a row for each range
    return inside.join(F.broadcast(sizes.select("__sg_part", before.alias("before"))), "__sg_part").select(*names, (F.col("before") + F.col("__sg_at")).alias("place"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs (doc_id, text): weight adds up the gains of its
    features towards target (text), score is weight plus Gumbel noise, and rank numbers the `percent` of 100 rows with
    at least `min_words` words that have the highest scores; the others' is null.

    Null and empty texts have no features and weight 0; texts of any length count whole. Repeated rows stand for
    themselves; ties go to the lesser doc_id, a null one last, then to the earlier row. Without target features all
    counts are smoothed alone. An empty table gives an empty one; other columns are not read."""
    index = cut(postings(docs, longest, buckets))
    aim = postings(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets)
    flat = lambda df, *more: df.select(*more, F.explode(F.arrays_zip("bucket", "count")).alias("p")).select(*more, "p.bucket", "p.count")
    known = cut(gains(flat(index), flat(aim), buckets))
    # A bucket's postings are dealt over as many shards as keep each of bounded size, its gain is sent to all.
    shards = max(1, -(-index.count() // SHARD_DOCS))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")
    sent = flat(index, "row").select("bucket", shard, "row", "count")
    met = sent.hint("shuffle_hash").join(known.select("bucket", "gain", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).hint("shuffle_hash"), ["bucket", "shard"])
    weights = met.groupBy("row").agg(F.sum(F.col("count") * F.col("gain")).alias("weight"))
    rows = index.select("row", "doc_id", "n_words", "n_features").join(weights, "row", "left")
    rows = rows.select("row", "doc_id", "n_words", "n_features", F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))
    rows = cut(rows.withColumn("score", F.col("weight") + noise("doc_id", seed)))
    fit = F.col("n_words") >= min_words
    quota = rows.filter(fit).count() * percent // 100
    first = ranked(rows.filter(fit), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")])
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = first.select(*columns, F.when(F.col("place") <= quota, F.col("place")).cast("long").alias("rank"))
    return drawn.unionByName(rows.filter(~fit).select(*columns, F.lit(None).cast("long").alias("rank")))
