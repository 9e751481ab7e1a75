"""Near-duplicate documents: MinHash signatures, an LSH forest, and exact Jaccard similarity of word shingles.

Documents with equal shingle sets are one node from the start, so copies cost nothing later. Nodes are
candidates where the forest makes them neighbours; each candidate pair is confirmed on its full sets, and
components of confirmed links are found by distributed union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.llm import forest
from skillgrid.llm.scratch import cut, join_narrow
from skillgrid.llm.vectext import mix, shingles, slices, words

SHINGLE_WORDS = 5
PERCENT = 75
#: Orders, values of each, and values that a region shares at least. A pair of similarity 0.75 shares no first
#: region with probability (1 - 0.75**3)**20 < 2e-5.
TREES, DEPTH, BASE = 20, 7, 3


def _sets(column: pa.Array, width: int) -> Iterator[list[np.ndarray]]:
    """The sorted distinct shingle hashes of each text, in runs of texts."""
    for lo, hi, data, offsets in slices(column):
        hashes, at = words(data, offsets)
        yield [np.unique(shingles(hashes[at[i] : at[i + 1]], width)) for i in range(hi - lo)]


def minhash(sets: list[np.ndarray], values: int, seed: int = 1) -> np.ndarray:
    """(texts, values) of 32-bit minima; the row of an empty set is 0."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 32, values, dtype=np.uint32) | np.uint32(1)
    turns = rng.integers(0, 1 << 32, values, dtype=np.uint32)
    out = np.zeros((len(sets), values), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
        begin = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        for k in range(values):
            out[full, k] = np.minimum.reduceat((flat * factors[k]) ^ turns[k], begin)
    return out


def signatures(docs: DataFrame, width: int = SHINGLE_WORDS, values: int = TREES * DEPTH) -> DataFrame:
    """(doc_id, n, h1, h2, signature): the size of each document's shingle set, a 128-bit fingerprint of it,
    and its minima; signature is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for sets in _sets(batch.column(1), width):
                n = np.array([len(s) for s in sets], np.int64)
                prints = np.array([(s.sum(dtype=np.uint64), mix(s + np.uint64(0x51ED)).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
                minima = minhash(sets, values).view(np.int32)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * values), pa.array(minima.ravel()))
                rows = pa.ListArray.from_arrays(rows.offsets, rows.values, mask=pa.array(n == 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(sets)), pa.array(n), pa.array(prints[:, 0]), pa.array(prints[:, 1]), rows], ["doc_id", "n", "h1", "h2", "signature"])
                lo += len(sets)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, signature array<int>")


def shingle_sets(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(id, n, shingles): each document's distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for sets in _sets(batch.column(1), width):
                values = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(sets)), pa.array([len(s) for s in sets], pa.int64()), values], ["id", "n", "shingles"])
                lo += len(sets)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "id long, n long, shingles array<long>")


def confirmer(ids: DataFrame, docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT):  # noqa: ANN201
    """Two functions: one keeps those of given pairs (a, b) of ids whose full shingle sets are similar enough,
    one adds their sets to rows (id, part). The sets are made once. Pairs whose sizes alone rule it out send
    none, so that what a row is sent never exceeds its own set's size by more than a third."""
    wanted = ids.withColumnRenamed("id", "doc_id")
    sets = cut(shingle_sets(join_narrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted, "doc_id", "left_semi"), width).dropDuplicates(["id"]))
    of = lambda k, column: sets.select(F.col("id").alias(k), F.col(column).alias(f"{column}_{k}"))

    def confirm(pairs: DataFrame) -> DataFrame:
        near = pairs.join(of("a", "n"), "a").join(of("b", "n"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        both = near.select("a", "b").join(of("b", "shingles"), "b").join(of("a", "shingles"), "a")
        shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
        return both.filter(forest.similar(shared, F.size("shingles_a"), F.size("shingles_b"), percent)).select("a", "b")

    return confirm, lambda rows: forest.dealt(rows.join(sets, "id")).select("id", "part", F.col("shingles").alias("elements"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Documents are linked where 100 * intersection >= percent * union of their shingle sets. A text with fewer
    words than a shingle has one, all its words; null, empty and blank texts have none and are linked with
    nothing. component_id is the least doc_id reachable; kept marks the row that has it. Rows that repeat a
    doc_id are alike in this. A row without doc_id has no component and is kept. Ties don't arise, an empty
    table gives an empty one, other columns are not read."""
    every = cut(signatures(docs, width))
    full = every.filter("n > 0 AND doc_id IS NOT NULL")
    nodes = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"))
    node_rows = full.join(nodes.select(F.col("id").alias("doc_id"), "h1", "h2"), ["doc_id", "h1", "h2"], "left_semi").dropDuplicates(["doc_id"])
    marks = cut(node_rows.select(F.col("doc_id").alias("id"), "signature"))
    reach = forest.classes(marks, [list(range(t * DEPTH, (t + 1) * DEPTH)) for t in range(TREES)], BASE, lambda ids: confirmer(ids, docs, width, percent), percent)
    placed = every.select("doc_id", "n", "h1", "h2").join(nodes, ["h1", "h2"], "left").join(reach, "id", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
