"""Bounded, repeatable samples of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANGE = float(1 << 62)
#: Values that a column may have whose every value is sampled.
MOST_GROUPS = 2000


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo the divisor."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor


def at_most(rows: DataFrame, key: str, group: str, bound: int, groups: int | None = 256, total: int | None = None) -> DataFrame:
    """About `bound` rows at most of each value of `group`, for its `groups` most frequent values (None: for
    all, of which there may be MOST_GROUPS; more are an error): those whose key hashes below the value's share. Where that may come to more than `total` rows, each
    value gets an equal part of these, one at least. The share follows from counts over all rows; only they (a
    row for each value) reach the driver."""
    sizes = rows.groupBy(group).count().orderBy(F.desc("count"), group)
    counts = sizes.limit(MOST_GROUPS + 1 if groups is None else groups).collect()
    if len(counts) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} values of {group}")
    if not counts:
        return rows.limit(0)
    if total is not None:
        bound = min(bound, max(1, total // len(counts)))
    unit = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), 2) / F.lit(_RANGE)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[group], min(1.0, bound / r["count"]))])
    return rows.filter(F.col(group).isin([r[group] for r in counts])).filter(unit < share[F.col(group)])
