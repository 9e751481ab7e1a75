"""Blocks of documents and key ranges that exchange sorted arrays.

Some operators ask, for very many short pieces of text, what the whole corpus knows about each. A row for each
piece would cost more than the answer; instead documents are dealt into blocks by a hash of their id, a block
sorts and de-duplicates its own pieces, and sends each key range one row of packed arrays. A range merges what
all blocks sent and answers each in the same order. A frequent piece reaches its range once from each block,
however many rows hold it, and key hashes spread ranges evenly, so no task gathers a hot key's rows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 23
KEY_BITS = 48


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks of about this size the texts make."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, -(-int(total) // block_bytes))


def block_of(n: int) -> Column:
    """A document's block; rows without an id are dealt by their text."""
    return F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), F.lit("block")), F.lit(n)).cast("int")


def bounds(ranges: int) -> np.ndarray:
    """The first key of each range, and the key after the last."""
    return np.array([(i << KEY_BITS) // ranges for i in range(ranges + 1)], dtype=np.uint64)


def cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where the ranges begin among sorted keys."""
    return np.searchsorted(keys, bounds(ranges))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences of four bytes where they fit, else as they are."""
    if len(keys) > 1:
        steps = np.diff(keys)
        if int(steps.max()) < 1 << 32:
            return b"\x04" + keys[:1].astype("<u8").tobytes() + steps.astype("<u4").tobytes()
    return b"\x08" + keys.astype("<u8").tobytes()


def unpack_keys(packed: bytes) -> np.ndarray:
    if packed[0] == 8:
        return np.frombuffer(packed, "<u8", offset=1).astype(np.uint64)
    first = np.frombuffer(packed, "<u8", count=1, offset=1)
    return np.cumsum(np.concatenate([first, np.frombuffer(packed, "<u4", offset=9)]), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Whole numbers, most of them small and alike, in the least width that holds them all, deflated."""
    width = next(w for w in (1, 2, 4, 8) if not len(counts) or int(counts.max()) < 1 << (8 * w))
    return bytes([width]) + zlib.compress(counts.astype(f"<u{width}").tobytes(), 1)


def unpack_counts(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1:]), f"<u{packed[0]}").astype(np.int64)
