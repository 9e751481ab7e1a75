"""Repeated byte strings: a depth-limited radix sort of the suffixes that can repeat.

A byte is removed if a string of `threshold` bytes covers it that also starts in a document with a smaller id.
Suffixes are ordered only through their first `threshold` bytes, by passes from the most significant digit
down, and each pass keeps only suffixes whose group has others: what is left at the end are exactly the
repeated strings.

The first digit of a suffix is the least-hashed run of GRAM bytes within its string and where that run lies.
Equal strings share it, and it changes only every dozen bytes or so, so that neighbouring suffixes travel
together: this pass needs one key for each such run. Later digits are the string's own bytes, eight at a time,
compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.llm import blocks
from skillgrid.llm.vectext import mix, powers, prefix_sums, slices

THRESHOLD = 50
GRAM = 24
#: Strings that a pass over a key range expands at once, if they don't all share one first digit.
EXPANDED = 80_000
#: Bytes of text in a block.
BLOCK_BYTES = 1 << 22

_P_INVERSE = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_PLACE = np.uint64((1 << 24) - 1)
_SHIFT = np.uint64(64 - blocks.KEY_BITS)
_PART = 1 << 22


class _Runs:
    """Neighbouring strings with the same first digit, of one stretch of bytes: where the strings start
    (from p, n of them), the digit's key, where its run lies from p, and a hash of all bytes they span."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, threshold: int):
        span = threshold - GRAM + 1  # runs of GRAM bytes in a string
        n = len(data) - threshold + 1
        self.p = self.n = self.at = np.zeros(0, np.int64)
        self.key = self.print = np.zeros(0, np.uint64)
        if n <= 0:
            return
        sums = prefix_sums(data)
        back = powers(_P_INVERSE, len(data) + 1)
        keys = mix((sums[GRAM:] - sums[:-GRAM]) * back[: len(data) - GRAM + 1])
        least = (keys & ~_PLACE) | np.arange(len(keys), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: n], least[span - width : span - width + n])
        place = (least[:n] & _PLACE).astype(np.int64)
        place[ends[np.arange(n)] - np.arange(n) < threshold] = -1  # the string would leave its text
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.append(first, n))
        keep = place[first] >= 0
        self.p, self.n = first[keep], count[keep]
        g = place[self.p]
        self.at, self.key = g - self.p, keys[g] >> _SHIFT
        stop = self.p + self.n + threshold - 1
        self.print = mix((sums[stop] - sums[self.p]) * back[self.p] + self.n.astype(np.uint64) * np.uint64(0x9E37) + self.at.astype(np.uint64))


def _stretches(column: pa.Array, threshold: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first text, bytes, offsets, place of the first byte in its text); a long text comes in overlapping
    stretches of its own, so that places fit their bits and memory is bounded."""
    for lo, _, data, offsets in slices(column):
        if len(data) <= _PART:
            yield lo, data, offsets, 0
        else:
            for at in range(0, max(1, len(data) - threshold + 1), _PART):
                part = data[at : at + _PART + threshold - 1]
                yield lo, part, np.array([0, len(part)]), at


class _Block:
    """One block's documents in the order of their ids, without copies of texts with smaller ids."""

    def __init__(self, table: pa.Table, threshold: int):
        copies = table.filter(table.column("copied"))
        table = table.filter(pa.compute.invert(table.column("copied"))).sort_by([("doc_id", "ascending"), ("h", "ascending")])
        self.threshold = threshold
        gone = set(zip(copies.column("doc_id").to_pylist(), copies.column("h").to_pylist(), strict=True))
        pairs = list(zip(table.column("doc_id").to_pylist(), table.column("h").to_pylist(), strict=True))
        self.ids = [d for d, _ in pairs]
        self.copied = np.array([p in gone for p in pairs], dtype=bool)
        text = table.column("text").combine_chunks() if len(table) else pa.array([], pa.string())
        self.text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        self.searched = np.array([d is not None and not c for d, c in zip(self.ids, self.copied.tolist(), strict=True)], dtype=bool)
        self.numbers = np.array([d if d is not None else 0 for d in self.ids], dtype=np.int64)

    def runs(self) -> Iterator[tuple[np.ndarray, _Runs]]:
        """(document of each run, runs), with places in the texts."""
        for lo, data, offsets, at in _stretches(self.text, self.threshold):
            ends = np.repeat(offsets[1:], np.diff(offsets))
            runs = _Runs(data, ends, self.threshold)
            local = np.searchsorted(offsets, runs.p, side="right") - 1
            doc = lo + local
            runs.p = runs.p - offsets[local] + at
            keep = self.searched[doc] if len(doc) else np.zeros(0, bool)
            for k in ("p", "n", "at", "key", "print"):
                setattr(runs, k, getattr(runs, k)[keep])
            yield doc[keep], runs

    def gather(self) -> dict[str, np.ndarray]:
        """All runs of the block: doc, p (in the text), n, at, key, print."""
        parts: dict[str, list[np.ndarray]] = {k: [] for k in ("doc", "p", "n", "at", "key", "print")}
        for doc, runs in self.runs():
            for k, v in (("doc", doc.astype(np.int32)), ("p", runs.p), ("n", runs.n.astype(np.uint8)), ("at", runs.at.astype(np.uint8)), ("key", runs.key), ("print", runs.print)):
                parts[k].append(v)
        empty = {"doc": np.int32, "p": np.int64, "n": np.uint8, "at": np.uint8, "key": np.uint64, "print": np.uint64}
        return {k: np.concatenate(v) if v else np.zeros(0, empty[k]) for k, v in parts.items()}

    def keys(self, r: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The block's distinct keys, and whether runs of several documents have each."""
        order = np.lexsort((r["doc"], r["key"]))
        key, doc = r["key"][order], r["doc"][order]
        new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        group = np.cumsum(new) - 1
        several = np.zeros(int(group[-1]) + 1 if len(group) else 0, dtype=bool)
        several[group[1:][(~new[1:]) & (doc[1:] != doc[:-1])]] = True
        return key[new], several


def _contexts(block: _Block, r: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Distinct runs (by key, then print) with the least document id that has each, and for every run of the
    block its number among them."""
    number = block.numbers[r["doc"]]
    order = np.lexsort((number, r["print"], r["key"]))
    key, mark = r["key"][order], r["print"][order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])])[: len(key)]
    which = np.empty(len(key), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    head = order[new]
    return {"key": r["key"][head], "doc": number[head], "at": r["at"][head], "n": r["n"][head], "text": r["doc"][head], "p": r["p"][head]}, which


def equal_groups(digits: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passes from the most significant digit down: rows of `digits` with equal `first` and equal digits.

    Returns the rows that have equals, ordered by group, and the number of each one's group."""
    rows, group = np.arange(len(first)), first
    for k in range(digits.shape[1] + 1):
        if k:
            order = np.lexsort((digits[rows, k - 1], group))
            rows, group, digit = rows[order], group[order], digits[rows[order], k - 1]
            new = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        else:
            order = np.argsort(group, kind="stable")
            rows, group = rows[order], group[order]
            new = group[1:] != group[:-1]
        new = np.concatenate([[True], new])[: len(rows)]
        alone = new & np.concatenate([new[1:], [True]])[: len(rows)]
        group = np.cumsum(new)[~alone]
        rows = rows[~alone]
        if not len(rows):
            break
    return rows, group


def _earlier(keys: np.ndarray, docs: np.ndarray, at: np.ndarray, count: np.ndarray, begin: np.ndarray, data: np.ndarray, threshold: int) -> np.ndarray:
    """For runs of strings, bits of those of their strings that occur in a run with a smaller document."""
    out = np.zeros(len(keys), dtype=np.uint32)
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])[: len(order)]
    alone = new & np.concatenate([new[1:], [True]])[: len(order)]
    order, group = order[~alone], np.cumsum(new)[~alone]
    words = -(-threshold // 8)
    every = np.lib.stride_tricks.sliding_window_view(data, threshold)  # a view: nothing is copied
    total = np.cumsum(count[order])
    lo = 0
    while lo < len(order):
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + EXPANDED, side="right"))
        hi = max(hi, lo + 1)
        while hi < len(order) and group[hi] == group[hi - 1]:
            hi += 1
        some, n = order[lo:hi], count[order[lo:hi]].astype(np.int64)
        run = np.repeat(np.arange(hi - lo), n)
        k = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        first = (group[lo:hi][run] << 8) | (at[some].astype(np.int64)[run] - k)
        rows, _ = equal_groups(np.zeros((len(run), 0), np.uint64), first)
        strings = np.zeros((len(rows), words * 8), np.uint8)
        strings[:, :threshold] = every[begin[some][run[rows]] + k[rows]]
        equal, number = equal_groups(strings.view(">u8").astype(np.uint64), first[rows])
        if len(equal):
            rows = rows[equal]
            own = docs[some][run[rows]]
            heads = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
            least = np.repeat(np.minimum.reduceat(own, heads), np.diff(np.append(heads, len(number))))
            late = rows[own > least]
            np.bitwise_or.at(out, some[run[late]], np.uint32(1) << k[late].astype(np.uint32))
        lo = hi
    return out


def _copies(docs: DataFrame, threshold: int) -> DataFrame:
    """(doc_id, h) of texts that a smaller id has too."""
    marks = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= threshold)).select("doc_id", "h", F.xxhash64("text", F.lit(1)).alias("h2"))
    first = marks.groupBy("h", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("h", "h2", "first")
    return marks.join(first, ["h", "h2"]).filter("doc_id > first").select("doc_id", "h").distinct()


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) for each row of docs (doc_id, text): the removed runs of bytes as
    {start, end} and the UTF-8 bytes that stay.

    Every string is judged on the input. Null texts count as empty; texts shorter than the threshold lose
    nothing. Rows that share a doc_id don't remove each other's bytes; rows without one are left alone. An
    empty table gives an empty one; other columns are not read. threshold: GRAM + 2 to GRAM + 31."""
    if not GRAM + 2 <= threshold <= GRAM + 31:
        raise ValueError("this threshold doesn't suit the first digit's width")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = blocks.block_count(docs, BLOCK_BYTES)
    docs = docs.withColumn("h", F.xxhash64("text"))
    marks = _copies(docs, threshold).select("doc_id", F.lit("").alias("text"), "h", F.lit(True).alias("copied"))
    dealt = docs.withColumn("copied", F.lit(False)).unionByName(marks).select(blocks.block_of(n).alias("block"), "doc_id", "text", "h", "copied")

    def ask(table: pa.Table) -> pa.Table:
        block = _Block(table, threshold)
        keys, several = block.keys(block.gather())
        edges, rows = blocks.cuts(keys, n), []
        for s in range(n):
            a, b = edges[s], edges[s + 1]
            if a < b:
                rows.append((s, blocks.pack_keys(keys[a:b]), np.packbits(several[a:b]).tobytes()))
        number = table.column("block")[0].as_py()
        return pa.table([pa.array([number] * len(rows), pa.int32()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary())))], ["block", "range", "keys", "several"])

    def answer(table: pa.Table) -> pa.Table:
        asked = [blocks.unpack_keys(x) for x in table.column("keys").to_pylist()]
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(table.column("several").to_pylist(), asked, strict=True)]).astype(bool)
        _, which, counts = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
        again = counts > 1
        again[which[several]] = True
        parts = np.split(again[which], np.cumsum([len(k) for k in asked])[:-1])
        out = pa.array([np.packbits(x).tobytes() for x in parts], pa.binary())
        return pa.table([table.column("block"), table.column("range"), out, pa.array([1] * len(asked), pa.int32())], ["block", "range", "bits", "pass"])

    def candidates(block: _Block, replies: dict[int, bytes]) -> dict[str, np.ndarray]:
        """The block's runs whose keys have others."""
        r = block.gather()
        keys, _ = block.keys(r)
        edges, again = blocks.cuts(keys, n), np.zeros(len(keys), dtype=bool)
        for s, bits in replies.items():
            a, b = edges[s], edges[s + 1]
            again[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(b - a)).astype(bool)
        keep = again[np.searchsorted(keys, r["key"])] if len(keys) else np.zeros(0, bool)
        return {k: v[keep] for k, v in r.items()}

    def replies_of(table: pa.Table, step: int) -> dict[int, bytes]:
        return {r["range"]: r["bits"] for r in table.to_pylist() if r["pass"] == step}

    def show(table: pa.Table, replies: pa.Table) -> pa.Table:
        columns = ["block", "range", "keys", "docs", "at", "n", "strings"]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        rows: list[tuple] = []
        if len(table):
            block = _Block(table, threshold)
            c, _ = _contexts(block, candidates(block, replies_of(replies, 1)))
            raw = block.text.cast(pa.large_binary())
            edges = blocks.cuts(c["key"], n)
            where = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
            for s in range(n):
                a, b = edges[s], edges[s + 1]
                if a < b:
                    size = c["n"][a:b].astype(np.int64) + threshold - 1
                    begin = where[c["text"][a:b]] + c["p"][a:b]
                    flat = data[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                    rows.append((table.column("block")[0].as_py(), s, c["key"][a:b].astype("<u8").tobytes(), c["doc"][a:b].astype("<i8").tobytes(), c["at"][a:b].tobytes(), c["n"][a:b].tobytes(), flat.tobytes()))
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], columns)

    def judge(table: pa.Table) -> pa.Table:
        rows = [{k: np.frombuffer(table.column(k)[i].as_py(), t) for k, t in (("keys", "<u8"), ("docs", "<i8"), ("at", np.uint8), ("n", np.uint8), ("strings", np.uint8))} for i in range(len(table))]
        whole = {k: np.concatenate([r[k] for r in rows]) for k in rows[0]}
        size = whole["n"].astype(np.int64) + threshold - 1
        bits = _earlier(whole["keys"], whole["docs"], whole["at"], whole["n"].astype(np.int64), np.cumsum(size) - size, whole["strings"], threshold)
        parts = np.split(bits, np.cumsum([len(r["keys"]) for r in rows])[:-1])
        return pa.table([table.column("block"), table.column("range"), pa.array([x.astype("<u4").tobytes() for x in parts], pa.binary()), pa.array([2] * len(rows), pa.int32())], ["block", "range", "bits", "pass"])

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(table):
            block = _Block(table, threshold)
            r = candidates(block, replies_of(replies, 1))
            c, which = _contexts(block, r)
            edges, bits = blocks.cuts(c["key"], n), np.zeros(len(c["key"]), np.uint32)
            for s, packed in replies_of(replies, 2).items():
                bits[edges[s] : edges[s + 1]] = np.frombuffer(packed, "<u4")
            every = np.uint32(0xFFFFFFFF)
            mine = np.where(block.numbers[r["doc"]] > c["doc"][which], every, bits[which]) if len(which) else np.zeros(0, np.uint32)
            some = mine != 0
            by_doc: dict[int, list[tuple[int, int, int]]] = {}
            for d, p, k, b in zip(r["doc"][some].tolist(), r["p"][some].tolist(), r["n"][some].tolist(), mine[some].tolist(), strict=True):
                by_doc.setdefault(d, []).append((p, k, b))
            for d in range(len(block.ids)):
                raw = (block.text[d].as_py() or "").encode()
                spans: list[tuple[int, int]] = []
                if block.copied[d]:
                    spans = [(0, len(raw))]
                else:
                    for p, k, b in sorted(by_doc.get(d, ())):
                        b &= (1 << k) - 1
                        while b:
                            low = (b & -b).bit_length() - 1
                            high = low + ((b >> low) + 1 & -((b >> low) + 1)).bit_length() - 1
                            start, end = p + low, p + high - 1 + threshold
                            if spans and start <= spans[-1][1]:
                                spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
                            else:
                                spans.append((start, end))
                            b &= ~((1 << high) - 1)
                edges_ = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[edges_[i] : edges_[i + 1]] for i in range(0, len(edges_), 2))
                out.append((block.ids[d], len(raw), [{"start": a, "end": b} for a, b in spans], kept))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["doc_id", "n_bytes", "removed", "kept"])

    reply = "block int, range int, bits binary, pass int"
    again = dealt.groupBy("block").applyInArrow(ask, "block int, range int, keys binary, several binary").groupBy("range").applyInArrow(answer, reply)
    shown = dealt.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(show, "block int, range int, keys binary, docs binary, at binary, n binary, strings binary")
    earlier = shown.groupBy("range").applyInArrow(judge, reply)
    return dealt.groupBy("block").cogroup(again.unionByName(earlier).groupBy("block")).applyInArrow(finish, "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary")
