"""Language-model scoring: a trigram model whose trie is held in Elias-Fano levels.

Counts are taken over all training documents. A trie of the whole corpus would not fit a task, so each block
of documents gets the part of it that its own texts can ask for: the block sends its distinct n-grams with
their counts to key ranges, which add up what all blocks sent and answer with the totals. A triple is sent only if
other blocks have both its pairs, since no other block can have it else. The block then builds its trie and
scores its documents with it. A block's trie is bounded by its text, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.llm import blocks
from skillgrid.llm.eliasfano import Trie
from skillgrid.llm.vectext import mix, slices, words

#: Weight of the shorter history, in counts, for pairs and triples.
MU = (200.0, 20.0)
#: Bytes of text in a block; a task holds about fifty times as many while it scores them.
BLOCK_BYTES = 7 << 20
END = np.uint64(0xE0D0E0D0E0D0E0D1)
_TOP = np.uint64(64 - blocks.KEY_BITS)


def _stream(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens of the texts, each text's end included, and where each text's tokens begin."""
    keys, lengths = [], []
    for _, _, data, offsets in slices(text):
        h, at = words(data, offsets)
        keys.append(np.insert(h, at[1:], END))
        lengths.append(np.diff(at) + 1)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(keys), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b) >> _TOP


def _triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(mix(a * np.uint64(0xD6E8FEB86659FD93) + b) * np.uint64(0xA0761D6478BD642F) + c) >> _TOP


def _starts(n: int, begin: np.ndarray, order: int) -> np.ndarray:
    """Places in a stream of n tokens at which `order` tokens of one text start."""
    ok = np.ones(n, dtype=bool)
    for k in range(1, order):
        last = begin[1:] - k
        ok[last[last >= 0]] = False
    return np.flatnonzero(ok)


def _cuts(keys: np.ndarray, order: int, ranges: int) -> np.ndarray:
    return blocks.cuts(keys >> _TOP if order == 1 else keys, ranges)


def _tally(keys: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how many counted rows have each."""
    key = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    distinct = key[first]
    known = np.sort(keys[counted])
    return distinct, np.searchsorted(known, distinct, side="right") - np.searchsorted(known, distinct, side="left")


def totals(docs: DataFrame, ranges: int) -> tuple[int, int]:
    """Tokens and distinct tokens of docs (text); only these two numbers reach the driver."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = np.unique(_stream(batch.column(0))[0], return_counts=True)
            edges = _cuts(keys, 1, ranges)
            rows = [(s, blocks.pack_keys(keys[edges[s] : edges[s + 1]]), int(counts[edges[s] : edges[s + 1]].sum())) for s in range(ranges) if edges[s] < edges[s + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.int64()))], ["range", "keys", "n"])

    def merge(table: pa.Table) -> pa.Table:
        keys = np.concatenate([blocks.unpack_keys(x) for x in table.column("keys").to_pylist()])
        return pa.table({"tokens": [int(pa.compute.sum(table.column("n")).as_py())], "types": [len(np.unique(keys))]})

    sent = docs.select("text").mapInArrow(gather, "range int, keys binary, n long")
    row = sent.groupBy("range").applyInArrow(merge, "tokens long, types long").agg(F.sum("tokens"), F.sum("types")).first()
    return int(row[0] or 0), int(row[1] or 0)


def score(docs: DataFrame, mu: tuple[float, float] = MU) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id,
    text, held_out); the model learns from rows that aren't held out.

    Scores are log10 probabilities of the whole text and its end: base_score of single tokens with one added
    to each count, score of the trigram model. Null and empty texts are an end alone. Rows whose held_out is
    null are learned from. Repeated rows count as often as they appear and score alike; with nothing to learn
    from, all tokens are unknown; an empty table gives an empty one; other columns are not read."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("held_out", F.lit(False)).alias("held_out"))
    n = blocks.block_count(docs, BLOCK_BYTES)
    tokens, types = totals(docs.filter(~F.col("held_out")), n)
    total = float(tokens + types + 1)
    dealt = docs.select(blocks.block_of(n).alias("block"), "doc_id", "text", "held_out")

    def ask(table: pa.Table) -> pa.Table:
        keys, begin, learned = stream_of(table)
        at = _starts(len(keys), begin, 2)
        return sent(table, [(1, *_tally(keys, learned)), (2, *_tally(_pair(keys[at], keys[at + 1]), learned[at]))])

    def ask_triples(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return asked_schema.empty_table()
        keys, begin, learned = stream_of(table)
        at, _, shared = pairs_of(keys, begin, answers_of(replies))
        elsewhere = np.zeros(len(keys), dtype=bool)
        elsewhere[at] = shared
        at = _starts(len(keys), begin, 3)
        at = at[elsewhere[at] & elsewhere[at + 1]]
        return sent(table, [(3, *_tally(_triple(keys[at], keys[at + 1], keys[at + 2]), learned[at]))])

    def stream_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, begin = _stream(table.column("text"))
        return keys, begin, np.repeat(~np.array(table.column("held_out").to_pylist(), dtype=bool), np.diff(begin))

    def answers_of(replies: pa.Table) -> dict[tuple[int, int], bytes]:
        return {(r["order"], r["range"]): r["counts"] for r in replies.to_pylist()}

    def counted(distinct: np.ndarray, order: int, answers: dict[tuple[int, int], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the distinct, sorted keys that the block has asked for, and whether other blocks
        asked for them too."""
        edges, out = _cuts(distinct, order, n), np.zeros(len(distinct), dtype=np.int64)
        for s in range(n):
            if edges[s] < edges[s + 1]:
                out[edges[s] : edges[s + 1]] = blocks.unpack_counts(answers[order, s])
        return out >> 1, (out & 1).astype(bool)

    def pairs_of(keys: np.ndarray, begin: np.ndarray, answers: dict[tuple[int, int], bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the pairs of tokens, for each its training count and whether other blocks have it too. A
        triple can be in other blocks only if both its pairs are."""
        at = _starts(len(keys), begin, 2)
        distinct, which = np.unique(_pair(keys[at], keys[at + 1]), return_inverse=True)
        every, shared = counted(distinct, 2, answers)
        return at, every[which], shared[which]

    def sent(table: pa.Table, tallies: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
        number, out = table.column("block")[0].as_py(), []
        for order, distinct, counts in tallies:
            edges = _cuts(distinct, order, n)
            for s in range(n):
                a, b = edges[s], edges[s + 1]
                if a < b:
                    out.append((number, s, order, blocks.pack_keys(distinct[a:b]), blocks.pack_counts(counts[a:b])))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(asked_schema.types)], schema=asked_schema)

    asked_schema = pa.schema([("block", pa.int32()), ("range", pa.int32()), ("order", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def answer(table: pa.Table) -> pa.Table:
        order = np.array(table.column("order").to_pylist())
        reply: list[bytes | None] = [None] * len(table)
        for k in np.unique(order):
            rows = np.flatnonzero(order == k).tolist()
            keys = [blocks.unpack_keys(table.column("keys")[i].as_py()) for i in rows]
            counts = np.concatenate([blocks.unpack_counts(table.column("counts")[i].as_py()) for i in rows])
            _, which = np.unique(np.concatenate(keys), return_inverse=True)
            sums = ((np.bincount(which, counts).astype(np.int64) << 1) | (np.bincount(which) > 1))[which]
            for i, part in zip(rows, np.split(sums, np.cumsum([len(x) for x in keys])[:-1]), strict=True):
                reply[i] = blocks.pack_counts(part)
        return pa.table([table.column("block"), table.column("range"), table.column("order"), pa.array(reply, pa.binary())], ["block", "range", "order", "counts"])

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        kinds = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
        if not len(table):
            return pa.schema(kinds).empty_table()
        answers = answers_of(replies)
        keys, begin, learned = stream_of(table)
        vocabulary = np.unique(keys)
        w = np.searchsorted(vocabulary, keys)
        single, _ = counted(vocabulary, 1, answers)
        size = len(vocabulary)
        at2, every, shared = pairs_of(keys, begin, answers)
        at3 = _starts(len(keys), begin, 3)
        pairs, of2 = np.unique(w[at2] * size + w[at2 + 1], return_inverse=True)
        a, b = pairs // size, pairs % size
        n2 = np.zeros(len(pairs), dtype=np.int64)
        n2[of2] = every
        pair_of, elsewhere = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        pair_of[at2], elsewhere[at2] = of2, shared
        triples, of3 = np.unique(pair_of[at3] * size + w[at3 + 2], return_inverse=True)
        k, c = triples // size, triples % size
        n3 = np.bincount(of3, learned[at3], len(triples)).astype(np.int64)
        asked = np.zeros(len(triples), dtype=bool)
        asked[of3] = elsewhere[at3] & elsewhere[at3 + 1]
        distinct, which = np.unique(_triple(vocabulary[a[k[asked]]], vocabulary[b[k[asked]]], vocabulary[c[asked]]), return_inverse=True)
        n3[asked] = counted(distinct, 3, answers)[0][which]
        del keys, learned, pair_of, elsewhere, every, shared, asked, distinct, which
        some2, some3 = n2 > 0, n3 > 0
        rank = np.cumsum(some2) - 1
        trie = Trie(single, (a[some2], b[some2]), n2[some2], (rank[k[some3]], c[some3]), n3[some3], total, mu)
        p2, place = trie.after_word(a, b)
        tail = np.searchsorted(pairs, b[k] * size + c)
        p3 = trie.after_pair(place[k], b[k], place[tail], p2[tail])
        p = trie.word(w)
        p[at2 + 1] = p2[of2]
        p[at3 + 2] = p3[of3]
        base = np.log10((single + 1) / total)[w]
        sums = lambda x: np.add.reduceat(x, begin[:-1])
        length = np.diff(begin)
        out = [table.column("doc_id"), table.column("held_out"), pa.array(length), pa.array(sums((single > 0)[w].astype(np.int64))), pa.array(np.full(len(table), tokens)), pa.array(sums(base)), pa.array(sums(p))]
        return pa.table(out, schema=pa.schema(kinds))

    packed, reply = "block int, range int, order int, keys binary, counts binary", "block int, range int, order int, counts binary"
    replies = dealt.groupBy("block").applyInArrow(ask, packed).groupBy("range").applyInArrow(answer, reply)
    triples = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(ask_triples, packed).groupBy("range").applyInArrow(answer, reply)
    return dealt.groupBy("block").cogroup(replies.unionByName(triples).groupBy("block")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
