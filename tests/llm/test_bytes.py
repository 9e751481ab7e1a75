from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skillgrid.llm import media, packing, repeats

PATH = public_tokenizers.path("word_bpe_49k.json")


def by_hand(rows, k=50):
    docs = [(i, (t or "").encode()) for i, t in rows]
    first: dict[bytes, int] = {}
    for i, b in docs:
        for p in range(len(b) - k + 1):
            if i is not None:
                first[b[p : p + k]] = min(first.get(b[p : p + k], i), i)
    out = []
    for i, b in docs:
        gone = bytearray(len(b))
        for p in range(len(b) - k + 1):
            if i is not None and first[b[p : p + k]] < i:
                gone[p : p + k] = b"\1" * k
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i if i is not None else -1, len(b), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def removed(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block int, h string")
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], len(r["removed"]), bytes(r["kept"])) for r in repeats.remove_repeats(docs).collect())


def test_repeats_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 60, 200, 700)]
    rows = []
    for i in range(80):
        parts = [text(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 4)):
            parts += [rng.choice(shared), text(rng.randint(0, 60))]
        rows.append((rng.randrange(1000), "".join(parts)))
    rows += [(2000, rows[0][1]), (2001, rows[0][1]), (2001, rows[0][1]), (None, rows[0][1]), (2002, None), (2003, ""), (2004, "ab" * 300), (2005, "ab" * 200), (2006, "a" * 500), (1, shared[5] * 2)]
    rng.shuffle(rows)
    assert removed(spark, rows) == by_hand(rows)


def test_repeats_of_many_copies_and_of_nothing(spark):
    t = "one passage that is repeated in very many documents of this table, word for word"
    rows = [(i, t) for i in range(300)] + [(1000 + i, f"{i} before {t} after {i}") for i in range(200)]
    assert removed(spark, rows) == by_hand(rows)
    assert removed(spark, []) == []


def test_equal_groups():
    first = np.array([1, 1, 2, 1, 1, 2])
    digits = np.array([[5, 1], [5, 2], [5, 1], [5, 1], [6, 1], [7, 7]], dtype=np.uint64)
    rows, group = repeats.equal_groups(digits, first)
    assert rows.tolist() == [0, 3] and len(set(group.tolist())) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=40))
def test_plan_packs_every_token_once(lengths):
    pieces = packing.plan(np.array(lengths, dtype=np.int64))
    by_doc, by_sequence = {}, {}
    for d, start, n, s, offset in pieces:
        by_doc.setdefault(d, []).append((start, n))
        by_sequence.setdefault(s, []).append((offset, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, k in sorted(by_doc[d]):
            assert start == at and k > 0
            at += k
        assert at == n
    for parts in by_sequence.values():
        at = 0
        for offset, k in sorted(parts):
            assert offset == at
            at += k
        assert at == 4096 or at & (at - 1) == 0


def test_packing_balances_cost():
    lengths = np.array([3000] * 8 + [300] * 200)
    cost = {}
    for _, _, n, s, _ in packing.plan(lengths):
        cost[s] = cost.get(s, 0) + n + n * n / 2048
    full = sorted(cost.values())[-14:]
    assert full[-1] < 2.2 * full[0]


def test_packed_ids_are_the_tokenizers(spark):
    texts = ["", None, "Hello,  World's\nend", "á ́b \x01  x", "<|endoftext|> it's 12 ΣΑΣ", "词 语 déjà vu " * 900, "same", "same"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x", 1)], "doc_id long, text string, ids int")
    tok = Tokenizer.from_file(PATH)
    got = {}
    for r in packing.pack(docs, PATH, window=3000).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"]), r["doc_tokens"], r["length"]))
    assert set(got) == {*range(len(texts)), None}
    for i, t in enumerate(texts):
        ids = np.concatenate([np.frombuffer(x[1], "<u4") for x in sorted(got[i])]).tolist()
        assert ids == [*tok.encode(t or "", add_special_tokens=False).ids, 2] and {x[2] for x in got[i]} == {len(ids)} and all(len(x[1]) == 4 * x[3] for x in got[i])
    assert packing.pack(docs.limit(0), PATH).collect() == []


@pytest.mark.parametrize("marked", [True, False])
def test_new_chunks_are_encoded_in_one_call(monkeypatch, marked):
    """As many calls as batches, not one for each chunk, with the ids that each text has alone."""
    encoder = packing.Encoder(PATH)
    plain, calls = encoder.tokenizer, []

    class Counted:
        def encode(self, text, **k):
            calls.append(text)
            return plain.encode(text, **k)

        def encode_batch(self, texts, **k):
            calls.extend(texts)
            return plain.encode_batch(texts, **k)

    monkeypatch.setattr(encoder, "tokenizer", Counted())
    if not marked:
        encoder.mark = None
    for texts in (["one two", "", "İstanbul ÉCHAN!! e\u0301 1999 \u3000 x's", "one"], ["two"], [" "], ["new"], [f"a{encoder.mark or '<|endoftext|>'}b new c", "<|startoftext|> <|ENDOFTEXT|>"]):
        assert [x.tolist() for x in encoder(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    if marked:
        calls.clear()
        encoder([f"fresh{i} word{i}," for i in range(300)])
        assert len(calls) == 1


def test_media_round_trip(spark):
    texts = [None, "", "ñ", "x" * 192, "x" * 193, "word " * 60_000, "same", "same"]
    docs = spark.createDataFrame([(i, t, b"m") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    out = media.load(media.store(docs)).orderBy("doc_id").collect()
    for t, r in zip(texts, out, strict=True):
        raw = (t or "").encode()
        assert r["n_bytes"] == len(raw) and bytes(r["payload"]).startswith(raw) and not bytes(r["payload"])[len(raw) :].strip(b" ") and len(r["payload"]) % 192 == 0 < len(r["payload"])
        assert bytes(r["media"])[:8] == media.SIGNATURE and len(r["feature"]) == 16
    assert out[6]["feature"] == out[7]["feature"] and out[0]["media"] == out[1]["media"]
    assert media.load(media.store(docs.limit(0))).collect() == []


def test_damaged_files_are_null(spark):
    good = media.write_png(b"a" * 192)
    bad = [None, b"", b"text", good[:-5], good[:40] + bytes([good[40] ^ 1]) + good[41:]]
    df = spark.createDataFrame([(i, 1, x) for i, x in enumerate([*bad, good])], "doc_id long, n_bytes long, media binary")
    out = media.load(df).orderBy("doc_id").collect()
    assert [r["payload"] is None and r["feature"] is None for r in out] == [True] * len(bad) + [False]


@pytest.mark.parametrize("kind", range(5))
def test_row_filters_are_undone(kind):
    rng = np.random.default_rng(kind)
    x = rng.integers(0, 256, (6, 12), dtype=np.uint8)
    step, lines = 3, np.zeros((6, 13), np.uint8)
    for r in range(6):
        for i in range(12):
            a, b = int(x[r, i - step]) if i >= step else 0, int(x[r - 1, i]) if r else 0
            c = int(x[r - 1, i - step]) if r and i >= step else 0
            p = a + b - c
            near = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            lines[r, i + 1] = (int(x[r, i]) - (0, a, b, (a + b) // 2, near)[kind]) & 255
        lines[r, 0] = kind
    assert (media.unfilter(lines, step) == x).all()
    head = struct.pack(">IIBBBBB", 4, 6, 8, 2, 0, 0, 0)
    file = media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", zlib.compress(lines.tobytes())) + media._chunk(b"IEND", b"")
    assert (media.read_png(file).reshape(6, 12) == x).all()


def test_written_rows_are_filtered_and_undone():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 256, (40, 192), dtype=np.uint8)
    x[10:20] = np.repeat(rng.integers(0, 256, (10, 3), dtype=np.uint8), 64, axis=0).reshape(10, 192)
    x[20:30] = x[19]
    x[30:] //= 64
    lines = media.filtered(x, 3)
    assert set(lines[:, 0].tolist()) == {0, 1, 2} and (media.unfilter(lines, 3) == x).all()
    assert (media.read_png(media.write_png(x.tobytes())).reshape(40, 192) == x).all()
    lines[3, 0] = 5
    with pytest.raises(ValueError):
        media.unfilter(lines, 3)


def test_registered_media_query_by_hand(spark):
    from conftest import SMALL

    from skillgrid.llm.queries import op10_media

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out = op10_media(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    for r in out:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        file = media.write_png(payload)
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == want
        assert r["feature"] == f"{media.cosine_hash(np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)):016x}"


def test_hash_ignores_small_changes():
    rng = np.random.default_rng(0)
    x = np.kron(rng.integers(0, 200, (8, 8, 3)), np.ones((16, 16, 1))).astype(float)
    y = x + rng.normal(0, 2, x.shape)
    other = np.kron(rng.integers(0, 200, (8, 8, 3)), np.ones((16, 16, 1)))
    assert (media.cosine_hash(x) ^ media.cosine_hash(y)).bit_count() < 6 < 16 < (media.cosine_hash(x) ^ media.cosine_hash(other)).bit_count()
