"""Operators 3 and 10 against the tokenizers library and exact round trips."""

import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from featsieve.llm import addressable_codes as codes, packing, tokens
from featsieve.llm.common import new_path

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)
LIBRARY.encode_special_tokens = True


def plain(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r.,'!&$|-0aZéſßğ's"), st.characters(codec="utf-8")), max_size=60), max_size=4))
def test_memo_gives_the_library_ids(texts):
    ids, counts = ENCODER.encode(texts)
    assert np.split(ids, np.cumsum(counts))[:-1] == [] if not texts else [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain(t) for t in texts]


ENCODER = tokens.Encoder(open(FILE, encoding="utf-8").read())


def test_memo_reset_keeps_ids(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_UNITS", 3)
    own = tokens.Encoder(open(FILE, encoding="utf-8").read())
    for text in ("one two three four five", "six one seven", "one"):
        assert own.encode([text])[0].tolist() == plain(text)


def test_encoder_memory_is_bounded():
    size, own = 1_000_000, tokens.Encoder(open(FILE, encoding="utf-8").read(), 60_000)
    blocks = [" ".join(f"word{i % 5000} x{k} {i * 7919 % 99991:05x}" for i in range(size // 16))[:size] for k in range(3)]
    tracemalloc.start()
    try:
        tokens.unit_starts(np.frombuffer(blocks[0].encode(), np.uint8), np.array([0, size]))
        assert tracemalloc.get_traced_memory()[1] < 18 * size  # was 22: one array had eight bytes a place
        for block in blocks:
            tracemalloc.reset_peak()
            own.encode([block])
            assert tracemalloc.get_traced_memory()[1] < 20 * size  # was 26
    finally:
        tracemalloc.stop()


def test_forgetting_keeps_the_most_used():
    own = tokens.Encoder(open(FILE, encoding="utf-8").read(), 6)
    own.encode(["often often often twice twice once"])
    own.encode([" a b c d e f g"])
    own._forget_rare()
    assert set(own.memo) == {b" often", b" twice"}
    for text in ("often twice once", " often g twice a once" + "z" * 100, " twice often"):
        assert own.encode([text])[0].tolist() == plain(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_codes_round_trip_and_random_access(values):
    ids = np.asarray(values, np.uint32)
    levels = codes.encode_ids(ids)
    assert codes.decode_ids(levels, len(ids)).tolist() == values
    if values:
        at = np.random.default_rng(0).integers(0, len(ids), 50)
        assert codes.ids_at(levels, at).tolist() == ids[at].tolist()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_files_hold_all_ids_in_order(spark, odd, rows):
    path = new_path(spark, "codes")
    codes.write_codes(odd, path, segment_tokens=50)
    got = codes.read_documents(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [r[0] for r in in_order(rows)]
    stream, by_id = [], {}
    for r in rows:
        by_id[r[0]] = plain(r[1]) + [0]
    for r in got:
        assert r.start == len(stream) and r.n_tokens == len(by_id[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == by_id[r.doc_id]
        stream += by_id[r.doc_id]
    places = [0, 1, 17, len(stream) // 2, len(stream) - 1]
    asked = spark.createDataFrame([(p,) for p in [*places, len(stream), -1]], "position long")
    assert {r.position: r.id for r in codes.tokens_at(spark, path, asked).collect()} == {p: stream[p] for p in places}


def test_codes_of_no_rows(spark, empty):
    path = new_path(spark, "codes")
    codes.write_codes(empty, path)
    assert codes.read_documents(spark, path).count() == 0


def check_packing(rows, pieces, capacity):
    want = sorted(tuple(plain(r[1]) + [1]) for r in rows)
    parts, places = {}, {}
    for p in pieces:
        assert p.length == len(p.ids) // 4 > 0
        parts.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(p.length for p in pieces) == sum(map(len, want))
    return places


@pytest.mark.parametrize("capacity,shard_bytes", [(2048, 8_000_000), (64, 3_000)])
def test_every_id_is_packed_once(odd, rows, capacity, shard_bytes):
    pieces = packing.pack_documents(odd, capacity=capacity, shard_bytes=shard_bytes).collect()
    places = check_packing(rows, pieces, capacity)
    for r in {r[0]: r for r in rows if r[0] != 7}.values():
        own = sorted((p.start, bytes(p.ids)) for p in pieces if p.doc_id == r[0])
        assert np.frombuffer(b"".join(x for _, x in own), "<u4").tolist() == plain(r[1]) + [1]
        assert [s for s, _ in own] == np.cumsum([0, *[len(x) // 4 for _, x in own]])[:-1].tolist()
    shards = {s >> 32 for s in places}
    padding = sum(capacity - sum(n for _, n in own) for own in places.values())
    assert padding < capacity * len(shards)


def test_packing_does_not_depend_on_layout(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 3)
    texts = [(i, "word " * (i * 7 % 300)) for i in range(150)] + [(5, "the same row again")] * 20 + [(None, "nobody's row")] * 9 + [(6, None)] * 5
    found = []
    for parts in (1, 7):
        docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)
        pieces = packing.pack_documents(docs, capacity=64, shard_bytes=2_000)
        found.append(sorted((p.doc_id is None, p.doc_id or 0, p.start, p.length, p.sequence_id, p.offset, bytes(p.ids)) for p in pieces.collect()))
    assert found[0] == found[1] and len({p[4] >> 32 for p in found[0] if p[1] == 5}) > 3
    want = sorted((d is None, d or 0, *plain(t), 1) for d, t in texts)
    assert sum(p[3] for p in found[0]) == sum(len(w) - 2 for w in want)


def test_packing_of_no_rows(empty):
    assert packing.pack_documents(empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_assignment_balances_cost(lengths):
    sizes = np.asarray(lengths)
    placed = packing.assign(sizes, 64)
    used = {}
    for piece, first, n, sequence, offset in placed:
        assert offset == used.get(sequence, 0) and n > 0
        used[sequence] = offset + n
    assert max(used.values()) <= 64 and len(used) <= -(-int(sizes.sum()) // 64)
    whole = np.zeros(len(sizes), int)
    for piece, first, n, *_ in placed:
        whole[piece] += n
    assert whole.tolist() == lengths


def test_largest_cost_goes_first_to_the_cheapest():
    placed = packing.assign(np.asarray([10, 30, 20, 40]), 64)
    assert [p[0] for p in placed][:3] == [3, 1, 2]
    assert placed[0][3] != placed[1][3] and placed[2][3] == placed[1][3]


def test_checksums_are_those_of_zlib(odd, rows):
    text = {r[0]: plain(r[1]) + [1] for r in rows}
    for p in packing.packing_rows(odd).filter(F.col("doc_id") != 7).collect():
        ids = np.asarray(text[p.doc_id][p.start : p.start + p.length], "<u4")
        assert p.ids_crc32 == zlib.crc32(ids.tobytes())
