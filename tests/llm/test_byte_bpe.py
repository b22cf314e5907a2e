"""Operator 12 against the tiktoken library and exact round trips."""

import hashlib
import itertools

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from featsieve.llm import byte_bpe, tokens

RANKS = byte_bpe.read_ranks(byte_bpe.default_ranks())
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
DEFINITION = byte_bpe.definition(RANKS, public_tokenizers.PATTERN)
ENCODER, TABLE = tokens.Encoder(DEFINITION), byte_bpe.ByteTable(DEFINITION)
TEXTS = st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r.,'!&$|-0aZéſßğ's漢\U0001f600"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_ids_are_those_of_tiktoken(texts):
    ids, counts = ENCODER.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [PLAIN.encode_ordinary(t) for t in texts]
    assert TABLE.decode(ids)[0].tobytes() == "".join(texts).encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"ab", b"ba", b"aa", b"aab", b"abb", b"aba", b"bab", b"aaa", b"aaaa", b"abab"]), unique=True), st.text("ab", max_size=14))
def test_one_merge_a_token_does_what_ranks_ask_for(extra, text):
    """Any order of ranks, also of tokens that can be joined in several ways or not at all."""
    order = [b"a", b"b", *[t for t in extra if len(t) > 1]]
    ranks = {t: i for i, t in enumerate(order)} | {bytes([i]): len(order) + i for i in range(256) if bytes([i]) not in order}
    want = tiktoken.Encoding("any", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
    assert Tokenizer.from_str(byte_bpe.definition(ranks, r"\S+")).encode(text).ids == want


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_offsets_are_the_touched_characters(text):
    ids, _ = ENCODER.encode([text])
    data, sizes = TABLE.decode(ids)
    starts, ends = byte_bpe.character_offsets(data, sizes)
    owner = [i for i, c in enumerate(text) for _ in c.encode()]  # the character of every byte
    at = 0
    for n, a, b in zip(sizes.tolist(), starts.tolist(), ends.tolist()):
        assert (a, b) == (owner[at], owner[at + n - 1] + 1)
        at += n
    assert at == len(owner)


def test_split_characters_wait_for_their_end():
    text = "x\U0001f9ff漢͸ğ"
    pieces = [PLAIN.decode_single_token_bytes(i) for i in PLAIN.encode_ordinary(text)]
    shown = byte_bpe.whole_characters(pieces)
    assert len(shown) == len(pieces) and "".join(shown) == text and "" in shown
    assert byte_bpe.whole_characters([b"a\xf0\x9f"]) == ["a�"] and byte_bpe.whole_characters([]) == []


def test_byte_characters_are_a_reversible_table():
    shown = byte_bpe.byte_characters()
    assert len(set(shown)) == 256 and all(len(c) == 1 and c.isprintable() for c in shown) and shown[32] == "Ġ" and shown[65] == "A"


def test_rows_round_trip(odd, rows):
    coded = byte_bpe.encode_texts(odd)
    got = byte_bpe.decode_ids(coded, as_text=True).collect()
    by_row = lambda x: (x[0] is not None, x[0] or 0, x[1])
    want = sorted(((r[0], r[1] or "") for r in rows), key=by_row)
    assert sorted(((r.doc_id, r.text) for r in got), key=by_row) == want
    for r in got:
        assert bytes(r.decoded) == r.text.encode() and r.n_tokens == len(r.ids) // 4
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == PLAIN.encode_ordinary(r.text)
        starts, ends = np.frombuffer(r.starts, "<u4").tolist(), np.frombuffer(r.ends, "<u4").tolist()
        owner = [i for i, c in enumerate(r.text) for _ in c.encode()]
        at = list(itertools.accumulate((len(PLAIN.decode_single_token_bytes(i)) for i in ids), initial=0))
        assert starts == [owner[a] for a in at[:-1]] and ends == [owner[b - 1] + 1 for b in at[1:]]


def test_no_rows_and_other_columns(spark, empty):
    assert byte_bpe.encode_texts(empty).count() == 0 and byte_bpe.decode_ids(byte_bpe.encode_texts(empty)).count() == 0
    coded = spark.createDataFrame([(1, bytearray(np.asarray([7, 9], "<u4").tobytes()), "a"), (2, None, "b")], "`a.b` int, IDS binary, Text string")
    found = byte_bpe.decode_ids(coded)
    assert found.columns == ["a.b", "IDS", "Text", "decoded"]
    assert sorted((r[0], bytes(r.decoded)) for r in found.collect()) == [(1, PLAIN.decode_bytes([7, 9])), (2, b"")]
    with pytest.raises(ValueError):
        TABLE.decode(np.asarray([50_300], np.uint32))


def test_query_digests(spark, data):
    from featsieve.llm import QUERIES

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = QUERIES["op12_byte_bpe"](spark, data).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = PLAIN.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
