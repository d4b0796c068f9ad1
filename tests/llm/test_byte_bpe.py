"""Byte-level BPE: ids as tiktoken gives them and an exact round trip."""

import random

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["Hello, WORLD!", None, "", " ", "\n\n", "  a  b\n\n c\t", "É Σ  ΑΣ  á ŸÃ ﬁ <|endoftext|>x", "it's I'LL don't 'Tis 12345 !! \x1c x", "ab" * 300, "word " * 3000, "日本語 テキスト 🙂🙂", "Hello, WORLD!"]


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})


def test_matches_library_and_round_trips(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (0, "Hello", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = byte_bpe.decode(byte_bpe.encode(docs, PATH), PATH).collect()
    enc = library()
    want = sorted(((d is None, d or 0, t or "", enc.encode_ordinary(t or "")) for d, t, _ in rows), key=str)
    assert sorted(((r.doc_id is None, r.doc_id or 0, bytes(r.body).decode(), list(np.frombuffer(r.ids, "<u4"))) for r in got), key=str) == want


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert byte_bpe.decode(byte_bpe.encode(docs, PATH), PATH).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab Z9'st.,\n\té あ-"), max_size=40), min_size=1, max_size=6))
def test_any_text(texts):
    import pyarrow as pa

    codec, enc = byte_bpe._codec(PATH, public_tokenizers.PATTERN), library()
    got = codec.encode_run(pa.array(texts))
    assert [list(x) for x in got] == [enc.encode_ordinary(t) for t in texts]
    assert codec.decode_run(got) == [t.encode() for t in texts]


def test_long_words_and_every_byte(spark):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(3000)), "é" * 1200, "a" * 2500, "".join(map(chr, range(1, 0x250))), "\x00\x00 \x00a", "".join(chr(rng.randrange(0x110000 - 0x800) % 0xD800) for _ in range(500)), "  \n\n  x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs, PATH).collect()}
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == enc.encode_ordinary(t) and bytes(got[i].body) == t.encode()
