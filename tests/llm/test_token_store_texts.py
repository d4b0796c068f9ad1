"""Token shards: texts of every kind against the library, texts above a slice, other vocabularies."""

import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import pieces
from quillon.llm import token_store as ts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = st.sampled_from(["don't", "I'LL", "<|endoftext|>", "<|", "'", "’s", "été", "É", "naïve ", " ", " ", "İ", "ǅ", "東京", "12", "a1b2", "--", "\x00", "\t\n", "ﬁ", "K", "😀", "the ", "The", "."])


def got(texts, path=PATH):
    out = []
    for ids, n in ts.encode_texts(pa.array(texts, pa.string()), path, 2):
        out += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.lists(PARTS, max_size=12).map("".join)), min_size=1, max_size=8))
def test_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert got(texts) == [[*LIBRARY.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_texts_above_a_slice(monkeypatch):
    monkeypatch.setattr(pieces.slices, "__defaults__", (1000,))
    texts = ["word " * 5000, "", None, "x" * 3000, "a b"]
    assert got(texts) == [[*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_a_vocabulary_with_other_rules_and_wide_ids(spark, tmp_path):
    own = json.loads(LIBRARY.to_str())
    own["normalizer"] = None
    shift = 70_000
    own["model"]["vocab"] = {k: v + shift for k, v in own["model"]["vocab"].items()}
    for t in own["added_tokens"]:
        t["id"] = own["model"]["vocab"].get(t["content"], t["id"])
    path = str(tmp_path / "own.json")
    with open(path, "w") as out:
        json.dump(own, out)
    library = Tokenizer.from_file(path)
    texts = ["Hello  World", "don't\tStop", "", "A" * 50]
    assert ts._about(path) == (False, 4) and ts._about(PATH) == (True, 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = ts.read_token_shards(docs.select("doc_id"), ts.write_token_shards(docs, path)).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}


@pytest.mark.parametrize("width", [2, 4])
def test_index_round_trip(width):
    keys = np.arange(0, 999, 3, dtype=np.int64)
    index = ts.ShardIndex.from_bytes(ts.ShardIndex.build(keys, np.ones(len(keys), int), width).to_bytes())
    first, many = index.find(keys)
    assert index.width == width and (first == np.arange(len(keys))).all() and (many == 1).all()
