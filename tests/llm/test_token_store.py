"""Token store: ids as the tokenizers library gives them, exact offsets, and the perfect hash index."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillon.llm import token_store as ts

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, WORLD!", None, "", " ", "\n\n", "  a  b\n\n c\t", "É Σ ΑΣ á ŸÃ ﬁ <|endoftext|>x", "it's I'LL don't 'Tis 12345 !!", "x" * 5000, "word " * 3000, "a b c", "Hello, WORLD!", "'s't '", "J̌Ǎ"]


def brute(rows):
    tok, out, start = Tokenizer.from_file(PATH), [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def result(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, ids int")
    manifest = ts.write_token_shards(docs, PATH)
    got = ts.read_token_shards(docs.select("doc_id"), manifest).collect()
    return sorted(((r.doc_id, r.start, len(r.ids) // 4, zlib.crc32(r.ids)) for r in got), key=lambda r: r[1])


@pytest.mark.parametrize("rows", [[(i * 7 - 20, t) for i, t in enumerate(TEXTS)], [(1, "b"), (1, "a"), (1, "a"), (None, "x y"), (None, None), (3, "c")], []])
def test_matches_library(spark, rows):
    assert result(spark, rows) == brute(rows)


def test_index_finds_its_keys_and_no_others():
    keys = np.sort(np.concatenate([np.arange(-500, 40_000) * 13, [13, 13]]))
    index = ts.ShardIndex.from_bytes(ts.ShardIndex.build(keys, np.full(len(keys), 2)).to_bytes())
    first, many = index.find(keys)
    assert (keys[first] == keys).all() and many.max() == 3
    slots = index.mph.slots(np.unique(keys).view(np.uint64))
    assert sorted(slots) == list(range(len(slots)))
    assert (index.find(keys + 1)[0] == -1).mean() > 0.999
