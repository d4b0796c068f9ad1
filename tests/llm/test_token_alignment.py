"""Cross-tokenizer alignment against the libraries, text by text and link by link."""

import random
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillon.llm import token_alignment as ta
from quillon.llm.pieces import LONGEST

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts):
    a, b = libraries()
    chars, names = ta.byte_characters(), {i: t for t, i in a.get_vocab().items()}
    rows, holds = [], Counter()
    for t in texts:
        ia, ib = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        ba = [bytes(chars[c] for c in names[i]) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not t or b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            rows.append(None)
            continue
        groups, left, right = [], [], []
        na = nb = x = y = 0
        while x < len(ia):
            if na <= nb:
                na, left, x = na + len(ba[x]), [*left, ia[x]], x + 1
            while nb < na:
                nb, right, y = nb + len(bb[y]), [*right, ib[y]], y + 1
            if na == nb:
                groups.append((left, right))
                left, right = [], []
        links = [(p, q) for g, h in groups for p in g for q in h]
        holds.update(set(links))
        rows.append((len(ia), len(ib), groups, links))
    most = defaultdict(int)
    for (p, _), n in holds.items():
        most[p] = max(most[p], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if r is None
        else (r[0], r[1], len(r[2]), len(r[3]), sum(holds[x] == most[x[0]] for x in r[3]), sum(holds[x] for x in r[3]), ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in r[2]))
        for r in rows
    ]


def random_texts(n, seed=4):
    rng = random.Random(seed)
    parts = ["the ", "of", " ", "  ", "\n", "\t", "Zürich", "語", "日本語", "😀", "é", "é", "aaaa", "12", "3.5", "'s", "<|endoftext|>", "<s>", "<0x41>", "\x00", "\xa0", "　", "▁", "tokenization ", "ﬁ", "ß"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(n)]


def aligned(spark, texts, parts=3):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id bigint, text string, part string, pair string").repartition(parts)
    return [tuple(r)[1:] for r in sorted(ta.align(df, A, B).collect(), key=lambda r: r.doc_id)]


def test_every_link(spark, monkeypatch):
    texts = [None, "", " ", "a", "  ", "x▁y", *random_texts(120), "a " * 300, "q" * 2000, *["the same text"] * 5]
    assert aligned(spark, texts) == brute(texts)


def test_small_blocks_give_the_same(monkeypatch):
    texts = [t for t in [*random_texts(40, 7), "q" * 700, "語" * 90 + "q" * 400] if "▁" not in t]
    va, vb = ta.byte_level(A), ta.sentence_pieces(B)

    def tables():
        batch = pa.RecordBatch.from_pydict({"did": list(range(len(texts))), "text": texts})
        rows = pa.concat_batches(list(ta._encode(A, B)(batch)))
        return rows, sorted(zip(*ta.linked_pairs(rows, va, vb)[1].to_pydict().values(), strict=True))

    rows, want = tables()
    monkeypatch.setattr(ta, "MOST_LINKS", 50)
    monkeypatch.setattr(ta, "LARGE_GROUP", 2)
    monkeypatch.setattr(ta, "RUN_BYTES", 200)
    again, got = tables()
    assert got == want and again.to_pydict() == rows.to_pydict()


@pytest.mark.parametrize(("seed", "most"), [(1, 10**6), (2, 150)])
def test_ids_as_the_libraries_give_them(seed, most, monkeypatch):
    monkeypatch.setattr(ta, "MOST_PIECES", most)
    texts = [t for t in random_texts(800, seed) if t] + ["q" * 300, "語" * 200, "q" * 300]
    a, b = libraries()
    for part in (texts[:100], texts[100:150], texts[150:], texts[:300]):
        assert ta.byte_level(A).lists(pa.array(part)).to_pylist() == [e.ids for e in a.encode_batch([" " + t for t in part], add_special_tokens=False)]
        assert ta.sentence_pieces(B).lists(pa.array(part)).to_pylist() == b.encode(part)
        assert all(len(v.keys) < 5000 and max(map(len, v.keys.to_pylist())) <= LONGEST for v in (ta.byte_level(A), ta.sentence_pieces(B)))


def test_no_rows(spark):
    assert aligned(spark, []) == []


def test_rows_that_repeat_and_null_ids(spark):
    rows = [(None, "the cat"), (None, "the cat"), (1, "the cat"), (1, "a dog")]
    got = ta.align(spark.createDataFrame(rows, "doc_id bigint, text string"), A, B).collect()
    assert sorted((r.doc_id or 0, r.count_sum) for r in got if r.groups and r.n_a == 2) == sorted(zip((0, 0, 1, 1), [x[5] for x in brute([t for _, t in rows])], strict=True))
