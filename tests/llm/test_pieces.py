"""Cutting next to characters beyond ASCII: ids as the libraries give them for the whole text."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from quillon.llm import byte_bpe, token_store
from quillon.llm.pieces import LONGEST, PieceTable, split_pieces

BPE, WORD = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
#: White space of one to three bytes, letters of two to four, marks that compose, and letters whose lower case is special.
PARTS = [" ", "\n", "\t ", "\x85", "\xa0", " ", " ", " ", " ", " ", "　", "\x1c", "é", "Ñ", "Σ", "ΑΣ", "İ", "H", "I", "a", "̱", "̇", "ß", "語", "가", "😀", "𝔘", "—", "“", "·", "٣", "½", "'s", "'", "9", "."]


def random_texts(n):
    rng = random.Random(5)
    return ["", " ", "é", " é", "é ", "　 a", "😀 "] + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_both_ways_of_encoding():
    texts = random_texts(4000)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(BPE), special_tokens={})
    got = byte_bpe._codec(BPE, public_tokenizers.PATTERN).encode_run(pa.array(texts))
    assert [list(x) for x in got] == [enc.encode_ordinary(t) for t in texts]
    whole, ids = Tokenizer.from_file(WORD), []
    for run, lens in token_store.encode_texts(pa.array(texts), WORD, 2):
        ids += [list(x) for x in map(lambda e, n: run[e - n : e], lens.cumsum(), lens)]
    assert ids == [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_where_texts_are_cut():
    def cut(text):
        which, pieces, counts = split_pieces(pa.array([text]), fold=False)
        assert counts.tolist() == [len(which)] and "".join(pieces[k] for k in which) == text
        return [pieces[k] for k in which]

    assert cut("été né, 語 😀 x") == ["été", " né,", " 語", " 😀", " x"]
    assert cut("a\xa0 b") == ["a\xa0 b"] and cut("　 b \n") == ["　 b \n"]


def one_id_a_character(pieces):
    lens = np.array([len(p) for p in pieces], np.int64)
    return np.array([ord(c) for p in pieces for c in p], np.int64), lens


def test_slots_give_the_ids_of_every_piece():
    rng = random.Random(3)
    table = PieceTable(one_id_a_character, np.uint32, most=40, most_bytes=2000)
    for _ in range(200):
        pieces = list({"".join(rng.choice("ab語") for _ in range(rng.choice([0, 1, 3, 8, LONGEST, LONGEST + 1, 500]))) for _ in range(rng.randrange(12))})
        ids, lens = table.gather(table.slots(pieces))
        assert "".join(map(chr, ids)) == "".join(pieces) and lens.tolist() == list(map(len, pieces))
        assert len(table.at) <= 40 + 12 and all(len(p) <= LONGEST for p in table.at)


def test_unspaced_texts_do_not_fill_the_table():
    table, rng = PieceTable(one_id_a_character, np.uint32, most_bytes=4_000_000), np.random.default_rng(5)
    for _ in range(100):  # 10,000 texts of 600 characters, no two alike, and as many pieces of 100: 28 MB
        block = rng.integers(0x4E00, 0x9F00, 60_000).astype(np.uint32).tobytes().decode("utf-32-le")
        texts = [block[k : k + 600] for k in range(0, 60_000, 600)] + [block[k : k + 100] for k in range(0, 10_000, 100)]
        table.gather(table.slots(texts))
        assert table.bytes <= 4_000_000 and table.ids.nbytes < 8_000_000 and sum(map(len, table.at)) <= 1_000_000
