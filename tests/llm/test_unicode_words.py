"""Words by Unicode: quotes, dashes and spaces beyond ASCII part words, and Chinese text has a word for each character."""

import random

import corpus_pipeline
import pytest
import regex

from quillon.llm import decontaminate as dc
from quillon.llm import unicode_words as uw

CUT = regex.compile(f"{uw.SOLO.pattern[:-1]}|(?:(?!{uw.SOLO.pattern[:-1]})[\\p{{L}}\\p{{M}}\\p{{N}}])+")


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_same_words_same_hashes(block):
    rng = random.Random(2)
    letters = "abZ09éÉß́  　“”’—…。、漢字かカー한국ไทยдЖ٣🙂\n,"
    seen, back = {}, {}
    for _ in range(600):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        words = [w for w in CUT.findall(text.lower()) if regex.match(r"[\p{L}\p{M}\p{N}]", w)]
        got = uw.word_hashes(text, block).tolist()
        assert len(got) == len(words)
        assert all(seen.setdefault(w, h) == h and back.setdefault(h, w) == w for w, h in zip(words, got, strict=True))
    assert uw.word_hashes("café bar")[1] == uw.word_hashes("bar")[0]


def test_items_between_marks(spark):
    short, item = "one two three four five", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    chinese = "数据清洗需要找出测试集中的段落并且删除它们"
    items = spark.createDataFrame([(1, short), (2, item), (3, chinese)], "item_id bigint, text string")
    texts = [f"he said “{short}” aloud", f"yes—{short}—no", short.replace(" ", " "), f"so “{item}” ends", f"前面的文字{chinese}后面的文字", "无关的内容没有任何段落"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id, r.distance) for r in dc.find_items(docs, items).collect()} == {(0, 1, 0), (1, 1, 0), (2, 1, 0), (3, 2, 0), (4, 3, 0)}


def test_chinese_near_copies_in_the_pipeline(spark):
    rng = random.Random(5)
    text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(300))
    other = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(300))
    docs = spark.createDataFrame([(1, text), (2, text[:100] + "们" + text[101:]), (3, other)], "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == {1, 3}
