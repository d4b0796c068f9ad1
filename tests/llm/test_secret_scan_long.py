"""Secret scans of long texts: time grows with the length, rows that repeat, and the parser of rules."""

import re
import time

import pyarrow as pa
import pytest

from quillon.llm import automaton as am
from quillon.llm import secret_scan as ss


def lines(n):
    return "".join(f"{i:064x}  token=abcdefgh{i}é\n" for i in range(n))


def test_a_text_of_matches_on_every_line():
    scanner = ss.build()
    ss.scan_batch(scanner, pa.array(["warm AKIA" + "Z" * 12]))
    text = lines(100_000)
    start = time.time()
    spans = ss.scan_batch(scanner, pa.array([text]))[0]
    assert time.time() - start < 15 and len(spans) == 200_000
    assert all(text[s:e].startswith("token=" if k == "assign" else "0") for k, s, e in spans[:: 997])


@pytest.mark.parametrize("text", ["eyJ" * 200_000, "a=" * 300_000 + "token=" + "b" * 300_000, "-----BEGIN " * 60_000, "token" + " " * 500_000, "AKIA" * 150_000])
def test_one_long_line(text):
    scanner = ss.build()
    text += " AKIA" + "Q" * 12
    start = time.time()
    spans = ss.scan_batch(scanner, pa.array(["", None, text]))[2]
    assert time.time() - start < 15
    assert spans[-1] == ("access", len(text) - 16, len(text))


def test_rows_that_repeat(spark):
    docs = spark.createDataFrame([(1, lines(3)), (1, lines(3)), (None, lines(3))], "doc_id bigint, text string")
    got = ss.scan_secrets(docs).collect()
    assert len(got) == 3 and got[0].spans == got[1].spans == got[2].spans and len(got[0].spans) == 6


@pytest.mark.parametrize("bad", ["a(b", "a)", "[a", "*a", r"\d", "^a", "é"])
def test_rules_that_no_automaton_has(bad):
    with pytest.raises(ValueError):
        am.compile_rules([(bad, False)], False)


@pytest.mark.parametrize("pattern", [r"[^a\x62]+c", "a{2}(b|c){1,2}", r"\.[a\-]b?", "(?:ab)*c"])
def test_patterns_and_beginnings(pattern):
    import random

    import numpy as np

    rng, rule = random.Random(5), re.compile(pattern)
    full, marks = am.compile_rules([(pattern, False)], False), am.compile_rules([(pattern, False)], False, marks=True)
    for few in (0, 99):
        texts = ["".join(rng.choice("aabbcc.-d") for _ in range(rng.randrange(14))) for _ in range(few + 20)]
        data, stops = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([len(t) for t in texts])
        heads = stops - [len(t) for t in texts]
        want = [h + i for h, t in zip(heads, texts) for i in range(len(t)) if rule.match(t, i) and rule.match(t, i).end() > i]
        assert am.beginnings(marks, data, heads, stops).tolist() == want
        for t in texts:
            ends = [e for e in range(1, len(t) + 1) if rule.fullmatch(t, 0, e)]
            assert am.longest(full, t.encode(), 0, len(t)) == (max(ends) if ends else -1)
