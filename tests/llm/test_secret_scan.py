"""Secret scans against Python's own regexes, and the automaton's parts."""

import random
import re

import numpy as np
import pytest

from quillon.llm import automaton as am
from quillon.llm import secret_scan as ss

PLAIN = {"assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def brute(text):
    out = []
    for n, (kind, rule) in enumerate(PLAIN.items()):
        for m in rule.finditer(text or ""):
            if {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}[kind](m):
                out.append((m.start(), n, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_base_spans(spark):
    rng = random.Random(1)
    parts = ["password", "token", "api_key", "APIKEY", "secret", "=", ":", " ", "'", '"', "abc12345", "ab", "AKIA", "ABCD1234EFGH", "0123456789abcdef", "é", "\n", ",", "deadbeef" * 4, "==", "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 20]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)] + [None, "", "token=" + "a" * 50_000, "-----BEGIN RSA PRIVATE KEY-----"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "AKIA" + "Z" * 12, "x")], "doc_id bigint, text string, spans string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in ss.scan_secrets(docs).collect()}
    assert all([s for s in got[i] if s[0] in ss.BASE] == brute(t) for i, t in enumerate(texts))
    assert got[None] == [("access", 0, 16)] and [s[0] for s in got[len(texts) - 1]] == ["pem"] and any(s[0] == "jwt" for spans in got.values() for s in spans)
    assert ss.scan_secrets(docs.where("false")).collect() == []


@pytest.mark.parametrize("pattern", ["a(b|cd)*e", "[a-c]{2,3}d?", "x+y{2,}", "(ab|a)(bc|c)"])
def test_automaton_agrees_with_regexes(pattern):
    rng = random.Random(2)
    a, search, rule = am.compile_rules([(pattern, False)], False), am.compile_rules([(pattern, False)], True), re.compile(pattern)
    texts = ["".join(rng.choice("abcdexy") for _ in range(rng.randrange(12))) for _ in range(300)]
    for t in texts:
        ends = [e for e in range(1, len(t) + 1) if rule.fullmatch(t, 0, e)]
        assert am.longest(a, t.encode(), 0, len(t)) == (max(ends) if ends else -1)
    data = "".join(texts).encode()
    stops = np.cumsum([len(t) for t in texts])
    hit = am.scan(search, np.frombuffer(data, np.uint8), stops - [len(t) for t in texts], stops)
    assert [bool(h) for h in hit] == [rule.search(t) is not None for t in texts]


def test_minimal():
    assert am.compile_rules([("a|b|c", False)], False).states == 3
