"""Language ID's parts against plain versions, and rows and columns that need care."""

import math
import random
from collections import Counter

import numpy as np

from quillon.llm import language_id as lid


def test_vectors_against_counting():
    rng = random.Random(1)
    idf = np.random.default_rng(1).random(2**10) + 1
    for text in ["a", "ab", "Łódź, naïve Über", "x" * 5000, "".join(rng.choice("abc ä") for _ in range(400))]:
        # every n-gram's slot, asked for one at a time: the slots of its characters less those of shorter ones
        slots, n = lid.counts(text, 10)
        assert n.sum() == sum(max(0, len(text) - k) for k in range(3))
        assert Counter(dict(zip(slots.tolist(), n.tolist()))) == plain_counts(text, 10)
        at, values = lid.vector(text, 10, idf)
        want = {s: (1 + math.log(c)) * idf[s] for s, c in plain_counts(text, 10).items()}
        norm = math.sqrt(sum(v * v for v in want.values()))
        assert at.tolist() == sorted(want) and np.allclose(values, [want[s] / norm for s in sorted(want)])


def plain_counts(text, bits):
    out, low = Counter(), 0xFFFFFFFF
    c = [ord(x) for x in text.lower()]
    for i in range(len(c)):
        h = c[i] * 0x9E3779B1 & low
        out[h >> (32 - bits)] += 1
        for k in (1, 2):
            if i + k < len(c):
                h = ((h ^ h >> 15) * 0x85EBCA6B + c[i + k] * 0xC2B2AE35) & low
                out[((h ^ h >> 13) * 0x27D4EB2F & low) >> (32 - bits)] += 1
    return Counter({k: v for k, v in out.items() if v})


def plain_ftrl(rows, slots, classes, epochs, alpha, beta, l1, l2):
    z, n = [[0.0] * classes for _ in range(slots + 1)], [[0.0] * classes for _ in range(slots + 1)]

    def weight(i, k):
        penalty = l1 if i < slots else 0.0
        if abs(z[i][k]) <= penalty:
            return 0.0
        return -(z[i][k] - math.copysign(penalty, z[i][k])) / ((beta + math.sqrt(n[i][k])) / alpha + l2)

    for _ in range(epochs):
        for at, values, label in rows:
            xs = [*zip(at, values), (slots, 1.0)]
            w = {(i, k): weight(i, k) for i, _ in xs for k in range(classes)}
            e = [math.exp(sum(x * w[i, k] for i, x in xs)) for k in range(classes)]
            for i, x in xs:
                for k in range(classes):
                    g = x * (e[k] / sum(e) - (k == label))
                    z[i][k] += g - (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / alpha * w[i, k]
                    n[i][k] += g * g
    return np.array([[weight(i, k) for k in range(classes)] for i in range(slots + 1)])


def test_ftrl_against_a_plain_version():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(60):
        at = np.sort(rng.choice(12, 4, replace=False))
        rows.append((at, rng.random(4), int(at.sum() % 3)))
    for l1, l2 in [(0.0, 0.0), (0.02, 0.001), (0.6, 0.5)]:
        w, b = lid.ftrl(rows, 12, 3, epochs=3, l1=l1, l2=l2)
        want = plain_ftrl(rows, 12, 3, 3, 0.5, 1.0, l1, l2)
        assert np.allclose(w, want[:-1], atol=1e-9) and np.allclose(b, want[-1], atol=1e-9)
    assert (w == 0).any()  # the penalty makes it sparse


def test_temperature_against_a_grid():
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 3, 400)
    logits = 4 * (np.eye(3)[np.where(rng.random(400) < 0.8, labels, (labels + 1) % 3)])
    grid = np.exp(np.linspace(math.log(0.05), math.log(15), 4000))
    loss = [-np.log(lid.softmax(logits / t)[np.arange(400), labels]).mean() for t in grid]
    assert abs(math.log(lid.fit_temperature(logits, labels)) - math.log(grid[int(np.argmin(loss))])) < 0.01
    assert lid.fit_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def model():
    idf, w = np.ones(2**8), np.zeros((2**8, 2), np.float32)
    return lid.Model(["aa", "bb"], idf, w, np.zeros(2), 8, letters=np.array([ord(c) for c in "abc"], np.uint32))


def test_ties_repeats_long_texts_and_clashing_columns(spark):
    rows = [(1, "abc", "x", 0.5, 7), (1, "abc", "x", 0.5, 7), (2, "cab " * 300_000, "y", 0.1, 8), (3, "жжж abc", "z", 0.2, 9), (4, None, "n", 0.3, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, Lang_Pred string, score double, guess_of_text int")
    out = lid.predict(docs, model())
    assert out.columns == [*docs.columns, "lang_pred_", "score_"]
    got = sorted(out.collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.Lang_Pred, r.score, r.guess_of_text) for r in got] == [(r[0], *r[2:]) for r in rows]
    assert [(r.lang_pred_, r.score_) for r in got] == [("aa", 0.5)] * 4 + [("und", 0.0)]
    kept = lid.recognised(docs, model(), 0.0, 0.6)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 2]


def test_sample_is_bounded_in_entries(spark):
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuv"]
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(words) for _ in range(200)), "xy"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    whole, small = lid.train(docs, bits=10, max_rows=200), lid.train(docs, bits=10, max_rows=200, max_entries=20_000)
    assert whole.report["sampled"] == 200 and 10 <= small.report["sampled"] < 100
