"""Substring dedup against every window, at all prefix lengths; parts, words and trees by themselves."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import substring_dedup as sd
from quillon.llm.parts import numbered

SCHEMA = "doc_id bigint, text string, part string, did string"


def brute(rows, window):
    low = lambda d: sd.NO_ID if d is None else d
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, low(d)), low(d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < low(d) for k in range(i, i + window)}
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def removed(spark, rows, **how):
    got = sd.remove_repeats(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3), **how).collect()
    for r in got:
        assert sum(b - a for a, b in zip(r.starts, r.ends, strict=True)) == r.n_removed
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str)


def corpus(seed):
    rng = random.Random(seed)
    few = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    many = lambda n: "".join(rng.choice(["Ünï", "x", "yy", "zq", "語", "w v"]) + str(rng.randrange(9)) + rng.choice([" ", "\n", "\t ", "\x0b"]) for _ in range(n))
    passage, line = many(30), few(8)
    rows = [(i, many(rng.randrange(40)) + (passage if rng.random() < 0.4 else "") + many(rng.randrange(10)) + (line if i % 2 else "")) for i in range(40)]
    rows += [(100 + i, few(rng.randrange(60))) for i in range(30)]
    rows += [(i + 200, rows[i][1]) for i in range(5)] + [(7, rows[8][1]), (8, rows[8][1]), (None, rows[3][1]), (None, passage), (300, None), (301, ""), (302, " \n\t"), (303, "a " * 400), (304, "a " * 13), (305, "  " * 20)]
    return rows


@pytest.mark.parametrize(("window", "gram", "group_rows", "forest_rows"), [(13, 5, 20_000, 50_000), (13, 5, 3, 7), (6, 2, 10, 1), (4, 4, 2, 100), (3, 1, 10**6, 5)])
def test_every_window(spark, window, gram, group_rows, forest_rows):
    rows = corpus(window)
    assert removed(spark, rows, window=window, gram=gram, group_rows=group_rows, forest_rows=forest_rows) == brute(rows, window)


def test_no_rows(spark):
    assert removed(spark, []) == []


def test_long_texts_and_words(monkeypatch):
    texts = [" ".join(f"w{k % 700}é" for k in range(3000)), "x" * 5000 + " y", "", "z"]
    whole = sd.word_hashes(pa.array(texts))
    monkeypatch.setattr(sd, "BLOCK_BYTES", 1000)
    short = sd.word_hashes(pa.array(texts))
    assert whole[1].tolist() == short[1].tolist() == [3000, 2, 0, 1]
    same = whole[0] == short[0]
    assert same[:3000].all() and same[3001:].all() and len(np.unique(whole[0][:3000])) == 700  # a word beyond the block has a hash of its own kind


def test_least_places():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 4, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 9):
        assert sd.least_places(values, width).tolist() == [i + int(np.argmin(values[i : i + width])) for i in range(200 - width + 1)]


def test_parts_are_bounded(spark):
    rows = [(i, "x" * (i % 7) * 100) for i in range(200)]
    df = spark.createDataFrame(rows, "did bigint, text string").repartition(4)
    got = df.mapInArrow(numbered(lambda b: iter([b]), part_bytes=1000), "part bigint, did bigint, text string").collect()
    assert sorted((r.did, r.text) for r in got) == sorted(rows)
    sizes, counts = {}, {}
    for r in got:
        sizes[r.part], counts[r.part] = sizes.get(r.part, 0) + len(r.text), counts.get(r.part, 0) + 1
    assert all(s <= 1000 or counts[p] == 1 for p, s in sizes.items()) and len(sizes) > 20
