"""N-gram Jaccard join against all pairs compared one by one."""

import random
import re

import pytest

from quillon.llm import ngram_join as nj


def grams(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                n[i], n[j] = n[i] + 1, n[j] + 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 62), -1 if d is None else d)
    return sorted((-1 if d is None else d, least[find(i)], n[i]) for i, (d, _) in enumerate(rows))


def make(seed, groups=14, most=30):
    rng, rows = random.Random(seed), []
    words = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 5, 8, 40, 120, 300]))]
        for _ in range(rng.randint(1, most)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((rng.randrange(10**6), rng.choice([" ", ", ", "\n"]).join(own).title()))
    return [*rows, (None, rows[0][1]), (5, None), (6, ""), (7, "?!"), rows[-1]]


@pytest.mark.parametrize(("seed", "block"), [(1, 256), (2, 7)])
def test_links_and_classes(spark, monkeypatch, seed, block):
    monkeypatch.setattr(nj, "BLOCK_ROWS", block)
    rows = make(seed)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, rid string")
    got = nj.jaccard_groups(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id, r.n_links) for r in got) == brute(rows)
    kept = nj.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {-1 if r.doc_id is None else r.doc_id for r in kept.collect()} == {c for _, c, _ in brute(rows)}


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert nj.jaccard_groups(docs).collect() == [] and nj.one_of_each(docs).collect() == []


def test_bands_reach_the_recall():
    rows, count = nj.bands(0.8)
    assert rows * count <= 256 and 1 - (1 - 0.8**rows) ** count >= 0.99999


def test_large_overlap_products_match_sets():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 3000, 500).astype(np.uint64)) for _ in range(40)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (nj.overlaps(sets, sets) == np.array(want)).all()
