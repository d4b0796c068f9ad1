"""Decontamination: recall on fresh passages of every size class, unedited passages, several blocks, odd rows."""

import random

import pytest

from quillon.llm import decontaminate as dc

from .test_decontaminate_whole import edited, say


@pytest.mark.parametrize("cap", [None, 2])
def test_fresh_passages_of_every_class(monkeypatch, cap):
    if cap:
        monkeypatch.setattr(dc, "MOST_TABLES", cap)
    rng = random.Random(13)
    sizes = (12, 25, 50, 100, 200, 400, 800)
    items = [say(n + k % 3, rng) for n in sizes for k in range(12)]
    index = dc.Index([(k, " ".join(i)) for k, i in enumerate(items)], 0.1, 0.95)
    assert len(index.recalls) == len(sizes) and min(index.recalls.values()) >= 0.95
    for c in range(len(sizes)):
        own = [c * 12 + j % 12 for j in range(48)]
        texts = [" ".join([*say(30, rng), *edited(items[k], len(items[k]) // 10, rng), *say(30, rng)]) for k in own]
        hits = {(row, k) for row, k, *_ in index.find(texts)}
        assert sum((row, k) in hits for row, k in enumerate(own)) >= 0.88 * len(own), sizes[c]  # 0.95 less three deviations of 48 trials
        whole = [" ".join([*say(j, rng), *items[k], *say(9, rng)]) for j, k in enumerate(own)]
        exact = {(row, k) for row, k, distance, _ in index.find(whole) if distance == 0}
        assert all((row, k) in exact for row, k in enumerate(own)), sizes[c]


def test_walks_that_outrun_an_item_leave_it_seeds():
    rng = random.Random(2)
    items = [say(n, rng) for n in (10, 10, 11, 12, 13, 19)]
    index = dc.Index([(k, " ".join(i)) for k, i in enumerate(items)], 0.1, 0.95)
    placed = {(int(k), int(o)) for t in index.tables for k, o in t.owners}
    seeded = {k for rows in index.seeds.values() for _, k, _ in rows}
    assert all(k in seeded or all((k, o) in placed for o in range(dc.STRIDE)) for k in range(len(items)))


def test_blocks_repeats_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 3)
    rng = random.Random(5)
    items = [say(n, rng) for n in (5, 12, 20, 33, 60, 90, 180)]
    rows = [(k, " ".join(i)) for k, i in enumerate(items)] + [(None, " ".join(items[2])), (2, " ".join(items[2])), (50, None), (51, "")]
    docs = [(d, " ".join([*say(20, rng), *items[d % 7], *say(20, rng)]), "x") for d in range(21)] + [(None, " ".join(items[2]), "x"), (3, " ".join(items[3]), "y"), (40, "", "x"), (41, None, "x"), (42, " ".join(say(30_000, rng) + items[6]), "x")]
    a = spark.createDataFrame(docs, "doc_id bigint, text string, recall string")
    b = spark.createDataFrame(rows, "item_id bigint, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.item_id is None else r.item_id, r.distance) for r in dc.find_items(a, b).collect())
    want = [(d, k, 0) for d in range(21) for k in [d % 7]] + [(d, k, 0) for d in range(21) if d % 7 == 2 for k in (2, -1)]
    assert got == sorted([*want, (-1, 2, 0), (-1, 2, 0), (-1, -1, 0), (3, 3, 0), (42, 6, 0)])
    kept = dc.clean_of(a, b)
    assert kept.columns == a.columns and sorted(r.doc_id for r in kept.collect()) == [40, 41]
