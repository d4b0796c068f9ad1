"""Decontamination finds what it promises: long items, and passages at the edges of any text of a run."""

import random

import pytest

from quillon.llm import decontaminate as dc


def edited(item, edits, rng):
    out = list(item)
    for _ in range(edits):
        i, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[i] = f"z{rng.randrange(10**9)}"
        elif kind == 1:
            out.insert(i, f"z{rng.randrange(10**9)}")
        else:
            del out[i]
    return out


def say(n, rng):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


@pytest.mark.parametrize(("sizes", "cap"), [((15, 30, 60, 120, 240, 480, 900), None), ((15, 30, 60, 120), 4)])
def test_every_class_reaches_its_recall(monkeypatch, sizes, cap):
    if cap:
        monkeypatch.setattr(dc, "MOST_TABLES", cap)
    rng = random.Random(3)
    items = [say(n, rng) for n in sizes for _ in range(3)]
    index = dc.Index([(k, " ".join(i)) for k, i in enumerate(items)], 0.1, 0.95)
    assert len(index.recalls) == len(sizes) and min(index.recalls.values()) >= 0.95
    for first in range(0, len(items), 3):
        owners = [first + j % 3 for j in range(20)]
        texts = [" ".join([*say(40, rng), *edited(items[k], len(items[k]) // 10, rng), *say(40, rng)]) for k in owners]
        found = {(row, k) for row, k, _, _ in index.find(texts)}
        assert sum((row, k) in found for row, k in enumerate(owners)) >= 0.85 * len(owners), len(items[first])


@pytest.mark.parametrize("edge", ["start", "end"])
def test_passages_at_the_edges_of_later_texts(edge):
    rng = random.Random(6)
    items = [say(n, rng) for n in (20, 25, 30, 35, 40, 50, 60, 75) for _ in range(5)]
    index = dc.Index([(k, " ".join(i)) for k, i in enumerate(items)], 0.1, 0.95)
    texts = ["the first text of the run"]
    for item in items:
        cut = 2 if len(item) < 30 else 3
        texts.append(" ".join([*item[cut:], *say(30, rng)] if edge == "start" else [*say(30, rng), *item[:-cut]]))
    apart = [{k for _, k, _, _ in index.find([t])} for t in texts]
    run = [set() for _ in texts]
    for row, k, distance, _ in index.find(texts):
        run[row].add(k)
        assert distance <= len(items[k]) // 10
    assert run == apart  # a text's place in the batch changes nothing
    assert sum(k in run[k + 1] for k in range(len(items))) >= 0.9 * len(items)
