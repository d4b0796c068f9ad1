"""Decontamination: the distance against a plain table of distances, planted passages against every window compared."""

import random

import numpy as np
import pytest

from quillon.llm import decontaminate as dc


def plain(item, window):
    row = [0] * (len(window) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(window):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        assert dc.edit_distance(np.array(a), np.array(b))[0] == plain(a, b)


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["the", "of"] * 60
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [say(n) for n in [1, 3, 7, 9, *[rng.randrange(10, 60) for _ in range(30)], 150]]
    items[0] = ["unique"]
    docs = [say(rng.randrange(0, 400)) for _ in range(120)]
    for i, d in enumerate(docs):
        if i % 3:
            item = list(items[i % len(items)])
            if i % 3 == 2:
                for _ in range(rng.randint(0, int(0.12 * len(item)))):
                    item[rng.randrange(len(item))] = rng.choice(words)
            at = rng.choice([0, len(d), rng.randrange(len(d) + 1)])
            d[at:at] = item
    return items, docs


def test_against_every_window(spark):
    items, docs = corpus()
    want, edited = set(), set()
    for d, doc in enumerate(docs):
        for k, item in enumerate(items):
            most = int(0.1 * len(item)) if len(item) >= dc.SHORT else 0
            distance = plain(item, doc)
            if distance <= most:
                (want if distance == 0 else edited).add((d, k, distance))
    a = spark.createDataFrame([(i, " ".join(d).title(), "x") for i, d in enumerate(docs)] + [(900, None, "x"), (901, "", "x")], "doc_id bigint, text string, item_id string")
    b = spark.createDataFrame([(k, ",\n".join(i).upper()) for k, i in enumerate(items)] + [(900, None), (901, "?!")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in dc.find_items(a, b).collect()}
    assert want <= got and got <= want | edited
    assert len(got & edited) >= 0.85 * len(edited) > 0
    stay = dc.clean_of(a, b)
    assert stay.columns == a.columns
    assert {r.doc_id for r in stay.collect()} == {*range(len(docs)), 900, 901} - {d for d, _, _ in got}


@pytest.mark.parametrize("none", ["docs", "items"])
def test_no_rows(spark, none):
    docs = spark.createDataFrame([] if none == "docs" else [(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([] if none == "items" else [(1, "a b")], "item_id bigint, text string")
    assert dc.find_items(docs, items).collect() == []


def test_index_reaches_its_recall():
    items, _ = corpus()
    index = dc.Index([(k, " ".join(i)) for k, i in enumerate(items)], 0.1, 0.95)
    assert min(index.recalls.values()) >= 0.95


def test_many_blocks_of_items(spark, monkeypatch):
    items, docs = corpus()
    a = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)] + [(900, None)], "doc_id bigint, text string").repartition(5)
    b = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id bigint, text string")
    whole = {(r.doc_id, r.item_id) for r in dc.find_items(a, b).collect() if r.distance == 0}
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # many batches to each run
    try:
        found = dc.find_items(a, b).collect()
        stay = {r.doc_id for r in dc.clean_of(a, b).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.doc_id, r.item_id) for r in found if r.distance == 0} == whole
    assert stay == {*range(len(docs)), 900} - {r.doc_id for r in found}
