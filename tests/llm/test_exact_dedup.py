"""Exact dedup by recipes, also where short hashes collide; cuts are the same for equal texts and bounded."""

import random

import pytest

from quillon.llm import exact_dedup as xd


def rows():
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(90_000))
    out = [(i, "ab" * (i % 17) if i % 3 else f"z{i % 7}") for i in range(120)]
    return [*out, (200, long), (201, long), (202, long[:-1]), (203, "x" + long), (300, None), (301, ""), (None, "ab" * 4), (None, "only here"), (5, "ab" * 5), (5, "ab" * 5)]


@pytest.mark.parametrize("bits", [64, 3])
def test_groups(spark, bits):
    data = rows()
    docs = spark.createDataFrame([(*r, "x") for r in data], "doc_id bigint, text string, sha string")
    by = {}
    for d, t in data:
        by.setdefault(t or "", []).append(d)
    got = xd.exact_groups(docs, hash_bits=bits).collect()
    want = [(d, max((x for x in ids if x is not None), default=None), len(ids)) for ids in by.values() for d in ids]
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == sorted(want, key=str)
    assert sum(r.kept for r in got) == len(by)


def test_one_of_each_stays_with_all_columns(spark):
    data = rows()
    docs = spark.createDataFrame([(*r, "x") for r in data], "doc_id bigint, text string, _keep_sha string")
    got = xd.dedup_exact(docs.withColumnRenamed("_keep_sha", "sha"))
    assert got.columns == ["doc_id", "text", "sha"]
    assert sorted((t or "") for _, t, _ in got.collect()) == sorted({t or "" for _, t in data})
    assert xd.dedup_exact(docs.where("false")).collect() == []


def test_cuts():
    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(300_000))
    ends = xd.cuts(data)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(data) and max(sizes) <= xd.MAX_CHUNK and min(sizes[:-1]) >= xd.MIN_CHUNK
    moved = xd.cuts(b"12345" + data)
    assert len({e - 5 for e in moved} & set(ends)) > len(ends) // 2
    assert xd.cuts(b"") == [0] and xd.cuts(b"\0" * 200_000)[-1] == 200_000
