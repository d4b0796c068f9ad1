"""The two nearest points: every pair computed plainly, with copies, ties, nulls, NaN and lengths that differ."""

import math
import random

from quillon.operators import nearest, pixels as px

SCHEMA = "id bigint, v array<float>"


def plain_two(rows, queries):
    out = {}
    for query, qv in queries:
        ranked = []
        for point, pv in rows:
            if None in (point, query) or point == query:
                continue
            both = [(a - b) * (a - b) for a, b in zip(pv or [], qv or [], strict=False) if a is not None and b is not None]
            total = 0.0
            for x in both:
                total += x
            d = math.sqrt(total) if both and total == total else total if both else None
            ranked.append((d is None, d is not None and d != d, d if d is not None and d == d else 0.0, point, d))
        ranked.sort(key=lambda s: s[:4])
        if ranked:
            out[query] = (ranked[0][3], ranked[0][4], ranked[1][4] if len(ranked) > 1 else None)
    return out


def shown(d):
    return None if d is None else "nan" if d != d else d


def check(spark, rows, pick):
    df = spark.createDataFrame(rows, SCHEMA)
    got = px.nearest_two(df, df.where(pick), "id", "v")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    want = plain_two([(r.id, r.v) for r in df.collect()], [(r.id, r.v) for r in df.where(pick).collect()])
    assert {r.query: (r.point, shown(r.distance), shown(r.d2)) for r in got.collect()} == {q: (p, shown(d), shown(e)) for q, (p, d, e) in want.items()}


def test_odd_rows_and_ties(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, [rng.choice([0.0, 0.1, -0.3, 1.0]) for _ in range(4)]) for k in range(120)]
    rows += [(200, None), (201, []), (202, [None] * 4), (203, [0.1, None, 1.0, 0.0]), (204, [0.1, float("nan"), 0.0, 0.0]), (205, [float("inf")] * 4), (206, [1e30] * 4), (207, [0.1, 0.1]), (210, [3e38] * 4), (220, [0.3] * 6), (None, [0.0] * 4)]
    monkeypatch.setattr(nearest, "HELD_PAIRS", 500)
    for numbers in (1 << 18, 64):
        monkeypatch.setattr(nearest, "TILE_NUMBERS", numbers)
        check(spark, rows, "id % 5 = 0 OR id > 190 OR id IS NULL")
    check(spark, rows[:1], "id = 0")
    check(spark, rows[:2], "id = 0")
    check(spark, rows[:0], "id = 0")


def test_near_ties_far_from_zero(spark, monkeypatch):
    monkeypatch.setattr(nearest, "TILE_NUMBERS", 500)
    rng = random.Random(6)
    rows = [(k, [1000.0 + rng.randrange(3) * 2.0**-13 for _ in range(8)]) for k in range(300)]
    check(spark, rows, "id % 10 = 0")
