"""Hard negatives against every score, and what pruning may leave out."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int, rid string, v string"


def brute(rows, top=5):
    use = [(-(2**63) if i is None else i, [math.floor(256 * x) for x in v], l) for i, v, l in rows if v is not None and l is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, v, l) in enumerate(use):
        if i == -(2**63) or i % 10:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for n, (j, w, m) in enumerate(use) if n != k)
        for place, (s, j, _) in enumerate([x for x in scored if x[2] == l][:top]):
            found = [x for x in scored if x[2] != l and 80 * -s <= 100 * -x[0] <= 100 * -s][:top]
            out += [(i, None if j == -(2**63) else j, r + 1, None if x[1] == -(2**63) else x[1], -s, -x[0], place + 1) for r, x in enumerate(found)]
    return sorted(out, key=str)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in hn.mine(df, F.col("vid") % 10 == 0, F.col("label"), **how).collect()), key=str)


@pytest.mark.parametrize("run_values", [60, 10**6])
def test_matches_every_score(spark, run_values):
    rng = random.Random(3)
    unit = lambda n, scale=1.0: [rng.gauss(0, scale) for _ in range(n)]
    rows = [(i, unit(6, rng.choice([0.2, 1, 3])), rng.randrange(3)) for i in range(90)]
    rows += [(i, rows[0][1], i % 2) for i in range(90, 110)]  # copies of one vector under two labels
    rows += [(110, None, 1), (111, [1.0, None], 1), (112, [float("nan")], 1), (113, [float("inf")], 1), (114, unit(6), None), (None, unit(6), 1), (115, [], 1), (116, unit(3), 2), (120, [0.0] * 6, 1), (0, rows[0][1], rows[0][2]), (10, rows[10][1], rows[10][2])]
    assert mined(spark, rows, run_values=run_values) == brute(rows)


def test_no_rows_and_alone(spark):
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [1.0], 2)]) == []  # a positive with a score below zero has no range


def test_large_components_stay_exact(spark):
    big = float(2**22)
    rows = [(0, [big, 1.0], 1), (1, [big, 3.0], 1), (2, [big, 2.0], 2), (3, [big, 2.9], 2), (4, [2.0**40, 1.0], 2)]
    assert mined(spark, rows) == brute([r for r in rows if r[0] != 4])


def test_pruning_leaves_out_rows_but_no_answer():
    rng = np.random.default_rng(1)
    values = np.floor(256 * np.concatenate([rng.normal(0, 1, (300, 4)), np.tile([5.0, 0, 0, 0], (20, 1)) + rng.normal(0, 0.1, (20, 4))]))
    lengths = np.sqrt((values**2).sum(1))
    order = np.argsort(-lengths)
    anchor = np.array([256.0, 10, 0, 0])
    length = np.linalg.norm(anchor)
    pruned = 0
    for start in range(0, 320, 64):
        b = hn.Bucket(values, lengths, order[start : start + 64])
        for least in (-1e5, 0, 5e4, 2e5, 3e5):
            found = b.candidates(anchor, length, least)
            full = np.flatnonzero(values[b.at] @ anchor >= least)
            if found is not None:
                assert set(full) <= set(found)
                pruned += len(found) < 64
    assert pruned > 5


def test_matrix_fills_up():
    assert hn.matrix(pa.array([[1.0, 2.0], [], [3.0]])).tolist() == [[1, 2], [0, 0], [3, 0]]
