"""Statistics with null keys, NaN, clashing names and groups beyond what one task sorts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import joins, metrics, stats
from quillon.operators import pixels as px

NAN = float("nan")


@pytest.fixture(params=[2_000_000, 50])
def group_rows(request, monkeypatch):
    monkeypatch.setattr(stats, "GROUP_ROWS", request.param)


def rows_of(seed=1):
    rng = random.Random(seed)
    rows = [(None, rng.choice([2.0, rng.random()])) for _ in range(300)] + [("a", float(k % 7)) for k in range(60)] + [("n", NAN), ("n", None), ("n", 4.0), ("x", None), ("x", NAN)]
    return [(g, None if v is None else v, k) for k, (g, v) in enumerate(rows)]


def values(rows):
    out = {}
    for g, v, _ in rows:
        out.setdefault(g, [])
        if v is not None and not math.isnan(v):
            out[g].append(v)
    return out


def test_percentiles_and_places(spark, group_rows):
    rows = rows_of()
    df = spark.createDataFrame([(*r, "m", "w") for r in rows], "g string, v double, i bigint, cell string, before string")
    got = {r.g: r for r in stats.group_percentiles(df, ["g"], "v", {"a": 0.1, "m": 0.5, "v": 1.0}).collect()}
    want = {g: np.percentile(x, [10, 50, 100]) for g, x in values(rows).items() if x}
    assert set(got) == set(want) and all(np.allclose([got[g].a, got[g].m, got[g].v], w) for g, w in want.items())
    placed = stats.numbered(df, ["g"], ["i"], "k")
    assert placed.columns == [*df.columns, "k"] and all((r.cell, r.before) == ("m", "w") for r in placed.collect())
    seen = {}
    for r in placed.orderBy("i").collect():
        seen.setdefault(r.g, []).append(r.k)
    assert sum(map(len, seen.values())) == len(rows) and all(k == list(range(len(k))) for k in seen.values())
    both = {r.g: (r.med, r.mad) for r in stats.median_and_mad(df, ["g"], "v").collect()}
    assert all(np.allclose(both[g], (np.median(x), np.median(np.abs(np.array(x) - np.median(x))))) for g, x in values(rows).items() if x)


def test_modified_z_returns_every_row(spark):
    rows = [*rows_of(), ("a", 900.0, -1)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "g string, v double, i bigint, z int")
    got = stats.modified_z(df, ["g"], "v").collect()
    assert len(got) == len(rows)
    assert [r.i for r in got if r.outlier] == [-1]
    assert all((r.z is None) == (r.v is None or math.isnan(r.v)) for r in got)


def test_global_percentiles_narrow_all_ranks_at_once(spark, monkeypatch):
    monkeypatch.setattr(stats, "FINAL_VALUES", 20)
    monkeypatch.setattr(stats, "BUCKETS", 8)
    rng = random.Random(4)
    x = [rng.gauss(0, 1) ** 3 for _ in range(900)] + [1.25] * 300 + [1e300, -1e300]
    df = spark.createDataFrame([(v,) for v in [*x, None, NAN]], "v double")
    q = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    assert np.allclose(stats.global_percentiles(df, "v", q), np.quantile(x, q), rtol=1e-12)
    assert stats.global_percentiles(df.where("v = 1.25"), "v", [0.3]) == [1.25]


def test_null_regions_and_nearest(spark):
    points = [(None if k < 70 else "s", 0, k, 0, k % 64, 0.1 + (k % 9) / 10) for k in range(140)]
    df = spark.createDataFrame(points, "grp string, frame_id bigint, pos int, y int, x int, v double")
    assert {r.grp for r in px.envelope(df).collect()} == {None, "s"} == {r.grp for r in metrics.region_stats(df, 0.02, 0.98).collect()}
    vectors = spark.createDataFrame([(k, [float(k % 5), float(k // 5)]) for k in range(20)], "k bigint, v array<double>")
    for r in px.nearest_two(vectors, vectors.where("k % 3 = 0"), "k", "v").collect():
        d = sorted((math.hypot(r["query"] % 5 - k % 5, r["query"] // 5 - k // 5), k) for k in range(20) if k != r["query"])
        assert (r.point, r.distance, r.d2) == (d[0][1], d[0][0], d[1][0])


def test_joins_on_nulls(spark):
    a = spark.createDataFrame([(None, 1, "l"), (1, 2, "l")], "k bigint, v int, k_right string")
    b = spark.createDataFrame([(None, 7), (2, 8)], "k bigint, w int")
    assert sorted(joins.on_equal(a, b, ["k"], "left").collect(), key=str) == sorted([(1, 2, "l", None), (None, 1, "l", 7)], key=str)
    assert joins.on_equal(a, b.agg(F.max("w").alias("m")), []).count() == 2
