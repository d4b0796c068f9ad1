"""Sources left out of an envelope and directions of pixels: against plain versions and odd rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import appearance


def test_reasons(spark):
    rng = random.Random(4)
    rows = [("r", i, 20 + i, 0.1, 0.5 + 0.01 * rng.random()) for i in range(9)] + [("r", 9, 50, 0.35, 0.9), ("r", 10, 15, 0.9, 0.5), ("r", 11, 16, 0.36, 0.5), ("r", 12, None, None, 0.5), ("r", 13, 40, 0.0, None)]
    rows += [("two", 0, 40, 0.0, 0.1), ("two", 1, 40, 0.0, 0.9), ("same", 0, 40, 0.0, 0.5), ("same", 1, 40, 0.0, 0.5), ("same", 2, 40, 0.0, 0.5), ("same", 2, 40, 0.0, 0.5), ("none", 0, 3, 0.0, 0.5), (None, 0, 40, 0.0, 0.5)]
    df = spark.createDataFrame(rows, "region string, source int, pixels int, clipped double, med double").withColumn("n", F.lit("kept"))
    got = appearance.source_exclusions(df, "region").collect()
    assert len(got) == len(rows) and {r.n for r in got} == {"kept"}
    own = np.array([m for g, i, n, c, m in rows if g == "r" and m is not None and i not in (10, 11)])
    spread = np.median(np.abs(own - np.median(own)))
    for r in got:
        early = "few_pixels" if r.pixels is not None and r.pixels < 16 else "clipped" if r.clipped is not None and r.clipped > 0.35 else None
        z = 0.6745 * abs(r.med - np.median(own)) / max(spread, 1e-4) if r.region == "r" and early is None and r.med is not None else 0.0 if r.region == "same" else None
        assert r.z is None if z is None else abs(r.z - z) < 1e-9, r
        assert r.reason == (early or ("outlier" if z and z > 3.5 else None)), r
    assert {(r.region, r.source) for r in got if r.reason == "outlier"} == {("r", 9)}
    assert appearance.source_exclusions(df.limit(0), "region").collect() == []


def test_directions(spark):
    rows = [(30.0, 0.0, 0.4), (None, -20.0, 2.0), (0.0, None, -1.0), (180.0, 360.0, 0.5), (-50.0, 25.0, None)]
    d = appearance.direction(F.col("a"), F.col("b"), F.col("s"))
    for r in spark.createDataFrame(rows, "a double, b double, s double").withColumn("d", d).collect():
        x, y = (math.sin(math.radians(v or 0.0)) for v in (r.a, r.b))
        size = math.hypot(x, y)
        x, y = (x / size, y / size) if size > 1e-6 else (1.0, 0.0)
        assert abs(r.d.x - (x + 1) / 2) < 1e-9 and abs(r.d.y - (y + 1) / 2) < 1e-9
        assert r.d.strength is None if r.s is None else r.d.strength == min(max(r.s, 0), 1)
