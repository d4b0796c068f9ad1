"""Operators on small rows with known results."""

import math

import numpy as np
from pyspark.sql import functions as F

from quillon.functions import scalar as sc
from quillon.operators import fitting, gates, ledger, stats
from quillon.operators import pixels as px


def test_global_percentiles_by_refinement(spark, monkeypatch):
    monkeypatch.setattr(stats, "FINAL_VALUES", 10)
    rng = np.random.default_rng(1)
    values = [*rng.normal(0, 1e6, 2000).tolist(), *[5.0] * 500, 1e-300, -1e300]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (math.nan,)], "v double")
    q = [0, 0.05, 0.5, 0.99, 1]
    assert np.allclose(stats.global_percentiles(df, "v", q), np.quantile(values, q))
    assert stats.global_percentiles(df.where("v > 1e308"), "v", [0.5]) == [None]


def test_weighted_step_quantile_takes_a_value_that_is_there(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 9.0, 2.0), ("b", 4.0, 0.5), ("b", 4.0, 0.5)], "g string, v double, w double")
    got = {r.g: r.q for r in stats.weighted_step_quantile(df, ["g"], "v", "w", 0.5, "q").collect()}
    assert got == {"a": 2.0, "b": 4.0}


def test_modified_z_needs_three(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 1.1, 0.9, 50.0)] + [("b", 1.0), ("b", 99.0)], "g string, v double")
    got = {(r.g, r.v): r.outlier for r in stats.modified_z(df, ["g"], "v").collect()}
    assert got == {("a", 1.0): False, ("a", 1.1): False, ("a", 0.9): False, ("a", 50.0): True, ("b", 1.0): False, ("b", 99.0): False}


def test_circular_mean_wraps(spark):
    df = spark.createDataFrame([(1, 350.0), (1, 10.0), (2, 0.0), (2, 180.0)], "g int, d double")
    got = {r.g: (r.mean_angle, r.resultant) for r in stats.circular_mean(df, ["g"], F.col("d"), F.lit(1.0)).collect()}
    assert min(got[1][0], 360 - got[1][0]) < 1e-6 and got[2] == (0.0, 0.0)


def test_gates_report_all_reasons_and_fail_closed(spark):
    df = spark.createDataFrame([(1, 5.0), (2, -1.0), (3, None)], "i int, v double")
    got = {r.i: (r.reasons, r.accepted) for r in gates.gate(df, [(F.col("v") < 0, "negative"), (F.col("v") < 3, "small")]).collect()}
    assert got == {1: ([], True), 2: (["negative", "small"], False), 3: (["negative", "small"], False)}


def test_paths(spark):
    rows = ["a/b.png", "/a", "a//b", "../a", "a/../b", "~/a", "http://x", "a\\b", "a/", "", None, "raw/x.PNG", "a/raw/b"]
    df = spark.createDataFrame([(r,) for r in rows], "p string")
    got = df.select("p", sc.safe_relative_path(F.col("p")).alias("ok"), sc.asset_uri_reason(F.col("p")).alias("why"), sc.safe_extension(F.col("p")).alias("ext")).collect()
    assert [r.p for r in got if r.ok] == ["a/b.png", "a//b", "raw/x.PNG", "a/raw/b"]
    assert {r.p: r.why for r in got}["a/raw/b"] == "private" and [r.ext for r in got if r.p == "raw/x.PNG"] == [".png"]


def test_tampered_ledger_is_found(spark):
    df = spark.createDataFrame([(1, i, f"a{i}") for i in range(5)] + [(2, 0, "b")], "k int, s int, action string")
    fields = [F.col("action"), F.col("k")]
    chained = ledger.chain(df, "k", "s", fields)
    assert ledger.chain_breaks(chained, "k", "s", fields, "digest", "previous_digest").collect() == []
    bad = chained.withColumn("action", F.when((F.col("k") == 1) & (F.col("s") == 2), "changed").otherwise(F.col("action")))
    assert [(r.k, r.first_bad) for r in ledger.chain_breaks(bad, "k", "s", fields, "digest", "previous_digest").collect()] == [(1, 2)]
    assert ledger.sequence_breaks(df.where("s <> 3"), "k", "s").collect()[0].asDict() == {"k": 1, "expected": 3, "found": 4}


def test_colour_round_trip(spark):
    df = spark.range(256).select((F.col("id") / 255.0).alias("v"), "id")
    assert df.where(sc.linear_to_srgb_byte(sc.srgb_to_linear(F.col("v"))) != F.col("id")).count() == 0


def test_peak_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(3, 1, 0, 1.0), (2, 1, 0, 1.0), (1, 1, 0, 0.5)], "frame_id int, grp int, pos int, v double")
    assert px.peak_frame(df).collect()[0].peak_frame == 2


def test_coordinate_descent_finds_the_minimum():
    specs = [fitting.Parameter("a", 0, 1, 0.25, 0.01), fitting.Parameter("b", -1, 1, 0.5, 0.01), fitting.Parameter("c", 0, 1, 0.5, 0.1, locked=True)]
    calls = []

    def loss(some):
        calls.extend(some)
        return [(c["a"] - 0.4) ** 2 + (c["b"] - 0.3) ** 2 for c in some]

    best, least, trials = fitting.coordinate_descent({"a": 0.0, "b": 0.0, "c": 0.5}, specs, loss, passes=20, trials=200, tolerance=1e-6)
    assert least < 1e-3 and best["c"] == 0.5 and trials == len(calls) == len({tuple(sorted(c.items())) for c in calls})
