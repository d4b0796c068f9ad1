"""Line dedup: runs are merged in their own order, very long lines and texts, repeated rows, clean-up after a failure."""

import pytest
from pyspark.sql import functions as F

from quillon.llm import line_dedup as ld

from .test_line_dedup import brute


def test_runs_are_not_sorted_again(spark):
    rows = lambda b: spark.range(2000).select(F.unhex(F.md5(F.concat(F.lit(str(b % 3)), F.col("id")))).alias("h"), F.col("id").alias("did"))
    with ld.LineRuns(spark, fan_in=9) as store:
        for b in range(3):
            store.add(rows(b))
        batch = rows(5).groupBy("h").agg(F.count("*").alias("docs"), F.max("did").alias("last_doc"))
        plan = store._merged(batch)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange hashpartitioning") == 1
        assert plan.count("Sort [") == 1  # the batch, once
        assert store.totals().count() == 6000
        names = [n for _, n in store.runs]
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_a_failure_leaves_no_tables(spark):
    with pytest.raises(RuntimeError), ld.LineRuns(spark) as store:
        store.add(spark.createDataFrame([(b"a", 1)], "h binary, did bigint"))
        names = [n for _, n in store.runs]
        raise RuntimeError
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_long_lines_texts_and_repeats(spark):
    long, common = "y" * 2_000_000, "a line that very many documents have in common"
    rows = [(i, "\n".join([common, long, str(i)])) for i in range(6)] + [(50, "\n".join(f"{common} {i % 1000}" for i in range(60_000)))]
    rows += [(51 + i, "\n".join(f"{common} {k}" for k in range(3))) for i in range(5)] + [(60, common), (60, common), (2, "\n".join([common, long, "2"]))]
    got = ld.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=str) == brute(rows, 5)
