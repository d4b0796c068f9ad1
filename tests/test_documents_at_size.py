"""Canonical documents: work dealt to all cores, numbers and strings at the edges of the short way."""

from pyspark.sql import functions as F

from quillon.functions import documents as doc
from quillon.plans import catalog
from test_documents import plain_number


def test_rows_are_dealt_to_all_cores(spark):
    for name in ("canonical_documents", "schema_faults"):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_edges_of_the_short_way(spark):
    numbers = ["0", "-0", "0.0", "-0.0", "100", "1.50", "0.000001", "0.0000001", "-0.5", "123456789012345", "1234567890123456", "999999999.999999", "9999999999.999999", "0.1234567", "12e2", "1E-7", "-7"]
    texts = ['"Ab é"', '"\\u00e9"', '"a\\/b"', '"q\\"\\n"', '"true"', '"1"', '""', '"\\u007f"']
    want = {n: plain_number(n) for n in numbers} | dict(zip(texts, ['"Ab é"', '"é"', '"a/b"', '"q\\"\\n"', '"true"', '"1"', '""', '"\x7f"'], strict=True)) | {x: x for x in ("true", "false", "null")}
    rows = [(t, f"[{t}, {{\"10\": {t}, \"9\": {t}, \"a\": {t}}}]") for t in want]
    for r in spark.createDataFrame(rows, "t string, d string").select("t", doc.canonical_json(F.col("t"), depth=2).alias("c"), doc.canonical_json(F.col("d"), depth=2).alias("d")).collect():
        w = want[r.t]
        assert (r.c, r.d) == (w, f'[{w},{{"9":{w},"10":{w},"a":{w}}}]'), r.t
