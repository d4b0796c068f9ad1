"""Line deduplication over levelled sorted runs of line hashes.

The store is a set of runs. A run is a Parquet table bucketed and sorted by line hash, one file a bucket, so a merge join
against it needs neither an exchange nor a sort of the run. Every hash lives in one run only: a new batch, sorted once, is
merged with all runs in turn; its unseen hashes (the anti-join) become a run of level 0, and its seen ones go to a log of
hits (hash, documents, last document). When a level has `fan_in` runs, they are merged into one run of the next level. A
hash's totals are its run row plus its hits. The runs are tables of the session's catalogue, quillon_run_*, and are dropped
at the end, also where the work fails.

Defined results: a null or empty text is one empty line; each row counts as one document; a null doc_id sorts below
all others; columns other than doc_id and text are neither read nor returned; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters stripped from both ends of a line for its key.
STRIP = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(2**63)


def _line_key(line: Column, min_chars: int) -> Column:
    """128-bit hash of a line's key; null where the key is shorter than min_chars code points."""
    key = F.btrim(line, F.lit(STRIP))
    ascii_only = F.length(key) == F.octet_length(key)
    folded = F.when(ascii_only, F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))
    return F.when(F.length(key) >= min_chars, F.unhex(F.md5(folded)))


def _lines() -> Column:
    return F.split(common.text_or_empty(), "\n", -1)


#: With it, a scan of a bucketed table with one file a bucket is known to be sorted.
SORTED_SCAN = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class LineRuns:
    """The levelled store, also a context. add() takes batches; totals() gives every hash's documents and last document."""

    def __init__(self, spark: SparkSession, fan_in: int = 3):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = common.parallelism(spark)
        self.root = common.work_path(spark, "line-runs")
        self.runs: list[tuple[int, str]] = []  # level, table
        self.hits: list[DataFrame] = []

        self.before = spark.conf.get(SORTED_SCAN)
        spark.conf.set(SORTED_SCAN, "true")

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def drop(self) -> None:
        for _, name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        common.remove(self.root)
        self.spark.conf.set(SORTED_SCAN, self.before)

    def _write_run(self, rows: DataFrame, level: int) -> None:
        name = f"quillon_run_{uuid.uuid4().hex}"
        self.runs.append((level, name))
        one_file = rows.repartition(self.buckets, "h")
        one_file.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.root}/{name}").format("parquet").saveAsTable(name)

    def _all(self, names: list[str]) -> DataFrame:
        return reduce(DataFrame.unionAll, [self.spark.table(n) for n in names])

    def _merged(self, batch: DataFrame) -> DataFrame:
        """batch with column seen: whether some run has the hash. One merge join for each run, none sorted anew."""
        batch = batch.withColumn("seen", F.lit(False))
        for _, name in self.runs:
            run = self.spark.table(name).select("h", F.lit(True).alias("there")).hint("merge")
            batch = batch.join(run, "h", "left").select("h", "docs", "last_doc", (F.col("seen") | F.col("there").isNotNull()).alias("seen"))
        return batch

    def add(self, rows: DataFrame) -> None:
        """rows (h, did): a row for each document and distinct line of the batch."""
        batch = rows.groupBy("h").agg(F.count("*").alias("docs"), F.max("did").alias("last_doc"))
        merged = common.saved(self._merged(batch), f"{self.root}/batch-{uuid.uuid4().hex}")
        self.hits.append(merged.where("seen").select("h", "docs", "last_doc"))
        self._write_run(merged.where("NOT seen").select("h", "docs", "last_doc"), 0)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(full := [n for lv, n in self.runs if lv == level]) >= self.fan_in:
            self.runs = [r for r in self.runs if r[1] not in full]
            self._write_run(self._all(full), level + 1)
            for name in full:
                self.spark.sql(f"DROP TABLE {name}")
                common.remove(f"{self.root}/{name}")
            level += 1

    def totals(self) -> DataFrame:
        """(h, docs, last_doc): one row for each hash."""
        rows = [self.spark.table(n).select("h", "docs", "last_doc") for _, n in self.runs] + self.hits
        return reduce(DataFrame.unionAll, rows).groupBy("h").agg(F.sum("docs").alias("docs"), F.max("last_doc").alias("last_doc"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fan_in: int = 3) -> DataFrame:
    """Drops frequent lines. A key of min_chars or more, held by min_docs or more documents, keeps its lines only in the
    document with the largest doc_id that holds it.

    Returns doc_id, n_lines, n_dropped, kept_text: one row for each row of docs.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    did = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    keyed = docs.select(did.alias("did"), F.explode(F.array_distinct(F.transform(_lines(), lambda x: _line_key(x, min_chars)))).alias("h")).where("h is not null")
    staged_at = common.work_path(spark, "line-keys")
    keyed.withColumn("batch", F.pmod(F.xxhash64("did"), F.lit(batches))).write.partitionBy("batch").parquet(staged_at)
    staged = spark.read.schema("did bigint, h binary, batch bigint").parquet(staged_at)
    frequent_at = common.work_path(spark, "frequent-lines")
    with LineRuns(spark, fan_in) as store:
        for b in range(batches):
            store.add(staged.where(F.col("batch") == b).select("h", "did"))
        frequent = common.saved(store.totals().where(F.col("docs") >= min_docs).select("h", "docs", "last_doc"), frequent_at)
    common.remove(staged_at)

    rid = F.xxhash64(common.text_or_empty())  # with did, tells rows apart whose lines differ
    at = docs.select(did.alias("did"), rid.alias("rid"), F.posexplode(F.transform(_lines(), lambda x: _line_key(x, min_chars))).alias("i", "h")).where("h is not null")
    gone = common.join_split(at, frequent, "h", "docs").where(F.col("did") < F.col("last_doc")).groupBy("did", "rid").agg(F.collect_set("i").alias("gone"))
    joined = docs.select("doc_id", "text", did.alias("did"), rid.alias("rid")).join(gone.hint("shuffle_hash"), ["did", "rid"], "left")
    lines = joined.select("doc_id", _lines().alias("lines"), "gone").withColumn("n", F.size("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.element_at(F.col("lines"), i + 1)))
    n_gone = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone"))
    return lines.select("doc_id", F.col("n").cast("long").alias("n_lines"), n_gone.cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept_text"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, l[i] AS line, translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), frequent AS (
  SELECT k, max(doc_id) AS last_doc FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.i, l.line, coalesce(l.doc_id < f.last_doc, false) AS gone FROM lines l LEFT JOIN frequent f ON l.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
