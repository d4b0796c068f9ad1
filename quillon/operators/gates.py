"""Gates that report every reason for which a row fails, and constraints over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons(rules: Sequence[tuple[Column, str]]) -> Column:
    """The messages of all rules whose predicate is true, in order. A predicate that is null fails closed: it counts as true."""
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(message)) for bad, message in rules]), lambda x: x.isNotNull())


def gate(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """Adds reasons (array) and accepted (no reason)."""
    return df.withColumn("reasons", reasons(rules)).withColumn("accepted", F.size("reasons") == 0)


def first_violation(rules: Sequence[tuple[Column, str]]) -> Column:
    """The message of the first rule that is true, null where none is."""
    out = F.lit(None).cast("string")
    for bad, message in reversed(rules):
        out = F.when(bad, F.lit(message)).otherwise(out)
    return out


def completeness(df: DataFrame, kind: str, needs: Sequence[tuple[str, int, Sequence[str]]]) -> DataFrame:
    """The kinds with fewer rows than needed and none of their alternatives: kind, least, n."""
    spark = df.sparkSession
    counts = df.groupBy(kind).count().withColumnRenamed(kind, "kind")
    wanted = spark.createDataFrame([(k, n, list(alts)) for k, n, alts in needs], "kind string, least int, alternatives array<string>")
    present = counts.select(F.col("kind").alias("alternative"))
    other = wanted.select("kind", F.explode("alternatives").alias("alternative")).join(present, "alternative", "left_semi").select("kind").distinct()
    short = wanted.join(counts, "kind", "left").withColumn("n", F.coalesce("count", F.lit(0))).where("n < least")
    return short.join(other, "kind", "left_anti").select("kind", "least", "n")


def duplicates(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Keys that more than one row has, with their number: empty where the constraint holds."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing(keys: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Rows of keys without a row in table."""
    return keys.join(table.select(on).distinct(), on, "left_anti")


def splits(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that do not, with their reasons)."""
    out = gate(df, rules)
    return out.where("accepted").drop("reasons", "accepted"), out.where("NOT accepted").drop("accepted")
