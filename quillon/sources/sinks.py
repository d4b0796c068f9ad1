"""Sinks: JSON documents, guarded appends to ledgers, content-addressed ingest, rasters."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.scalar import canonical_digest
from quillon.operators import gates


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document a row, without null fields; Spark's commit makes the folder whole or absent."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def schema_text(schema: T.StructType) -> str:
    """A record type as JSON with sorted keys."""
    return json.dumps(schema.jsonValue(), indent=2, sort_keys=True) + "\n"


def append_events(ledger: DataFrame, new: DataFrame, key: str, fields: Sequence[Column], rules: Sequence[tuple[Column, str]], path: str) -> tuple[DataFrame, DataFrame]:
    """Appends events that pass the rules, each chained to the one before it; a ledger takes its events in order of `sequence`.

    Returns (appended, rejected with reasons). One writer at a time: the heads are read before the append.
    """
    good, bad = gates.splits(new, rules)
    heads = ledger.groupBy(key).agg(F.max_by("digest", "sequence").alias("_head"), F.max("sequence").alias("_last"))
    order = Window.partitionBy(key).orderBy("sequence")
    placed = good.join(heads, key, "left").withColumn("sequence", (F.coalesce("_last", F.lit(-1)) + F.row_number().over(order)).cast("int"))
    chained = placed.withColumn("digest", canonical_digest(*fields)).withColumn("previous_digest", F.coalesce(F.lag("digest").over(order), F.col("_head"))).drop("_head", "_last")
    chained.write.mode("append").parquet(path)
    return chained, bad


def ingest(known: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Content-addressed ingest of files (path, sha256): (new, one for each hash; rejected: path, reason)."""
    first = files.groupBy("sha256").agg(F.min("path").alias("path"), F.count("*").alias("n"))
    new = first.join(known.select("sha256").distinct(), "sha256", "left_anti").select("path", "sha256", F.concat(F.substring("sha256", 1, 2), F.lit("/"), "sha256").alias("stored_as"))
    return new, files.join(new.select("path"), "path", "left_anti").select("path", F.lit("duplicate").alias("reason"))


def pixels_to_bytes(px: DataFrame, frame: str, value: Column, width: int) -> DataFrame:
    """Rasters of one byte a pixel (row by row), from pixel rows of values in 0..1; ties round to even."""
    byte = F.lpad(F.hex(F.bround(F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)) * 255, 0).cast("int")), 2, "0")
    at = F.struct((F.col("y") * width + F.col("x")).alias("at"), byte.alias("b"))
    return px.groupBy(frame).agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda s: s["b"]), "")).alias("grey"))

