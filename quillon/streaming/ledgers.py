"""Streaming twins of the ledger operators: events arrive as files, state is kept for each ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_each: int = 100) -> DataFrame:
    """A stream of a folder's Parquet files, with the schema that they have now."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_each).parquet(folder)


def running_state(events: DataFrame, key: str, at: str, event_id: str, state: str) -> DataFrame:
    """The state of each ledger's last event so far, and its number of events (complete or update mode)."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(at, event_id)).alias("state"), F.count("*").alias("events"))


def windowed_counts(events: DataFrame, at: str, key: str, width: str, late: str) -> DataFrame:
    """Events of each key in tumbling windows. In append mode a window comes out once the watermark has passed it, its state
    goes, and events later than `late` are dropped; in complete mode all windows stay and nothing is dropped."""
    w = F.window(at, width)
    events = events.withColumn(at, F.col(at).cast("timestamp"))
    return events.withWatermark(at, late).groupBy(w, key).count().select(F.col("window.start").alias("start"), key, F.col("count").alias("n"))


def guarded(events: DataFrame, key: str, sequence: str, state: str, ranks: dict[str, int]) -> DataFrame:
    """Steps that climb more than one rank above the ledger's last state: key, sequence, from_state, to_state.

    A ledger's events have to arrive in order of sequence; its last state is all that is kept."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(sequence)
        last = held.get[0] if held.exists else None
        before = rows[state].shift(1, fill_value=last)
        low = before.map(ranks).fillna(-1)
        wrong = rows[state].map(ranks) > low + 1
        if len(rows):
            held.update((rows[state].iloc[-1],))
        out = pd.DataFrame({key: k[0], sequence: rows[sequence].astype("int64"), "from_state": before, "to_state": rows[state]})
        yield out[wrong]

    schema = f"{key} bigint, {sequence} bigint, from_state string, to_state string"
    return events.groupBy(key).applyInPandasWithState(step, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there and ends. Complete results replace what the path had."""
    if mode == "complete":
        writer = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
    else:
        writer = stream.writeStream.outputMode(mode).format("parquet").option("path", path)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
