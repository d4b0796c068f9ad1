"""Promotion ledgers as a stream: each event is held against its ledger as it arrives, in whatever order.

State is kept for each ledger, since a ledger is one chain: the next sequence, events that arrived before their turn, and
for each profile the last event's revision, state and lane, and the fingerprint of the open revision, which goes when the next
one opens. An event waits until those before it have come; when the watermark has passed it by `late` without them, it is
taken with the reason sequence-gap. The rules are those of the batch, as columns after the state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillon.operators import promotion

ADDED = T.StructType([T.StructField(n, t()) for n, t in (("known", T.BooleanType), ("latest_state", T.StringType), ("latest_revision", T.LongType), ("latest_lane", T.StringType), ("changed", T.BooleanType), ("gap", T.BooleanType))])


class LatestProcessor(StatefulProcessor):
    """Events (as JSON, with sequence and time in seconds) in, the same with ADDED out, each ledger's in order of sequence."""

    def __init__(self, late_seconds: int):
        self.late = late_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "sequence bigint")
        self.early = handle.getMapState("early", "sequence bigint", "event string, at bigint")
        self.latest = handle.getMapState("latest", "profile string", "revision bigint, state string, lane string")
        self.prints = handle.getMapState("prints", "profile string", "parts string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 (names of the interface)
        turn = self.turn.get()[0] if self.turn.exists() else 0
        for r in rows:
            if r.sequence is not None and r.sequence >= turn:
                self.early.updateValue((r.sequence,), (r.event, r.at))
                self.handle.registerTimer(r.at + self.late)
            else:  # without a place, or for one that is taken
                yield self._row(key, r.event, None, True)
        yield from self._advance(key, turn)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        turn = self.turn.get()[0] if self.turn.exists() else 0
        waiting = sorted((k[0], v[1]) for k, v in self.early.iterator())
        overdue = [k for k, at in waiting if at + self.late <= now]
        if overdue:
            yield from self._advance(key, turn, max(overdue))

    def _advance(self, key, turn: int, until: int = -1) -> Iterator[Row]:
        """Takes the events from turn on that are there; up to `until` also past gaps."""
        while self.early.containsKey((turn,)) or turn <= until:
            if self.early.containsKey((turn,)):
                yield self._row(key, self.early.getValue((turn,))[0], turn, False)
                self.early.removeKey((turn,))
                turn += 1
            else:
                turn = min(k[0] for k, _ in self.early.iterator())
                yield self._row(key, self.early.getValue((turn,))[0], turn, True)
                self.early.removeKey((turn,))
                turn += 1
        self.turn.update((turn,))

    def _row(self, key, event: str, turn: int | None, gap: bool) -> Row:
        e = json.loads(event)
        who = (e.get("profile_id") or "",)
        latest = self.latest.getValue(who) if self.latest.containsKey(who) else None
        held = json.loads(self.prints.getValue(who)[0]) if self.prints.containsKey(who) else {}
        parts = {k: v for k, v in (e.get("fingerprint") or {}).items() if v is not None}
        new = latest is None or latest[0] != e.get("revision")
        changed = not new and any(held.get(k, v) != v for k, v in parts.items())
        if turn is not None:
            lane = (e.get("lane") or "physical") if new else latest[2]
            self.latest.updateValue(who, (e.get("revision"), e.get("to_state"), lane))
            self.prints.updateValue(who, (json.dumps(parts if new else held | parts),))
        before = latest or (None, None, None)
        return Row(ledger=key[0], event=event, known=latest is not None, latest_state=before[1], latest_revision=before[0], latest_lane=before[2], changed=changed, gap=gap)


def judged_stream(events: DataFrame, at: str, late_seconds: int = 3600) -> DataFrame:
    """The stream's events with what came before each and the reasons against it, once everything before it has come.

    at: the column with the time of an event, for the watermark. Append mode; needs the RocksDB state store."""
    body = F.to_json(F.struct(*events.columns))
    own = events.select("ledger", "sequence", body.alias("event"), F.col(at).cast("timestamp").alias("_time")).withWatermark("_time", f"{late_seconds} seconds")
    own = own.select("ledger", "sequence", "event", "_time", (F.unix_millis("_time")).alias("at"))
    out = T.StructType([T.StructField("ledger", events.schema["ledger"].dataType), T.StructField("event", T.StringType()), *ADDED.fields])
    latest = own.groupBy("ledger").transformWithState(LatestProcessor(late_seconds), out, "append", "eventTime")
    back = latest.select(F.from_json("event", events.schema).alias("e"), *ADDED.names).select("e.*", *ADDED.names)
    gap = F.when(F.col("gap"), F.array(F.lit("sequence-gap"))).otherwise(F.array().cast("array<string>"))
    return promotion.judged(back).withColumn("reasons", F.concat(gap, "reasons")).drop("gap")
