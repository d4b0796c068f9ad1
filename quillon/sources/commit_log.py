"""Guarded appends to review ledgers by several writers at once.

A log is a folder with parts (Parquet, one for each accepted batch) and commits, one small file a version, that names its part.
A version's file is created only if it is not there (a link or a rename that does not overwrite), so of two writers that saw
the same head one gets the next version; the other reads what came in between, judges its events anew and tries again. So
the log is one chain whatever the order, and an event is judged by all that were accepted before it. Events are known by
their event_id: sent again, they are not appended twice, and the answer is the first one's.

Events have ledger, event_id, place (the writer's order within a ledger), reviewer, action, item, requires_resolution, target.
What a ledger says so far is found by aggregates and joins, one row a ledger; each ledger's new events are then judged in order.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import canonical_digest
from quillon.operators import review
from quillon.session import remove_folder, shared_folder

#: What may be reviewed for the technical approval, what for the others, and the actions of a review.
TECHNICAL_ITEMS = ("card-identity", "capture-quality", "registration", "semantic-masks", "material-maps", "matched-renders")
ACTIONS = ("open-review", "comment", "resolve-comment", "approve-item", "reject-item", *review.APPROVALS, "revoke-approval", "close-review")

FIELDS = ("action", "event_id", "item", "ledger", "requires_resolution", "reviewer", "sequence", "target")
SCHEMA = "ledger string, event_id string, sequence bigint, reviewer string, action string, item string, requires_resolution boolean, target string, digest string, previous_digest string"


@dataclass(frozen=True)
class Items:
    """The items that each approval asks for."""

    technical: tuple[str, ...] = TECHNICAL_ITEMS
    rights: str = "rights"
    production: str = "production-profile"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def create_once(spark: SparkSession, uri: str, body: str) -> bool:
    """Makes a file with that body, whole, if there is none of that name; false if there is."""
    files, path = _store(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with files.open_output_stream(draft) as out:
        out.write(body.encode())
    try:
        if isinstance(files, fs.LocalFileSystem):
            os.link(draft, path)
        else:
            hadoop, java = spark._jvm.org.apache.hadoop.fs, spark._jvm
            target = hadoop.Path(uri)
            context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
            none = spark.sparkContext._gateway.new_array(java.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(hadoop.Path(f"{uri.rsplit('/', 1)[0]}/{os.path.basename(draft)}"), target, none)
    except FileExistsError:
        return False
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        return False
    finally:
        if files.get_file_info(draft).type == fs.FileType.File:
            files.delete_file(draft)
    return True


def commits(log: str) -> list[str]:
    """The parts of the committed versions, in order. A version that others have passed is never missing."""
    files, path = _store(f"{log}/commits")
    found = sorted(f.path for f in files.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".json"))
    out = []
    for f in found:
        with files.open_input_file(f) as src:
            out.append(json.loads(src.read())["part"])
    return out


def events(spark: SparkSession, log: str, parts: list[str] | None = None) -> DataFrame:
    """All events of the log, or of some of its parts."""
    parts = commits(log) if parts is None else parts
    return spark.read.schema(SCHEMA).parquet(*[f"{log}/parts/{p}" for p in parts]) if parts else spark.createDataFrame([], SCHEMA)


def ledger_states(held: DataFrame) -> DataFrame:
    """One row a ledger: last (sequence), head (its digest), approved and rejected items, open comments (ids), active approvals (id, action)."""
    per = held.groupBy("ledger").agg(F.max("sequence").alias("last"), F.max_by("digest", "sequence").alias("head"))
    decided = held.where(F.col("action").isin("approve-item", "reject-item") & F.col("item").isNotNull()).groupBy("ledger", "item").agg(F.max_by("action", "sequence").alias("decision"))
    which = lambda a: F.collect_list(F.when(F.col("decision") == a, F.col("item")))
    items = decided.groupBy("ledger").agg(which("approve-item").alias("approved"), which("reject-item").alias("rejected"))
    open_ = review.unresolved_comments(held).groupBy("ledger").agg(F.collect_list("event_id").alias("open"))
    active = review.active_approvals(held).groupBy("ledger").agg(F.map_from_entries(F.collect_list(F.struct("event_id", "action"))).alias("active"))
    return per.join(items, "ledger", "left").join(open_, "ledger", "left").join(active, "ledger", "left")


class Ledger:
    """One ledger while its new events are judged, in order."""

    def __init__(self, held: dict, items: Items):
        get = lambda name, none: none if held.get(name) is None else held[name]
        self.items, self.last = items, int(get("last", -1))
        self.decided = {i: True for i in get("approved", [])} | {i: False for i in get("rejected", [])}
        self.open, self.active = set(get("open", [])), dict(get("active", {}))
        self.seen: dict[str, tuple[str, bool]] = {}  # of the new events: action, requires_resolution

    def dirty(self) -> list[str]:
        bad = sorted(i for i, ok in self.decided.items() if not ok)
        return [f"rejected-items:{'|'.join(bad)}"] * bool(bad) + ["unresolved-comments"] * bool(self.open)

    def missing(self, *names: str) -> list[str]:
        lacks = [n for n in names if not self.decided.get(n)]
        return [f"missing-items:{'|'.join(lacks)}"] * bool(lacks)

    def reasons(self, action: str, target: str | None, known: tuple[str, bool] | None) -> list[str]:
        """Why the event may not be appended. known: action and requires_resolution of the target, where it is in the ledger."""
        known = self.seen.get(target, known)
        if action == "resolve-comment":
            if known is None or known[0] != "comment":
                return ["no-such-comment"]
            return [] if target in self.open else ["already-resolved" if known[1] else "needs-no-resolution"]
        if action == "revoke-approval":
            if known is None or known[0] not in review.APPROVALS:
                return ["no-such-approval"]
            return [] if target in self.active else ["inactive-approval"]
        if action == "approve-technical":
            return [*self.dirty(), *self.missing(*self.items.technical)]
        if action == "approve-rights":
            return [*self.dirty(), *self.missing(self.items.rights)]
        if action == "approve-production":
            lacks = [f"no-active-{a}" for a in review.APPROVALS[:2] if a not in self.active.values()]
            return [*self.dirty(), *self.missing(self.items.production), *lacks]
        return [] if action in ACTIONS else ["unknown-action"]

    def take(self, event_id: str, action: str, item: str | None, required: bool, target: str | None) -> int:
        self.last += 1
        self.seen[event_id] = (action, required)
        if action in ("approve-item", "reject-item") and item:
            self.decided[item] = action == "approve-item"
        elif action == "comment" and required:
            self.open.add(event_id)
        elif action == "resolve-comment":
            self.open.discard(target)
        elif action in review.APPROVALS:
            self.active[event_id] = action
        elif action == "revoke-approval":
            self.active.pop(target, None)
        if action == "reject-item" or (action == "comment" and required):
            self.active.clear()
        return self.last


JUDGED = "ledger string, event_id string, place bigint, reviewer string, action string, item string, requires_resolution boolean, target string, accepted boolean, sequence bigint, reasons array<string>, head string"


GIVEN = [c.split()[0] for c in JUDGED.split(", ")[:8]]


def _judge(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of whole ledgers one after the other: first what the ledger holds, if there is any, then its new events in order."""
        own, at, head = Ledger({}, items), (), None
        for batch in batches:
            accepted, sequence, reasons, heads = [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("ledger", "event_id", "reviewer", "action", "item", "requires_resolution", "target", "target_action", "target_required", "held")]
            for ledger, event_id, reviewer, action, item, required, target, target_action, target_required, held in zip(*columns, strict=True):
                if at != (ledger,) or held is not None:
                    at, head = (ledger,), (held or {}).get("head")
                    own = Ledger(held or {}, items)
                if held is not None:
                    continue
                known = (target_action, bool(target_required)) if target_action else None
                why = ["no-ledger"] * (ledger is None) + ["no-event-id"] * (not event_id) + ["no-reviewer"] * (not (reviewer or "").strip())
                why = why or own.reasons(action, target, known)
                accepted.append(not why)
                reasons.append(why)
                sequence.append(own.take(event_id, action, item, bool(required), target) if not why else None)
                heads.append(head)
            new = batch.filter(pc.is_null(batch.column("held")))
            told = [pa.array(accepted, pa.bool_()), pa.array(sequence, pa.int64()), pa.array(reasons, pa.list_(pa.string())), pa.array(heads, pa.string())]
            yield pa.RecordBatch.from_arrays([new.column(c) for c in GIVEN] + told, [c.split()[0] for c in JUDGED.split(", ")])

    return run


def judge(held: DataFrame, new: DataFrame, items: Items = Items()) -> DataFrame:  # noqa: B008 (frozen)
    """new (all columns of an event but sequence) with accepted, sequence and reasons: every event judged by what its ledger
    holds and by those of new that were accepted before it. Of new events with one event_id the first counts.

    A task reads its ledgers as one sorted stream, so neither the number of ledgers nor the length of one is a matter of calls or of groups held."""
    first = F.row_number().over(Window.partitionBy("event_id").orderBy("place", "ledger"))
    once = new.withColumn("_n", F.when(F.col("event_id").isNull(), 1).otherwise(first)).where("_n = 1").drop("_n")
    touched = held.join(new.select("ledger").distinct(), "ledger", "left_semi")
    about = touched.select("ledger", F.col("event_id").alias("target"), F.col("action").alias("target_action"), F.coalesce("requires_resolution", F.lit(False)).alias("target_required"))
    asked = once.join(about, ["ledger", "target"], "left").select(*GIVEN, "target_action", "target_required")
    states = ledger_states(touched)
    states = states.select("ledger", F.struct(*[c for c in states.columns if c != "ledger"]).alias("held"))
    rows = asked.unionByName(states, allowMissingColumns=True).repartition("ledger")
    in_order = rows.sortWithinPartitions("ledger", F.col("held").isNull(), F.col("place").asc_nulls_last(), F.col("event_id").asc_nulls_last())
    return in_order.mapInArrow(_judge(items), JUDGED)


def append(spark: SparkSession, log: str, new: DataFrame, items: Items = Items(), attempts: int = 50, before_commit: Callable[[int], None] | None = None) -> DataFrame:  # noqa: B008
    """Appends the events that the guards let pass. Returns ledger, event_id, accepted, sequence, reasons and version (of the
    commit that has the event), one row for each event_id of new. before_commit: called with the number of the attempt, for tests."""
    for attempt in range(attempts):
        parts = commits(log)
        held = events(spark, log, parts)
        there = held.select("event_id", F.col("sequence").alias("_sequence"), F.lit(True).alias("_there"))
        asked, at = shared_folder(spark, "asked"), shared_folder(spark, "judged")
        new.select(*GIVEN).join(there, "event_id", "left").write.parquet(asked)  # new may be costly: it is computed once an attempt
        given = spark.read.parquet(asked)
        judge(held, given.where("_there IS NULL").select(*GIVEN), items).write.parquet(at)
        judged = spark.read.schema(JUDGED).parquet(at)
        good = judged.where("accepted")
        again = given.where("_there").groupBy("event_id", "_sequence").agg(F.min("ledger").alias("ledger")).select("ledger", "event_id", F.lit(True).alias("accepted"), F.col("_sequence").alias("sequence"), F.array().cast("array<string>").alias("reasons"))
        version = None
        if good.head(1):
            version, part = len(parts), uuid.uuid4().hex
            order = Window.partitionBy("ledger").orderBy("sequence")
            chained = good.withColumn("digest", canonical_digest(*map(F.col, FIELDS))).withColumn("previous_digest", F.coalesce(F.lag("digest").over(order), F.col("head")))
            chained.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.parquet(f"{log}/parts/{part}")
            if before_commit:
                before_commit(attempt)
            if not create_once(spark, f"{log}/commits/{version:020d}.json", json.dumps({"part": part})):
                for folder in (f"{log}/parts/{part}", asked, at):
                    remove_folder(folder)
                continue
        out = shared_folder(spark, "appended")
        mine = judged.select("ledger", "event_id", "accepted", "sequence", "reasons", F.when(F.col("accepted"), version).cast("int").alias("version"))
        mine.unionByName(again.withColumn("version", F.lit(None).cast("int"))).write.parquet(out)
        remove_folder(asked)
        remove_folder(at)
        return spark.read.schema(mine.schema).parquet(out)
    raise RuntimeError(f"other writers were first {attempts} times")


def breaks(log_events: DataFrame) -> DataFrame:
    """(ledger, sequence, fault): events whose place, digest or link does not hold, and event_ids that are there twice."""
    order = Window.partitionBy("ledger").orderBy("sequence")
    own = log_events.withColumns({"_place": F.row_number().over(order) - 1, "_before": F.lag("digest").over(order), "_digest": canonical_digest(*map(F.col, FIELDS))})
    fault = F.when(F.col("sequence") != F.col("_place"), "sequence").when(~F.col("digest").eqNullSafe(F.col("_digest")), "digest").when(~F.col("previous_digest").eqNullSafe(F.col("_before")), "link")
    wrong = own.withColumn("fault", fault).where("fault IS NOT NULL").select("ledger", "sequence", "fault")
    twice = log_events.groupBy("event_id").agg(F.count("*").alias("n"), F.max(F.struct("ledger", "sequence")).alias("s")).where("n > 1").select("s.ledger", "s.sequence", F.lit("event-id").alias("fault"))
    return wrong.unionByName(twice)
