"""Append-only ledgers: chain checks, folds to the current state, guarded transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import canonical_digest


def ledger(df: DataFrame, key: str, at: str, event_id: str) -> DataFrame:
    """Adds sequence, from 0 in each ledger by time and id."""
    return df.withColumn("sequence", F.row_number().over(Window.partitionBy(key).orderBy(at, event_id)) - 1)


def sequence_breaks(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """The first row of each ledger whose sequence is not its position: key, expected, found."""
    order = Window.partitionBy(key).orderBy(sequence)
    placed = df.withColumn("expected", F.row_number().over(order) - 1).where(F.col(sequence) != F.col("expected"))
    return placed.groupBy(key).agg(F.min("expected").alias("expected"), F.min(sequence).alias("found"))


def chain(df: DataFrame, key: str, sequence: str, fields: Sequence[Column]) -> DataFrame:
    """Adds digest (of the fields) and previous_digest (of the event before, null for the first)."""
    order = Window.partitionBy(key).orderBy(sequence)
    return df.withColumn("digest", canonical_digest(*fields)).withColumn("previous_digest", F.lag("digest").over(order))


def chain_breaks(df: DataFrame, key: str, sequence: str, fields: Sequence[Column], digest: str, previous: str) -> DataFrame:
    """The first event of each ledger whose digest or link does not hold."""
    order = Window.partitionBy(key).orderBy(sequence)
    wrong = (F.col(digest) != canonical_digest(*fields)) | ~F.col(previous).eqNullSafe(F.lag(digest).over(order))
    return df.withColumn("_wrong", wrong).where("_wrong").groupBy(key).agg(F.min(sequence).alias("first_bad"))


def standing_approvals(df: DataFrame, key: str, sequence: str, approves: Column, regresses: Column) -> DataFrame:
    """Approvals that no later regression of the same ledger invalidates. Because a regression invalidates all before it,
    the last regression of each ledger decides: an aggregate and a join, no window over a whole ledger."""
    last = df.where(regresses).groupBy(key).agg(F.max(sequence).alias("_last"))
    return df.where(approves).join(last, key, "left").where(F.col("_last").isNull() | (F.col(sequence) > F.col("_last"))).drop("_last")


def current_state(df: DataFrame, key: str, sequence: str, state: str) -> DataFrame:
    """The state of each ledger's last event, with the number of events."""
    return df.groupBy(key).agg(F.max_by(state, sequence).alias("state"), F.count("*").alias("events"))


def review_ladder(df: DataFrame, key: str, sequence: str, action: str, comment: str, resolve: str, ladder: Sequence[tuple[str, str]], regress: str) -> DataFrame:
    """The review state of each ledger: needs-revision while comments are open or a regression came last, else the highest
    rung reached without a gap by approvals that stand. ladder: (approving action, state), lowest first."""
    steps = standing_approvals(df, key, sequence, F.col(action).isin(*[a for a, _ in ladder]), F.col(action) == regress)
    have = steps.groupBy(key).agg(F.collect_set(action).alias("have"))
    marks = df.groupBy(key).agg(F.count_if(F.col(action) == comment).alias("comments"), F.count_if(F.col(action) == resolve).alias("resolved"), F.max(F.when(F.col(action) == regress, F.col(sequence))).alias("_reg"), F.max(F.when(F.col(action).isin(*[a for a, _ in ladder]), F.col(sequence))).alias("_app"))
    state = F.lit("unreviewed")
    for i in range(len(ladder)):
        all_so_far = F.lit(True)
        for a, _ in ladder[: i + 1]:
            all_so_far = all_so_far & F.coalesce(F.array_contains("have", a), F.lit(False))
        state = F.when(all_so_far, ladder[i][1]).otherwise(state)
    dirty = (F.col("comments") > F.col("resolved")) | F.coalesce(F.col("_reg") > F.coalesce("_app", F.lit(-1)), F.lit(False))
    return marks.join(have, key, "left").select(key, F.when(dirty, "needs-revision").otherwise(state).alias("state"), "comments", "resolved")


def transition_violations(df: DataFrame, key: str, sequence: str, state: str, order: Sequence[str]) -> DataFrame:
    """Steps that climb more than one rank at once, or begin above the first: key, sequence, from_state, to_state."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, i)]), F.col(state))
    steps = df.withColumn("_rank", rank).withColumn("from_state", F.lag(state).over(Window.partitionBy(key).orderBy(sequence))).withColumn("_from", F.lag("_rank").over(Window.partitionBy(key).orderBy(sequence)))
    return steps.where(F.col("_rank") > F.coalesce(F.col("_from"), F.lit(-1)) + 1).select(key, sequence, "from_state", F.col(state).alias("to_state"))


def fingerprints(df: DataFrame, key: str, sequence: str, name: Column, value: Column) -> DataFrame:
    """The last non-null value of each name of each ledger: as-of lookups folded to rows."""
    return df.select(key, sequence, name.alias("name"), value.alias("value")).where("value IS NOT NULL").groupBy(key, "name").agg(F.max_by("value", sequence).alias("value"))
