"""Review ledgers: the state that items, required comments and approvals leave a session in.

An event has ledger, sequence, event_id, action, item, requires_resolution and target (the event_id that a resolve-comment
or revoke-approval is about).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Approvals, in the order in which they count.
APPROVALS = ("approve-technical", "approve-rights", "approve-production")


def unresolved_comments(events: DataFrame) -> DataFrame:
    """Comments that require a resolution and have no later one: ledger, event_id, sequence."""
    asked = events.where((F.col("action") == "comment") & F.col("requires_resolution")).select("ledger", "event_id", "sequence")
    return _without(asked, events.where(F.col("action") == "resolve-comment"))


def _without(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """rows (ledger, event_id, sequence) that no later answer has as its target."""
    last = answers.groupBy("ledger", F.col("target").alias("event_id")).agg(F.max("sequence").alias("_answer"))
    return rows.join(last, ["ledger", "event_id"], "left").where("_answer IS NULL OR _answer < sequence").drop("_answer")


def active_approvals(events: DataFrame) -> DataFrame:
    """Approvals that still cover what was reviewed: no later rejection or required comment in the ledger, not revoked."""
    regress = (F.col("action") == "reject-item") | ((F.col("action") == "comment") & F.col("requires_resolution"))
    last = events.where(regress).groupBy("ledger").agg(F.max("sequence").alias("_last"))
    given = events.where(F.col("action").isin(*APPROVALS)).select("ledger", "event_id", "sequence", "action")
    standing = given.join(last, "ledger", "left").where("_last IS NULL OR sequence > _last").drop("_last")
    return _without(standing, events.where(F.col("action") == "revoke-approval"))


def status(events: DataFrame) -> DataFrame:
    """ledger, events, rejected (items whose last decision is a rejection), unresolved, state: needs-revision while an item is
    rejected or a required comment open, else the highest of production-approved, rights-approved and technically-approved of
    which all approvals are active, else unreviewed."""
    per = events.groupBy("ledger").agg(F.count("*").alias("events"))
    decided = events.where(F.col("action").isin("approve-item", "reject-item") & F.col("item").isNotNull()).groupBy("ledger", "item").agg(F.max_by("action", "sequence").alias("last"))
    rejected = decided.groupBy("ledger").agg(F.count_if(F.col("last") == "reject-item").alias("rejected"))
    open_ = unresolved_comments(events).groupBy("ledger").agg(F.count("*").alias("unresolved"))
    have = active_approvals(events).groupBy("ledger").agg(F.collect_set("action").alias("_have"))
    all_ = per.join(rejected, "ledger", "left").join(open_, "ledger", "left").join(have, "ledger", "left").na.fill(0, ["rejected", "unresolved"])
    technical, rights, production = (F.coalesce(F.array_contains("_have", a), F.lit(False)) for a in APPROVALS)
    state = (
        F.when((F.col("rejected") > 0) | (F.col("unresolved") > 0), "needs-revision")
        .when(technical & rights & production, "production-approved")
        .when(technical & rights, "rights-approved")
        .when(technical, "technically-approved")
        .otherwise("unreviewed")
    )
    return all_.select("ledger", "events", "rejected", "unresolved", state.alias("state"))
