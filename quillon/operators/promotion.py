"""Promotion ledgers of two lanes: every event held against the state machine, and the replay of whole ledgers.

An event has ledger, sequence, action (open-revision, promote, demote), lane, revision, from_state, to_state, fingerprint (a
map) and what requirements ask for: actor_type, source_session, input_hashes, evidence_packet, metrics (numbers of both),
technical_reviewer, rights_status, rights_reviewer, reference_bundle_id, source_quality_tier, adversarial_review. It may have
profile_id (a ledger without it is of one profile), and actor, reason and schema_version: rules about those hold where they are.

Rules fail closed: what is null breaks every rule that needs it, but a null lane is the physical one and nulls in a
fingerprint say nothing. with_latest adds what came before an event; judged is plain columns, so that the streaming twin
(streaming/promotions.py) shares every rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import gates
from quillon.operators.joins import on_equal

#: The states of both lanes, lowest first.
STATES = {
    "physical": (
        "hypothesis", "public-reference-supported", "authenticated-capture-ingested", "quality-approved", "registration-approved", "masks-proposed",
        "masks-reviewed", "material-maps-proposed", "material-maps-reviewed", "profile-fitted", "render-reviewed", "capture-validated", "production-validated",
    ),
    "reference": (
        "hypothesis", "exact-variant-verified", "public-reference-supported", "reference-assets-proposed", "reference-profile-fitted", "adversarial-review-passed",
        "internal-reference-prototype", "production-reference-derived",
    ),
}
#: States that only a person may set, and states that a revision may begin with.
HUMAN_ONLY = {
    "physical": ("quality-approved", "registration-approved", "masks-reviewed", "material-maps-reviewed", "render-reviewed", "capture-validated", "production-validated"),
    "reference": ("exact-variant-verified", "adversarial-review-passed", "internal-reference-prototype", "production-reference-derived"),
}
#: Kinds of actors and events, and versions of the event's schema, of which the first has no reference lane.
ACTORS, ACTIONS, VERSIONS = ("human", "agent", "ci"), ("open-revision", "promote", "demote"), ("1.0.0", "1.1.0")
ENTRY = {"physical": ("hypothesis", "public-reference-supported", "authenticated-capture-ingested"), "reference": ("hypothesis",)}


def rank(lane: Column, state: Column) -> Column:
    """The state's place in its lane, null where the lane does not have it."""
    pairs = [F.lit(x) for name, states in STATES.items() for k, s in enumerate(states) for x in (f"{name}/{s}", k)]
    return F.try_element_at(F.create_map(*pairs), F.concat_ws("/", lane, state))


def _of(lane: Column, table: dict[str, tuple[str, ...]], state: Column) -> Column:
    return F.when(lane == "physical", state.isin(*table["physical"])).otherwise(state.isin(*table["reference"]))


def lane_of(lane: Column) -> Column:
    """The lane that counts: where none is given, the physical one."""
    return F.coalesce(lane, F.lit("physical"))


def with_latest(events: DataFrame) -> DataFrame:
    """Adds what the ledger said of the event's profile before it: known (whether anything), latest_state, latest_revision,
    latest_lane (a revision's lane is that of its first event) and changed, whether a part of the fingerprint differs from its
    last value in the revision. One shuffle and sort of the events, and one of the parts of fingerprints."""
    profile = F.coalesce(F.col("profile_id"), F.lit("")) if "profile_id" in events.columns else F.lit("")
    own = events.withColumn("_profile", profile)
    w = Window.partitionBy("ledger", "_profile").orderBy("sequence")
    own = own.withColumns({"latest_state": F.lag("to_state").over(w), "latest_revision": F.lag("revision").over(w), "known": F.coalesce(F.lag(F.lit(True)).over(w), F.lit(False))})
    first = ~F.col("known") | ~F.col("revision").eqNullSafe(F.col("latest_revision"))
    own = own.withColumns({"_run": F.sum(first.cast("int")).over(w), "_lane": F.last(F.when(first, lane_of(F.col("lane"))), ignorenulls=True).over(w)}).withColumn("latest_lane", F.lag("_lane").over(w))
    parts = own.select("ledger", "_profile", "_run", "sequence", F.explode("fingerprint").alias("name", "value")).where("value IS NOT NULL")
    was = F.lag("value").over(Window.partitionBy("ledger", "_profile", "_run", "name").orderBy("sequence"))
    changed = parts.withColumn("was", was).where("was <> value").select("ledger", "_profile", "sequence", F.lit(True).alias("changed")).distinct()
    out = on_equal(own, changed, ["ledger", "_profile", "sequence"], "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
    return out.drop("_run", "_lane", "_profile")


def _requirements() -> list[tuple[str, Column]]:
    """What an event lacks that its target state asks for, by lane; demotions lack nothing."""
    lane, target = lane_of(F.col("lane")), F.col("to_state")
    at = rank(lane, target)
    person = _of(lane, HUMAN_ONLY, target)
    from_ = lambda name, state: (lane == name) & (at >= STATES[name].index(state))
    no = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    tier, rights = F.coalesce("source_quality_tier", F.lit("")), F.coalesce("rights_status", F.lit("unknown")) == "unknown"
    assets = from_("reference", "reference-assets-proposed")
    record = F.coalesce(F.col("fingerprint")["bundle-tier-record"], F.lit("")).rlike("^[0-9a-f]{64}$")
    return [
        ("human-only", person & (F.col("actor_type") != "human")),
        ("no-source-session", from_("physical", "authenticated-capture-ingested") & no("source_session")),
        ("tier-c", (lane == "reference") & (tier == "C")),
        ("no-reference-bundle", from_("reference", "exact-variant-verified") & no("reference_bundle_id")),
        ("no-input-hashes", (from_("physical", "authenticated-capture-ingested") | from_("reference", "public-reference-supported")) & none("input_hashes")),
        ("no-tier", assets & ~tier.isin("A", "B")),
        ("no-tier-record", assets & (tier == "B") & ~record),
        ("no-evidence", (from_("physical", "quality-approved") | assets) & no("evidence_packet")),
        ("no-metrics", (from_("physical", "profile-fitted") | from_("reference", "reference-profile-fitted")) & none("metrics")),
        ("no-adversarial-review", from_("reference", "internal-reference-prototype") & no("adversarial_review")),
        ("no-technical-reviewer", person & no("technical_reviewer")),
        ("no-rights-status", (assets | ((lane == "physical") & target.isin("capture-validated", "production-validated"))) & rights),
        ("no-rights-reviewer", target.isin("production-validated", "production-reference-derived") & no("rights_reviewer")),
    ]


def _shape(columns: list[str]) -> list[tuple[str, Column]]:
    """Rules for an event by itself, as far as the table has the columns."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rules = {
        "action": ("unknown-action", ~F.col("action").isin(*ACTIONS)),
        "actor": ("no-actor", blank("actor")),
        "reason": ("no-demotion-reason", (F.col("action") == "demote") & blank("reason")),
        "schema_version": ("unknown-schema", ~F.col("schema_version").isin(*VERSIONS)),
    }
    out = [rule for column, rule in rules.items() if column in columns]
    out.append(("unknown-actor-type", ~F.col("actor_type").isin(*ACTORS)))
    if "schema_version" in columns:
        out.append(("schema-without-lane", (lane_of(F.col("lane")) == "reference") & (F.col("schema_version") == VERSIONS[0])))
    return out


def judged(events: DataFrame) -> DataFrame:
    """events with what with_latest adds, and reasons: every rule that the event breaks, in a fixed order; none for a valid event."""
    action, lane, target = F.coalesce(F.col("action"), F.lit("")), lane_of(F.col("lane")), F.col("to_state")
    opens, known = action == "open-revision", F.col("known")
    at, was = rank(lane, target), rank(lane, F.col("latest_state"))
    rules = [
        *_shape(events.columns),
        ("revision-not-next", opens & (F.col("revision") != F.coalesce("latest_revision", F.lit(0)) + 1)),
        ("not-an-entry-state", opens & ~_of(lane, ENTRY, target)),
        ("no-open-revision", ~opens & ~known),
        ("other-revision", ~opens & known & (F.col("revision") != F.col("latest_revision"))),
        ("other-lane", ~opens & known & (lane != F.col("latest_lane"))),
        ("other-from-state", ~opens & known & ~F.col("from_state").eqNullSafe(F.col("latest_state"))),
        ("fingerprint-changed", ~opens & known & F.col("changed")),
        ("not-one-step", (action == "promote") & ~at.eqNullSafe(F.coalesce(was, F.when(~known, -1)) + 1)),
        ("not-earlier", (action == "demote") & ~F.coalesce(at < was, F.lit(False))),
        ("unknown-state", at.isNull()),
        *[(name, (action != "demote") & lacks) for name, lacks in _requirements()],
    ]
    return events.withColumn("reasons", gates.reasons([(broken, name) for name, broken in rules]))


def violations(events: DataFrame) -> DataFrame:
    """The events with what their ledgers said before and the reasons against them."""
    return judged(with_latest(events))


def replay(events: DataFrame, breaks: DataFrame | None = None) -> DataFrame:
    """The first event of each ledger that the state machine refuses: ledger, sequence, reason (the first). Ledgers that hold
    have no row. breaks (ledger, first_bad), as ledger.chain_breaks finds them: events whose digest or link does not hold."""
    wrong = violations(events).where(F.size("reasons") > 0).select("ledger", "sequence", F.col("reasons")[0].alias("reason"), F.lit(1).alias("_order"))
    if breaks is not None:
        wrong = wrong.unionByName(breaks.select("ledger", F.col("first_bad").alias("sequence"), F.lit("broken-chain").alias("reason"), F.lit(0).alias("_order")))
    return wrong.groupBy("ledger").agg(F.min(F.struct("sequence", "_order", "reason")).alias("first")).select("ledger", "first.sequence", "first.reason")


def current(events: DataFrame) -> DataFrame:
    """ledger, profile_id, revision, state, lane and fingerprint of each profile after its last event: of its last revision, the
    lane of the first event and the last value of each part of the fingerprint."""
    keys = ["ledger", "profile_id"]
    latest = with_latest(events)
    starts = latest.where(~F.col("known") | ~F.col("revision").eqNullSafe(F.col("latest_revision"))).groupBy(*keys).agg(F.max_by(F.struct("sequence", lane_of(F.col("lane")).alias("lane")), "sequence").alias("_start"))
    last = events.groupBy(*keys).agg(F.max_by(F.struct("revision", "to_state"), "sequence").alias("_last"))
    heads = on_equal(last, starts, keys)
    parts = on_equal(events.select(*keys, "sequence", "fingerprint"), heads, keys).where(F.col("sequence") >= F.col("_start.sequence")).select(*keys, "sequence", F.explode("fingerprint").alias("name", "value")).where("value IS NOT NULL")
    print_ = parts.groupBy(*keys, "name").agg(F.max_by("value", "sequence").alias("value")).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("_print"))
    out = on_equal(heads, print_, keys, "left")
    return out.select(*keys, F.col("_last.revision").alias("revision"), F.col("_last.to_state").alias("state"), F.col("_start.lane").alias("lane"), F.coalesce("_print", F.create_map().cast("map<string,string>")).alias("fingerprint"))
