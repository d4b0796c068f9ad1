"""Promotion ledgers with nulls, several profiles and blank fields, and the stream of shuffled events against the batch."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import ledger, promotion
from quillon.streaming import ledgers, promotions

SCHEMA = (
    "ledger string, sequence bigint, profile_id string, action string, lane string, revision bigint, from_state string, to_state string, fingerprint map<string,string>, actor string, actor_type string, "
    "source_session string, input_hashes int, evidence_packet string, metrics int, technical_reviewer string, rights_status string, rights_reviewer string, reference_bundle_id string, "
    "source_quality_tier string, adversarial_review string, reason string, schema_version string, created_at timestamp"
)
FULL = {
    "ledger": "l", "profile_id": "p", "action": "promote", "lane": None, "revision": 1, "fingerprint": {}, "actor": "ann", "actor_type": "human", "source_session": "s", "input_hashes": 1, "evidence_packet": "e", "metrics": 1,
    "technical_reviewer": "t", "rights_status": "cleared", "rights_reviewer": "r", "reference_bundle_id": "b", "source_quality_tier": "A", "adversarial_review": "a", "reason": None, "schema_version": "1.1.0",
}
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def ladder(lane=None, **more):
    """A valid ledger up to the top of a lane."""
    states = promotion.STATES[lane or "physical"]
    return [FULL | {"lane": lane, "action": "promote" if k else "open-revision", "from_state": states[k - 1] if k else None, "to_state": s} | more for k, s in enumerate(states)]


def frame(spark, events, start="2024-01-01"):
    from datetime import datetime, timedelta

    t = datetime.fromisoformat(start)
    rows = [tuple((FULL | e | {"sequence": e.get("sequence", k), "created_at": t + timedelta(minutes=k)}).get(n) for n in NAMES) for k, e in enumerate(events)]
    return spark.createDataFrame(rows, SCHEMA)


def reasons(spark, events):
    return [r.reasons for r in promotion.violations(frame(spark, events)).orderBy("sequence").collect()]


@pytest.mark.parametrize("lane", [None, "physical", "reference"])
def test_whole_ladders_hold(spark, lane):
    got = reasons(spark, ladder(lane))
    assert got == [[]] * len(promotion.STATES[lane or "physical"])


def test_nulls_fail_closed(spark):
    start = ladder()[:3]
    step = ladder()[3]
    assert reasons(spark, [*start, step | {"actor_type": None}])[3] == ["unknown-actor-type", "human-only"]
    assert "revision-not-next" in reasons(spark, [ladder()[0] | {"revision": None}])[0]
    assert reasons(spark, [*start, step | {"revision": None}])[3] == ["other-revision"]
    jump = {"lane": None, "actor_type": "agent", "from_state": "hypothesis", "to_state": "production-validated", "evidence_packet": None, "metrics": None, "source_session": None, "technical_reviewer": None, "rights_reviewer": None, "rights_status": None, "input_hashes": None}
    assert reasons(spark, [ladder()[0], FULL | jump])[1] == ["not-one-step", "human-only", "no-source-session", "no-input-hashes", "no-evidence", "no-metrics", "no-technical-reviewer", "no-rights-status", "no-rights-reviewer"]
    assert "unknown-action" in reasons(spark, [ladder()[0] | {"action": None}])[0]
    assert "unknown-state" in reasons(spark, [*start, step | {"to_state": None}])[3]
    assert "unknown-state" in reasons(spark, [*start, step | {"to_state": "exact-variant-verified"}])[3]
    assert reasons(spark, [*start, step | {"lane": "reference", "to_state": "exact-variant-verified"}])[3] == ["other-lane", "not-one-step"]
    assert reasons(spark, [*start, step | {"fingerprint": None}])[3] == []


def test_records_by_themselves(spark):
    first, second = ladder()[:2]
    down = second | {"action": "demote", "from_state": "public-reference-supported", "to_state": "hypothesis"}
    assert reasons(spark, [first, second, down])[2] == ["no-demotion-reason"]
    assert reasons(spark, [first, second, down | {"reason": "failed", "actor": " "}])[2] == ["no-actor"]
    assert reasons(spark, [first | {"schema_version": "2.0.0"}])[0] == ["unknown-schema"]
    assert reasons(spark, [ladder("reference")[0] | {"schema_version": "1.0.0"}])[0] == ["schema-without-lane"]


def test_profiles_of_one_ledger_do_not_meet(spark):
    a, b = ladder("reference", profile_id="a"), ladder(profile_id="b")
    mixed = [e for pair in zip(a, b) for e in pair] + b[len(a) :]  # noqa: B905
    assert reasons(spark, mixed) == [[]] * len(mixed)
    state = {r.profile_id: (r.revision, r.state, r.lane) for r in promotion.current(frame(spark, mixed)).collect()}
    assert state == {"a": (1, "production-reference-derived", "reference"), "b": (1, "production-validated", "physical")}


def test_fingerprints_hold_within_a_revision(spark):
    digest = hashlib.sha256(b"x").hexdigest()
    events = [e | {"fingerprint": {"camera": "c1"} if k != 2 else {"lens": "l"}} for k, e in enumerate(ladder()[:4])]
    assert reasons(spark, events) == [[]] * 4
    events[3]["fingerprint"] = {"camera": "c2", "lens": None}
    assert reasons(spark, events)[3] == ["fingerprint-changed"]
    new = FULL | {"action": "open-revision", "revision": 2, "to_state": "hypothesis", "fingerprint": {"camera": "c2", "bundle-tier-record": digest}}
    assert reasons(spark, [*events[:3], new]) == [[]] * 4
    assert [r.fingerprint for r in promotion.current(frame(spark, [*events[:3], new])).collect()] == [new["fingerprint"]]
    assert [r.fingerprint for r in promotion.current(frame(spark, events[:3])).collect()] == [{"camera": "c1", "lens": "l"}]


def test_replay_checks_the_chain(spark):
    fields = [F.col(c) for c in ("action", "revision", "sequence", "to_state")]
    held = ledger.chain(frame(spark, ladder()), "ledger", "sequence", fields)
    assert promotion.replay(held, ledger.chain_breaks(held, "ledger", "sequence", fields, "digest", "previous_digest")).collect() == []
    edited = held.withColumn("revision", F.when(F.col("sequence") == 3, 2).otherwise(F.col("revision")))
    breaks = ledger.chain_breaks(edited, "ledger", "sequence", fields, "digest", "previous_digest")
    assert [tuple(r) for r in promotion.replay(edited, breaks).collect()] == [("l", 3, "broken-chain")]


def test_the_stream_equals_the_batch_in_any_order(spark, tmp_path):
    rng = random.Random(9)
    events = []
    for name in ("l1", "l2", None):
        a, b = ladder("reference", profile_id="a", ledger=name), ladder(profile_id=None, ledger=name)
        own = [e | {"fingerprint": {"camera": f"c{rng.randrange(2)}"}} for pair in zip(a, b) for e in pair]  # noqa: B905
        own.insert(5, own[4] | {"actor_type": None, "revision": None})
        events += [e | {"sequence": k} for k, e in enumerate(own)]
    df = frame(spark, events)
    want = promotion.violations(df)
    source = str(tmp_path / "in")
    for k in range(4):  # files in which the order of a ledger is lost
        df.withColumn("k", F.pmod(F.xxhash64("ledger", "sequence"), F.lit(4))).where(f"k = {k}").drop("k").orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = promotions.judged_stream(ledgers.event_stream(spark, source, files_each=1), "created_at", late_seconds=10**6)
        ledgers.drain(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    say = lambda d: sorted(map(str, d.select("ledger", "sequence", "profile_id", "known", "latest_state", "latest_revision", "latest_lane", "changed", "reasons").collect()))
    assert say(spark.read.parquet(str(tmp_path / "out"))) == say(want)
