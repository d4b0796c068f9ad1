"""Guarded appends: every guard, writers that meet, retries and repeats, against a plain fold."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from quillon.operators import review
from quillon.sources import commit_log as cl

SCHEMA = "ledger string, event_id string, place bigint, reviewer string, action string, item string, requires_resolution boolean, target string"
SMALL = cl.Items(technical=("i0", "i1"), rights="i2", production="i3")


def event(event_id, action, item=None, required=None, target=None, ledger="l", reviewer="ann", place=0):
    return (ledger, event_id, place, reviewer, action, item, required, target)


def frame(spark, rows):
    return spark.createDataFrame([(r[0], r[1], k, *r[3:]) for k, r in enumerate(rows)], SCHEMA)


def outcome(spark, log, rows, **how):
    return {r.event_id: r.reasons for r in cl.append(spark, log, frame(spark, rows), SMALL, **how).collect()}


def test_every_guard(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    got = outcome(spark, log, [
        event("c1", "comment", required=True), event("c2", "comment"), event("r1", "resolve-comment", target="c2"), event("r2", "resolve-comment", target="none"), event("t1", "approve-technical"),
        event("r3", "resolve-comment", target="c1"), event("r4", "resolve-comment", target="c1"), event("a0", "approve-item", "i0"), event("t2", "approve-technical"), event("a1", "approve-item", "i1"), event("t3", "approve-technical"),
        event("g1", "approve-rights"), event("a2", "approve-item", "i2"), event("g2", "approve-rights"), event("p1", "approve-production"), event("a3", "approve-item", "i3"), event("p2", "approve-production"),
        event("v1", "revoke-approval", target="a3"), event("v2", "revoke-approval", target="g2"), event("v3", "revoke-approval", target="g2"), event("p3", "approve-production"), event("x", "dance"), event(None, "comment"), event("y", "comment", reviewer=" "),
    ])
    assert got == {
        "c1": [], "c2": [], "r1": ["needs-no-resolution"], "r2": ["no-such-comment"], "t1": ["unresolved-comments", "missing-items:i0|i1"], "r3": [], "r4": ["already-resolved"], "a0": [], "t2": ["missing-items:i1"], "a1": [], "t3": [],
        "g1": ["missing-items:i2"], "a2": [], "g2": [], "p1": ["missing-items:i3"], "a3": [], "p2": [], "v1": ["no-such-approval"], "v2": [], "v3": ["inactive-approval"], "p3": ["no-active-approve-rights"], "x": ["unknown-action"], None: ["no-event-id"], "y": ["no-reviewer"],
    }
    later = outcome(spark, log, [event("r5", "resolve-comment", target="c1"), event("j", "reject-item", "i1"), event("v4", "revoke-approval", target="t3"), event("g3", "approve-rights"), event("c1", "comment")])
    assert later == {"r5": ["already-resolved"], "j": [], "v4": ["inactive-approval"], "g3": ["rejected-items:i1"], "c1": []}
    held = cl.events(spark, log)
    assert cl.breaks(held).collect() == [] and held.count() == 12
    assert [r.fault for r in cl.breaks(held.withColumn("action", F.when(F.col("event_id") == "a0", "reject-item").otherwise(F.col("action")))).collect()] == ["digest"]
    assert {r.fault for r in cl.breaks(held.where("event_id <> 'a0'")).collect()} == {"sequence"}


def test_a_writer_that_comes_second_judges_anew(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    outcome(spark, log, [event("a0", "approve-item", "i0"), event("a1", "approve-item", "i1")])

    def other(attempt):
        if attempt == 0:
            assert outcome(spark, log, [event("j", "reject-item", "i1"), event("o", "open-review", ledger="other")]) == {"j": [], "o": []}

    got = cl.append(spark, log, frame(spark, [event("t", "approve-technical"), event("n", "comment", ledger="third")]), SMALL, before_commit=other).collect()
    assert {r.event_id: (r.accepted, r.reasons, r.version) for r in got} == {"t": (False, ["rejected-items:i1", "missing-items:i1"], None), "n": (True, [], 2)}
    held = cl.events(spark, log)
    assert cl.breaks(held).collect() == [] and [r.event_id for r in held.where("ledger = 'l'").orderBy("sequence").collect()] == ["a0", "a1", "j"]
    again = cl.append(spark, log, frame(spark, [event("n", "comment", ledger="third")]), SMALL).collect()
    assert [(r.accepted, r.sequence) for r in again] == [(True, 0)] and cl.events(spark, log).count() == 5


def plain(rows):
    """The fold of one writer's events, by review's own rules on what was accepted."""
    state, out = {}, {}
    for r in rows:
        own = state.setdefault(r[0], cl.Ledger({}, SMALL))
        why = own.reasons(r[4], r[7], own.seen.get(r[7]))
        out[r[1]] = why
        if not why:
            own.take(r[1], r[4], r[5], bool(r[6]), r[7])
    return out


def test_batches_equal_one_fold(spark, tmp_path):
    rng = random.Random(6)
    actions = ["comment", "resolve-comment", "approve-item", "approve-item", "reject-item", *review.APPROVALS, "revoke-approval"]
    rows = []
    for k in range(160):
        name = rng.choice("pqr")
        before = [r[1] for r in rows if r[0] == name]
        rows.append(event(f"e{k:03d}", rng.choice(actions), rng.choice(["i0", "i1", "i2", "i3"]), rng.random() < 0.3, rng.choice(before) if before and rng.random() < 0.9 else None, ledger=name))
    want, got = plain(rows), {}
    for start in (0, 50, 51, 120):
        end = {0: 50, 50: 51, 51: 120, 120: 160}[start]
        got |= outcome(spark, f"file://{tmp_path}/log", rows[start:end])
    assert got == want and sum(not w for w in want.values()) > 60
    held = cl.events(spark, f"file://{tmp_path}/log")
    assert cl.breaks(held).collect() == []
    assert {r.ledger: r.state for r in review.status(held).collect()}.keys() == {"p", "q", "r"}


def test_two_writers_at_once(spark, tmp_path):
    log, errors = f"file://{tmp_path}/log", []

    def write(name):
        try:
            for k in range(3):
                outcome(spark, log, [event(f"{name}{k}", "approve-item", "i0"), event(f"{name}{k}own", "comment", ledger=name)])
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in ("u", "w")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    held = cl.events(spark, log)
    assert not errors and held.count() == 12 and cl.breaks(held).collect() == [] and len(cl.commits(log)) == 6


@pytest.mark.parametrize("body", ["a", "b"])
def test_a_file_is_made_once(spark, tmp_path, body):
    uri = f"file://{tmp_path}/x/1.json"
    assert cl.create_once(spark, uri, body) and not cl.create_once(spark, uri, "other")
    assert (tmp_path / "x/1.json").read_text() == body and len(list((tmp_path / "x").iterdir())) == 1
