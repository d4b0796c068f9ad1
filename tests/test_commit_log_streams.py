"""Judging reads a task's ledgers as one stream: ledgers longer than a batch, with what they hold, equal one fold."""

import random

from quillon.operators import review
from quillon.sources import commit_log as cl
from test_commit_log import SMALL, event, frame, plain


def test_ledgers_run_across_batches(spark, tmp_path):
    rng = random.Random(8)
    actions = ["comment", "resolve-comment", "approve-item", "approve-item", "reject-item", *review.APPROVALS, "revoke-approval"]
    rows = []
    for k in range(150):
        name = f"l{rng.randrange(12) ** 2 // 20}"
        before = [r[1] for r in rows if r[0] == name]
        rows.append(event(f"e{k:03d}", rng.choice(actions), rng.choice(["i0", "i1", "i2", "i3"]), rng.random() < 0.3, rng.choice(before) if before and rng.random() < 0.9 else None, ledger=name))
    odd = [event("n0", "comment", ledger=None), event(None, "comment", ledger=None), event("n1", "comment", ledger=None), event(None, "comment", ledger="l0"), event("n2", None, ledger="l0")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        log, got = f"file://{tmp_path}/log", {}
        for part in (rows[:70], rows[70:] + odd):
            answers = cl.append(spark, log, frame(spark, part), SMALL).collect()
            assert len(answers) == len(part)
            got |= {r.event_id: r.reasons for r in answers if r.event_id}
        plan = cl.judge(cl.events(spark, log), frame(spark, rows), SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain(rows) | {"n0": ["no-ledger"], "n1": ["no-ledger"], "n2": ["unknown-action"]}
    assert got == want and "CoGroup" not in plan and "MapInArrow" in plan
    assert cl.breaks(cl.events(spark, log)).collect() == []
