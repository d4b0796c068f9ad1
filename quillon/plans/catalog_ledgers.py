"""Queries over review and promotion ledgers, both read from `events`. Registered by catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import promotion, review
from quillon.plans.catalog import LEDGER_SQL, query, user_ledger

REVIEW_SQL = LEDGER_SQL + """, a AS (SELECT user_id, sequence, event_id, CASE event_type WHEN 'signup' THEN 'approve-technical' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'approve-rights' ELSE 'approve-production' END
  WHEN 'click' THEN 'comment' WHEN 'view' THEN 'resolve-comment' ELSE CASE event_id % 5 WHEN 0 THEN 'reject-item' WHEN 1 THEN 'revoke-approval' ELSE 'approve-item' END END AS action,
  'item' || event_id % 2 AS item, event_id % 12 = 0 AS required FROM ledger),
v AS (SELECT *, CASE action WHEN 'resolve-comment' THEN max(event_id) FILTER (action = 'comment' AND required) OVER w WHEN 'revoke-approval' THEN max(event_id) FILTER (action IN ('approve-technical', 'approve-rights', 'approve-production')) OVER w END AS target
  FROM a WINDOW w AS (PARTITION BY user_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def review_events(spark: SparkSession, sf: str) -> DataFrame:
    e, k = F.col("event_type"), F.col("event_id")
    other = F.when(k % 5 == 0, "reject-item").when(k % 5 == 1, "revoke-approval").otherwise("approve-item")
    action = F.when(e == "signup", "approve-technical").when(e == "purchase", F.when(k % 2 == 0, "approve-rights").otherwise("approve-production")).when(e == "click", "comment").when(e == "view", "resolve-comment").otherwise(other)
    rows = user_ledger(spark, sf).select(F.col("user_id").alias("ledger"), F.col("sequence").cast("long").alias("sequence"), "event_id", action.alias("action"), F.concat(F.lit("item"), (k % 2).cast("string")).alias("item"), (k % 12 == 0).alias("requires_resolution"))
    before = Window.partitionBy("ledger").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda which: F.max(F.when(which, F.col("event_id"))).over(before)
    target = F.when(F.col("action") == "resolve-comment", last((F.col("action") == "comment") & F.col("requires_resolution"))).when(F.col("action") == "revoke-approval", last(F.col("action").isin(*review.APPROVALS)))
    return rows.withColumn("target", target)


@query(f"""WITH {REVIEW_SQL}, open AS (SELECT c.user_id, count(*) AS unresolved FROM v c WHERE c.action = 'comment' AND c.required AND NOT EXISTS (SELECT 1 FROM v r WHERE r.user_id = c.user_id AND r.action = 'resolve-comment' AND r.target = c.event_id AND r.sequence > c.sequence) GROUP BY 1),
items AS (SELECT user_id, item, arg_max(action, sequence) AS last FROM v WHERE action IN ('approve-item', 'reject-item') GROUP BY 1, 2), bad AS (SELECT user_id, count(*) FILTER (last = 'reject-item') AS rejected FROM items GROUP BY 1),
act AS (SELECT user_id, bool_or(action = 'approve-technical') AS t, bool_or(action = 'approve-rights') AS r, bool_or(action = 'approve-production') AS p FROM v x WHERE action IN ('approve-technical', 'approve-rights', 'approve-production')
  AND NOT EXISTS (SELECT 1 FROM v y WHERE y.user_id = x.user_id AND y.sequence > x.sequence AND (y.action = 'reject-item' OR (y.action = 'comment' AND y.required) OR (y.action = 'revoke-approval' AND y.target = x.event_id))) GROUP BY 1),
n AS (SELECT user_id, count(*) AS events FROM v GROUP BY 1)
SELECT user_id AS ledger, events, coalesce(rejected, 0) AS rejected, coalesce(unresolved, 0) AS unresolved, CASE WHEN coalesce(rejected, 0) > 0 OR coalesce(unresolved, 0) > 0 THEN 'needs-revision' WHEN t AND r AND p THEN 'production-approved'
  WHEN t AND r THEN 'rights-approved' WHEN t THEN 'technically-approved' ELSE 'unreviewed' END AS state FROM n LEFT JOIN bad USING (user_id) LEFT JOIN open USING (user_id) LEFT JOIN act USING (user_id)""")
def review_status(spark, sf):
    return review.status(review_events(spark, sf))


@query(f"""WITH {REVIEW_SQL} SELECT event_id, user_id AS ledger, sequence, action FROM v x WHERE action IN ('approve-technical', 'approve-rights', 'approve-production')
AND NOT EXISTS (SELECT 1 FROM v y WHERE y.user_id = x.user_id AND y.sequence > x.sequence AND (y.action = 'reject-item' OR (y.action = 'comment' AND y.required) OR (y.action = 'revoke-approval' AND y.target = x.event_id)))""")
def active_approvals(spark, sf):
    return review.active_approvals(review_events(spark, sf)).select("event_id", "ledger", "sequence", "action")


# ---- promotion

PHYSICAL, REFERENCE = (", ".join(f"'{s}'" for s in promotion.STATES[lane]) for lane in ("physical", "reference"))
PROMOTION_SQL = LEDGER_SQL + f""", o AS (SELECT *, event_type = 'signup' OR (sequence = 0 AND event_id % 13 <> 0) AS opens FROM ledger),
r AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY sequence) + CASE WHEN event_id % 67 = 0 THEN 1 ELSE 0 END AS revision, CASE WHEN (user_id % 2 = 0) <> (event_id % 17 = 0) THEN 'physical' ELSE 'reference' END AS lane FROM o),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, revision ORDER BY sequence) - 1 AS pos, CASE WHEN opens THEN 'open-revision' WHEN event_type = 'error' THEN 'demote' ELSE 'promote' END AS action FROM r),
k AS (SELECT *, greatest(least(CASE WHEN action = 'demote' THEN pos - 3 ELSE pos END + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END, CASE lane WHEN 'physical' THEN 12 ELSE 7 END), 0) AS place FROM p),
t AS (SELECT *, CASE lane WHEN 'physical' THEN ([{PHYSICAL}])[place + 1] ELSE ([{REFERENCE}])[place + 1] END AS to_state FROM k),
f AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 'hypothesis' ELSE lag(to_state) OVER w END AS from_state, lag(to_state) OVER w AS was, lag(revision) OVER w AS was_revision, 'c' || (revision + CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END) AS camera FROM t WINDOW w AS (PARTITION BY user_id ORDER BY sequence)),
u AS (SELECT *, sum(CASE WHEN revision IS NOT DISTINCT FROM was_revision THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY sequence) AS run FROM f),
l AS (SELECT *, first_value(lane) OVER (PARTITION BY user_id, run ORDER BY sequence) AS run_lane, lag(camera) OVER (PARTITION BY user_id, run ORDER BY sequence) AS was_camera FROM u),
x AS (SELECT *, lag(run_lane) OVER (PARTITION BY user_id ORDER BY sequence) AS was_lane, CASE lane WHEN 'physical' THEN list_position([{PHYSICAL}], was) ELSE list_position([{REFERENCE}], was) END - 1 AS was_at,
  CASE lane WHEN 'physical' THEN to_state IN ('quality-approved', 'registration-approved', 'masks-reviewed', 'material-maps-reviewed', 'render-reviewed', 'capture-validated', 'production-validated')
    ELSE to_state IN ('exact-variant-verified', 'adversarial-review-passed', 'internal-reference-prototype', 'production-reference-derived') END AS person,
  CASE WHEN event_id % 59 = 0 THEN 'C' WHEN event_id % 59 < 20 THEN 'B' ELSE 'A' END AS tier FROM l),
reasoned AS (SELECT event_id, user_id, sequence, concat_ws(',',
  CASE WHEN opens AND revision <> coalesce(was_revision, 0) + 1 THEN 'revision-not-next' END,
  CASE WHEN opens AND place > CASE lane WHEN 'physical' THEN 2 ELSE 0 END THEN 'not-an-entry-state' END,
  CASE WHEN NOT opens AND was_revision IS NULL THEN 'no-open-revision' END,
  CASE WHEN NOT opens AND revision <> was_revision THEN 'other-revision' END,
  CASE WHEN NOT opens AND lane <> was_lane THEN 'other-lane' END,
  CASE WHEN NOT opens AND was_revision IS NOT NULL AND from_state IS DISTINCT FROM was THEN 'other-from-state' END,
  CASE WHEN NOT opens AND was_revision IS NOT NULL AND camera <> was_camera THEN 'fingerprint-changed' END,
  CASE WHEN action = 'promote' AND place IS DISTINCT FROM CASE WHEN was_revision IS NULL THEN -1 ELSE was_at END + 1 THEN 'not-one-step' END,
  CASE WHEN action = 'demote' AND NOT coalesce(place < was_at, false) THEN 'not-earlier' END,
  CASE WHEN action <> 'demote' THEN nullif(concat_ws(',',
    CASE WHEN person AND event_id % 5 = 0 THEN 'human-only' END,
    CASE WHEN lane = 'physical' AND place >= 2 AND event_id % 23 = 0 THEN 'no-source-session' END,
    CASE WHEN lane = 'reference' AND tier = 'C' THEN 'tier-c' END,
    CASE WHEN lane = 'reference' AND place >= 1 AND event_id % 53 = 0 THEN 'no-reference-bundle' END,
    CASE WHEN place >= 2 AND event_id % 29 = 0 THEN 'no-input-hashes' END,
    CASE WHEN lane = 'reference' AND place >= 3 AND tier = 'C' THEN 'no-tier' END,
    CASE WHEN lane = 'reference' AND place >= 3 AND tier = 'B' AND event_id % 3 <> 0 THEN 'no-tier-record' END,
    CASE WHEN place >= 3 AND event_id % 31 = 0 THEN 'no-evidence' END,
    CASE WHEN place >= CASE lane WHEN 'physical' THEN 9 ELSE 4 END AND event_id % 37 = 0 THEN 'no-metrics' END,
    CASE WHEN lane = 'reference' AND place >= 6 AND event_id % 61 = 0 THEN 'no-adversarial-review' END,
    CASE WHEN person AND event_id % 41 = 0 THEN 'no-technical-reviewer' END,
    CASE WHEN place >= CASE lane WHEN 'physical' THEN 11 ELSE 3 END AND event_id % 43 < 2 THEN 'no-rights-status' END,
    CASE WHEN place = CASE lane WHEN 'physical' THEN 12 ELSE 7 END AND event_id % 47 = 0 THEN 'no-rights-reviewer' END), '') END) AS reasons FROM x)"""


def promotion_events(spark: SparkSession, sf: str) -> DataFrame:
    k, u = F.col("event_id"), F.col("user_id")
    w = Window.partitionBy("user_id").orderBy("sequence")
    rows = user_ledger(spark, sf).select("user_id", F.col("sequence").cast("long").alias("sequence"), "event_id", "event_type")
    rows = rows.withColumn("opens", (F.col("event_type") == "signup") | ((F.col("sequence") == 0) & (k % 13 != 0)))
    rows = rows.withColumn("revision", F.sum(F.col("opens").cast("int")).over(w) + (k % 67 == 0).cast("int")).withColumn("lane", F.when((u % 2 == 0) != (k % 17 == 0), "physical").otherwise("reference"))
    pos = F.row_number().over(Window.partitionBy("user_id", "revision").orderBy("sequence")) - 1
    rows = rows.withColumn("action", F.when(F.col("opens"), "open-revision").when(F.col("event_type") == "error", "demote").otherwise("promote")).withColumn("pos", pos)
    top = F.when(F.col("lane") == "physical", 12).otherwise(7)
    at = F.greatest(F.least(F.col("pos") - F.when(F.col("action") == "demote", 3).otherwise(0) + (k % 7 == 0).cast("int"), top), F.lit(0))
    name = lambda lane: F.get(F.array(*map(F.lit, promotion.STATES[lane])), at)
    rows = rows.withColumn("to_state", F.when(F.col("lane") == "physical", name("physical")).otherwise(name("reference")))
    given = lambda n, value="x": F.when(k % n != 0, value)
    camera = F.concat(F.lit("c"), (F.col("revision") + (k % 19 == 0).cast("int")).cast("string"))
    record = F.when(k % 3 == 0, F.create_map(F.lit("bundle-tier-record"), F.sha2(F.lit("record"), 256))).otherwise(F.create_map().cast("map<string,string>"))
    return rows.select(
        u.alias("ledger"), "sequence", "event_id", "action", "lane", "revision", "to_state",
        F.when(k % 11 == 0, "hypothesis").otherwise(F.lag("to_state").over(w)).alias("from_state"),
        F.create_map(F.lit("camera"), camera).alias("camera"), record.alias("record"),
        F.when(k % 5 == 0, "agent").otherwise("human").alias("actor_type"), given(23).alias("source_session"), (k % 29).alias("input_hashes"), given(31).alias("evidence_packet"), (k % 37).alias("metrics"),
        given(41).alias("technical_reviewer"), F.when(k % 43 == 1, "unknown").when(k % 43 > 1, "cleared").alias("rights_status"), given(47).alias("rights_reviewer"), given(53).alias("reference_bundle_id"),
        F.when(k % 59 == 0, "C").when(k % 59 < 20, "B").otherwise("A").alias("source_quality_tier"), given(61).alias("adversarial_review"),
    ).withColumn("fingerprint", F.map_concat("camera", "record")).drop("camera", "record")


@query(f"WITH {PROMOTION_SQL} SELECT event_id, reasons FROM reasoned")
def promotion_violations(spark, sf):
    return promotion.violations(promotion_events(spark, sf)).select("event_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {PROMOTION_SQL} SELECT user_id AS ledger, min(sequence) AS sequence, string_split(arg_min(reasons, sequence), ',')[1] AS reason FROM reasoned WHERE reasons <> '' GROUP BY 1")
def ledger_replay(spark, sf):
    return promotion.replay(promotion_events(spark, sf))
