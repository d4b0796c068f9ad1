"""Queries over the gates of promotion, publication and review. Registered by catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import promotion, publication, review
from quillon.plans.catalog import LEDGER_SQL, query, read_table, shared_folder
from quillon.plans.catalog_ledgers import PHYSICAL, PROMOTION_SQL, REFERENCE, REVIEW_SQL, promotion_events, review_events
from quillon.session import remove_folder
from quillon.sources import commit_log

# ---- promotion: nulls, two profiles a ledger, records by themselves

HUMAN = {lane: ", ".join(f"'{s}'" for s in states) for lane, states in promotion.HUMAN_ONLY.items()}


def _from(physical: int | None, reference: int | None) -> str:
    """Whether the state is that high in its lane, in SQL; unknown states are."""
    parts = [f"(lane2 = '{lane}' AND rk >= {k})" for lane, k in (("physical", physical), ("reference", reference)) if k is not None]
    return "(" + " OR ".join(parts) + ")"


RULES = {
    "no-actor": "event_id % 83 = 0",
    "no-demotion-reason": "action = 'demote' AND event_id % 2 = 1",
    "unknown-schema": "event_id % 97 = 0",
    "unknown-actor-type": "event_id % 26 = 0",
    "schema-without-lane": "lane2 = 'reference' AND event_id % 31 = 0 AND event_id % 97 <> 0",
    "revision-not-next": "opens AND rev <> coalesce(was_rev, 0) + 1",
    "not-an-entry-state": "opens AND CASE lane2 WHEN 'physical' THEN to_state NOT IN ('hypothesis', 'public-reference-supported', 'authenticated-capture-ingested') ELSE to_state <> 'hypothesis' END",
    "no-open-revision": "NOT opens AND NOT known",
    "other-revision": "NOT opens AND known AND rev <> was_rev",
    "other-lane": "NOT opens AND known AND lane2 <> was_lane",
    "other-from-state": "NOT opens AND known AND from_state IS DISTINCT FROM was2",
    "fingerprint-changed": "NOT opens AND known AND coalesce(camera <> was_camera, false)",
    "not-one-step": "action = 'promote' AND rk IS DISTINCT FROM coalesce(was_rk, CASE WHEN NOT known THEN -1 END) + 1",
    "not-earlier": "action = 'demote' AND NOT coalesce(rk < was_rk, false)",
    "unknown-state": "rk IS NULL",
}
REQUIRED = {
    "human-only": "person AND CASE WHEN event_id % 26 = 0 THEN NULL ELSE event_id % 5 = 0 END",
    "no-source-session": f"{_from(2, None)} AND event_id % 23 = 0",
    "tier-c": "lane2 = 'reference' AND tier = 'C'",
    "no-reference-bundle": f"{_from(None, 1)} AND event_id % 53 = 0",
    "no-input-hashes": f"{_from(2, 2)} AND event_id % 29 = 0",
    "no-tier": f"{_from(None, 3)} AND tier = 'C'",
    "no-tier-record": f"{_from(None, 3)} AND tier = 'B' AND event_id % 3 <> 0",
    "no-evidence": f"{_from(3, 3)} AND event_id % 31 = 0",
    "no-metrics": f"{_from(9, 4)} AND event_id % 37 = 0",
    "no-adversarial-review": f"{_from(None, 6)} AND event_id % 61 = 0",
    "no-technical-reviewer": "person AND event_id % 41 = 0",
    "no-rights-status": f"({_from(None, 3)} OR (lane2 = 'physical' AND to_state IN ('capture-validated', 'production-validated'))) AND event_id % 43 < 2",
    "no-rights-reviewer": "to_state IN ('production-validated', 'production-reference-derived') AND event_id % 47 = 0",
}
SAID = ", ".join([f"CASE WHEN coalesce({rule}, true) THEN '{name}' END" for name, rule in RULES.items()] + [f"CASE WHEN action <> 'demote' AND coalesce({rule}, true) THEN '{name}' END" for name, rule in REQUIRED.items()])
PLACE = f"nullif(CASE lane2 WHEN 'physical' THEN coalesce(list_position([{PHYSICAL}], STATE), 0) ELSE coalesce(list_position([{REFERENCE}], STATE), 0) END, 0) - 1"
GATE_SQL = PROMOTION_SQL + f""", g AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS profile, CASE WHEN event_id % 71 <> 0 THEN revision END AS rev, CASE WHEN event_id % 5 = 1 THEN 'physical' ELSE lane END AS lane2, CASE WHEN event_id % 59 = 0 THEN 'C' WHEN event_id % 59 < 20 THEN 'B' ELSE 'A' END AS tier FROM f),
h AS (SELECT *, lag(to_state) OVER v AS was2, lag(rev) OVER v AS was_rev, row_number() OVER v > 1 AS known FROM g WINDOW v AS (PARTITION BY user_id, profile ORDER BY sequence)),
i AS (SELECT *, sum(CASE WHEN NOT known OR rev IS DISTINCT FROM was_rev THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, profile ORDER BY sequence) AS run2 FROM h),
j AS (SELECT *, first_value(lane2) OVER w AS lane_of_run, lag(camera) OVER w AS was_camera FROM i WINDOW w AS (PARTITION BY user_id, profile, run2 ORDER BY sequence)),
q AS (SELECT *, lag(lane_of_run) OVER (PARTITION BY user_id, profile ORDER BY sequence) AS was_lane, {PLACE.replace('STATE', 'to_state')} AS rk, {PLACE.replace('STATE', 'was2')} AS was_rk,
  CASE lane2 WHEN 'physical' THEN to_state IN ({HUMAN['physical']}) ELSE to_state IN ({HUMAN['reference']}) END AS person FROM j),
told AS (SELECT event_id, user_id, profile, sequence, rev, to_state, lane_of_run, camera, concat_ws(',', {SAID}) AS reasons FROM q)"""


def odd_promotions(spark: SparkSession, sf: str) -> DataFrame:
    """promotion_events with two profiles in each ledger, nulls, blank actors and old schemas."""
    k = F.col("event_id")
    none = lambda n, c: F.when(k % n != 0, F.col(c))
    version = F.when(k % 97 == 0, "2.0.0").when(k % 31 == 0, "1.0.0").otherwise("1.1.0")
    changed = {"profile_id": F.when(k % 3 == 0, "a").otherwise("b"), "revision": none(71, "revision"), "lane": F.when(k % 5 != 1, F.col("lane")), "actor_type": none(26, "actor_type"), "actor": F.when(k % 83 == 0, " ").otherwise("ann"), "reason": F.when(k % 2 == 0, "failed"), "schema_version": version}
    return promotion_events(spark, sf).withColumns(changed)


@query(f"WITH {GATE_SQL} SELECT event_id, reasons FROM told")
def promotion_gate(spark, sf):
    return promotion.violations(odd_promotions(spark, sf)).select("event_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {GATE_SQL} SELECT user_id AS ledger, min(sequence) AS sequence, string_split(arg_min(reasons, sequence), ',')[1] AS reason FROM told WHERE reasons <> '' GROUP BY 1")
def promotion_first_refusal(spark, sf):
    return promotion.replay(odd_promotions(spark, sf))


@query(f"""WITH {GATE_SQL} SELECT user_id AS ledger, profile AS profile_id, arg_max(coalesce(rev, -1), sequence) AS revision, arg_max(to_state, sequence) AS state, arg_max(lane_of_run, sequence) AS lane, arg_max(camera, sequence) AS camera FROM told GROUP BY ALL""")
def promotion_state(spark, sf):
    got = promotion.current(odd_promotions(spark, sf))
    return got.select("ledger", "profile_id", F.coalesce("revision", F.lit(-1)).alias("revision"), "state", "lane", F.col("fingerprint")["camera"].alias("camera"))


# ---- publication: users as profiles, customers as their sessions, suppliers as delivered files

BODY_SQL = """'{' || CASE WHEN k % 7 = 0 THEN '"lane":"reference",' ELSE '' END || '"provenance":{"reviewStatus":"' || CASE WHEN k % 4 = 0 THEN 'pending' ELSE 'approved' END || '","reviewer":"' || CASE WHEN k % 6 = 0 THEN '' ELSE 'ann' END
  || '","sourceType":"' || CASE WHEN k % 9 = 0 THEN 'public-reference-synthesis' ELSE 'capture' END || '"' || CASE WHEN k % 14 = 0 THEN '' ELSE ',"referenceBundleId":"b"' END || '},"classification":{"confidence":"' || label || '"},"assets":{"map":{"uri":"' || uri || '","sha256":"' || declared || '"}'
  || CASE WHEN k % 13 = 0 THEN ',"env":{"uri":"tex/env.png"}' ELSE '' END || '}' || CASE WHEN k % 17 = 0 THEN '' ELSE '}' END"""
LABELS = ("capture-validated", "production-validated", "hypothesis", "reference-derived", "internal-reference-prototype")
PROFILE_SQL = f"""n AS (SELECT DISTINCT user_id AS k FROM events),
names AS (SELECT k, ({list(LABELS)})[k % 5 + 1] AS label, CASE k % 8 WHEN 0 THEN '../up.png' WHEN 1 THEN 'raw/x.png' WHEN 2 THEN 'https://cdn/x.png' ELSE './tex//' || (k % 12 + 1) || '.png' END AS uri,
  CASE WHEN k % 11 = 0 THEN sha256('other') WHEN k % 10 = 0 THEN upper(sha256('file' || (k % 12 + 1))) ELSE sha256('file' || (k % 12 + 1)) END AS declared FROM n),
profiles AS (SELECT k, label, uri, lower(declared) AS declared, {BODY_SQL} AS body FROM names),
sessions AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'verified' END AS auth, CASE WHEN c_acctbal < 0 THEN 'unknown' ELSE 'cleared' END AS rights, c_nationkey > 4 AS derivs FROM customer),
files AS (SELECT 'tex/' || s_suppkey || '.png' AS path, CASE WHEN s_suppkey = 7 THEN sha256('changed') ELSE sha256('file' || s_suppkey) END AS actual FROM supplier)"""


def published(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """profiles, sessions, review events and files."""
    k = F.col("k")
    users = read_table(spark, sf, "events").select(F.col("user_id").alias("k")).distinct()
    file_hash = F.sha2(F.concat(F.lit("file"), (k % 12 + 1).cast("string")), 256)
    uri = F.when(k % 8 == 0, "../up.png").when(k % 8 == 1, "raw/x.png").when(k % 8 == 2, "https://cdn/x.png").otherwise(F.concat(F.lit("./tex//"), (k % 12 + 1).cast("string"), F.lit(".png")))
    declared = F.when(k % 11 == 0, F.sha2(F.lit("other"), 256)).when(k % 10 == 0, F.upper(file_hash)).otherwise(file_hash)
    some = lambda n, a, b="": F.when(k % n == 0, a).otherwise(b)
    body = F.concat(
        F.lit("{"), some(7, '"lane":"reference",'), F.lit('"provenance":{"reviewStatus":"'), some(4, "pending", "approved"), F.lit('","reviewer":"'), some(6, "", "ann"), F.lit('","sourceType":"'), some(9, "public-reference-synthesis", "capture"), F.lit('"'),
        some(14, "", ',"referenceBundleId":"b"'), F.lit('},"classification":{"confidence":"'), F.get(F.array(*map(F.lit, LABELS)), (k % 5).cast("int")), F.lit('"},"assets":{"map":{"uri":"'), uri, F.lit('","sha256":"'), declared, F.lit('"}'), some(13, ',"env":{"uri":"tex/env.png"}'), F.lit("}"), some(17, "", "}"),
    )
    profiles = users.select(k.alias("profile_id"), k.alias("session_id"), body.alias("body"))
    c = F.col("c_custkey")
    sessions = read_table(spark, sf, "customer").select(c.alias("session_id"), F.when(c % 5 != 0, "verified").alias("authentication"), F.when(F.col("c_acctbal") < 0, "unknown").otherwise("cleared").alias("rights"), (F.col("c_nationkey") > 4).alias("public_derivatives"))
    e = F.col("event_id")
    digests = profiles.select(F.col("profile_id").alias("ledger"), F.sha2("body", 256).alias("now"))
    after = F.when((F.col("action") == "approve-production") & (e % 5 != 0), F.when(e % 3 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.col("now")))
    events = eased_reviews(spark, sf).join(digests, "ledger").withColumn("after_digest", after).drop("now")
    s = F.col("s_suppkey")
    files = read_table(spark, sf, "supplier").select(F.concat(F.lit("tex/"), s.cast("string"), F.lit(".png")).alias("path"), F.when(s == 7, F.sha2(F.lit("changed"), 256)).otherwise(F.sha2(F.concat(F.lit("file"), s.cast("string")), 256)).alias("sha256"))
    return profiles, sessions, events, files


def eased_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """review_events of which clicks and errors approve too, so that some ledgers reach the end."""
    k = F.col("event_id")
    action = F.when(k % 3 == 0, "approve-technical").when(k % 3 == 1, "approve-rights").otherwise("approve-production")
    return review_events(spark, sf).withColumn("action", F.when((k % 10 < 7), action).otherwise(F.col("action")))


EASED_SQL = """z AS (SELECT user_id, sequence, event_id, CASE WHEN event_id % 10 < 7 THEN CASE event_id % 3 WHEN 0 THEN 'approve-technical' WHEN 1 THEN 'approve-rights' ELSE 'approve-production' END ELSE action END AS action, item, required, target FROM v)"""


@query(f"""WITH {REVIEW_SQL}, {EASED_SQL}, {PROFILE_SQL},
act AS (SELECT user_id, event_id, sequence, action FROM z x WHERE action IN ('approve-technical', 'approve-rights', 'approve-production')
  AND NOT EXISTS (SELECT 1 FROM z y WHERE y.user_id = x.user_id AND y.sequence > x.sequence AND (y.action = 'reject-item' OR (y.action = 'comment' AND y.required) OR (y.action = 'revoke-approval' AND y.target = x.event_id)))),
items AS (SELECT user_id, item, arg_max(action, sequence) AS last FROM z WHERE action IN ('approve-item', 'reject-item') GROUP BY 1, 2),
dirty AS (SELECT user_id FROM items WHERE last = 'reject-item' UNION SELECT c.user_id FROM z c WHERE c.action = 'comment' AND c.required AND NOT EXISTS (SELECT 1 FROM z r WHERE r.user_id = c.user_id AND r.action = 'resolve-comment' AND r.target = c.event_id AND r.sequence > c.sequence)),
have AS (SELECT user_id, bool_or(action = 'approve-technical') AS t, bool_or(action = 'approve-rights') AS r, bool_or(action = 'approve-production') AS p, arg_min(event_id, sequence) FILTER (action = 'approve-production') AS first FROM act GROUP BY 1),
s AS (SELECT k, CASE WHEN k IN (SELECT user_id FROM dirty) THEN 'needs-revision' WHEN t AND r AND p THEN 'production-approved' WHEN t AND r THEN 'rights-approved' WHEN t THEN 'technically-approved' ELSE 'unreviewed' END AS state,
  CASE WHEN first % 5 <> 0 THEN CASE WHEN first % 3 = 0 THEN sha256('old') ELSE sha256(body) END END AS approved, sha256(body) AS digest, p.* EXCLUDE (k), auth, rights, derivs, x.k IS NOT NULL AS there, k % 17 <> 0 AS readable, k % 7 = 0 AS ref, actual
  FROM profiles p LEFT JOIN have h ON h.user_id = p.k LEFT JOIN sessions x USING (k) LEFT JOIN files ON path = replace(replace(uri, './', ''), '//', '/'))
SELECT k AS profile_id, state, concat_ws(',', CASE WHEN state <> 'production-approved' THEN 'not-production-approved:' || state END, CASE WHEN state = 'production-approved' AND approved IS NULL THEN 'approval-without-digest' END, CASE WHEN NOT there THEN 'no-session' END,
  CASE WHEN there AND auth IS NULL THEN 'not-authenticated' END, CASE WHEN there AND rights = 'unknown' THEN 'rights-unknown' END, CASE WHEN there AND NOT derivs THEN 'no-public-derivatives' END, CASE WHEN NOT readable THEN 'profile-unreadable' END,
  CASE WHEN readable AND state = 'production-approved' AND approved <> digest THEN 'not-the-reviewed-profile' END,
  CASE WHEN readable THEN nullif(concat_ws(',', CASE WHEN k % 4 = 0 THEN 'not-approved' END, CASE WHEN k % 6 = 0 THEN 'no-reviewer' END, CASE WHEN NOT ref AND k % 9 = 0 THEN 'lane-not-declared' END, CASE WHEN ref THEN 'reference-lane-blocked' END, CASE WHEN ref AND k % 14 = 0 THEN 'no-reference-bundle' END,
    CASE WHEN ref AND label = 'internal-reference-prototype' THEN 'preview-only' END, CASE WHEN ref AND label NOT IN ('internal-reference-prototype', 'reference-derived') THEN 'not-a-label:' || label END, CASE WHEN ref AND label = 'capture-validated' THEN 'physical-claims:capture-validated' END,
    CASE WHEN NOT ref AND label NOT IN ('capture-validated', 'production-validated') THEN 'not-a-label:' || label END, CASE WHEN k % 13 = 0 THEN 'asset-without-hash:env' END,
    CASE WHEN k % 8 = 2 THEN 'asset-remote:map' WHEN k % 8 < 2 THEN 'asset-unsafe:map' WHEN actual IS NULL THEN 'asset-missing:map' WHEN actual <> declared THEN 'asset-differs:map' END), '') END) AS errors, CASE WHEN readable AND k % 8 > 2 THEN actual END AS map_hash FROM s""")
def publication_gate(spark, sf):
    got = publication.check(*published(spark, sf))
    return got.select("profile_id", "state", F.array_join("errors", ",").alias("errors"), F.col("checked")["map"].alias("map_hash"))


# ---- review: events appended to a new log in three batches

ITEMS = commit_log.Items(technical=("item0",), rights="item1", production="item1")


@query(f"""WITH RECURSIVE {LEDGER_SQL}{REVIEW_SQL.removeprefix(LEDGER_SQL)}, {EASED_SQL},
fold AS (
  SELECT DISTINCT user_id, -1::BIGINT AS upto, -1::BIGINT AS event_id, NULL::VARCHAR AS why, []::VARCHAR[] AS good, []::VARCHAR[] AS bad, []::BIGINT[] AS comments, []::BIGINT[] AS required, []::BIGINT[] AS open, []::BIGINT[] AS given, []::BIGINT[] AS t, []::BIGINT[] AS r, []::BIGINT[] AS p, -1::BIGINT AS place FROM z
  UNION ALL
  SELECT user_id, sequence, event_id, why,
    CASE WHEN why <> '' THEN good WHEN action = 'approve-item' THEN list_append(list_filter(good, lambda x: x <> item), item) WHEN action = 'reject-item' THEN list_filter(good, lambda x: x <> item) ELSE good END,
    CASE WHEN why <> '' THEN bad WHEN action = 'reject-item' THEN list_append(list_filter(bad, lambda x: x <> item), item) WHEN action = 'approve-item' THEN list_filter(bad, lambda x: x <> item) ELSE bad END,
    CASE WHEN why = '' AND action = 'comment' THEN list_append(comments, event_id) ELSE comments END, CASE WHEN why = '' AND action = 'comment' AND need THEN list_append(required, event_id) ELSE required END,
    CASE WHEN why <> '' THEN open WHEN action = 'comment' AND need THEN list_append(open, event_id) WHEN action = 'resolve-comment' THEN list_filter(open, lambda x: x <> target) ELSE open END,
    CASE WHEN why = '' AND starts_with(action, 'approve-') AND action <> 'approve-item' THEN list_append(given, event_id) ELSE given END,
    {", ".join(f"CASE WHEN why <> '' THEN {c} WHEN action = 'reject-item' OR (action = 'comment' AND need) THEN []::BIGINT[] WHEN action = '{a}' THEN list_append({c}, event_id) WHEN action = 'revoke-approval' THEN list_filter({c}, lambda x: x <> target) ELSE {c} END" for c, a in zip("trp", review.APPROVALS, strict=True))},
    CASE WHEN why = '' THEN place + 1 ELSE place END
  FROM (SELECT z.user_id, z.sequence, z.event_id, z.action, z.item, z.required AS need, z.target, f.* EXCLUDE (user_id, event_id, why, upto), CASE z.action
      WHEN 'resolve-comment' THEN CASE WHEN NOT coalesce(list_contains(comments, z.target), false) THEN 'no-such-comment' WHEN list_contains(open, z.target) THEN '' WHEN list_contains(f.required, z.target) THEN 'already-resolved' ELSE 'needs-no-resolution' END
      WHEN 'revoke-approval' THEN CASE WHEN NOT coalesce(list_contains(given, z.target), false) THEN 'no-such-approval' WHEN list_contains(t, z.target) OR list_contains(r, z.target) OR list_contains(p, z.target) THEN '' ELSE 'inactive-approval' END
      WHEN 'approve-technical' THEN concat_ws(',', CASE WHEN len(bad) > 0 THEN 'rejected-items:' || array_to_string(list_sort(bad), '|') END, CASE WHEN len(open) > 0 THEN 'unresolved-comments' END, CASE WHEN NOT list_contains(good, 'item0') THEN 'missing-items:item0' END)
      WHEN 'approve-rights' THEN concat_ws(',', CASE WHEN len(bad) > 0 THEN 'rejected-items:' || array_to_string(list_sort(bad), '|') END, CASE WHEN len(open) > 0 THEN 'unresolved-comments' END, CASE WHEN NOT list_contains(good, 'item1') THEN 'missing-items:item1' END)
      WHEN 'approve-production' THEN concat_ws(',', CASE WHEN len(bad) > 0 THEN 'rejected-items:' || array_to_string(list_sort(bad), '|') END, CASE WHEN len(open) > 0 THEN 'unresolved-comments' END, CASE WHEN NOT list_contains(good, 'item1') THEN 'missing-items:item1' END, CASE WHEN len(t) = 0 THEN 'no-active-approve-technical' END, CASE WHEN len(r) = 0 THEN 'no-active-approve-rights' END)
      ELSE '' END AS why FROM fold f JOIN z ON z.user_id = f.user_id AND z.sequence = f.upto + 1))
SELECT 'e' || event_id AS event_id, why AS reasons, CASE WHEN why = '' THEN place END AS sequence FROM fold WHERE upto >= 0""")
def guarded_append(spark, sf):
    name = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("e"), F.col(c).cast("string")))
    new = eased_reviews(spark, sf).select(F.col("ledger").cast("string").alias("ledger"), name("event_id").alias("event_id"), F.col("sequence").alias("place"), F.lit("ann").alias("reviewer"), "action", "item", "requires_resolution", name("target").alias("target"))
    log, answers, at = shared_folder(spark, "review-log"), [], shared_folder(spark, "reviews")
    new.write.parquet(at)  # read by each batch
    new = spark.read.schema(new.schema).parquet(at)
    longest = new.agg(F.max("place")).first()[0] or 0
    for low, high in ((0, 3), (3, longest // 2), (max(3, longest // 2), longest + 1)):
        answers.append(commit_log.append(spark, log, new.where((F.col("place") >= low) & (F.col("place") < high)), ITEMS))
    remove_folder(at)
    got = answers[0].unionByName(answers[1]).unionByName(answers[2])
    return got.select("event_id", F.array_join("reasons", ",").alias("reasons"), "sequence")
