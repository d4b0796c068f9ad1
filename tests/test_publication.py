"""The publication gate: a profile that passes, and every reason why one does not."""

import hashlib
import json

import pytest

from quillon.operators import publication

APPROVED = ("approve-technical", "approve-rights", "approve-production")
SHA = hashlib.sha256(b"map").hexdigest()


def body(**change):
    doc = {"provenance": {"reviewStatus": "approved", "reviewer": "ann", "sourceType": "capture"}, "classification": {"confidence": "capture-validated"}, "assets": {"map": {"uri": "tex/map.png", "sha256": SHA}}}
    for path, value in change.items():
        *way, last = path.split("__")
        at = doc
        for w in way:
            at = at.setdefault(w, {})
        if value is ...:
            at.pop(last, None)
        else:
            at[last] = value
    return json.dumps(doc)


def tables(spark, text, session=("verified", "cleared", True), actions=APPROVED, digest=..., files=(("tex/map.png", SHA),)):
    after = hashlib.sha256((text or "").encode()).hexdigest() if digest is ... else digest
    profiles = spark.createDataFrame([("p", "s", text)], "profile_id string, session_id string, body string")
    sessions = spark.createDataFrame([("s", *session)] if session else [], "session_id string, authentication string, rights string, public_derivatives boolean")
    rows = [("s", k, f"e{k}", a, None, a == "comment", None, after if a == "approve-production" else None, f"d{k}") for k, a in enumerate(actions)]
    events = spark.createDataFrame(rows, "ledger string, sequence bigint, event_id string, action string, item string, requires_resolution boolean, target string, after_digest string, digest string")
    return profiles, sessions, events, spark.createDataFrame(list(files), "path string, sha256 string")


def result(spark, text=None, **how):
    more = {k: how.pop(k) for k in ("chain_faults", "schema_faults", "allow_remote") if k in how}
    return publication.check(*tables(spark, body() if text is None else text, **how), **more).collect()[0]


def test_a_profile_with_all_its_evidence_passes(spark):
    r = result(spark)
    assert r.passed and r.errors == [] and r.state == "production-approved" and r.head_digest == "d2"
    assert r.checked == {"map": SHA} and r.profile_digest == hashlib.sha256(body().encode()).hexdigest()
    assert result(spark, body(assets=...)).passed and result(spark, body(assets__map__sha256=SHA.upper(), assets__map__uri="./tex//map.png")).passed


@pytest.mark.parametrize(
    ("how", "errors"),
    [
        ({"actions": ()}, ["not-production-approved:unreviewed"]),
        ({"actions": (*APPROVED, "comment")}, ["not-production-approved:needs-revision"]),
        ({"digest": None}, ["approval-without-digest"]),
        ({"digest": "0" * 64}, ["not-the-reviewed-profile"]),
        ({"session": None}, ["no-session"]),
        ({"session": ("pending", None, False)}, ["not-authenticated", "rights-unknown", "no-public-derivatives"]),
        ({"session": (None, "cleared", None)}, ["not-authenticated", "no-public-derivatives"]),
        ({"files": ()}, ["asset-missing:map"]),
        ({"files": (("tex/map.png", "f" * 64),)}, ["asset-differs:map"]),
        ({"files": (("tex/map.png", "f" * 64), ("tex/map.png", SHA))}, ["asset-differs:map"]),
    ],
)
def test_evidence_that_lacks_or_contradicts(spark, how, errors):
    r = result(spark, **how)
    assert r.errors == errors and not r.passed


@pytest.mark.parametrize(
    ("change", "errors"),
    [
        ({"provenance__reviewStatus": "pending", "provenance__reviewer": ""}, ["not-approved", "no-reviewer"]),
        ({"provenance": ..., "classification": ...}, ["not-approved", "no-reviewer", "not-a-label:none"]),
        ({"classification__confidence": "hypothesis"}, ["not-a-label:hypothesis"]),
        ({"provenance__sourceType": "public-reference-synthesis"}, ["lane-not-declared"]),
        ({"lane": "reference", "classification__confidence": "reference-derived"}, ["reference-lane-blocked", "no-reference-bundle"]),
        ({"lane": "reference", "provenance__referenceBundleId": "b", "classification__confidence": "internal-reference-prototype"}, ["reference-lane-blocked", "preview-only"]),
        ({"lane": "reference", "provenance__referenceBundleId": "b", "note": "Physically Measured"}, ["reference-lane-blocked", "not-a-label:capture-validated", "physical-claims:capture-validated|physically measured"]),
        ({"assets__map__uri": "../map.png"}, ["asset-unsafe:map"]),
        ({"assets__map__uri": "private-references/map.png"}, ["asset-unsafe:map"]),
        ({"assets__map__uri": "~/map.png"}, ["asset-unsafe:map"]),
        ({"assets__map__uri": "a\\map.png"}, ["asset-unsafe:map"]),
        ({"assets__map__sha256": ...}, ["asset-without-hash:map"]),
        ({"assets__env": {"uri": "https://cdn/x.png"}, "assets__alt": {"uri": "//cdn/x.png"}}, ["asset-remote:alt", "asset-remote:env"]),
    ],
)
def test_claims_that_may_not_be_made(spark, change, errors):
    assert result(spark, body(**change)).errors == errors


def test_broken_chains_schemas_and_remote_assets(spark):
    r = result(spark, chain_faults=spark.createDataFrame([("s",)], "ledger string"), schema_faults=spark.createDataFrame([("p", "b"), ("p", "a"), ("q", "c")], "profile_id string, message string"))
    assert r.errors == ["broken-chain", "schema:a", "schema:b"] and r.state == "unreviewed"
    remote = result(spark, body(assets__map__uri="https://cdn/x.png"), allow_remote=True)
    assert remote.passed and remote.warnings == ["asset-remote:map"] and remote.checked == {}
    for text in ("not json", "[1]", ""):
        assert result(spark, text).errors == ["profile-unreadable"]
