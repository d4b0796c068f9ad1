"""Group percentiles, coherence, promotion and review rules, records: against plain versions and odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import records as rec
from quillon.operators import imaging as im
from quillon.operators import pixels as px
from quillon.operators import promotion, review, stats
from quillon.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_group_percentiles_and_places(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([1.5, rng.random() * 9])) for _ in range(5000)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None)] + [(f"g{i % 40}", float(i % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in stats.group_percentiles(df, ["g"], "v", {"a": 0.05, "m": 0.5, "z": 1.0}).collect()}
    assert set(got) == {g for g, _ in rows} - {"none"}
    for g, r in got.items():
        own = [v for k, v in rows if k == g and v is not None]
        assert np.allclose([r.a, r.m, r.z], np.percentile(own, [5, 50, 100]))
    ids = spark.createDataFrame([(g, i) for i, (g, _) in enumerate(rows)], "g string, i bigint")
    places = {}
    for r in stats.numbered(ids, ["g"], ["i"], "k").collect():
        places.setdefault(r.g, []).append((r.i, r.k))
    assert all([k for _, k in sorted(p)] == list(range(len(p))) for p in places.values())


def plain_coherence(a, b):
    if len(a) < 3 or max(np.mean(a), np.mean(b)) < 0.02:
        return None
    la, lb = np.log(np.array(a) + 0.05), np.log(np.array(b) + 0.05)
    p, q = (np.array([x[i] - x[j] for i in range(len(x)) for j in range(i + 1, len(x))]) for x in (la, lb))
    low, high = sorted([p.std(), q.std()])
    if high < 0.25:
        return None
    if low < 1e-9:
        return 0.0
    p, q = p - p.mean(), q - q.mean()
    return float(np.clip((p * q).sum() / (math.sqrt((p * p).sum() * (q * q).sum()) + 1e-6), -1, 1) * low / (high + 1e-6))


def test_coherence_of_pairs(spark):
    rng = random.Random(2)
    groups = {"verdict": ([math.exp(x) - 0.05 for x in (0, 1, 3)], [math.exp(x) - 0.05 for x in (0, 2, 1)]), "two": ([0.1, 0.9], [0.2, 0.8]), "dark": ([0.0] * 4, [0.01] * 4), "alike": ([0.5] * 5, [0.5] * 5), "flat": ([0.1, 0.5, 0.9], [0.3] * 3)}
    groups |= {f"r{i}": ([rng.random() for _ in range(i)], [rng.random() for _ in range(i)]) for i in range(3, 9)}
    rows = [(g, i, x, y) for g, (a, b) in groups.items() for i, (x, y) in enumerate(zip(a, b, strict=True))]
    got = {r.g: r.coherence for r in px.intensity_coherence(spark.createDataFrame(rows, "g string, i int, a double, b double"), "g", "i", "a", "b").collect()}
    for g, (a, b) in groups.items():
        want = plain_coherence(a, b)
        assert got[g] is None if want is None else abs(got[g] - want) < 1e-6, g


def test_small_frames_have_no_highlight(spark):
    rows = [(1, "g", i, 0, i, float(i)) for i in range(3)] + [(2, "g", i, 0, i, float(i)) for i in range(4)]
    got = {r.frame_id: r.cx for r in px.highlight_centroid(spark.createDataFrame(rows, "frame_id int, grp string, pos int, y int, x int, v double")).collect()}
    assert got == {1: None, 2: 3.0}


def plain_blur(img):
    k = np.array([[math.exp(-(x * x + y * y) / 4.5) for x in range(-5, 6)] for y in range(-5, 6)])
    k /= k.sum()
    p = np.pad(img, 5, mode="reflect")
    return np.array([[(p[y : y + 11, x : x + 11] * k).sum() for x in range(img.shape[1])] for y in range(img.shape[0])])


def test_structure_and_band_energy_against_loops():
    rng = np.random.default_rng(3)
    a, b, valid = rng.random((24, 20)), rng.random((24, 20)), np.ones((24, 20), bool)
    valid[:3, :4] = False
    ma, mb = plain_blur(a), plain_blur(b)
    term = (plain_blur(a * b) - ma * mb + 1e-4) / (np.sqrt(np.maximum(plain_blur(a * a) - ma**2, 0) * np.maximum(plain_blur(b * b) - mb**2, 0)) + 1e-4)
    inner = [(y, x) for y in range(24) for x in range(20) if valid[max(0, y - 5) : y + 6, max(0, x - 5) : x + 6].all()]
    assert abs(im.structure(a, b, valid=valid) - np.mean([np.clip(term[y, x], -1, 1) for y, x in inner])) < 1e-9
    z = (a - a.mean()) / a.std() * np.hanning(24)[:, None] * np.hanning(20)[None, :]
    energy = np.zeros(4)
    for u in range(24):
        for v in range(20):
            f = math.hypot(min(u, 24 - u) / 24, min(v, 20 - v) / 20)
            wave = np.exp(-2j * np.pi * (np.arange(24)[:, None] * u / 24 + np.arange(20)[None, :] * v / 20))
            for k, (low, high) in enumerate(((0.02, 0.06), (0.06, 0.14), (0.14, 0.30), (0.30, 0.50))):
                energy[k] += abs((z * wave).sum()) ** 2 if low <= f < high else 0
    assert np.allclose(im.band_energy(a), energy / energy.sum())
    assert im.band_energy(np.ones((9, 9))) is None and im.band_energy(a[:7, :9]) is None
    assert im.texture_agreement(a, a) == 1.0 and im.texture_agreement(a, np.ones_like(a)) is None


def test_texture_query(spark):
    rasters = {r.vec_id: np.array(r.embedding, float).reshape(8, 8) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    got = catalog.QUERIES["texture_of_next"](spark, DATA).collect()
    assert got and all(abs(r.agreement - im.texture_agreement(rasters[r.f], rasters[r.g])) < 1e-5 for r in got)


EVENT = "ledger string, sequence bigint, action string, lane string, revision int, from_state string, to_state string, fingerprint map<string,string>, actor_type string, source_session string, input_hashes int, evidence_packet string, metrics int, technical_reviewer string, rights_status string, rights_reviewer string, reference_bundle_id string, source_quality_tier string, adversarial_review string"


def climb(lane, ledger="x", **change):
    """A ledger that goes up its whole lane; change: sequence to fields."""
    out = []
    for k, state in enumerate(promotion.STATES[lane]):
        row = dict(ledger=ledger, sequence=k, action="promote" if k else "open-revision", lane=lane, revision=1, from_state=promotion.STATES[lane][k - 1] if k else None, to_state=state, fingerprint={"camera": "a"}, actor_type="human", source_session="s", input_hashes=1, evidence_packet="e", metrics=1, technical_reviewer="t", rights_status="cleared", rights_reviewer="r", reference_bundle_id="b", source_quality_tier="A", adversarial_review="v")
        out.append(row | change.get(f"s{k}", {}))
    return out


def first(spark, rows):
    names = [c.split()[0] for c in EVENT.split(", ")]
    got = promotion.replay(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], EVENT)).collect()
    return {r.ledger: (r.sequence, r.reason) for r in got}


def test_promotion_rules(spark):
    cases = {
        "whole": ("physical", {}, None),
        "whole-reference": ("reference", {}, None),
        "agent": ("physical", {"s3": {"actor_type": "agent"}}, (3, "human-only")),
        "agent-may": ("physical", {"s5": {"actor_type": "agent"}}, None),
        "lane": ("physical", {"s4": {"lane": "reference"}}, (4, "other-lane")),
        "jump": ("physical", {"s2": {"to_state": "quality-approved"}}, (2, "not-one-step")),
        "from": ("physical", {"s2": {"from_state": "hypothesis"}}, (2, "other-from-state")),
        "camera": ("physical", {"s2": {"fingerprint": {"camera": "b"}}}, (2, "fingerprint-changed")),
        "revision": ("physical", {"s0": {"revision": 2}}, (0, "revision-not-next")),
        "entry": ("reference", {"s0": {"to_state": "exact-variant-verified"}}, (0, "not-an-entry-state")),
        "unopened": ("physical", {"s0": {"action": "promote"}}, (0, "no-open-revision")),
        "hashes": ("reference", {"s2": {"input_hashes": 0}}, (2, "no-input-hashes")),
        "rights": ("physical", {"s11": {"rights_status": "unknown"}}, (11, "no-rights-status")),
        "reviewer": ("reference", {"s7": {"rights_reviewer": None}}, (7, "no-rights-reviewer")),
        "tier": ("reference", {"s1": {"source_quality_tier": "C"}}, (1, "tier-c")),
        "record": ("reference", {"s3": {"source_quality_tier": "B"}}, (3, "no-tier-record")),
        "record-there": ("reference", {"s3": {"source_quality_tier": "B", "fingerprint": {"bundle-tier-record": "a" * 64}}}, None),
        "demote-up": ("physical", {"s2": {"action": "demote"}}, (2, "not-earlier")),
    }
    rows = [r for name, (lane, change, _) in cases.items() for r in climb(lane, name, **change)]
    assert first(spark, rows) == {name: want for name, (_, _, want) in cases.items() if want}
    again = climb("physical", "again") + [climb("physical", "again")[0] | {"sequence": 13, "revision": 2, "fingerprint": {"camera": "z"}}]
    assert first(spark, again) == {} and first(spark, []) == {}


def test_review_status(spark):
    ledgers = {
        "none": [("comment", None, False, None)],
        "technical": [("approve-technical", None, False, None)],
        "rights": [("approve-technical", None, False, None), ("approve-rights", None, False, None)],
        "production": [("approve-technical", None, False, None), ("approve-rights", None, False, None), ("approve-production", None, False, None)],
        "rejected": [("reject-item", "a", False, None), ("approve-technical", None, False, None)],
        "mended": [("reject-item", "a", False, None), ("approve-item", "a", False, None), ("approve-technical", None, False, None)],
        "open": [("approve-technical", None, False, None), ("comment", None, True, None)],
        "resolved": [("comment", None, True, None), ("resolve-comment", None, False, 0), ("approve-technical", None, False, None)],
        "stale": [("approve-technical", None, False, None), ("comment", None, True, None), ("resolve-comment", None, False, 1)],
        "revoked": [("approve-technical", None, False, None), ("revoke-approval", None, False, 0)],
        "too-early": [("resolve-comment", None, False, 1), ("comment", None, True, None)],
    }
    rows = [(name, k, f"{name}/{k}", action, item, needs, None if at is None else f"{name}/{at}") for name, events in ledgers.items() for k, (action, item, needs, at) in enumerate(events)]
    got = {r.ledger: r.state for r in review.status(spark.createDataFrame(rows, "ledger string, sequence bigint, event_id string, action string, item string, requires_resolution boolean, target string")).collect()}
    revise = "needs-revision"
    assert got == {"none": "unreviewed", "technical": "technically-approved", "rights": "rights-approved", "production": "production-approved", "rejected": revise, "mended": "technically-approved", "open": revise, "resolved": "technically-approved", "stale": "unreviewed", "revoked": "unreviewed", "too-early": revise}


@pytest.mark.parametrize(("make", "cases"), [
    (lambda c: F.size(rec.parse_quad(c)), {"[[0,0],[1,0],[1,1],[0,1]]": 4, '{"corners":[[0,0],[1,0],[1,1],[0,1]]}': 4, "[[0,0],[1,0],[1,1]]": None, "[[0,0],[1],[1,1],[0,1]]": None, "x": None, None: None}),
    (rec.safe_frame_id, {"Ab-1": "ab-1", "a": None, "_ab": None, "ab/c": None, "ab\n": None, None: None}),
    (lambda c: F.date_format(rec.utc_time(c), "yyyy-MM-dd HH:mm"), {"2024-01-02T03:04:05Z": "2024-01-02 03:04", "2024-01-02T03:04:05+02:00": "2024-01-02 01:04", "2024-01-02T03:04:05": "2024-01-02 03:04", "no": None, None: None}),
    (lambda c: F.to_json(rec.json_object(c)), {'{"a":1}': '{"a":"1"}', "[1]": None, "x": None, None: "{}"}),
    (lambda c: rec.relative_inside(F.lit("/a/b"), c), {"/a/b/c/d": "c/d", "/a/b": None, "/a/bc": None, "/a": None, None: None}),
])
def test_records(spark, make, cases):
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", make(F.col("t")).alias("got"))
    assert {r.t: (None if r.got in (None, -1) else r.got) for r in df.collect()} == cases


def test_prompts_and_observations(spark):
    rows = [(0, False, False, 0.0, 1.0), (1, False, False, 0.0, 1.0), (0, True, False, 0.0, 1.0), (0, True, False, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "n int, box boolean, mask boolean, x0 double, x1 double")
    got = df.select(rec.prompt_reasons(F.col("n"), F.col("box"), F.col("mask"), F.col("x0"), F.lit(0.0), F.col("x1"), F.lit(1.0)).alias("r")).collect()
    assert [r.r for r in got] == [["no input"], [], [], ["empty box"]]
    df = spark.createDataFrame([("still", ["a"]), ("still", ["a", "b"]), ("sequence", ["a"]), ("sequence", ["a", "a"])], "form string, ids array<string>")
    got = df.select(F.size(rec.observation_reasons(F.col("form"), F.col("ids"))).alias("n")).collect()
    assert [r.n for r in got] == [0, 1, 1, 1]
