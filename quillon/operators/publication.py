"""The publication gate: what a profile claims, held against the evidence for it, in one plan.

Claims are the profile's own (its text), evidence comes from other tables: the capture session, the review ledger and the
faults of its chain, the files that were delivered with their hashes, and the faults that a schema found. Everything is joined
outer, so that what is missing is a reason like what contradicts. All reasons are given, in a fixed order; nulls fail closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import documents
from quillon.operators import review

#: Labels with which a profile may be published, by lane, the label of a preview, parts of a path and phrases that may not occur.
PUBLISHABLE = {"physical": ("capture-validated", "production-validated"), "reference": ("reference-derived", "source-supported simulation", "visually fitted across real-card references")}
PREVIEW, FORBIDDEN_PARTS = "internal-reference-prototype", ("raw", "private-references", "source")
PHYSICAL_CLAIMS, SYNTHESIS = ("capture-validated", "physically measured", "physically exact"), "public-reference-synthesis"

PROFILE = "lane string, provenance struct<reviewStatus:string,reviewer:string,sourceType:string,referenceBundleId:string>, classification struct<confidence:string>, assets map<string,struct<uri:string,sha256:string>>"


def is_remote(uri: Column) -> Column:
    return uri.contains("://") | uri.startswith("//")


def is_safe(uri: Column) -> Column:
    """Whether a local path stays below its root and out of the folders of sources."""
    parts = F.split(uri, "/")
    return ~(uri.contains("\\") | uri.startswith("/") | uri.startswith("~")) & ~F.arrays_overlap(parts, F.array(*map(F.lit, ("..", *FORBIDDEN_PARTS))))


def plain_path(uri: Column) -> Column:
    """The path without empty parts and dots."""
    return F.array_join(F.filter(F.split(uri, "/"), lambda p: ~p.isin("", ".")), "/")


def asset_reasons(profiles: DataFrame, files: DataFrame, allow_remote: bool) -> DataFrame:
    """(profile_id, asset_errors, warnings, checked): for each declared asset what is wrong with it, in order of name. files: path
    (below the assets' root) and sha256; the least hash counts where a path is there twice with different ones, which is wrong by itself."""
    own = profiles.select("profile_id", F.explode("doc.assets").alias("name", "asset")).select("profile_id", "name", F.coalesce("asset.uri", F.lit("")).alias("uri"), F.lower("asset.sha256").alias("declared"))
    own = own.withColumn("path", plain_path(F.col("uri")))
    there = files.groupBy("path").agg(F.min("sha256").alias("actual"), F.count_distinct("sha256").alias("kinds"))
    met = own.join(there, "path", "left")
    remote = is_remote(F.col("uri"))
    local = ~remote & is_safe(F.col("uri")) & F.col("declared").isNotNull()
    fault = (
        F.when(remote, None if allow_remote else "asset-remote")
        .when(~is_safe(F.col("uri")), "asset-unsafe")
        .when(F.col("declared").isNull(), "asset-without-hash")
        .when(F.col("actual").isNull(), "asset-missing")
        .when((F.col("kinds") > 1) | (F.col("actual") != F.col("declared")), "asset-differs")
    )
    said = lambda kind: F.concat_ws(":", kind, "name")
    told = met.select("profile_id", "name", F.when(fault.isNotNull(), said(fault)).alias("error"), F.when(remote & F.lit(allow_remote), said(F.lit("asset-remote"))).alias("warning"), F.when(local & F.col("actual").isNotNull(), F.struct("name", "actual")).alias("checked"))
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("name", c)))), lambda s: s[c])
    return told.groupBy("profile_id").agg(in_order("error").alias("asset_errors"), in_order("warning").alias("warnings"), F.map_from_entries(F.sort_array(F.collect_list("checked"))).alias("checked"))


def approvals(events: DataFrame) -> DataFrame:
    """(session_id, approved_digest, state, head_digest): of the first production approval that is active."""
    state = review.status(events).select(F.col("ledger").alias("session_id"), "state")
    active = review.active_approvals(events).where("action = 'approve-production'").join(events.select("ledger", "event_id", "after_digest"), ["ledger", "event_id"])
    first = active.groupBy(F.col("ledger").alias("session_id")).agg(F.min_by("after_digest", "sequence").alias("approved_digest"))
    heads = events.groupBy(F.col("ledger").alias("session_id")).agg(F.max_by("digest", "sequence").alias("head_digest")) if "digest" in events.columns else None
    out = state.join(first, "session_id", "left")
    return out.join(heads, "session_id", "left") if heads is not None else out.withColumn("head_digest", F.lit(None).cast("string"))


def check(profiles: DataFrame, sessions: DataFrame, events: DataFrame, files: DataFrame, chain_faults: DataFrame | None = None, schema_faults: DataFrame | None = None, allow_remote: bool = False) -> DataFrame:
    """Whether each profile may be published: profile_id, passed, state, errors, warnings, profile_digest, head_digest, checked.

    profiles: profile_id, session_id, body (JSON). sessions: session_id, authentication, rights, public_derivatives. events: as in
    review, with after_digest (and digest). files: path, sha256. chain_faults: ledger. schema_faults: profile_id, message."""
    own = profiles.select("profile_id", "session_id", "body", F.from_json("body", PROFILE).alias("doc"), F.sha2("body", 256).alias("profile_digest"), documents.as_map(documents.parsed(F.col("body"))).isNotNull().alias("readable"))
    told = own.join(approvals(events), "session_id", "left")
    told = told.join(sessions.select("session_id", "authentication", "rights", "public_derivatives", F.lit(True).alias("has_session")), "session_id", "left")
    told = told.join(asset_reasons(own, files, allow_remote), "profile_id", "left")
    if chain_faults is not None:
        told = told.join(chain_faults.select(F.col("ledger").alias("session_id"), F.lit(True).alias("broken")).distinct(), "session_id", "left")
    if schema_faults is not None:
        told = told.join(schema_faults.groupBy("profile_id").agg(F.sort_array(F.collect_set(F.concat(F.lit("schema:"), "message"))).alias("schema_errors")), "profile_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in told.columns else F.lit(False)
    state, lane, confidence = F.coalesce("state", F.lit("unreviewed")), F.coalesce("doc.lane", F.lit("")), F.coalesce("doc.classification.confidence", F.lit("none"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reference, readable, approved, session = lane == "reference", F.coalesce("readable", F.lit(False)), state == "production-approved", flag("has_session")
    claims = F.filter(F.array(*[F.when(F.contains(F.lower("body"), F.lit(p)), F.lit(p)) for p in PHYSICAL_CLAIMS]), lambda p: p.isNotNull())
    with_value = lambda label, value: F.concat(F.lit(label + ":"), value)
    early = [
        (flag("broken"), F.lit("broken-chain")),
        (~flag("broken") & ~approved, with_value("not-production-approved", state)),
        (~flag("broken") & approved & F.col("approved_digest").isNull(), F.lit("approval-without-digest")),
        (~session, F.lit("no-session")),
        (session & ~F.col("authentication").eqNullSafe("verified"), F.lit("not-authenticated")),
        (session & (F.coalesce("rights", F.lit("unknown")) == "unknown"), F.lit("rights-unknown")),
        (session & ~flag("public_derivatives"), F.lit("no-public-derivatives")),
        (~readable, F.lit("profile-unreadable")),
        (readable & approved & ~flag("broken") & F.col("approved_digest").isNotNull() & (F.col("approved_digest") != F.col("profile_digest")), F.lit("not-the-reviewed-profile")),
    ]
    late = [
        (~F.col("doc.provenance.reviewStatus").eqNullSafe("approved"), F.lit("not-approved")),
        (blank("doc.provenance.reviewer"), F.lit("no-reviewer")),
        (~reference & F.col("doc.provenance.sourceType").eqNullSafe(SYNTHESIS), F.lit("lane-not-declared")),
        (reference, F.lit("reference-lane-blocked")),
        (reference & blank("doc.provenance.referenceBundleId"), F.lit("no-reference-bundle")),
        (reference & (confidence == PREVIEW), F.lit("preview-only")),
        (reference & ~confidence.isin(PREVIEW, *PUBLISHABLE["reference"]), with_value("not-a-label", confidence)),
        (reference & (F.size(claims) > 0), with_value("physical-claims", F.array_join(claims, "|"))),
        (~reference & ~confidence.isin(*PUBLISHABLE["physical"]), with_value("not-a-label", confidence)),
    ]
    some = lambda rules: F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), message) for bad, message in rules]), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    schema = F.coalesce("schema_errors", none) if schema_faults is not None else none
    errors = F.concat(some(early), F.when(readable, F.concat(schema, some(late), F.coalesce("asset_errors", none))).otherwise(none))
    out = told.withColumn("errors", errors)
    return out.select("profile_id", (F.size("errors") == 0).alias("passed"), F.when(flag("broken"), "unreviewed").otherwise(state).alias("state"), "errors", F.coalesce("warnings", none).alias("warnings"), F.when(readable, F.col("profile_digest")).alias("profile_digest"), "head_digest", F.coalesce("checked", F.create_map().cast("map<string,string>")).alias("checked"))


