"""Scoring, tiering and coverage of evidence sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalar import clamp
from quillon.operators.stats import distinct_with_null, median

# The score of each level, and the weights of the components.
VISIBILITY = {"raw": 1.0, "sleeved": 0.7, "toploader": 0.5, "slabbed": 0.35, "unknown": 0.4}
LIGHTING = {"none": 0.0, "low": 0.35, "medium": 0.7, "high": 1.0, "unknown": 0.25}
COMPRESSION = {"low": 0.0, "medium": 0.4, "high": 0.8, "unknown": 0.5}
EDITING = {"low": 0.0, "medium": 0.5, "high": 1.0, "unknown": 0.6}
PROXY = {"low": 0.0, "medium": 0.5, "high": 1.0}
WEIGHTS = {
    "exact_variant_match": 0.22,
    "english_confirmation": 0.1,
    "surface_visibility": 0.14,
    "angles_score": 0.1,
    "macro_score": 0.08,
    "lighting_diversity": 0.08,
    "resolution_score": 0.1,
    "alignment_success": 0.18,
}
PENALTIES = {"compression_penalty": 0.3, "editing_risk_penalty": 0.35, "proxy_risk_penalty": 0.5}
COVERAGE_WEIGHTS = {
    "temporal_sequence": 0.1,
    "angle_span": 0.2,
    "lighting_consistency": 0.15,
    "macro_coverage": 0.1,
    "independent_sources": 0.15,
    "variant_confidence": 0.2,
    "interference_diversity": 0.1,
}


def level(c: Column, scores: dict[str, float]) -> Column:
    """The score of a level by a constant map."""
    pairs = [F.lit(x) for kv in scores.items() for x in kv]
    return F.element_at(F.create_map(*pairs), c)


def source_components(df: DataFrame, alignment: Column) -> DataFrame:
    """Adds the eleven components to sources (protection, lighting, compression, editing, proxy, language, macro,
    useful_angles, short_side, variant_confidence)."""
    return df.withColumns(
        {
            "exact_variant_match": clamp(F.col("variant_confidence"), 0, 1),
            "english_confirmation": F.when(F.col("language") == "en", 1.0).otherwise(0.0),
            "surface_visibility": level(F.col("protection"), VISIBILITY),
            "angles_score": F.least(F.col("useful_angles") / 5.0, F.lit(1.0)),
            "macro_score": F.when(F.col("macro"), 1.0).otherwise(0.0),
            "lighting_diversity": level(F.col("lighting"), LIGHTING),
            "resolution_score": F.coalesce(F.least(F.col("short_side") / 1200.0, F.lit(1.0)), F.lit(0.25)),
            "alignment_success": alignment,
            "compression_penalty": level(F.col("compression"), COMPRESSION),
            "editing_risk_penalty": level(F.col("editing"), EDITING),
            "proxy_risk_penalty": level(F.col("proxy"), PROXY),
        }
    )


def composite() -> Column:
    """Weighted positive components less weighted penalties, in 0..1, to four decimals: tiers are set from this figure."""
    good = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    bad = sum((F.col(k) * w for k, w in PENALTIES.items()), F.lit(0.0))
    return F.round(F.round(clamp(good - bad, 0, 1), 9), 4)  # ties are told after the noise of sums is gone


def source_tier(score: Column, variant: Column, proxy: Column, usable: Column) -> Column:
    return (
        F.when(~usable, "C")
        .when((score >= 0.75) & (variant >= 0.9) & (proxy == 0), "A")
        .when((score >= 0.5) & (variant >= 0.6) & (proxy < 1), "B")
        .otherwise("C")
    )


def bundle_tiers(scored: DataFrame, bundle: str, tier: str, route: Column | None = None) -> DataFrame:
    """n_a, n_b, bundle_tier and eligible of each bundle; route: an aggregate that lifts a C bundle to B."""
    counts = scored.groupBy(bundle).agg(F.count_if(F.col(tier) == "A").alias("n_a"), F.count_if(F.col(tier) == "B").alias("n_b"), (route if route is not None else F.lit(False)).alias("route"))
    tier_of = F.when(F.col("n_a") >= 2, "A").when((F.col("n_a") >= 1) | (F.col("n_a") + F.col("n_b") >= 2) | F.col("route"), "B").otherwise("C")
    return counts.select(bundle, "n_a", "n_b", tier_of.alias("bundle_tier"), (tier_of == "A").alias("eligible"))


def family_key(notes: Column, seller: Column, url: Column) -> Column:
    """Sources of one origin: all of unknown provenance together, else by seller, else by listing."""
    return F.when(F.contains(F.upper(F.coalesce(notes, F.lit(""))), F.lit("PROVENANCE UNKNOWN")), "unknown").when(F.trim(F.coalesce(seller, F.lit(""))) != "", F.concat(F.lit("seller:"), F.lower(F.trim(seller)))).otherwise(F.concat(F.lit("listing:"), url))


def coverage(df: DataFrame, bundle: str) -> DataFrame:
    """Seven axes and their weighted sum for each bundle of sources (media_form, angle, lighting, seller_repeats, macro,
    family, variant_confidence, flagged)."""
    legible = F.avg(F.when(F.col("lighting").isin("medium", "high"), 1.0).otherwise(0.0))
    axes = df.groupBy(bundle).agg(
        F.max(F.when(F.col("media_form") == "video", 1.0).otherwise(0.0)).alias("temporal_sequence"),
        F.least(distinct_with_null(F.col("angle")) / 3.0, F.lit(1.0)).alias("angle_span"),
        (legible * F.when(F.max("seller_repeats"), 1.0).otherwise(0.6)).alias("lighting_consistency"),
        F.max(F.when(F.col("macro"), 1.0).otherwise(0.0)).alias("macro_coverage"),
        F.least(F.countDistinct("family") / 3.0, F.lit(1.0)).alias("independent_sources"),
        ((F.min("variant_confidence") + median(F.col("variant_confidence"))) / 2).alias("variant_confidence"),
        F.when(F.min("flagged") != F.max("flagged"), 1.0).when(F.max("flagged"), 0.3).otherwise(0.8).alias("interference_diversity"),
    )
    return axes.withColumn("coverage", sum((F.col(k) * w for k, w in COVERAGE_WEIGHTS.items()), F.lit(0.0)))


def families_with_two(df: DataFrame, family: str, card: str, session: str) -> DataFrame:
    """Families seen on two cards and in two sessions at least."""
    return df.groupBy(family).agg(F.countDistinct(card).alias("cards"), F.countDistinct(session).alias("sessions")).where("cards >= 2 AND sessions >= 2")


def consistency(df: DataFrame, by: str, error: str) -> DataFrame:
    """mean(a) (1 - concentration / 2) with a = exp(-error / 0.06), and whether one source alone carries the fit."""
    a = F.exp(-F.col(error) / 0.06)
    sums = df.groupBy(by).agg(F.count("*").alias("n"), F.avg(a).alias("mean_a"), (F.max(a) / F.sum(a)).alias("share"), F.count_if(F.col(error) <= 0.06).alias("good"), F.min(error).alias("least"), F.min(F.when(F.col(error) > 0.06, F.col(error))).alias("next"))
    spread = F.when(F.col("n") > 1, (F.col("share") - 1 / F.col("n")) / (1 - 1 / F.nullif(F.col("n").cast("double"), F.lit(1.0)))).otherwise(1.0)
    overfit = (F.col("n") == 1) | ((F.col("good") == 1) & (F.col("next") > 0.12) & (F.col("next") >= 2 * F.col("least")))
    return sums.select(by, "n", (F.col("mean_a") * (1 - 0.5 * spread)).alias("consistency"), F.coalesce(overfit, F.lit(False)).alias("overfit"))
