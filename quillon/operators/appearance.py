"""Hue ranges of appearance envelopes, the order of hues along an axis, lobes of highlights, and priors over maps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalar import EPSILON, clamp, signed_angle, wrap_degrees
from quillon.operators.joins import on_equal
from quillon.operators.stats import Z_FACTOR, circular_correlation, circular_mean, median_and_mad, weighted_step_quantile


def hue_range(sources: DataFrame, by: str, trim: float = 0.1) -> DataFrame:
    """Of each group's sources (axis in degrees, low and high deviations from it, weight, chromatic share): the dominant axis,
    the trimmed ends of the range, and the mean chromatic share; all 0 where no source is chromatic."""
    own = sources.where("axis IS NOT NULL AND chromatic > 0").withColumn("_w", F.col("weight") * F.col("chromatic"))
    centre = circular_mean(own, [by], F.col("axis"), F.col("_w")).select(by, F.col("mean_angle").alias("dominant"))
    away = own.join(centre, by).withColumn("_away", signed_angle(F.col("axis"), F.col("dominant")))
    away = away.select(by, "_w", "chromatic", (F.col("_away") + F.col("low")).alias("_low"), (F.col("_away") + F.col("high")).alias("_high"))
    low, high = weighted_step_quantile(away, [by], "_low", "_w", trim, "_l"), weighted_step_quantile(away, [by], "_high", "_w", 1 - trim, "_h")
    got = centre.join(low, by).join(high, by).join(own.groupBy(by).agg(F.avg("chromatic").alias("coverage")), by)
    told = got.select(by, "dominant", wrap_degrees(F.col("dominant") + F.col("_l")).alias("min_deg"), wrap_degrees(F.col("dominant") + F.col("_h")).alias("max_deg"), "coverage")
    return sources.select(by).distinct().join(told, by, "left").na.fill(0.0, ["dominant", "min_deg", "max_deg", "coverage"])


#: Fixed values of source_exclusions: pixels of a source at least, and the greatest share of them that may be clipped.
SOURCE_PIXELS, CLIPPED_SHARE = 16, 0.35


def source_exclusions(sources: DataFrame, by: str, floor: float = 1e-4, limit: float = 3.5, least: int = 3) -> DataFrame:
    """Adds z and reason: why a source takes no part in its region's envelope (null: it does).

    sources: one row for each region (by) and source, with pixels, clipped (a share) and med (its median level). Sources with
    few pixels ("few_pixels") or too many clipped ones ("clipped") go first and have no z; the modified z of the medians of
    those left tells "outlier", in regions that have at least `least` of them. A null count or share is no reason; a source
    without a median has no z, and a null region none either."""
    early = F.when(F.col("pixels") < SOURCE_PIXELS, "few_pixels").when(F.col("clipped") > CLIPPED_SHARE, "clipped")
    own = sources.withColumn("_early", early)
    usable = own.where("_early IS NULL AND med IS NOT NULL").select(by, "med")
    named = {"med": "_m", "mad": "_s"}
    centre = on_equal(median_and_mad(usable, [by], "med").withColumnsRenamed(named), usable.groupBy(by).agg(F.count("*").alias("_n")), [by])
    z = F.when(F.col("_early").isNull() & (F.col("_n") >= least), Z_FACTOR * F.abs(F.col("med") - F.col("_m")) / F.greatest(F.col("_s"), F.lit(floor)))
    told = own.join(centre, by, "left").withColumn("z", z)
    return told.withColumn("reason", F.coalesce("_early", F.when(F.col("z") > limit, "outlier"))).drop("_early", "_m", "_s", "_n")


def direction(tilt_x: Column, tilt_y: Column, activity: Column) -> Column:
    """Struct (x, y, strength), each 0..1: the unit vector of the sines of the angles (degrees) at which a pixel is brightest
    on both tilts, around 0.5. A tilt that was not measured (null) counts as 0; without any direction it is that of x. A null activity has no strength."""
    x, y = (F.sin(F.radians(F.coalesce(t, F.lit(0.0)))) for t in (tilt_x, tilt_y))
    size = F.hypot(x, y)
    part = lambda v, none: clamp(F.when(size > EPSILON, v / F.greatest(size, F.lit(EPSILON))).otherwise(none) * 0.5 + 0.5, 0, 1)
    return F.struct(part(x, 1.0).alias("x"), part(y, 0.0).alias("y"), F.when(activity.isNotNull(), clamp(activity, 0, 1)).alias("strength"))


#: Fixed values of hue_order: pixels of a region at least, bins, and the resultant above which hues count as one.
REGION_PIXELS, HUE_BINS, ONE_HUE = 48, 10, 0.995


def hue_order(px: DataFrame, axes: DataFrame) -> DataFrame:
    """Circular correlation of two hue profiles along each frame's axis: 1 where the hues are in the same order, -1 where reversed.

    px: frame_id, y, x, hue_a, hue_b (radians), weight. axes: frame_id, axis (radians). Pixels are put into bins by quantiles
    of their place along the axis; bins of fewer than 4 pixels or without weight are left out. Frames with a small region,
    fewer than 4 bins or hardly any change of hue have no row."""
    along = px.join(axes, "frame_id").withColumn("at", F.round(F.col("x") * F.cos("axis") + F.col("y") * F.sin("axis"), 9))
    cuts = along.groupBy("frame_id").agg(F.percentile("at", F.array(*[F.lit(k / HUE_BINS) for k in range(1, HUE_BINS)])).alias("cuts"), F.count("*").alias("size")).where(F.col("size") >= REGION_PIXELS)
    binned = along.join(cuts, "frame_id").withColumn("bin", F.size(F.filter("cuts", lambda c: F.col("at") >= c)))
    angle = lambda c: F.atan2(F.sum(F.col("weight") * F.sin(c)), F.sum(F.col("weight") * F.cos(c)))
    means = binned.groupBy("frame_id", "bin").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), angle("hue_a").alias("a"), angle("hue_b").alias("b")).where("n >= 4 AND w > 1e-4")
    length = lambda c: F.hypot(F.avg(F.sin(c)), F.avg(F.cos(c)))
    told = means.groupBy("frame_id").agg(F.count("*").alias("bins"), F.greatest(length("a"), length("b")).alias("r")).where((F.col("bins") >= 4) & (F.col("r") <= ONE_HUE))
    return circular_correlation(means.join(told.select("frame_id", "bins"), "frame_id"), ["frame_id", "bins"], F.col("a"), F.col("b"))


def in_lobe(x: Column, y: Column, glare_x: Column, glare_y: Column, azimuth: Column, elevation: Column, roughness: Column, hardness: Column) -> Column:
    """Whether a place (0..1 on both sides) is within the half maximum of a highlight, stretched along its azimuth (degrees)."""
    sigma = 0.04 + 0.30 * roughness
    longer = 1.0 + 1.5 * (1.0 - F.sin(F.radians(elevation)))
    dx, dy, turn = x - glare_x, y - glare_y, F.radians(azimuth)
    major, minor = (F.cos(turn) * dx + F.sin(turn) * dy) / (sigma * longer), (F.cos(turn) * dy - F.sin(turn) * dx) / sigma
    # exp(-r^h / 2) > 1 / 2
    return F.pow(F.hypot(major, minor) + EPSILON, hardness) < 2 * math.log(2)


def blend_prior(px: DataFrame, by: str, measured: str, prior: str, strength: float, out: str) -> DataFrame:
    """Adds out: measured, drawn by `strength` towards the prior scaled by the mean of what was measured (plus 0.25) where
    there is a prior; as measured in groups without one."""
    level = px.where(F.col(prior) > 0).groupBy(by).agg((F.avg(measured) + 0.25).alias("_level"))
    promoted = F.greatest(F.col(measured), F.col(prior) * F.col("_level"))
    drawn = clamp((1 - strength) * F.col(measured) + strength * promoted, 0, 1)
    return px.join(level, by, "left").withColumn(out, F.when(F.col("_level").isNotNull() & F.lit(strength > 0), drawn).otherwise(F.col(measured))).drop("_level")
