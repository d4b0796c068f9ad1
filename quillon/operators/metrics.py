"""Metrics of fits: a reference and a candidate sequence compared pixel by pixel, region by region, source by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalar import EPSILON, clamp
from quillon.operators.joins import on_equal
from quillon.operators.stats import median, median_and_mad


def paired(px: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pixels of given frame pairs side by side: f, g, pos, y, x, a (of f), b (of g)."""
    left = pairs.join(px.select(F.col("frame_id").alias("f"), "pos", "y", "x", F.col("v").alias("a")), "f")
    return left.join(px.select(F.col("frame_id").alias("g"), "pos", F.col("v").alias("b")), ["g", "pos"])


def absolute_error(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"), F.abs(F.avg("a") - F.avg("b")).alias("exposure"))


def centroid_error(pairs: DataFrame, centroids: DataFrame, diagonal: float) -> DataFrame:
    """Distance of the highlights of each pair over the diagonal; 0 where both have none, 1 where one has none."""
    of = lambda side: centroids.select(F.col("frame_id").alias(side), F.col("cx").alias(f"x{side}"), F.col("cy").alias(f"y{side}"))
    both = pairs.join(of("f"), "f", "left").join(of("g"), "g", "left")
    none_f, none_g = F.col("xf").isNull(), F.col("xg").isNull()
    return both.select("f", "g", F.when(none_f & none_g, 0.0).when(none_f | none_g, 1.0).otherwise(F.hypot(F.col("xf") - F.col("xg"), F.col("yf") - F.col("yg")) / diagonal).alias("centroid_error"))


def hue_error(rows: DataFrame, by: list[str], hue_a: str, hue_b: str, chroma_a: str, chroma_b: str, quantile: float = 0.35) -> DataFrame:
    """Chroma-weighted mean of |difference of hues| / pi over the rows whose lesser chroma is above its quantile."""
    c = rows.withColumn("_c", F.least(chroma_a, chroma_b))
    cut = c.groupBy(*by).agg(F.percentile("_c", F.lit(quantile)).alias("_q"))
    d = F.abs(F.atan2(F.sin(F.col(hue_a) - F.col(hue_b)), F.cos(F.col(hue_a) - F.col(hue_b)))) / F.pi()
    return c.join(cut, by).where("_c > _q").groupBy(*by).agg((F.sum(F.col("_c") * d) / F.sum("_c")).alias("hue_error"))


def region_stats(px: DataFrame, clip_low: float, clip_high: float, specular_floor: float = 0.10) -> DataFrame:
    """For each source (grp): n, clipped share, median, MAD, and the share of pixels above median + max(4 x 1.4826 MAD, floor)."""
    sums = px.groupBy("grp").agg(F.count("*").alias("n"), F.avg(F.when((F.col("v") <= clip_low) | (F.col("v") >= clip_high), 1.0).otherwise(0.0)).alias("clipped"))
    per = on_equal(sums, median_and_mad(px, ["grp"], "v"), ["grp"])
    cut = per.select("grp", (F.col("med") + F.greatest(4 * 1.4826 * F.col("mad"), F.lit(float(specular_floor)))).alias("cut"))
    spec = on_equal(px.select("grp", "v"), cut, ["grp"]).groupBy("grp").agg(F.avg(F.when(F.col("v") > F.col("cut"), 1.0).otherwise(0.0)).alias("specular"))
    return on_equal(per, spec, ["grp"])


def optimal_exposure(rows: DataFrame, by: str, frame: str, observed: Column, unit: Column) -> DataFrame:
    """Median over frames of the median of observed / unit where unit is above 0.02, in 0.25..4."""
    per = rows.where(unit > 0.02).groupBy(by, frame).agg(median(observed / (unit + EPSILON)).alias("r"))
    return per.groupBy(by).agg(clamp(median(F.col("r")), 0.25, 4).alias("exposure"))


def median_stack(px: DataFrame, target: float = 0.35, most_gain: float = 8.0, shading: float = 0.85) -> DataFrame:
    """Albedo of each group and pixel: frames scaled to a common median (gain at most most_gain), then the median over frames."""
    gain = px.groupBy("grp", "frame_id").agg(F.least(target / F.greatest(median(F.col("v")), F.lit(EPSILON)), F.lit(most_gain)).alias("gain"))
    return px.join(gain, ["grp", "frame_id"]).groupBy("grp", "pos").agg((median(F.col("v") * F.col("gain")) / shading).alias("albedo"))


def exposure_metadata(px: DataFrame, low: float, high: float) -> DataFrame:
    return px.groupBy("frame_id").agg(F.avg("v").alias("mean"), (0.5 / F.greatest(F.avg("v"), F.lit(EPSILON))).alias("gain"), F.avg(F.when(F.col("v") <= low, 1.0).otherwise(0.0)).alias("dark"), F.avg(F.when(F.col("v") >= high, 1.0).otherwise(0.0)).alias("bright"))


def activation_field(rows: DataFrame, by: list[str], value: str, baseline: str) -> DataFrame:
    """value - baseline less its median over the group, negative parts as 0."""
    res = rows.withColumn("_r", F.col(value) - F.col(baseline))
    med = res.groupBy(*by).agg(median(F.col("_r")).alias("_m"))
    return res.join(med, by).withColumn("activation", F.greatest(F.col("_r") - F.col("_m"), F.lit(0.0))).drop("_r", "_m")


def composite(scores: list[Column]) -> Column:
    """Mean of the scores that are there; null without any."""
    known = F.filter(F.array(*scores), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))


def prior_weighted(df: DataFrame, by: str, error: str, weight: str) -> DataFrame:
    """Weighted mean of errors, their plain mean where the weights vanish."""
    w = F.sum(weight)
    return df.groupBy(by).agg(F.when(w > EPSILON, F.sum(F.col(error) * F.col(weight)) / F.nullif(w, F.lit(0.0))).otherwise(F.avg(error)).alias("loss"))
