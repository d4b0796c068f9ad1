"""Queries over the joint fit: rasters of `embeddings` as frames, labels as sources. Registered by catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import joint_fit as jf
from quillon.plans.catalog import PIXELS_SQL, query, r6, raster_pixels

FIT_SQL = PIXELS_SQL + """, p AS (SELECT grp AS source, frame_id AS frame, x / 7.0::DOUBLE AS u, y / 7.0::DOUBLE AS w, v AS r, 0.9::DOUBLE * v AS g, 0.8::DOUBLE * v AS b, 0.2::DOUBLE + x / 20.0::DOUBLE AS ar, 0.3::DOUBLE AS ag, 0.2::DOUBLE + y / 20.0::DOUBLE AS ab
  FROM px WHERE (frame_id + pos) % 11 <> 0)"""


def fit_pixels(spark: SparkSession, sf: str) -> DataFrame:
    p = raster_pixels(spark, sf)
    u, v = jf.grid(8, 8)
    colours = {"r": F.col("v"), "g": 0.9 * F.col("v"), "b": 0.8 * F.col("v"), "ar": 0.2 + F.col("x") / 20, "ag": F.lit(0.3), "ab": 0.2 + F.col("y") / 20}
    return p.select(F.col("grp").alias("source"), F.col("frame_id").alias("frame"), "y", "x", u.alias("u"), v.alias("w"), *[c.alias(n) for n, c in colours.items()], ((F.col("frame_id") + F.col("pos")) % 11 != 0).alias("valid")).withColumnRenamed("w", "v")


def fit_state(spark: SparkSession, sf: str) -> DataFrame:
    """A state to start from: the light's azimuth is the frame's number."""
    frames = fit_pixels(spark, sf).select("source", "frame").distinct()
    own = {"prior": 1 - F.col("source") / 20, "azimuth": (F.col("frame") % 360).cast("double"), "glare_x": F.lit(0.5), "glare_y": F.lit(0.5), "elevation": F.lit(45.0), "hardness": F.lit(2.0), "exposure": F.lit(1.0), "specular": F.lit(0.5), "roughness": F.lit(0.4), "metallic": F.lit(0.5)}
    return frames.select("source", "frame", *[c.alias(n) for n, c in own.items()])


def _seen(glare_x: str, glare_y: str, roughness: str, exposure: str) -> dict[str, str]:
    """The rendered colours in SQL, with the other parameters of fit_state."""
    sigma, stretch = f"(0.04::DOUBLE + 0.3::DOUBLE * {roughness})", "(1 + 1.5::DOUBLE * (1 - sin(radians(45))))"
    dx, dy, cos, sin = f"(u - {glare_x})", f"(w - {glare_y})", "cos(radians(frame % 360))", "sin(radians(frame % 360))"
    radius = f"sqrt(pow(({cos} * {dx} + {sin} * {dy}) / ({sigma} * {stretch}), 2) + pow(({cos} * {dy} - {sin} * {dx}) / {sigma}, 2))"
    lobe = f"0.5::DOUBLE * exp(-0.5::DOUBLE * pow({radius} + 1e-6, 2))"
    return {c: f"least(greatest({exposure} * (a{c} * 0.85::DOUBLE + {lobe} * (0.5::DOUBLE + 0.5::DOUBLE * a{c} / (greatest(ar, ag, ab) + 1e-6))), 0), 1)" for c in "rgb"}


def _off(seen: dict[str, str]) -> str:
    return "(" + " + ".join(f"abs({s} - {c})" for c, s in seen.items()) + ") / 3"


def _luma(parts: dict[str, str]) -> str:
    return " + ".join(f"{w}::DOUBLE * {parts[c]}" for c, w in zip("rgb", jf.LUMA, strict=True))


@query(f"""WITH {FIT_SQL}, o AS (SELECT row_number() OVER (ORDER BY i <> 0 OR j <> 0, j, i) - 1 AS trial, 0.5::DOUBLE + i * 0.05::DOUBLE AS gx, 0.5::DOUBLE + j * 0.05::DOUBLE AS gy FROM range(-2, 3) a(i), range(-2, 3) b(j)),
s AS (SELECT frame, trial, gx, gy, avg({_off(_seen("gx", "gy", "0.4::DOUBLE", "1.0::DOUBLE"))}) AS loss FROM p, o GROUP BY ALL)
SELECT frame, round(arg_min(gx, (round(loss, 12), trial)), 6) AS glare_x, round(arg_min(gy, (round(loss, 12), trial)), 6) AS glare_y FROM s GROUP BY 1""")
def joint_fit_lights(spark, sf):
    """One step of the joint fit: the best place of each frame's glare."""
    return jf.step(fit_pixels(spark, sf), fit_state(spark, sf), "frame", jf.glare_options(0.05)).select("frame", r6("glare_x", "glare_x"), r6("glare_y", "glare_y"))


@query(f"""WITH {FIT_SQL}, o AS (SELECT 0 AS trial, 0.4::DOUBLE AS rough UNION ALL SELECT k + 1, 0.05::DOUBLE + 0.95::DOUBLE * k / 8 FROM range(9) t(k)),
unit AS (SELECT source, frame, trial, {_luma(_seen("0.5::DOUBLE", "0.5::DOUBLE", "rough", "1.0::DOUBLE"))} AS unit, {_luma({c: c for c in "rgb"})} AS seen FROM p, o),
f AS (SELECT source, frame, trial, median(seen / (unit + 1e-6)) FILTER (unit > 0.02) AS ratio FROM unit GROUP BY ALL),
e AS (SELECT source, trial, least(greatest(median(ratio), 0.25), 4) AS exposure FROM f GROUP BY ALL),
l AS (SELECT p.source, frame, o.trial, rough, avg({_off(_seen("0.5::DOUBLE", "0.5::DOUBLE", "rough", "exposure"))}) AS loss FROM p, o, e WHERE e.source = p.source AND e.trial = o.trial GROUP BY ALL)
SELECT source, trial, round(avg(loss), 6) AS loss FROM l GROUP BY ALL""")
def joint_fit_material(spark, sf):
    """One step of the joint fit: the loss of each source for each roughness of the range, its exposure solved anew for each."""
    scores = jf.losses(fit_pixels(spark, sf), fit_state(spark, sf), jf.range_options("roughness", 9), refit=True)
    return scores.groupBy("source", "trial").agg(r6(F.avg("loss"), "loss"))
