"""Parameter specifications of profiles held against the bounds that are allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.gates import reasons

#: Least, most, default step and least step of each parameter.
ALLOWED = {
    "renderer.foilStrength": (0.0, 2.0, 0.18, 0.01),
    "renderer.metallicStrength": (0.0, 2.0, 0.18, 0.01),
    "renderer.glossStrength": (0.0, 2.0, 0.15, 0.01),
    "renderer.textureStrength": (0.0, 2.0, 0.12, 0.01),
    "renderer.roughness": (0.0, 1.0, 0.08, 0.005),
    "renderer.clearcoat": (0.0, 1.0, 0.08, 0.005),
    "renderer.clearcoatRoughness": (0.0, 1.0, 0.06, 0.005),
    "renderer.iridescence": (0.0, 1.0, 0.1, 0.005),
    "renderer.iridescenceIor": (1.0, 2.333, 0.08, 0.005),
    "renderer.iridescenceThicknessMinNm": (0.0, 2000.0, 40.0, 2.0),
    "renderer.iridescenceThicknessMaxNm": (0.0, 2000.0, 55.0, 2.0),
    "renderer.anisotropy": (0.0, 1.0, 0.1, 0.005),
}


def check_specs(specs: DataFrame, group: str) -> DataFrame:
    """specs (group, name, low, high, step, least_step; nulls take the allowed value) with the effective figures and reasons.

    Bounds lie within the allowed ones and in order, steps are above 0 and in order, names are allowed and unique in a group."""
    spark = specs.sparkSession
    safe = spark.createDataFrame([(k, *v) for k, v in ALLOWED.items()], "name string, s_low double, s_high double, s_step double, s_least double")
    many = specs.groupBy(group, "name").agg(F.count("*").alias("_n"))
    rows = specs.join(many, [group, "name"]).join(F.broadcast(safe), "name", "left")  # safe: as many rows as ALLOWED
    rows = rows.withColumns({c: F.coalesce(c, s) for c, s in (("low", "s_low"), ("high", "s_high"), ("step", "s_step"), ("least_step", "s_least"))})
    known = F.col("s_low").isNotNull()
    bounds = (F.col("low") < F.col("s_low")) | (F.col("high") > F.col("s_high")) | (F.col("high") <= F.col("low"))
    steps = (F.col("step") <= 0) | (F.col("least_step") <= 0) | (F.col("least_step") > F.col("step"))
    told = reasons([(~known, "unsupported"), (known & bounds, "bounds"), (known & steps, "steps"), (F.col("_n") > 1, "repeated")])
    return rows.withColumn("reasons", told).drop("_n", "s_low", "s_high", "s_step", "s_least")
