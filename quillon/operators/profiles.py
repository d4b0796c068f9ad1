"""Material profiles as rows: derived style columns, plans and attestation checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalar import clamp, half_up


def style_columns(df: DataFrame) -> DataFrame:
    """gloss, size, band and width of profiles (gloss_strength, clearcoat, clearcoat_roughness, rotation, span)."""
    return df.withColumns(
        {
            "gloss": half_up(clamp(F.col("gloss_strength") * (0.4 + 0.6 * F.col("clearcoat")), 0, 2)),
            "size": half_up(55 + 70 * F.col("clearcoat_roughness")),
            "band": half_up(F.pmod(117 + F.col("rotation"), F.lit(360.0))),
            "width": half_up(clamp(6 + F.col("span") / 2000 * 10, 6, 16)),
        }
    )


def tier_plan(df: DataFrame) -> DataFrame:
    """detail_tilt, grid_tilt, foil and renderer of profiles (max_tilt, foil, metal, tier)."""
    detail = F.least(F.col("max_tilt"), F.lit(16.0))
    return df.withColumns(
        {
            "detail_tilt": detail,
            "grid_tilt": F.floor(detail + 0.5) / 2,
            "effective_foil": half_up(clamp(0.7 * F.col("foil") + 0.3 * F.col("metal"), 0, 1.4)),
            "plan": F.when(F.col("tier") == "A", "detail").when(F.col("tier") == "B", "grid").otherwise("static"),
        }
    )


def key_differences(keys: Column, allowed: Sequence[str], required: Sequence[str]) -> tuple[Column, Column]:
    """(keys that are not allowed, required keys that are missing), each sorted."""
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    return F.array_sort(F.array_except(keys, lits(allowed))), F.array_sort(F.array_except(lits(required), keys))


def handoff(channels: Column, declared: Sequence[str] = ("normalMap", "directionMap", "gltf")) -> Column:
    """The channels that need another renderer, null where there is none."""
    got = F.array_intersect(channels, F.array(*[F.lit(x) for x in declared]))
    return F.when(F.size(got) > 0, got)
