"""Fits: losses, grids evaluated as rows, and bounded coordinate descent driven from the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the loss terms.
LOSS_WEIGHTS = {"linear_rgb": 1.0, "gradient": 0.35, "highlight_centroid": 0.65, "hue": 0.45, "exposure": 0.25}


def weighted_loss(terms: dict[str, Column]) -> Column:
    return sum((terms[k] * w for k, w in LOSS_WEIGHTS.items() if k in terms), F.lit(0.0))


def frame_loss(df: DataFrame, frame: str, loss: str, region_loss: Column, region_weight: Column) -> DataFrame:
    """0.45 x a frame's loss + 0.55 x the weighted mean of its regions' losses; the frame's own where it has no weight."""
    regions = F.sum(region_loss * region_weight) / F.nullif(F.sum(region_weight), F.lit(0.0))
    return df.groupBy(frame).agg((0.45 * F.avg(loss) + 0.55 * F.coalesce(regions, F.avg(loss))).alias("frame_loss"))


def grid_argmin(grid: DataFrame, data: DataFrame, key: str, loss: Column, order: str) -> DataFrame:
    """For each key of data, the grid row with the least mean loss, the first by `order` among equals. The grid is a stated
    set of candidates, broadcast; losses are pre-aggregated in every task."""
    scored = data.crossJoin(F.broadcast(grid)).groupBy(key, order).agg(F.avg(loss).alias("loss"))
    return scored.groupBy(key).agg(F.min(F.struct(F.round("loss", 9).alias("loss"), F.col(order).alias(order))).alias("b")).select(key, f"b.{order}", "b.loss")


@dataclass(frozen=True)
class Parameter:
    """A parameter of a fit, with its bounds and steps."""

    name: str
    low: float
    high: float
    step: float
    least_step: float
    locked: bool = False


def candidates(values: dict[str, float], spec: Parameter, step: float) -> list[dict[str, float]]:
    """The neighbours one step down and up, inside the bounds; none for a locked parameter or where clipping leaves it as it is."""
    out = []
    for v in (values[spec.name] - step, values[spec.name] + step):
        v = min(max(v, spec.low), spec.high)
        if not spec.locked and v != values[spec.name] and v not in [o[spec.name] for o in out]:
            out.append({**values, spec.name: v})
    return out


def coordinate_descent(start: dict[str, float], specs: Sequence[Parameter], evaluate: Callable[[list[dict[str, float]]], list[float]], passes: int = 4, trials: int = 80, tolerance: float = 5e-4) -> tuple[dict[str, float], float, int]:
    """Coarse to fine, one parameter at a time; evaluate scores a list of candidates in one Spark job. Values already tried
    are not tried again. Returns (values, loss, number of trials)."""
    memo: dict[tuple, float] = {}

    def score(some: list[dict[str, float]]) -> list[float]:
        new = [c for c in some if tuple(sorted(c.items())) not in memo][: max(0, trials - len(memo))]
        memo.update(zip((tuple(sorted(c.items())) for c in new), evaluate(new) if new else [], strict=True))
        return [memo.get(tuple(sorted(c.items())), float("inf")) for c in some]

    best, loss = start, score([start])[0]
    steps = {s.name: s.step for s in specs}
    for _ in range(passes):
        before = loss
        for spec in specs:
            if steps[spec.name] > 0 and (some := candidates(best, spec, steps[spec.name])):
                found, values = min(zip(score(some), range(len(some)), strict=True)), some
                if found[0] < loss:
                    loss, best = found[0], values[found[1]]
        if before - loss < tolerance:
            steps = {s.name: steps[s.name] / 2 if steps[s.name] / 2 >= s.least_step else 0.0 for s in specs}
            if not any(steps.values()):
                break
    return best, loss, len(memo)
