"""One material for many sources: block-coordinate descent whose state is a table.

Pixels are rows (source, frame, y, x, u, v, r, g, b, ar, ag, ab, valid): observed linear colours, those of the albedo, and
coordinates in 0..1. The state has a row for each frame with all parameters: the light of the frame (azimuth, glare_x,
glare_y), what is shared by a source's frames (elevation, hardness, exposure) and by all (specular, roughness, metallic). A
step offers options for some parameters, scores all options of all frames in one pass over the pixels (losses are
pre-aggregated in every task), and takes the least loss of each frame, each source, or over all sources, in one aggregate;
of equal losses the first option, which is the present value. Exposure is never an option of the material's steps: it is the
median ratio of observed and rendered luma, found anew for each option, so that brightness cannot pass for material.

Pixels are written once, in buckets of (source, frame), so that a step moves the state to them. Sources are registered: pose
is not fitted. A frame without a valid pixel has loss 0 and takes part in nothing; null colours are not valid.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalar import EPSILON, clamp
from quillon.operators import pixels as px
from quillon.operators.stats import median
from quillon.session import remove_folder, shared_folder

#: Bounds of the parameters, the shading of the diffuse part, the luma from which an exposure is read, weights of luma.
BOUNDS = {"specular": (0.0, 1.0), "roughness": (0.05, 1.0), "metallic": (0.0, 1.0), "elevation": (5.0, 90.0), "hardness": (1.0, 4.0), "exposure": (0.25, 4.0), "glare": (-0.2, 1.2)}
SHADING, LEAST_LUMA, LUMA = 0.85, 0.02, (0.2126, 0.7152, 0.0722)
#: Where a fit starts, and the quantile of a frame's highlight.
START, HIGHLIGHT = {"specular": 0.5, "roughness": 0.4, "metallic": 0.5, "elevation": 45.0, "hardness": 2.0}, 0.96
#: Steps of the glare's grid (two to each side), spans and steps of the azimuth, widths of the fine search, factors of the exposure.
GLARE_STEPS, AZIMUTHS, FINE, FACTORS = (0.05, 0.015), ((90.0, 15.0), (12.0, 4.0)), {"elevation": (4.0, 8.0), "hardness": (0.2, 0.4)}, (0.96, 0.98, 1.02, 1.04)
#: For each pass over the material, the span around the present value (None: the whole range) and the number of values.
SPANS = ((None, 9), (0.15, 9), (0.05, 5))

LIGHT, OWN, SHARED = ("azimuth", "glare_x", "glare_y"), ("elevation", "hardness", "exposure"), ("specular", "roughness", "metallic")
KEYS = {"frame": ["source", "frame"], "source": ["source"], "shared": []}
Values = dict[str, Column]


def _bounded(value: Column, name: str) -> Column:
    """The value within its bounds; null stays null."""
    return F.when(value.isNotNull(), clamp(value, *BOUNDS[name]))


def luma(r: Column, g: Column, b: Column) -> Column:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def rendered(p: Values) -> tuple[Column, Column, Column]:
    """The colours of a planar sheet under one light: the shaded albedo and a lobe about the glare, which grows with roughness,
    stretches along the azimuth at low elevation, and falls off as its hardness says; a metal colours it."""
    sigma = 0.04 + 0.30 * p["roughness"]
    stretch = 1 + 1.5 * (1 - F.sin(F.radians(clamp(p["elevation"], *BOUNDS["elevation"]))))
    dx, dy = F.col("u") - p["glare_x"], F.col("v") - p["glare_y"]
    cos, sin = F.cos(F.radians(p["azimuth"])), F.sin(F.radians(p["azimuth"]))
    radius = F.hypot((cos * dx + sin * dy) / (sigma * stretch), (cos * dy - sin * dx) / sigma)
    lobe = p["specular"] * F.exp(-0.5 * F.pow(radius + EPSILON, clamp(p["hardness"], *BOUNDS["hardness"])))
    most = F.greatest("ar", "ag", "ab") + EPSILON
    return tuple(clamp(p["exposure"] * (F.col(a) * SHADING + lobe * (1 - p["metallic"] + p["metallic"] * F.col(a) / most)), 0, 1) for a in ("ar", "ag", "ab"))


def _trials(pixels: DataFrame, state: DataFrame, options: Column) -> tuple[DataFrame, Callable[[str], Column]]:
    """Each valid pixel with each option of its frame (trial, option), and how to read a parameter there."""
    fields = state.select(options.alias("o")).schema["o"].dataType.elementType.names
    held = pixels.where("valid").join(state.withColumn("options", options), ["source", "frame"])
    rows = held.select("*", F.posexplode("options").alias("trial", "option")).drop("options")
    return rows, lambda name: F.col("option")[name] if name in fields else F.col(name)


def _exposures(rows: DataFrame, value: Callable[[str], Column]) -> DataFrame:
    """(source, trial, fitted): the median over frames of the median ratio of observed and rendered luma, within bounds."""
    unit = luma(*rendered({n: F.lit(1.0) if n == "exposure" else value(n) for n in (*LIGHT, *OWN, *SHARED)}))
    ratio = F.when(unit > LEAST_LUMA, luma(F.col("r"), F.col("g"), F.col("b")) / (unit + EPSILON))
    frames = rows.groupBy("source", "frame", "trial").agg(median(ratio).alias("ratio"))
    return frames.groupBy("source", "trial").agg(_bounded(median(F.col("ratio")), "exposure").alias("fitted"))


def losses(pixels: DataFrame, state: DataFrame, options: Column, refit: bool = False) -> DataFrame:
    """(source, frame, trial, loss): the mean absolute difference of colours over valid pixels, for each option of each frame.
    refit: with the exposure that fits the option best."""
    rows, value = _trials(pixels, state, options)
    if refit:
        rows = rows.join(_exposures(rows, value), ["source", "trial"], "left").withColumn("exposure", F.coalesce("fitted", "exposure"))
    r, g, b = rendered({n: value(n) for n in (*LIGHT, *OWN, *SHARED)})
    off = (F.abs(r - F.col("r")) + F.abs(g - F.col("g")) + F.abs(b - F.col("b"))) / 3
    return rows.groupBy("source", "frame", "trial").agg(F.avg(off).alias("loss"))


def choose(scores: DataFrame, state: DataFrame, level: str) -> DataFrame:
    """(keys of the level, trial, loss): the option with the least loss. A source's loss is the mean of its frames', the whole
    loss the sum of the sources', each times its prior."""
    priors = state.groupBy("source").agg(F.first("prior").alias("prior"))
    if level != "frame":
        scores = scores.groupBy("source", "trial").agg(F.avg("loss").alias("loss"))
    if level == "shared":
        scores = scores.join(priors, "source").groupBy("trial").agg(F.sum(F.col("prior") * F.col("loss")).alias("loss"))
    return scores.groupBy(*KEYS[level]).agg(F.min(F.struct(F.round("loss", 12).alias("loss"), "trial")).alias("best")).select(*KEYS[level], "best.trial", "best.loss")


def step(pixels: DataFrame, state: DataFrame, level: str, options: Column, refit: bool = False) -> DataFrame:
    """The state with the best options taken. options: an array of structs of parameters, the present values first."""
    best = choose(losses(pixels, state, options, refit), state, level).drop("loss")
    with_best = state.withColumn("options", options)
    with_best = with_best.join(best, KEYS[level], "left") if KEYS[level] else with_best.crossJoin(F.broadcast(best))  # one row
    fields = with_best.schema["options"].dataType.elementType.names
    taken = F.get("options", F.coalesce("trial", F.lit(0)))
    return with_best.select(*[taken[c].alias(c) if c in fields else F.col(c) for c in state.columns])


def _with(present: tuple[str, ...], *others: Values) -> Column:
    """Options: the present values of the parameters, then the others."""
    one = lambda v: F.struct(*[v.get(n, F.col(n)).cast("double").alias(n) for n in present])
    return F.array(one({}), *map(one, others))


def glare_options(size: float) -> Column:
    move = lambda c, k: clamp(F.col(c) + k * size, *BOUNDS["glare"])
    return _with(("glare_x", "glare_y"), *[{"glare_x": move("glare_x", i), "glare_y": move("glare_y", j)} for j in range(-2, 3) for i in range(-2, 3) if i or j])


def azimuth_options(span: float, size: float) -> Column:
    n = int(span / size)
    return _with(("azimuth",), *[{"azimuth": F.pmod(F.col("azimuth") + k * size, F.lit(360.0))} for k in range(-n, n + 1) if k])


def range_options(name: str, count: int, span: float | None = None) -> Column:
    """count values of the whole range, or of the span to both sides of the present one."""
    low, high = BOUNDS[name]
    if span is None:
        return _with((name,), *[{name: F.lit(low + (high - low) * k / (count - 1))} for k in range(count)])
    return _with((name,), *[{name: clamp(F.col(name) + span * (2 * k / (count - 1) - 1), low, high)} for k in range(count)])


def around_options(name: str, moves: tuple[float, ...]) -> Column:
    return _with((name,), *[{name: clamp(F.col(name) + s * d, *BOUNDS[name])} for d in moves for s in (-1, 1)])


def refit_exposure(pixels: DataFrame, state: DataFrame) -> DataFrame:
    """The state with each source's exposure solved; it stays where no pixel tells."""
    rows, value = _trials(pixels, state, _with(("exposure",)))
    fitted = _exposures(rows, value).select("source", "fitted")
    return state.join(fitted, "source", "left").withColumn("exposure", F.coalesce("fitted", "exposure")).select(*state.columns)


def initial(pixels: DataFrame, priors: DataFrame) -> DataFrame:
    """The state to start from: the glare at the frame's highlight (or the middle), the light from there, exposure from medians."""
    own = pixels.where("valid").select(F.col("source").alias("grp"), F.col("frame").alias("frame_id"), F.col("u").alias("x"), F.col("v").alias("y"), luma(F.col("r"), F.col("g"), F.col("b")).alias("v"))
    spot = px.highlight_centroid(own, HIGHLIGHT).select(F.col("grp").alias("source"), F.col("frame_id").alias("frame"), F.col("cx").alias("glare_x"), F.col("cy").alias("glare_y"))
    of = lambda *c: median(F.when(F.col("valid"), luma(*map(F.col, c))))
    frames = pixels.groupBy("source", "frame").agg(of("r", "g", "b").alias("seen"), of("ar", "ag", "ab").alias("base"), F.count_if("valid").alias("pixels"))
    exposure = frames.groupBy("source").agg(F.coalesce(_bounded(median(F.col("seen") / (F.col("base") * SHADING + EPSILON)), "exposure"), F.lit(1.0)).alias("exposure"))
    state = frames.select("source", "frame").join(spot, ["source", "frame"], "left").join(exposure, "source").join(priors.select("source", "prior"), "source")
    state = state.withColumns({"glare_x": F.coalesce("glare_x", F.lit(0.5)), "glare_y": F.coalesce("glare_y", F.lit(0.5)), **{k: F.lit(x) for k, x in START.items()}})
    turn = F.pmod(F.degrees(F.atan2(F.col("glare_y") - 0.5, F.col("glare_x") - 0.5)), F.lit(360.0))
    return state.withColumn("azimuth", turn).select("source", "frame", "prior", *LIGHT, *OWN, *SHARED)


def _source_steps() -> list[Callable[[DataFrame, DataFrame], DataFrame]]:
    """The steps over each source's own parameters."""
    by = lambda level, options: lambda p, s: step(p, s, level, options())
    out = [by("frame", lambda x=x: glare_options(x)) for x in GLARE_STEPS] + [by("frame", lambda x=x: azimuth_options(*x)) for x in AZIMUTHS] + [refit_exposure]
    for name, moves in FINE.items():
        out += [by("source", lambda n=name: range_options(n, 7)), by("source", lambda n=name, m=moves: around_options(n, m))]
    factors = lambda: _with(("exposure",), *[{"exposure": clamp(F.col("exposure") * f, *BOUNDS["exposure"])} for f in FACTORS])
    return [*out, refit_exposure, by("source", factors)]


def _material_steps(spans=SPANS) -> list[Callable[[DataFrame, DataFrame], DataFrame]]:
    return [lambda p, s, n=name, w=span, k=count: step(p, s, "shared", range_options(n, k, w), refit=True) for span, count in spans for name in SHARED]


def fit(pixels: DataFrame, priors: DataFrame, rounds: int = 2) -> DataFrame:
    """Fits one material to all sources: rounds of the sources' own steps and the material's, then both once more. priors:
    source and prior, its weight. Returns the state: a row for each frame with all parameters.

    A step is a job over all pixels; its result, one row a frame, is written, and the one before it removed."""
    spark = pixels.sparkSession
    name, parts = f"quillon_pixels_{uuid.uuid4().hex}", max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = shared_folder(spark, "joint-pixels")
    pixels.write.bucketBy(parts, "source", "frame").option("path", at).format("parquet").saveAsTable(name)
    try:
        own = spark.table(name)
        before, state = None, initial(own, priors)
        for move in [lambda p, s: s, *(rounds + 1) * [*_source_steps(), *_material_steps()], refit_exposure]:
            now = shared_folder(spark, "joint-state")
            (state := move(own, state)).write.parquet(now)
            state = spark.read.schema(state.schema).parquet(now)
            if before:
                remove_folder(before)
            before = now
        return state
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_folder(at)


def report(pixels: DataFrame, state: DataFrame, threshold: float = 0.06) -> DataFrame:
    """For each source: frames, coverage (share of valid pixels), loss, exposure, elevation, hardness, the mean azimuth of its
    frames' lights, and weight: its prior times exp(-loss / (2 threshold)), in 0..1."""
    seen = pixels.groupBy("source").agg(F.countDistinct("frame").alias("frames"), F.avg(F.col("valid").cast("double")).alias("coverage"))
    loss = losses(pixels, state, _with(("exposure",))).groupBy("source").agg(F.avg("loss").alias("loss"))
    turn = F.pmod(F.degrees(F.atan2(F.sum(F.sin(F.radians("azimuth"))), F.sum(F.cos(F.radians("azimuth"))))), F.lit(360.0))
    own = state.groupBy("source").agg(*[F.first(c).alias(c) for c in ("prior", "exposure", "elevation", "hardness")], turn.alias("azimuth"))
    weight = clamp(F.col("prior") * F.exp(-F.col("loss") / (2 * threshold)), 0, 1)
    out = seen.join(own, "source").join(loss, "source", "left").withColumn("loss", F.coalesce("loss", F.lit(0.0)))
    return out.select("source", "frames", "coverage", "loss", "exposure", "elevation", "hardness", "azimuth", weight.alias("weight"))


def grid(height: int, width: int) -> tuple[Column, Column]:
    """u and v of a pixel (x, y)."""
    return F.col("x") / max(width - 1, 1), F.col("y") / max(height - 1, 1)


def plain_rendered(albedo, u, v, azimuth, elevation, glare_x, glare_y, hardness, exposure, specular, roughness, metallic) -> list[float]:
    """rendered, of one pixel in plain numbers: for tests and for making examples."""
    sigma, a = 0.04 + 0.30 * roughness, math.radians(azimuth)
    stretch = 1 + 1.5 * (1 - math.sin(math.radians(elevation)))
    dx, dy = u - glare_x, v - glare_y
    radius = math.hypot((math.cos(a) * dx + math.sin(a) * dy) / (sigma * stretch), (math.cos(a) * dy - math.sin(a) * dx) / sigma)
    lobe = specular * math.exp(-0.5 * (radius + EPSILON) ** hardness)
    return [min(max(exposure * (c * SHADING + lobe * (1 - metallic + metallic * c / (max(albedo) + EPSILON))), 0.0), 1.0) for c in albedo]
