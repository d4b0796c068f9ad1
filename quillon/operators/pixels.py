"""Pixel algebra: rasters as rows (frame, pos, y, x, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import EPSILON, clamp
from quillon.operators.joins import on_equal
from quillon.operators.nearest import two_of_each_tile
from quillon.operators.stats import Z_FACTOR, median, median_and_mad, numbered


def explode_rasters(df: DataFrame, frame: str, group: str, values: str, width: int, offset: float = 0.5) -> DataFrame:
    """One row for each value of an array: frame_id, grp, pos, y, x, v = offset + value."""
    out = df.select(F.col(frame).alias("frame_id"), F.col(group).alias("grp"), F.posexplode(values).alias("pos", "e"))
    return out.select("frame_id", "grp", "pos", F.floor(F.col("pos") / width).cast("int").alias("y"), (F.col("pos") % width).alias("x"), (F.lit(offset) + F.col("e").cast("double")).alias("v"))


def measure_sequence(px: DataFrame) -> DataFrame:
    """For each group and pixel over its frames: P95 - P5, population variance, median, and the first frame of the peak."""
    return px.groupBy("grp", "pos").agg(
        (F.percentile("v", F.lit(0.95)) - F.percentile("v", F.lit(0.05))).alias("span"),
        F.var_pop("v").alias("variance"),
        median(F.col("v")).alias("med"),
        (-F.max(F.struct("v", -F.col("frame_id")))["col2"]).alias("peak_frame"),
    )


def peak_frame(px: DataFrame) -> DataFrame:
    """The frame with the greatest value of each group and pixel, the first among equals."""
    best = F.max(F.struct(F.col("v").alias("v"), (-F.col("frame_id")).alias("f")))
    return px.groupBy("grp", "pos").agg(best.alias("b")).select("grp", "pos", (-F.col("b.f")).alias("peak_frame"), F.col("b.v").alias("peak"))


def activation(px: DataFrame, share: float = 0.35, quantile: float = 0.99, floor: float = 0.02) -> DataFrame:
    """Pixels of each frame at or above share x its high quantile; frames whose quantile is not above floor have none."""
    top = px.groupBy("frame_id").agg(F.percentile("v", F.lit(quantile)).alias("top"))
    return px.join(top, "frame_id").where((F.col("top") > floor) & (F.col("v") >= share * F.col("top"))).drop("top")


def next_frames(frames: DataFrame) -> DataFrame:
    """(grp, f, g): each frame with the one after it in its group."""
    own = numbered(frames.select("grp", "frame_id").distinct(), ["grp"], ["frame_id"], "k")
    after = own.select("grp", (F.col("k") - 1).alias("k"), F.col("frame_id").alias("g"))
    return own.join(after, ["grp", "k"]).select("grp", F.col("frame_id").alias("f"), "g")


def mask_iou(masks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Overlap of the masks (frame_id, pos) of given pairs (f, g): shared / joined pixels; two empty masks have 1."""
    sizes = masks.groupBy("frame_id").count()
    size = lambda c: pairs.select("f", "g", F.col(c).alias("frame_id")).join(sizes, "frame_id").select("f", "g", F.col("count").alias(f"n{c}"))
    of = pairs.select("f", "g").join(masks.select(F.col("frame_id").alias("f"), "pos"), "f")
    shared = of.join(masks.select(F.col("frame_id").alias("g"), "pos"), ["g", "pos"]).groupBy("f", "g").agg(F.count("*").alias("both"))
    out = pairs.join(shared, ["f", "g"], "left").join(size("f"), ["f", "g"], "left").join(size("g"), ["f", "g"], "left").na.fill(0, ["both", "nf", "ng"])
    either = F.col("nf") + F.col("ng") - F.col("both")
    return out.select("f", "g", F.when(either == 0, 1.0).otherwise(F.col("both") / F.nullif(either, F.lit(0))).alias("iou"))


def grid_cell(at: Column, size: int, cells: int = 3) -> Column:
    """The cell of a coordinate on a grid whose edges are int(size k / cells)."""
    out = F.lit(cells - 1)
    for k in reversed(range(1, cells)):
        out = F.when(at < size * k // cells, k - 1).otherwise(out)
    return out


def highlight_centroid(px: DataFrame, quantile: float = 0.96, least: int = 4) -> DataFrame:
    """Weighted centroid of each frame's pixels at or above its quantile (weight: the excess) and their number; null where
    the frame has fewer than `least` pixels in all."""
    top = px.groupBy("frame_id", "grp").agg(F.percentile("v", F.lit(quantile)).alias("top"), F.count("v").alias("size"))
    w = F.greatest(F.col("v") - F.col("top"), F.lit(EPSILON))
    hot = px.join(top, ["frame_id", "grp"]).where("v >= top").groupBy("frame_id", "grp")
    sums = hot.agg(F.count("*").alias("n"), F.max("size").alias("size"), (F.sum(w * F.col("x")) / F.sum(w)).alias("cx"), (F.sum(w * F.col("y")) / F.sum(w)).alias("cy"))
    return sums.select("frame_id", "grp", "n", *[F.when(F.col("size") >= least, F.col(c)).alias(c) for c in ("cx", "cy")])


def gradient(px: DataFrame) -> DataFrame:
    """Central differences of inner pixels: gx, gy and magnitude."""
    row, column = Window.partitionBy("frame_id", "y").orderBy("x"), Window.partitionBy("frame_id", "x").orderBy("y")
    out = px.select("frame_id", "pos", "y", "x", ((F.lead("v").over(row) - F.lag("v").over(row)) / 2).alias("gx"), ((F.lead("v").over(column) - F.lag("v").over(column)) / 2).alias("gy"))
    return out.where("gx IS NOT NULL AND gy IS NOT NULL").withColumn("magnitude", F.hypot("gx", "gy"))


def gradient_axis(grads: DataFrame, by: str) -> DataFrame:
    """Principal axis of the structure tensor, in radians."""
    sums = grads.groupBy(by).agg(F.sum(F.col("gx") ** 2).alias("xx"), F.sum(F.col("gy") ** 2).alias("yy"), F.sum(F.col("gx") * F.col("gy")).alias("xy"))
    return sums.select(by, (0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))).alias("axis"), F.hypot(2 * F.col("xy"), F.col("xx") - F.col("yy")).alias("strength"))


def temporal_delta(px: DataFrame) -> DataFrame:
    """Mean absolute change of each frame from the one before it in its group. Frames are numbered first, then pixels are
    joined with those of the next frame: both sides are keyed by pixel, none by group."""
    frames = numbered(px.select("grp", "frame_id").distinct(), ["grp"], ["frame_id"], "k")
    own = px.join(frames, ["grp", "frame_id"]).select("grp", "frame_id", "k", "pos", "v")
    before = own.select("grp", (F.col("k") + 1).alias("k"), "pos", F.col("v").alias("u"))
    return own.join(before, ["grp", "k", "pos"]).groupBy("grp", "frame_id").agg(F.avg(F.abs(F.col("v") - F.col("u"))).alias("delta"))


def trajectory_coherence(centroids: DataFrame) -> DataFrame:
    """For each group's centroids in order of frame: steps, mean step and mean turn score (1 + cos of the angle between
    neighbouring steps) / 2; steps below 1e-6 are left out of the turns."""
    w = Window.partitionBy("grp").orderBy("frame_id")
    steps = centroids.where("cx IS NOT NULL").withColumn("dx", F.col("cx") - F.lag("cx").over(w)).withColumn("dy", F.col("cy") - F.lag("cy").over(w))
    steps = steps.withColumn("px", F.lag("dx").over(w)).withColumn("py", F.lag("dy").over(w)).withColumn("len", F.hypot("dx", "dy")).withColumn("plen", F.hypot("px", "py"))
    turn = F.when((F.col("len") > EPSILON) & (F.col("plen") > EPSILON), (1 + (F.col("dx") * F.col("px") + F.col("dy") * F.col("py")) / F.nullif(F.col("len") * F.col("plen"), F.lit(0.0))) / 2)
    return steps.groupBy("grp").agg(F.count("len").alias("steps"), F.avg("len").alias("mean_step"), F.avg(turn).alias("turn"))


def temporal_coherence(observed: DataFrame, rendered: DataFrame, least_step: float = 1.0) -> DataFrame:
    """How well the rendered highlight of each group moves as the observed one does: steps scored and their mean score.

    Both are centroids (grp, frame_id, cx, cy); frames without one on either side are left out, the others follow each other
    by frame_id. A step where neither moves by least_step tells nothing. Others score half for the direction, (1 + cos) / 2
    (0 where one side stands still), and half for the length, 1 - |difference| / greater length."""
    both = observed.where("cx IS NOT NULL").select("grp", "frame_id", F.col("cx").alias("ox"), F.col("cy").alias("oy")).join(rendered.where("cx IS NOT NULL").select("grp", "frame_id", F.col("cx").alias("rx"), F.col("cy").alias("ry")), ["grp", "frame_id"])
    own = numbered(both, ["grp"], ["frame_id"], "k")
    before = own.select("grp", (F.col("k") + 1).alias("k"), *[F.col(c).alias(f"p{c}") for c in ("ox", "oy", "rx", "ry")])
    steps = own.join(before, ["grp", "k"]).select("grp", *[(F.col(c) - F.col(f"p{c}")).alias(c) for c in ("ox", "oy", "rx", "ry")])
    steps = steps.withColumns({"ol": F.hypot("ox", "oy"), "rl": F.hypot("rx", "ry")}).where(F.greatest("ol", "rl") >= least_step)
    length = 1 - F.least(F.abs(F.col("ol") - F.col("rl")) / (F.greatest("ol", "rl") + EPSILON), F.lit(1.0))
    cosine = clamp((F.col("ox") * F.col("rx") + F.col("oy") * F.col("ry")) / F.nullif(F.col("ol") * F.col("rl"), F.lit(0.0)), -1, 1)
    direction = F.when(F.least("ol", "rl") < EPSILON, 0.0).otherwise((1 + cosine) / 2)
    return steps.groupBy("grp").agg(F.count("*").alias("steps"), F.avg(0.5 * direction + 0.5 * length).alias("coherence"))


def nearest_two(points: DataFrame, queries: DataFrame, key: str, values: str, ratio: float = 0.72) -> DataFrame:
    """For each query its nearest point (of equal ones the least), its distance, that of the second nearest, and whether
    their ratio is low enough.

    queries is a stated query set held against all points, tile by tile (see nearest); each tile sends on the two nearest of a query."""
    pairs = two_of_each_tile(points, queries, key, values)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("d").asc_nulls_last(), "point"))
    own = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    joined = pairs.withColumn("place", place).where("place <= 2").groupBy("query").agg(own(1, "point").alias("point"), own(1, "d").alias("distance"), own(2, "d").alias("d2"))
    return joined.select("query", "point", "distance", "d2", (F.col("distance") < ratio * F.col("d2")).alias("matched"))


def envelope(px: DataFrame, floor: float = 1e-4, limit: float = 3.5, least: int = 3) -> DataFrame:
    """Appearance envelope over sources (grp): median, MAD and spread of each source, outliers by modified z of the medians
    (none with fewer than `least` sources), and the number of inliers."""
    sums = px.groupBy("grp").agg(F.count("*").alias("n"), F.var_pop("v").alias("variance"), F.min("v").alias("low"), F.max("v").alias("high"))
    per = on_equal(sums, median_and_mad(px, ["grp"], "v"), ["grp"])
    # one row a source from here on
    centre = per.agg(median(F.col("med")).alias("m"), F.count("*").alias("sources"))
    with_m = per.crossJoin(F.broadcast(centre))
    spread = with_m.agg(median(F.abs(F.col("med") - F.col("m"))).alias("s"))
    z = Z_FACTOR * F.abs(F.col("med") - F.col("m")) / F.greatest(F.col("s"), F.lit(floor))
    return with_m.crossJoin(F.broadcast(spread)).select("grp", "n", "med", "mad", "variance", "low", "high", z.alias("z"), ((F.col("sources") >= least) & (z > limit)).alias("outlier"))


def normals(px: DataFrame, left: Column, right: Column, top: Column, bottom: Column, strength: float = 1.6) -> DataFrame:
    """Surface normals from four raking directions (mean of the frames of each): nx, ny, nz of length 1 for each pixel."""
    pick = lambda side: F.avg(F.when(side, F.col("v")))
    m = px.groupBy("pos").agg(pick(left).alias("l"), pick(right).alias("r"), pick(top).alias("t"), pick(bottom).alias("b"))
    tilt = lambda a, b: strength * (F.col(a) - F.col(b)) / F.greatest(F.col(a) + F.col(b), F.lit(EPSILON))
    m = m.withColumn("nx", tilt("l", "r")).withColumn("ny", tilt("t", "b"))
    size = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + 1)
    return m.select("pos", (F.col("nx") / size).alias("nx"), (F.col("ny") / size).alias("ny"), (1 / size).alias("nz"))


#: Fixed values of intensity_coherence: offset of the logarithm, least mean level, and least spread of the differences.
LOG_OFFSET, LEAST_LEVEL, LEAST_SPREAD = 0.05, 0.02, 0.25


def intensity_coherence(levels: DataFrame, by: str, source: str, a: str, b: str) -> DataFrame:
    """Whether two levels of the sources of each group differ alike: over all ordered pairs of sources, the correlation of
    the differences of their logarithms about the mean difference, times the lesser spread over the greater.

    Null with fewer than 3 sources, where neither level is above the least, or where all sources agree; 0 where one side alone
    varies. The sums over pairs come from sums over sources: with place i of n, the differences add up to sum((n - 1 - 2 i) x),
    and their products to n sum(xy) - sum(x) sum(y)."""
    own = numbered(levels.select(by, F.col(source).alias("_source"), F.col(a).alias("_a"), F.col(b).alias("_b")), [by], ["_source"], "_i")
    own = own.withColumns({"x": F.log(F.col("_a") + LOG_OFFSET), "y": F.log(F.col("_b") + LOG_OFFSET)})
    n, turn = F.col("n"), lambda c: F.sum(F.col("_i") * F.col(c))
    sums = own.groupBy(by).agg(F.count("*").alias("n"), F.greatest(F.avg("_a"), F.avg("_b")).alias("level"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), turn("x").alias("ix"), turn("y").alias("iy"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy"))
    pairs = n * (n - 1) / 2
    mean = lambda s, i: ((n - 1) * F.col(s) - 2 * F.col(i)) / pairs
    moment = lambda v, m, k: n * n * F.col(v) - pairs * m * k
    mx, my = mean("sx", "ix"), mean("sy", "iy")
    square = lambda v, m: F.greatest(moment(v, m, m), F.lit(0.0))
    three = sums.where("n >= 3").withColumns({"xx": square("vx", mx), "yy": square("vy", my), "xy": moment("vxy", mx, my), "pairs": pairs})
    spread = lambda c: F.sqrt(F.col(c) / F.col("pairs"))
    low, high = F.least(spread("xx"), spread("yy")), F.greatest(spread("xx"), spread("yy"))
    score = clamp(F.col("xy") / (F.sqrt(F.col("xx") * F.col("yy")) + EPSILON), -1, 1) * low / (high + EPSILON)
    told = three.select(by, F.when((F.col("level") < LEAST_LEVEL) | (high < LEAST_SPREAD), None).when(low < 1e-9, 0.0).otherwise(score).alias("coherence"))
    return sums.select(by, "n").join(told, by, "left")


def mask_set(kind: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """REPLACE, UNION, SUBTRACT or INTERSECT of two sets of pixels."""
    return {"REPLACE": lambda: b.distinct(), "UNION": lambda: a.union(b).distinct(), "SUBTRACT": lambda: a.subtract(b), "INTERSECT": lambda: a.intersect(b)}[kind]()


def planar_light(x: Column, y: Column, gx: Column, gy: Column, specular: Column, roughness: Column, hardness: float = 2.0) -> Column:
    """A planar highlight: specular x exp(-(r / width)^hardness / 2), width growing with roughness."""
    r = F.hypot(x - gx, y - gy) / (0.08 + 0.5 * roughness)
    return specular * F.exp(-0.5 * F.pow(r, F.lit(hardness)))

