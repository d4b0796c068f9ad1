"""Robust and circular statistics over groups of rows.

Nulls and NaN are no values: they count for no statistic. A null key is a group like any other. Columns of the caller stay,
whatever their names, but for those that a function adds."""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import EPSILON, clamp
from quillon.operators.joins import fresh, on_equal
from quillon.session import shared_folder

Z_FACTOR = 0.6745
#: Values that global_percentiles brings to the driver for each rank at most, and buckets of a round.
FINAL_VALUES, BUCKETS = 100_000, 2048
#: Rows of a group that one task sorts; groups beyond are dealt by ranges.
GROUP_ROWS = 2_000_000


def _valued(value: Column) -> Column:
    x = value.cast("double")
    return x.isNotNull() & ~F.isnan(x)


def global_percentiles(df: DataFrame, value: str, quantiles: Sequence[float]) -> list[float | None]:
    """Exact, linearly interpolated percentiles of a whole column, without one task that holds it.

    Each wanted rank has an interval of values. A round counts all intervals in BUCKETS parts in one pass (pre-aggregated in
    every task), and each rank goes on in the part that has it, until every interval holds at most FINAL_VALUES values or equal
    ones; a last pass reads those.
    """
    x = df.where(_valued(F.col(value))).select(F.col(value).cast("double").alias("x"))
    n, low, high = x.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(quantiles)
    places = [q * (n - 1) for q in quantiles]
    at = {rank: (low, high, 0, n) for r in places for rank in (math.floor(r), math.ceil(r))}  # least, greatest, values before, values

    def piece(cuts: list[tuple[float, float]]) -> Column:
        """The number of the interval that x is in; intervals do not overlap."""
        out = F.lit(None).cast("int")
        for k, (a, b) in enumerate(cuts):
            out = F.when((F.col("x") >= a) & (F.col("x") <= b), k).otherwise(out)
        return out

    while wide := sorted({(a, b) for a, b, _, count in at.values() if count > FINAL_VALUES and a < b}):
        part = F.lit(0)
        for k, (a, b) in enumerate(wide):
            # halves keep the width finite for values of opposite signs near the ends of the range of doubles
            part = F.when(F.col("piece") == k, F.least(F.floor((F.col("x") / 2 - a / 2) / ((b / 2 - a / 2) / BUCKETS)), F.lit(BUCKETS - 1))).otherwise(part)
        rows = x.withColumn("piece", piece(wide)).where("piece IS NOT NULL").groupBy("piece", part.alias("k")).agg(F.count("*").alias("c"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy("piece", "k").collect()
        parts: dict[tuple[float, float], list] = {}
        for r in rows:
            parts.setdefault(wide[r.piece], []).append(r)
        for rank, (a, b, before, _) in list(at.items()):
            for r in parts.get((a, b), ()):
                if before + r.c > rank:
                    at[rank] = (r.a, r.b, before, r.c)
                    break
                before += r.c
    few = sorted({(a, b) for a, b, _, _ in at.values() if a < b})
    values = sorted(r.x for r in x.where(piece(few).isNotNull()).collect()) if few else []
    known = {rank: a if a == b else values[bisect.bisect_left(values, a) + rank - before] for rank, (a, b, before, _) in at.items()}
    return [known[math.floor(r)] + (known[math.ceil(r)] - known[math.floor(r)]) * (r - math.floor(r)) for r in places]


def robust_normalize(df: DataFrame, value: str, out: str, low: float = 0.05, high: float = 0.99) -> DataFrame:
    """Adds out: value between the low and high percentiles scaled to 0..1 and clipped; 0 where the two are equal."""
    a, b = global_percentiles(df, value, [low, high])
    if a is None or b - a < EPSILON:
        return df.withColumn(out, F.lit(0.0))
    return df.withColumn(out, clamp((F.col(value) - a) / (b - a), 0, 1))


def median(value: Column) -> Column:
    return F.percentile(value, F.lit(0.5))


def _placed(df: DataFrame, by: Sequence[str], order: Sequence[str], weight: str | None, out: str) -> DataFrame:
    """Adds out: the weight (or number) of the rows of the same group that come earlier. Rows are dealt by ranges of
    (by, order), written (ranges are drawn once; the copy goes when the driver ends) and numbered within their range; only
    counts of (group, range) are added up, so no group is in one task."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = shared_folder(spark, "placed")
    cell, start, w = (fresh(c, df) for c in ("cell", "start", "w"))
    df.repartitionByRange(parts, *by, *order).withColumn(cell, F.spark_partition_id()).write.parquet(at)
    rows = spark.read.parquet(at)
    own = F.col(weight) if weight else F.lit(1)
    earlier = Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*by, cell).agg(F.sum(own).alias(w)).select(*by, cell, F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(start))
    inside = Window.partitionBy(*by, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = on_equal(rows.withColumn(out, F.coalesce(F.sum(own).over(inside), F.lit(0))), cells, [*by, cell])
    return placed.withColumn(out, F.col(start) + F.col(out)).drop(cell, start)


def greatest_group(df: DataFrame, by: Sequence[str]) -> int:
    """The number of rows of the largest group: one aggregate, which runs at once."""
    n = fresh("n", df)
    return df.groupBy(*by).agg(F.count("*").alias(n)).agg(F.max(n)).first()[0] or 0


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Adds out, the row's place in its group from 0 by `order`, which must tell the group's rows apart.

    The sizes of the groups are looked up first, at once: only where one is larger than GROUP_ROWS are rows dealt by ranges."""
    if greatest_group(df, by) > GROUP_ROWS:
        return _placed(df, by, order, None, out)
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def group_percentiles(df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated percentiles of each group, for groups of any size: by, and a column for each quantile.

    A group without a value has no row. The sizes of the groups are looked up first, at once: in groups larger than GROUP_ROWS
    equal values are counted and placed by ranges."""
    v, w, n, before = (fresh(c, df) for c in ("v", "w", "n", "before"))
    own = df.where(_valued(F.col(value))).select(*by, F.col(value).cast("double").alias(v))
    if greatest_group(own, by) <= GROUP_ROWS:
        got = own.groupBy(*by).agg(F.percentile(v, F.array(*[F.lit(float(q)) for q in quantiles.values()])).alias(w))
        return got.select(*by, *[F.col(w)[k].alias(name) for k, name in enumerate(quantiles)])
    counts = own.groupBy(*by, v).agg(F.count("*").alias(w))
    placed = _placed(counts, by, [v], w, before)
    sizes = placed.groupBy(*by).agg(F.sum(w).alias(n))
    held = lambda rank: F.max(F.when((F.col(before) <= rank) & (rank < F.col(before) + F.col(w)), F.col(v)))
    ends, low, high = [], fresh("low", df), fresh("high", df)
    for name, q in quantiles.items():
        at = q * (F.col(n) - 1)
        ends += [held(F.floor(at)).alias(f"{name}{low}"), held(F.ceil(at)).alias(f"{name}{high}")]
    got = on_equal(placed, sizes, by).groupBy(*by, n).agg(*ends)
    part = lambda q: q * (F.col(n) - 1) - F.floor(q * (F.col(n) - 1))
    return got.select(*by, *[(F.col(f"{name}{low}") + (F.col(f"{name}{high}") - F.col(f"{name}{low}")) * part(q)).alias(name) for name, q in quantiles.items()])


def median_and_mad(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, med and mad: the median of each group and the median of the distances from it."""
    own = df.where(_valued(F.col(value))).select(*by, F.col(value).cast("double").alias(v := fresh("value", df)))
    med = group_percentiles(own, by, v, {"med": 0.5})
    away = on_equal(own, med, by).select(*by, F.abs(F.col(v) - F.col("med")).alias(v))
    return on_equal(med, group_percentiles(away, by, v, {"mad": 0.5}), by)


def modified_z(df: DataFrame, by: Sequence[str], value: str, floor: float = 1e-4, limit: float = 3.5, least: int = 3) -> DataFrame:
    """Adds med, mad, z and outlier: 0.6745 |value - median| / max(MAD, floor) over each group; groups of fewer than
    `least` values have no outliers, rows without a value have no z and are none. Every row comes back. Groups are expected to
    have at most some millions of distinct values: each one's are counted in one task (group_percentiles is the way for larger ones)."""
    n = fresh("n", df)
    own = df.drop("med", "mad", "z", "outlier")
    x = F.when(_valued(F.col(value)), F.col(value).cast("double"))
    with_med = on_equal(own, own.groupBy(*by).agg(median(x).alias("med"), F.count(x).alias(n)), by)
    mad = with_med.groupBy(*by).agg(median(F.abs(x - F.col("med"))).alias("mad"))
    z = Z_FACTOR * F.abs(x - F.col("med")) / F.greatest(F.col("mad"), F.lit(float(floor)))
    return on_equal(with_med, mad, by).withColumn("z", z).withColumn("outlier", F.coalesce((F.col(n) >= least) & (F.col("z") > limit), F.lit(False))).drop(n)


def weighted_step_quantile(df: DataFrame, by: Sequence[str], value: str, weight: str, q: float, out: str) -> DataFrame:
    """For each group, the first value in order whose cumulative weight reaches q of the whole weight.

    Equal values are added up first, so the window sees one row a value and group."""
    w, c, t = (fresh(x, df) for x in ("w", "c", "t"))
    per_value = df.where(_valued(F.col(value))).groupBy(*by, value).agg(F.sum(weight).alias(w))
    order = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    reached = per_value.withColumn(c, F.sum(w).over(order)).withColumn(t, F.sum(w).over(whole)).where(F.col(c) >= q * F.col(t) - 1e-9)
    return reached.groupBy(*by).agg(F.min(value).alias(out))


def circular_mean(df: DataFrame, by: Sequence[str], degrees: Column, weight: Column, period: float = 360.0) -> DataFrame:
    """mean_angle in [0, period) and resultant (0..1) of each group; both 0 where the resultant vanishes."""
    angle = F.radians(degrees * (360.0 / period))
    sums = df.groupBy(*by).agg(F.sum(weight * F.sin(angle)).alias("_s"), F.sum(weight * F.cos(angle)).alias("_c"), F.sum(weight).alias("_w"))
    length = F.hypot("_s", "_c") / F.greatest(F.col("_w"), F.lit(EPSILON))
    mean = F.pmod(F.degrees(F.atan2("_s", "_c")), F.lit(360.0)) * (period / 360.0)
    return sums.select(*by, F.when(length < 1e-9, 0.0).otherwise(mean).alias("mean_angle"), F.when(length < 1e-9, 0.0).otherwise(length).alias("resultant"))


def circular_correlation(df: DataFrame, by: Sequence[str], a: Column, b: Column) -> DataFrame:
    """rho of Fisher and Lee for two angles in radians, in [-1, 1]; null where either does not vary."""
    means = df.groupBy(*by).agg(*[f(F.sum(F.sin(x)), F.sum(F.cos(x))).alias(n) for f, x, n in ((F.atan2, a, "_ma"), (F.atan2, b, "_mb"))])
    both = on_equal(df.select(*by, a.alias("_a"), b.alias("_b")), means, by).select(*by, F.sin(F.col("_a") - F.col("_ma")).alias("_x"), F.sin(F.col("_b") - F.col("_mb")).alias("_y"))
    sums = both.groupBy(*by).agg(F.sum(F.col("_x") * F.col("_y")).alias("_xy"), F.sum(F.col("_x") ** 2).alias("_xx"), F.sum(F.col("_y") ** 2).alias("_yy"))
    scale = F.sqrt(F.col("_xx") * F.col("_yy"))
    return sums.select(*by, F.when(scale > 1e-9, clamp(F.col("_xy") / F.nullif(scale, F.lit(0.0)), -1, 1)).alias("rho"))


def exposure_gate(df: DataFrame, group: str, value: str, most: float, least_rows: int = 3) -> DataFrame:
    """For each group of at least least_rows: median, greatest deviation from it and number of rows beyond `most`."""
    med = df.groupBy(group).agg(median(F.col(value)).alias("med"), F.count(value).alias("n")).where(F.col("n") >= least_rows)
    dev = F.round(F.abs(F.col(value) - F.col("med")), 9)  # a deviation of exactly `most` passes
    return on_equal(df.select(group, value), med, [group]).groupBy(group).agg(F.first("med").alias("med"), F.max(dev).alias("max_deviation"), F.count(F.when(dev > most, 1)).alias("outliers"))


def domain_counts(df: DataFrame, key: str, domain: Sequence[str]) -> DataFrame:
    """The count of each value of a closed domain, 0 where there is none."""
    values = df.sparkSession.createDataFrame([(x,) for x in domain], f"{key} string")
    return values.join(df.groupBy(key).count(), key, "left").select(key, F.coalesce("count", F.lit(0)).alias("n"))


def distinct_with_null(value: Column) -> Column:
    """Distinct values, all nulls together counting as one."""
    return F.countDistinct(value) + F.max(F.when(value.isNull(), 1).otherwise(0))
