"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, root: str) -> DataFrame:
    """From edges (u, v) of longs to (node, root): root is the least node of the node's component. Nodes without an edge
    are not there. The work folder `root` has the steps and, when it is done, the result alone.

    Alternates large-star and small-star steps until nothing changes. Both are groupings by node with a join back: hubs are
    pre-aggregated, and their rows are joined where they are (join_split). Every step is written.
    """
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    now = common.saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{root}/0")
    was, step = mark(now), 0
    while was[0]:
        at = f"{root}/{step + 1}"
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")), f"{at}-least-large")
        large = common.join_split(both.where("v > u"), least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.saved(large, f"{at}-large")
        least = common.saved(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"{at}-least-small")
        small = common.join_split(large, least, "u", "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        now = common.saved(small.distinct(), at)
        common.remove(f"{at}-least-large", f"{at}-large", f"{at}-least-small", f"{root}/{step}")
        step += 1
        if (mine := mark(now)) == was:
            break
        was = mine
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
