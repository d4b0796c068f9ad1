"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws -ln(u) / weight, with u from a hash of the row's
key and the child's name, and the smallest draw wins: a child wins in proportion to its weight, and when a child's
weight changes, only draws of that child change. So a change of weight moves rows only into or out of the subtree whose
weight changed, at each level of the descent. A shard that opens a new region changes no older weight below the root,
so it takes rows only into itself; one added inside a rack also raises that rack's and region's weights, and rows move
only into those.

Everything is DataFrame functions: no Python runs on the executors. Slots are numbered without one task for a shard:
rows go by ranges of doc_id to cells, are numbered within (shard, cell), and offsets come from the cells' counts. Slots
follow doc_id in each shard, nulls first.

Defined results: a null text has size 8 and the crc32 of no bytes (0); a null doc_id is a key of its own; rows that
repeat a doc_id share a shard and take slots of their own; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Hexadecimal digits of the md5 used for a draw: 52 bits, exact in a double.
DIGITS = 13


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree: its number, the names of its region and rack, and its weight."""

    number: int
    region: str
    rack: str
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 4, per_region: int = 8) -> list[Shard]:
    """Shards of weight 1, filling racks of per_rack and regions of per_region in order."""
    return [Shard(i, f"g{i // per_region}", f"g{i // per_region}r{i % per_region // per_rack}") for i in range(shards)]


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))


def _children(tree: Sequence[Shard]) -> Column:
    """The tree as a constant map: each node's name to its children's names and weights."""
    below: dict[str, dict[str, float]] = {}
    for s in tree:
        if s.weight > 0:
            for node, child in (("root", s.region), (s.region, s.rack), (s.rack, f"shard{s.number}")):
                level = below.setdefault(node, {})
                level[child] = level.get(child, 0.0) + s.weight
    pairs = [(F.lit(node), F.array(*[F.struct(F.lit(c).alias("name"), F.lit(float(w)).alias("weight")) for c, w in sorted(cs.items())])) for node, cs in below.items()]
    return F.create_map(*[x for pair in pairs for x in pair])


def _draw(child: Column) -> Column:
    """-ln(u) / weight, u in (0, 1) from the key and the child's name."""
    digits = F.substring(F.md5(F.concat(_key(), F.lit("|"), child["name"])), 1, DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    return -F.log(u) / child["weight"]


def _descend(df: DataFrame, tree: Sequence[Shard], out: str) -> DataFrame:
    """Adds column out, the shard's number: three levels, at each the smallest draw among the node's children."""
    children = _children(tree)
    df = df.withColumn("_node", F.lit("root"))
    for _ in ("region", "rack", "shard"):
        draws = F.transform(F.element_at(children, F.col("_node")), lambda c: F.struct(_draw(c).alias("draw"), c["name"].alias("name")))
        df = df.withColumn("_node", F.array_min(draws)["name"])
    return df.withColumn(out, F.substring("_node", len("shard") + 1, 10).cast("int")).drop("_node")


def assign_shards(docs: DataFrame, tree: Sequence[Shard], grown: Sequence[Shard] | None = None) -> DataFrame:
    """Returns doc_id, size, text_crc32, shard, slot and grown_shard (under the grown tree, or null) for each row."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.encode(common.text_or_empty(), "UTF-8")).alias("text_crc32"))
    placed = _descend(rows, tree, "shard")
    placed = _descend(placed, grown, "grown_shard") if grown else placed.withColumn("grown_shard", F.lit(None).cast("int"))
    at = common.work_path(spark, "shards")
    placed = common.saved(placed, f"{at}/placed")  # each text is read once
    ranged = placed.repartitionByRange(common.parallelism(spark), F.col("doc_id").asc_nulls_first())
    placed = common.saved(ranged.withColumn("cell", F.spark_partition_id()), f"{at}/ranged")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "cell").count().select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "cell").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32")
    ranked = placed.withColumn("rank", F.row_number().over(inside) - 1)
    # starts has at most shards x cells rows, whatever the input: that bound is why it may be broadcast
    return ranked.join(F.broadcast(starts), ["shard", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank")).alias("slot"), "grown_shard")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(common.table(spark, sf_dir, "documents"), even_tree(24), even_tree(25))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def _oracle(shards: int, grown: int) -> str:
    """The same descent in SQL. crc32 is folded byte by byte with a table made by its rule."""

    def descent(n: int, out: str) -> str:
        tree = even_tree(n)
        levels = {s.region: ("root", 0.0) for s in tree} | {s.rack: (s.region, 0.0) for s in tree} | {f"shard{s.number}": (s.rack, 0.0) for s in tree}
        for s in tree:
            for child in (s.region, s.rack, f"shard{s.number}"):
                levels[child] = (levels[child][0], levels[child][1] + s.weight)
        rows = ", ".join(f"('{node}', '{child}', {w}::DOUBLE)" for child, (node, w) in levels.items())
        steps, last = [f"{out}_tree AS (SELECT * FROM (VALUES {rows}) t(node, child, weight))", f"{out}0 AS (SELECT DISTINCT doc_id, 'root' AS node FROM documents)"], f"{out}0"
        for k in (1, 2, 3):
            steps.append(f"{out}{k} AS (SELECT doc_id, arg_min(child, (-ln((('0x' || substr(md5(doc_id || '|' || child), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / weight, child)) AS node FROM {last} JOIN {out}_tree t USING (node) GROUP BY doc_id)")
            last = f"{out}{k}"
        return ", ".join(steps)

    return f"""
WITH tbl AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
{descent(shards, "now")}, {descent(grown, "later")},
b AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
octets AS (SELECT doc_id, text, n, list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bytes FROM b),
c AS (SELECT doc_id, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS crc FROM octets, tbl)
SELECT c.doc_id, n + 8 AS size, crc AS text_crc32, 'key' AS law, substr(now3.node, 6)::INT AS shard,
  row_number() OVER (PARTITION BY now3.node ORDER BY c.doc_id) - 1 AS slot, substr(later3.node, 6)::INT AS grown_shard
FROM c JOIN now3 USING (doc_id) JOIN later3 USING (doc_id)
"""


ORACLE = _oracle(24, 25)
