"""The hash tree: balance by weight, gapless slots, and movement only where weights change."""

from collections import Counter

from pyspark.sql import functions as F

from quillon.llm import sharding as sh


def test_slots_balance_and_growth(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") % 5).cast("int")).alias("text"), F.lit("x").alias("shard"))
    got = sh.assign_shards(docs, sh.even_tree(24), sh.even_tree(25)).collect()
    by = Counter(r.shard for r in got)
    assert set(by) == set(range(24)) and max(by.values()) < 1.25 * min(by.values())
    for s, n in by.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert all(r.grown_shard in (r.shard, 24) for r in got) and 0.5 < Counter(r.grown_shard for r in got)[24] / (20_000 / 25) < 1.5
    assert all(r.size == 8 + 2 * (r.doc_id % 5) for r in got)


def test_a_heavier_shard_draws_only_into_its_own_subtree(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    tree = sh.even_tree(16)
    heavier = [sh.Shard(s.number, s.region, s.rack, 3.0 if s.number == 5 else 1.0) for s in tree]
    got = sh.assign_shards(docs, tree, heavier).collect()
    moved = [(tree[r.shard], tree[r.grown_shard]) for r in got if r.shard != r.grown_shard]
    assert moved and all(b.region == tree[5].region for _, b in moved)
    assert all(b.rack == tree[5].rack for a, b in moved if a.region == b.region) and all(b.number == 5 for a, b in moved if a.rack == b.rack)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (1, "a"), (None, "b")], "doc_id bigint, text string")
    got = sh.assign_shards(docs, sh.even_tree(3)).collect()
    assert len(got) == 5 and len({r.shard for r in got if r.doc_id == 1}) == 1 and {r.size for r in got if r.text_crc32 == 0} == {8}
    assert sh.assign_shards(docs.where("false"), sh.even_tree(3)).collect() == []
