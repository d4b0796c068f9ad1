"""Readers with reject rows, sinks, and streaming twins."""

import struct
import zlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators import ledger
from quillon.sources import readers, sinks
from quillon.streaming import ledgers


def png(rows, channels):
    """An 8-bit PNG of rows of pixel tuples."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in rows)
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2 if channels == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_masks_and_rejects(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png([[(255, 0, 1), (10, 20, 30)], [(0, 0, 0), (9, 8, 7)]], 3))
    (tmp_path / "m.png").write_bytes(png([[(127,), (128,)]], 1))
    (tmp_path / "bad.png").write_bytes(b"no image")
    good, bad = readers.read_images(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["bad.png"]
    px = {(r.path.rsplit("/", 1)[1], r.y, r.x): (r.r, r.g, r.b) for r in readers.image_pixels(good).collect()}
    assert px["a.png", 0, 0] == (255, 0, 1) and px["a.png", 1, 1] == (9, 8, 7) and px["m.png", 0, 1] == (128, 128, 128)
    assert [(r.y, r.x) for r in readers.mask_pixels(good.where("path LIKE '%m.png'")).collect()] == [(0, 1)]
    assert good.select(readers.media_type(F.col("path")).alias("t")).distinct().collect()[0].t == "image/png"


def test_ledger_lines_and_files(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"k": 1, "action": "a"}\n\n  \nnot json\n{"k": "x", "action": "b"}\n{"k": 2, "action": "c"}\n')
    schema = T.StructType.fromDDL("k bigint, action string")
    events, rejects = readers.read_ledger(spark, str(tmp_path / "l.jsonl"), schema)
    assert sorted((r.k, r.action) for r in events.collect()) == [(1, "a"), (2, "c")] and rejects.count() == 2
    files = readers.read_files(spark, str(tmp_path))
    declared = files.withColumn("sha256", F.lit("0")).unionAll(files.withColumn("path", F.lit("gone")))
    assert sorted(r.reason for r in readers.verify_files(declared, files).collect()) == ["hash", "missing"]
    new, dup = sinks.ingest(files.where("false"), files.unionAll(files.withColumn("path", F.lit("z-copy"))))
    assert new.count() == 1 and dup.count() == 1
    (tmp_path / "changes.txt").write_text("M\ta/b\nR100\told\tnew\n")
    assert [(r.status, r.path) for r in readers.read_changes(spark, str(tmp_path / "changes.txt")).collect()] == [("M", "a/b"), ("R", "new")]


def test_guarded_append_keeps_the_chain(spark, tmp_path):
    fields = [F.col("action"), F.col("k"), F.col("sequence")]
    path = str(tmp_path / "ledger")
    first = ledger.chain(spark.createDataFrame([(1, "open", 0)], "k bigint, action string, sequence int"), "k", "sequence", fields)
    first.write.parquet(path)
    new = spark.createDataFrame([(1, "promote", 0), (1, "", 1), (2, "open", 0)], "k bigint, action string, sequence int")
    added, bad = sinks.append_events(spark.read.parquet(path), new, "k", fields, [(F.col("action") == "", "no action")], path)
    assert [r.reasons for r in bad.collect()] == [["no action"]]
    now = spark.read.parquet(path)
    assert now.count() == 3 and ledger.chain_breaks(now, "k", "sequence", fields, "digest", "previous_digest").collect() == []


def test_guarded_stream_matches_the_batch(spark, tmp_path):
    order = ["signup", "view", "click", "purchase", "error"]
    rows = ledger.ledger(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "user_id", "ts", "event_id").select("user_id", F.col("sequence").cast("long").alias("sequence"), "event_type")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ledgers.guarded(ledgers.event_stream(spark, str(tmp_path / "in")), "user_id", "sequence", "event_type", {s: i for i, s in enumerate(order)})
    ledgers.drain(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    want = ledger.transition_violations(rows, "user_id", "sequence", "event_type", order)
    say = lambda df: sorted(map(str, df.collect()))
    assert say(spark.read.parquet(str(tmp_path / "out")).select(want.columns)) == say(want)
