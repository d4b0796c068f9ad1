"""Exact deduplication by content-defined chunk recipes.

A text is cut where a rolling gear hash of its last 32 bytes has enough zero bits, so equal texts have equal cuts. Each
chunk has a short hash (64 bits) and a SHA-256 digest. Chunks are deduplicated to verified identifiers: all chunks under
one short hash are held against each other by digest and length, and those that differ get identifiers of their own (the
hash and an ordinal). A text is then its recipe, the ordered list of its identifiers; texts are equal if and only if their
recipes are. Only hashes, digests and recipes are shuffled, a few bytes for each chunk: no text ever leaves its task.

Defined results: a null text counts as empty and has the recipe of one empty chunk; a row with a null doc_id loses to
any other of its group; of rows that repeat doc_id and text, all count and share keep_id, and exactly one stays; other
columns are neither read nor returned; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_CHUNK, MASK_BITS, MAX_CHUNK = 2048, 12, 65536
NO_ID = -(2**63)


def _gear() -> np.ndarray:
    """256 random 32-bit values, from a hash of each byte."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4, person=b"gear").digest(), "little") for b in range(256)], dtype=np.uint32)


GEAR = _gear()


def cuts(data: bytes, smallest: int = MIN_CHUNK, bits: int = MASK_BITS, largest: int = MAX_CHUNK) -> list[int]:
    """End offsets of the chunks of data; the last is len(data)."""
    n = len(data)
    if n <= smallest:
        return [n]
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # after these, h[i] sums GEAR << age over the last 32 bytes
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    marks = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    ends, start = [], 0
    while n - start > smallest:
        k = np.searchsorted(marks, start + smallest)
        end = int(min(marks[k] if k < len(marks) else n, start + largest, n))
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> Iterator[bytes]:
    start = 0
    for end in cuts(data):
        yield data[start:end]
        start = end


def _chunk_lists(hash_bits: int):
    """Adds to doc_id the text's SHA-256 and, concatenated over its chunks, the short hashes and the digests."""
    cut = np.uint64(2**hash_bits - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list[bytes]] = [[], [], []]
            for text in b.column("text").cast(pa.large_binary()).to_pylist():
                data = text or b""
                digests = b"".join(hashlib.sha256(c + len(c).to_bytes(8, "little")).digest() for c in chunks(data))
                short = np.frombuffer(digests, np.uint64)[::4] & cut  # SHA-256's first 8 bytes
                for col, value in zip(rows, (hashlib.sha256(data).digest(), short.astype("<u8").tobytes(), digests), strict=True):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.binary()) for c in rows)], ["doc_id", "sha", "shorts", "digests"])

    return run


def _occurrences(rows: DataFrame) -> DataFrame:
    """(rid, pos, h, digest): one row for each chunk of each text."""
    n = F.length("shorts") / 8
    at = rows.select("rid", "shorts", "digests", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("pos"))
    return at.select("rid", "pos", F.substring("shorts", F.col("pos") * 8 + 1, F.lit(8)).alias("h"), F.substring("digests", F.col("pos") * 32 + 1, F.lit(32)).alias("digest"))


def exact_groups(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """Returns doc_id, keep_id, group_size, kept and sha (SHA-256 of the text, binary): one row for each row of docs.

    hash_bits shortens the short hash, so that tests can meet collisions.
    """
    at = common.work_path(docs.sparkSession, "exact-dedup")
    raw = docs.select("doc_id", "text").mapInArrow(_chunk_lists(hash_bits), "doc_id bigint, sha binary, shorts binary, digests binary")
    rows = common.saved(raw.withColumn("rid", F.monotonically_increasing_id()), f"{at}/lists")
    # verified identifiers: one short hash with several digests gets an ordinal for each
    distinct = _occurrences(rows).groupBy("h", "digest").count()
    shared = distinct.groupBy("h").agg(F.count("*").alias("variants"), F.array_sort(F.collect_set("digest")).alias("of")).where("variants > 1")
    collided = common.saved(shared.select("h", F.posexplode("of").alias("ordinal", "digest")), f"{at}/collided")
    if collided.isEmpty():
        recipes = rows.select("doc_id", "sha", "rid", F.col("shorts").alias("recipe"))
    else:
        known = _occurrences(rows).join(collided, ["h", "digest"], "left")
        ident = F.concat(F.hex("h"), F.lit("."), F.coalesce("ordinal", F.lit(0)))
        lists = known.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", ident.alias("id")))).alias("ids"))
        recipes = rows.select("doc_id", "sha", "rid").join(lists.select("rid", F.encode(F.array_join("ids.id", ","), "UTF-8").alias("recipe")), "rid")
        recipes = common.saved(recipes, f"{at}/recipes")
    recipes = recipes.withColumn("did", F.coalesce(F.col("doc_id"), F.lit(NO_ID)))
    groups = recipes.groupBy("recipe").agg(F.max("did").alias("keep_id"), F.max_by("rid", "did").alias("keep_rid"), F.count("*").alias("group_size"))
    groups = common.saved(groups, f"{at}/groups")
    keep_id = F.when(F.col("keep_id") != NO_ID, F.col("keep_id"))
    return common.join_split(recipes, groups, "recipe", "group_size").select("doc_id", keep_id.alias("keep_id"), "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "sha", "rid")


def dedup_exact(docs: DataFrame) -> DataFrame:
    """The rows of docs, of each group of equal texts only the one with the largest doc_id. All columns are kept.

    Where doc_id is repeated or null, rows are told apart by doc_id and text, and one of several such rows stays.
    """
    groups = exact_groups(docs)
    sha, did = common.fresh(docs, "text_sha"), common.fresh(docs, "text_doc")
    kept = groups.where("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias(did), F.col("sha").alias(sha))
    body = docs.withColumn(sha, F.unhex(F.sha2(common.text_or_empty(), 256))).withColumn(did, F.coalesce("doc_id", F.lit(NO_ID)))
    stays = body.join(kept.hint("shuffle_hash"), [did, sha], "left_semi")
    if not groups.where("NOT kept AND doc_id <=> keep_id").isEmpty():  # rows that repeat doc_id and text: one of them stays
        stays = stays.dropDuplicates([did, sha])
    return stays.drop(did, sha)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_groups(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
