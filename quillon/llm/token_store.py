"""Token ids in binary shards, with a minimal perfect hash index for constant-time keyed access.

Texts are range-partitioned by doc_id, so shard k holds the k-th range in ascending order. A shard is two files: raw ids
(unsigned little-endian, 16 or 32 bits) and an index. The index is a minimal perfect hash of the shard's document keys:
levels of bit arrays, in each of which the keys that hash alone to a bit are placed and the rest go on to the next; a
key's rank among the set bits is its slot. A slot stores a 32-bit fingerprint of its key, its first record and how many
records it has; a key that is not in the shard fails the fingerprint (but for one in 2^32). A lookup reads a few bits, one
slot and one slice of the payload, however many documents there are. Which shard has a key is told by the manifest, one row a shard.

Defined results: a null text is empty (its record is the end id alone); rows that repeat a doc_id are records of one key,
ordered by text; a null doc_id is a key that sorts first; other columns are not read; an empty table gives no shards.
"""

from __future__ import annotations

import json
import os
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pieces import PieceTable, slices, split_pieces

NO_ID = -(2**63)
MAGIC = b"QTOK2\0"
#: Bits for each key of a level; levels before the rest are listed one by one.
GAMMA, MOST_LEVELS = 2.0, 40
READ_BLOCK = 8 << 20


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of 64-bit keys."""
    h = keys.astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: slots(keys) is a bijection to 0..n-1 on its own keys, -1 for some others."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks = [np.concatenate([[0], np.cumsum(np.bitwise_count(x).astype(np.int64))]) for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left) and len(levels) < MOST_LEVELS:
            size = -(-max(64, int(GAMMA * len(left))) // 64) * 64
            pos = (_mix(left, len(levels) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(pos, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[pos]]
        return cls(levels, np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, todo, before = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for n, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            pos = _mix(keys[todo], n + 1) % np.uint64(64 * len(words))
            word, bit = (pos >> np.uint64(6)).astype(np.int64), pos & np.uint64(63)
            held = words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = before + ranks[word[hit]] + below[hit]
            todo, before = todo[~hit], before + ranks[-1]
        if len(todo) and len(self.rest):
            k = np.searchsorted(self.rest, keys[todo]).clip(0, len(self.rest) - 1)
            found = self.rest[k] == keys[todo]
            out[todo[found]] = before + k[found]
        return out


class ShardIndex:
    """keys -> records of a shard; offsets[r], offsets[r + 1]: the ids of record r."""

    def __init__(self, mph: PerfectHash, prints: np.ndarray, first: np.ndarray, many: np.ndarray, offsets: np.ndarray, width: int = 2):
        self.mph, self.prints, self.first, self.many, self.offsets, self.width = mph, prints, first, many, offsets, width

    @classmethod
    def build(cls, keys: np.ndarray, lens: np.ndarray, width: int = 2) -> ShardIndex:
        """keys (ascending, repeats together) and lengths of the records in order; width: bytes of an id."""
        distinct, first, many = np.unique(keys, return_index=True, return_counts=True)
        mph = PerfectHash.build(distinct.view(np.uint64))
        slot = mph.slots(distinct.view(np.uint64))
        prints, at, num = (np.zeros(len(distinct), t) for t in (np.uint32, np.uint32, np.uint32))
        prints[slot], at[slot], num[slot] = cls.print_of(distinct), first, many
        return cls(mph, prints, at, num, np.concatenate([[0], np.cumsum(lens)]).astype(np.int64), width)

    @staticmethod
    def print_of(keys: np.ndarray) -> np.ndarray:
        return (_mix(keys.view(np.uint64), 0xF1) >> np.uint64(32)).astype(np.uint32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record (-1: no such key) and number of records of each key."""
        if not len(self.prints):
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        slot = self.mph.slots(keys.view(np.uint64))
        known = (slot >= 0) & (self.prints[slot] == self.print_of(keys))
        return np.where(known, self.first[slot].astype(np.int64), -1), np.where(known, self.many[slot].astype(np.int64), 0)

    def to_bytes(self) -> bytes:
        arrays = [*self.mph.levels, self.mph.rest, self.prints, self.first, self.many, self.offsets]
        head = MAGIC + struct.pack("<III", self.width, len(self.mph.levels), len(arrays))
        return head + b"".join(struct.pack("<Q", a.nbytes) + a.tobytes() for a in arrays)

    @classmethod
    def from_bytes(cls, data: bytes) -> ShardIndex:
        width, levels, count = struct.unpack_from("<III", data, len(MAGIC))
        at, parts = len(MAGIC) + 12, []
        for _ in range(count):
            (size,) = struct.unpack_from("<Q", data, at)
            parts.append(data[at + 8 : at + 8 + size])
            at += 8 + size
        words = [np.frombuffer(p, np.uint64) for p in parts[: levels + 1]]
        prints, first, many = (np.frombuffer(p, np.uint32) for p in parts[levels + 1 : -1])
        return cls(PerfectHash(words[:-1], words[-1]), prints, first, many, np.frombuffer(parts[-1], np.int64), width)


def _library(path: str):
    """Encodes pieces with the tokenizers library; white space around a piece makes no ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(lists))

    return encode


#: The normaliser and splitting rule under which a text may be cut into pieces as split_pieces does it.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CUT_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


@lru_cache(maxsize=8)
def _about(path: str) -> tuple[bool, int]:
    """Whether texts may be cut into pieces, and the bytes of an id. Where the file has other rules, texts are encoded whole."""
    with open(path, encoding="utf-8") as src:
        own = json.load(src)
    steps = (own["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    split = steps[0].get("pattern", {}).get("Regex") == CUT_PATTERN and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and len(steps) == 2 and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    cut = bool(split) and (own["normalizer"] or {}).get("normalizers") == CUT_NORMALIZERS and all("<|" in t["content"] for t in own["added_tokens"])
    top = max([*own["model"]["vocab"].values(), *(t["id"] for t in own["added_tokens"])])
    return cut, 2 if top < 2**16 else 4


#: The worker's piece table for each vocabulary file.
_TABLES: dict[str, PieceTable] = {}


def encode_texts(texts: pa.Array, path: str, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of texts as (ids one after the other, ids for each text), the end id appended to each text."""
    if path not in _TABLES:
        _TABLES[path] = PieceTable(_library(path), np.uint16 if _about(path)[1] == 2 else np.uint32)
    table, cut = _TABLES[path], _about(path)[0]
    for run in slices(texts.fill_null("")):
        which, pieces, counts = split_pieces(run, fold=cut, whole="<|" if cut else "")
        slots = table.slots(pieces)[which] + 1
        ends = np.cumsum(counts)
        slots = np.insert(slots, ends, 0)  # 0: the end of a text
        ids, lens = np.zeros(0, table.dtype), np.ones(len(slots), np.int64)
        own = slots > 0
        got, lens[own] = table.gather(slots[own] - 1)
        ids = np.full(int(lens.sum()), end_id, table.dtype)
        stops = np.cumsum(lens)
        is_end = np.zeros(len(ids), bool)
        is_end[stops[~own] - 1] = True
        ids[~is_end] = got
        yield ids, np.diff(np.concatenate([[0], stops[~own]]))


def _write_shards(root: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{root}/{uuid.uuid4().hex}"  # a retried task writes files of its own; the manifest has those of the one that counted
        files, place = common.store(name)
        files.create_dir(posixpath.dirname(place), recursive=True)
        keys, lens, total, width = [], [], 0, _about(path)[1]
        with files.open_output_stream(place + ".ids") as out:
            for b in batches:
                keys.append(b.column("did").to_numpy(zero_copy_only=False))
                for ids, n in encode_texts(b.column("text"), path, end_id):
                    out.write(ids.astype(f"<u{width}").tobytes())
                    lens.append(n)
                    total += len(ids)
        if keys and len(all_keys := np.concatenate(keys)):
            index = ShardIndex.build(all_keys, np.concatenate(lens), width)
            common.write_file(name + ".mph", index.to_bytes())
            yield pa.RecordBatch.from_pydict({"file": [name], "first_key": [int(all_keys[0])], "docs": [len(all_keys)], "ids": [total]})

    return run


def write_token_shards(docs: DataFrame, path: str, end_id: int = 2, root: str | None = None) -> DataFrame:
    """Encodes and writes all texts. Returns the manifest: shard, file, first_key, docs, ids, start (ids before the shard)."""
    spark = docs.sparkSession
    root = root or common.work_path(spark, "token-shards")
    did = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    ranged = docs.select(did.alias("did"), "text").repartitionByRange(common.parallelism(spark), "did").sortWithinPartitions("did", "text")
    written = ranged.mapInArrow(_write_shards(f"{root}/shards", path, end_id), "file string, first_key bigint, docs bigint, ids bigint")
    rows = sorted(common.saved(written, f"{root}/written").collect(), key=lambda r: r.first_key)  # one row a shard
    common.remove(f"{root}/written")
    start, out = 0, []
    for k, r in enumerate(rows):
        out.append((k, r.file, r.first_key, r.docs, r.ids, start))
        start += r.ids
    return spark.createDataFrame(out, "shard int, file string, first_key bigint, docs bigint, ids bigint, start bigint")


class ShardReader:
    """Records of one shard by key, the payload read in blocks."""

    def __init__(self, file: str):
        self.index = ShardIndex.from_bytes(common.read_file(file + ".mph"))
        files, place = common.store(file + ".ids")
        self.src = files.open_input_file(place)
        self.at, self.block = 0, b""

    def record(self, r: int) -> np.ndarray:
        width = self.index.width
        a, b = width * int(self.index.offsets[r]), width * int(self.index.offsets[r + 1])
        if a < self.at or b > self.at + len(self.block):
            self.at, self.block = a, self.src.read_at(max(b - a, READ_BLOCK), a)
        return np.frombuffer(self.block, f"<u{width}", count=(b - a) // width, offset=a - self.at)


def read_token_shards(keys: DataFrame, manifest: DataFrame) -> DataFrame:
    """Looks every doc_id of keys up in the shards. Returns doc_id, start, ids (binary, unsigned 32-bit little-endian), one
    row for each stored record of a key, however often keys has it; keys that are not stored give no row."""
    spark = keys.sparkSession
    shards = manifest.orderBy("shard").collect()  # one row a shard
    firsts = np.array([s.first_key for s in shards], np.int64)
    files, starts = [s.file for s in shards], [s.start for s in shards]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("key").to_numpy(zero_copy_only=False)
            shard = np.searchsorted(firsts, key, side="right") - 1
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(shard.clip(0), pa.int32())], ["key", "shard"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, served = -1, None, None
        for b in batches:
            key, shard = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "shard"))
            for s in np.unique(shard):
                if s != now:
                    now, reader = int(s), ShardReader(files[s])
                    served = np.zeros(len(reader.index.offsets), bool)
                first, many = reader.index.find(key[shard == s])
                own = key[shard == s]
                todo = sorted((int(r + j), int(k)) for k, r, m in zip(own, first, many, strict=True) if r >= 0 and not served[r] for j in range(m))
                out: list[list] = [[], [], []]
                for r, k in todo:
                    if served[r]:
                        continue
                    served[r] = True
                    for col, v in zip(out, (None if k == NO_ID else k, starts[now] + int(reader.index.offsets[r]), reader.record(r).astype("<u4").tobytes()), strict=True):
                        col.append(v)
                    if len(out[0]) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["doc_id", "start", "ids"])
                        out = [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["doc_id", "start", "ids"])

    if not shards:
        return spark.createDataFrame([], "doc_id bigint, start bigint, ids binary")
    routed = keys.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("key")).mapInArrow(route, "key bigint, shard int")
    near = routed.repartition(min(len(shards), 4 * common.parallelism(spark)), "shard").sortWithinPartitions("shard", "key")
    return near.mapInArrow(look_up, "doc_id bigint, start bigint, ids binary")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    manifest = write_token_shards(docs, public_tokenizers.path("word_bpe_49k.json"))
    stored = read_token_shards(docs.select("doc_id"), manifest)
    return stored.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
