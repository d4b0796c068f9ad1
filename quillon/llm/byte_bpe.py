"""Byte-level BPE encoding and decoding with recursive DuckDB queries, one database in each Python worker.

A text is cut into words by the pattern. In each round of a recursive query a word's tokens become rows (word, position,
token, next token), those are joined with the merge table, and every word's leftmost pair of least rank is contracted,
until no word has a pair left. The recursion is keyed by word, so it holds one row a word however many rounds it needs.
Decoding joins the rows (text, position, token) with the vocabulary and aggregates the bytes in order of position.

A piece of text that repeats is encoded once for each worker (pieces.py). A word of n bytes takes up to n - 1 rounds over
its own rows, so one enormous word costs quadratic time but linear memory.

Defined results: a null text is empty and has no tokens; rows that repeat are encoded each; other columns of the input
are not read; an id outside the vocabulary fails the task; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pieces import PieceTable, gather, slices, split_pieces

CONTRACT = """
WITH RECURSIVE step(w, ts) USING KEY (w) AS (
  SELECT w, ts FROM words_in
  UNION ALL
  SELECT step.w, list_concat(ts[:k - 1], [m::INT], ts[k + 2:])
  FROM step JOIN (
    SELECT w, min(g.m::BIGINT * 4294967296 + x.p) AS least, least // 4294967296 AS m, least % 4294967296 AS k
    FROM (SELECT w, unnest(ts[:-2]) AS l, unnest(ts[2:]) AS r, generate_subscripts(ts[2:], 1) AS p FROM step WHERE len(ts) > 1) x
    JOIN merges g ON g.l = x.l AND g.r = x.r
    GROUP BY w
  ) b ON b.w = step.w
)
SELECT w, ts FROM step ORDER BY w
"""
DECODE = """
SELECT d, array_to_string(list(v.body ORDER BY p), '') AS body
FROM (SELECT d, unnest(ids) AS t, generate_subscripts(ids, 1) AS p FROM ids_in) JOIN vocab v USING (t) GROUP BY d
"""


#: Pieces kept in a worker; words encoded and ids decoded by one query.
MOST_PIECES, QUERY_WORDS, QUERY_IDS = 500_000, 50_000, 500_000


#: Bytes are kept in DuckDB's strings as the code points of Latin-1, and byte 0 as the one after them.
ZERO = "\u0100"


def _char(byte: int) -> str:
    return chr(byte) if byte else ZERO


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as src:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, src)}


class Codec:
    """Encodes words and decodes ids of one vocabulary in a DuckDB database of its own."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.words = regex.compile(pattern)
        self.size = len(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        merges = [(ranks[k[:i]], ranks[k[i:]], r) for k, r in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": os.path.join(tempfile.gettempdir(), "duckdb")})
        left, right, made = (pa.array(x, pa.int32()) for x in zip(*merges, strict=True))
        self._load("merges", pa.table({"l": left, "r": right, "m": made}))
        self._load("vocab", pa.table({"t": pa.array(ranks.values(), pa.int32()), "body": ["".join(map(_char, k)) for k in ranks]}))
        self.table = PieceTable(self.encode_pieces, np.uint16 if max(ranks.values()) < 2**16 else np.uint32, MOST_PIECES)

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("rows_in", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows_in")
        self.db.unregister("rows_in")

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after the other, and their number for each word."""
        ends = np.cumsum([0, *map(len, words)]).astype(np.int32)
        tokens = pa.ListArray.from_arrays(ends, pa.array(self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]))
        self.db.register("words_in", pa.table({"w": pa.array(range(len(words)), pa.int32()), "ts": tokens}))
        got = self.db.sql(CONTRACT).to_arrow_table().column("ts").combine_chunks()
        self.db.unregister("words_in")
        return got.flatten().to_numpy(zero_copy_only=False), got.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces one after the other, and their number for each piece."""
        cut = [self.words.findall(p) for p in pieces]
        number: dict[str, int] = {}
        which = np.fromiter((number.setdefault(w, len(number)) for ws in cut for w in ws), np.int64)
        distinct, ids, lens = list(number), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k in range(0, len(distinct), QUERY_WORDS):
            flat, each = self.encode_words([w.encode() for w in distinct[k : k + QUERY_WORDS]])
            ids.append(flat)
            lens.append(each)
        flat, lens = gather(np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(lens))]), which)
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        done = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)])]
        return flat, np.diff(done)

    def encode_run(self, texts: pa.Array) -> list[np.ndarray]:
        which, pieces, counts = split_pieces(texts, fold=False)
        ids, lens = self.table.gather(self.table.slots(pieces)[which] if pieces else np.zeros(0, np.int64))
        done = np.concatenate([[0], np.cumsum(lens)])[np.cumsum(counts)]
        return np.split(ids, done[:-1])

    def decode_run(self, ids: list[np.ndarray]) -> list[bytes]:
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)))
        if len(lists.values) and (lists.values.to_numpy().max() >= self.size or lists.values.to_numpy().min() < 0):
            raise ValueError("an id is not in the vocabulary")
        self.db.register("ids_in", pa.table({"d": pa.array(range(len(ids)), pa.int32()), "ids": lists}))
        got = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("ids_in")
        out = [b""] * len(ids)
        for d, body in zip(got.column("d").to_pylist(), got.column("body").to_pylist(), strict=True):
            out[d] = body.replace(ZERO, "\0").encode("latin-1")
        return out


#: The worker's databases by vocabulary and pattern.
_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for b in batches:
            at = 0
            for texts in slices(b.column("text").fill_null(""), 2_000_000):
                rows = [x.astype("<u4").tobytes() for x in codec.encode_run(texts)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(texts)), pa.array(rows, pa.binary())], ["doc_id", "ids"])
                at += len(texts)

    return run


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for b in batches:
            lists = [np.frombuffer(x or b"", "<u4") for x in b.column("ids").to_pylist()]
            start = 0
            while start < len(lists):
                end, total = start, 0
                while end < len(lists) and (end == start or total + len(lists[end]) <= QUERY_IDS):
                    total += len(lists[end])
                    end += 1
                bodies = codec.decode_run(lists[start:end])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(start, end - start), b.column("ids").slice(start, end - start), pa.array(bodies, pa.binary())], ["doc_id", "ids", "body"])
                start = end

    return run


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Returns doc_id and ids (unsigned 32-bit little-endian, binary): one row for each row of docs."""
    return docs.select("doc_id", "text").mapInArrow(_encode(path, pattern), "doc_id bigint, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """From doc_id and ids to doc_id, ids and body, the decoded bytes."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path, pattern), "doc_id bigint, ids binary, body binary")


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """decode(encode(docs)), both in one Python worker."""
    first, then = _encode(path, pattern), _decode(path, pattern)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: then(first(batches)), "doc_id bigint, ids binary, body binary")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = round_trip(common.table(spark, sf_dir, "documents"), path)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("body", 256).alias("decoded_sha256"))
