"""N-gram Jaccard join by MinHash banding.

A text's n-grams are its runs of five words (a text of fewer words has one, all of them), as 64-bit hashes. Words are lower-cased
runs of ASCII letters, digits and all characters beyond ASCII, as the oracle SQL has them; the pipeline cuts by unicode_words.py. Texts that are equal form a class, of which one row works. Rows of the signature are the least
values of the n-grams under random permutations of 32 bits. bands() chooses how many rows make a band and how many bands
are needed, so that a pair at the threshold meets in some band with the target recall.

Rows are shuffled on band hashes. Pairs that share a bucket are the candidates, and each is verified once, on the full n-gram
sets. Buckets with the same members are one. A bucket is cut into blocks of about BLOCK_ROWS, and each pair of blocks is a group
of rows; a pair that several buckets share is counted in the first of them. Where the buckets of one component of the graph
"shares a bucket" overlap so much that its rows would move more often than by taking all blocks of the component together, the
component is cut into blocks instead; which way is taken changes no result. A group sends on a count of links for each row
and ties to the least row it is linked to: never the pairs.

Defined results: null texts are empty; texts without a word have no n-grams and link only to equal texts; a null doc_id is
a document that sorts first; rows that repeat doc_id and text are copies of each other; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

NO_ID = -(2**63)
WORDS, THRESHOLD = 5, 0.8
#: A block's rows and n-grams on average: rows are dealt to as many blocks by a hash, so that a block holds a few times as
#: much at most (with 256 expected rows, 512 are beyond any chance), or one long text. N-grams compared at once, a firm bound.
BLOCK_ROWS, BLOCK_GRAMS, COMPARED = 256, 1_000_000, 1_000_000


def bands(threshold: float, recall: float = 0.99999, most: int = 256) -> tuple[int, int]:
    """(rows of a band, bands): the most rows with which at most `most` hash functions reach the recall at the threshold."""
    for rows in range(16, 0, -1):
        n = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if rows * n <= most:
            return rows, n
    raise ValueError("too few hash functions for the recall")


def _word_bytes() -> np.ndarray:
    out = np.zeros(256, bool)
    out[128:] = True
    for low, high in ((48, 57), (97, 122), (65, 90)):
        out[low : high + 1] = True
    return out


WORD_BYTE = _word_bytes()
POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
GRAM = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str, block: int = 1 << 22) -> np.ndarray:
    """A 64-bit hash of each word, in order; long texts are read in blocks that end between words."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    out, start = [], 0
    while start < len(data):
        end = min(len(data), start + block)
        while end < len(data) and WORD_BYTE[data[end]]:
            end += 1
        part = data[start:end]
        inside = WORD_BYTE[part]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(first):
            body = part[inside].astype(np.uint64) + np.uint64(1)
            lens = last - first
            heads = np.cumsum(lens) - lens
            at = np.arange(len(body)) - np.repeat(heads, lens)
            scale = POWERS[at & 63] ^ (at >> 6).astype(np.uint64)
            out.append(mix(np.add.reduceat(body * scale, heads) + lens.astype(np.uint64)))
        start = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def ngrams(text: str | None, words: int = WORDS, cut: Callable[[str], np.ndarray] = word_hashes) -> np.ndarray:
    """The sorted distinct hashes of the text's n-grams. cut: gives the hashes of a text's words."""
    w = cut(text or "")
    if not len(w):
        return w
    n = min(words, len(w))
    total = np.zeros(len(w) - n + 1, np.uint64)
    for j in range(n):
        total += w[j : len(w) - n + 1 + j] * GRAM[j % len(GRAM)] + np.uint64(j // len(GRAM))
    return np.unique(mix(total))


class Signer:
    """Band hashes of n-gram sets."""

    def __init__(self, rows: int, bands: int, seed: int = 11):
        self.rows, self.bands = rows, bands
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**32, rows * bands, dtype=np.uint32)[:, None] | np.uint32(1)
        self.b = rng.integers(0, 2**32, rows * bands, dtype=np.uint32)[:, None]

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        h = (grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 2**32 - 1, np.uint32)
        for i in range(0, len(h), 1024):
            least = np.minimum(least, (self.a * h[None, i : i + 1024] + self.b).min(axis=1))
        out = np.arange(self.bands, dtype=np.uint64)
        for part in least.reshape(self.bands, self.rows).T:
            out = mix(out + part.astype(np.uint64))
        return out.view(np.int64)


def _sign(rows: int, count: int, words: int, cut: Callable[[str], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(rows, count)
        for b in batches:
            for part in range(0, b.num_rows, 1000):
                own = b.slice(part, 1000)
                sets = [ngrams(t, words, cut) for t in own.column("text").to_pylist()]
                hashes = [sign(s) if len(s) else np.zeros(0, np.int64) for s in sets]
                ends = np.cumsum([0, *map(len, hashes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *hashes])))
                yield pa.RecordBatch.from_arrays([own.column("did"), own.column("tkey"), pa.array([len(s) for s in sets], pa.int64()), lists], ["did", "tkey", "grams", "bands"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of left with every set of right. Large sets, which have to be in order, are
    compared by ranges of values, so that about COMPARED of them are looked at together."""
    parts = -(-sum(map(len, [*left, *right])) // COMPARED)
    if parts < 2:
        return _overlaps(left, right)
    edges = np.array([k * 2**64 // parts for k in range(1, parts)], np.uint64)
    cuts = [[[0, *np.searchsorted(s, edges), len(s)] for s in side] for side in (left, right)]
    piece = lambda side, at, k: [s[c[k] : c[k + 1]] for s, c in zip(side, at, strict=True)]
    return sum((_overlaps(piece(left, cuts[0], k), piece(right, cuts[1], k)) for k in range(parts)), np.zeros((len(left), len(right)), np.int64))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The same of few values, by products of blocks of columns."""
    out = np.zeros((len(left), len(right)), np.int64)
    sets = [*left, *right]
    values, column = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    many = np.bincount(column, minlength=len(values)) > 1
    keep = many[column]
    row, column = row[keep], (np.cumsum(many) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(256, min(8192, (4 << 20) // max(1, len(sets))))
    for start in range(0, int(many.sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        block = np.zeros((len(sets), width), np.float32)  # sums of at most `width` ones are exact
        block[row[a:b], column[a:b] - start] = 1
        out += (block[: len(left)] @ block[len(left) :].T).astype(np.int64)
    return out


def similar(both, n, m, threshold: float):
    """Whether sets of n and m values with `both` in common reach the threshold, in whole numbers."""
    t = Fraction(threshold).limit_denominator(10**6)
    return both * t.denominator >= t.numerator * (n + m - both)


def links_of(left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of those of the pairs (a matrix of booleans) whose Jaccard similarity is at least the threshold."""
    n, m = np.array([len(s) for s in left], np.int64), np.array([len(s) for s in right], np.int64)
    i, j = np.nonzero(pairs)
    fits = similar(np.minimum(n[i], m[j]), n[i], m[j], threshold)
    i, j = i[fits], j[fits]
    if len(i) <= len(left) + len(right):
        both = np.array([len(np.intersect1d(left[a], right[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    else:
        rows, columns = np.unique(i), np.unique(j)
        table = overlaps([left[a] for a in rows], [right[b] for b in columns])
        both = table[np.searchsorted(rows, i), np.searchsorted(columns, j)]
    linked = similar(both, n[i], m[j], threshold)
    return i[linked], j[linked]


def _least(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes, the least node that it is connected with."""
    label = np.arange(n)
    while True:
        old = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == old).all():
            return label


def _sets(words: int, cut: Callable[[str], np.ndarray]):
    """(rid, text) to (rid, set), the n-grams as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, b.num_rows, 200):
                own = b.slice(part, 200)
                sets = [ngrams(t, words, cut).tobytes() for t in own.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([own.column("rid"), pa.array(sets, pa.binary())], ["rid", "set"])

    return run


GROUP = ("whole", "key", "low", "high", "block", "rid", "copies", "buckets", "set")


def _verify(threshold: float):
    """Rows of groups (GROUP), sorted by the first four, to (rid, links, root). whole: key is a component, else a bucket."""

    def solve(rows: dict[int, tuple], group: tuple) -> list[tuple[int, int, int]]:
        whole, key, low, high = group
        rids = sorted(rows)  # the least row of a local component is then its least rid
        sides = [[k for k, r in enumerate(rids) if rows[r][0] == side] for side in (low, high)]
        buckets = [np.array(rows[r][2], np.int64) for r in rids]
        if not whole:
            buckets = [b[b < key] for b in buckets]  # a pair counts in the first bucket that both are in
        shared = overlaps(*([buckets[k].view(np.uint64) for k in side] for side in sides)) > 0
        pairs = shared if whole else ~shared
        if low == high:
            pairs = np.triu(pairs, 1)
        sets = [np.frombuffer(rows[r][3], np.uint64) for r in rids]
        i, j = links_of([sets[k] for k in sides[0]], [sets[k] for k in sides[1]], pairs, threshold)
        i, j = np.array(sides[0], int)[i], np.array(sides[1], int)[j]
        copies = np.array([rows[r][1] for r in rids])
        links = np.bincount(i, copies[j], len(rids)) + np.bincount(j, copies[i], len(rids))
        label = _least(len(rids), i, j)
        return [(rids[k], int(links[k]), rids[label[k]]) for k in np.flatnonzero(links)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, {}, []
        for b in batches:
            for *group, block, rid, copies, buckets, grams in zip(*(b.column(c).to_pylist() for c in GROUP), strict=True):
                if group != now:
                    out += solve(rows, now) if rows else []
                    now, rows = group, {}
                rows[rid] = (block, copies, buckets, grams)
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["rid", "links", "root"])
                out = []
        out += solve(rows, now) if rows else []
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], ["rid", "links", "root"])

    return run


def jaccard_groups(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = 0.99999, cut: Callable[[str], np.ndarray] = word_hashes) -> DataFrame:
    """Returns for each row of docs: doc_id, class_id (the least doc_id of all it is linked with, directly or not), n_links
    (other rows with similarity of the threshold or more, equal texts among them), copies (rows with its text), tkey (md5
    of its text) and kept (true for the rows of one text of each class, that of the least doc_id).

    recall: the probability, at least, that a pair right at the threshold is a candidate; pairs above it have a higher one."""
    spark = docs.sparkSession
    at = common.work_path(spark, "ngram-join")
    per_band, count = bands(threshold, recall)
    own = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("did"), common.text_or_empty().alias("text"))
    own = own.withColumn("tkey", F.unhex(F.md5("text")))
    signed = own.mapInArrow(_sign(per_band, count, words, cut), "did bigint, tkey binary, grams bigint, bands array<bigint>")
    signed = common.saved(signed.withColumn("rid", F.monotonically_increasing_id()), f"{at}/signed")
    classes = common.saved(signed.groupBy("tkey").agg(F.min("rid").alias("rid"), F.count("*").alias("copies"), F.min("did").alias("lead")), f"{at}/classes")

    # one row of each class goes on, to the buckets of its bands; of buckets with the same members one is left
    blocks_of = lambda n, grams: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(grams / BLOCK_GRAMS))
    leads = signed.select("rid", "grams", "bands").join(classes.select("rid").hint("shuffle_hash"), "rid", "left_semi")
    leads = common.saved(leads, f"{at}/leads")  # read twice below
    placed = leads.select("rid", "grams", F.explode("bands").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.min("rid").alias("least"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("rid")).alias("who"), F.sum("grams").alias("grams")).where("n > 1")
    distinct = sizes.groupBy("least", "n", "who", "grams").agg(F.min("bucket").alias("bucket"))
    buckets = common.saved(distinct.select("bucket", "least", "n", blocks_of(F.col("n"), F.col("grams")).alias("blocks")), f"{at}/buckets")
    inside = common.saved(common.join_split(placed, buckets.hint("shuffle_hash"), "bucket", "n").select("rid", "grams", "bucket", "least", "n", "blocks"), f"{at}/inside")
    near = components(inside.where("rid <> least").select(F.col("rid").alias("u"), F.col("least").alias("v")).distinct(), f"{at}/near")
    ways = inside.groupBy("rid").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"), F.collect_list(F.struct("bucket", "blocks")).alias("cut"), F.sum("blocks").alias("moves"), F.first("grams").alias("grams"))
    members = common.saved(near.select(F.col("node").alias("rid"), F.col("root").alias("comp")).join(ways, "rid").join(classes, "rid"), f"{at}/members")

    # a component goes by its own blocks or by its buckets', whichever moves fewer rows
    whole = members.groupBy("comp").agg(F.count("*").alias("n"), F.sum("grams").alias("grams"), F.sum("moves").alias("moves")).withColumn("blocks", blocks_of(F.col("n"), F.col("grams")))
    whole = common.saved(whole.select("comp", "n", "blocks", (F.col("n") * F.col("blocks") <= F.col("moves")).alias("whole")), f"{at}/whole")
    cut_by = F.when(F.col("whole"), F.array(F.struct(F.col("comp").alias("bucket"), "blocks"))).otherwise(F.col("cut"))
    todo = common.saved(common.join_split(members.select("rid", "comp", "copies", "lead", "tkey", "buckets", "cut"), whole, "comp", "n").select("rid", "copies", "lead", "tkey", "buckets", "whole", cut_by.alias("cut")), f"{at}/todo")
    texts = own.join(todo.select("rid", "tkey", F.col("lead").alias("did")).hint("shuffle_hash"), ["tkey", "did"]).select("rid", "text")
    sets = common.saved(texts.mapInArrow(_sets(words, cut), "rid bigint, set binary").groupBy("rid").agg(F.first("set").alias("set")), f"{at}/sets")
    dealt = todo.select("rid", "copies", "buckets", "whole", F.explode("cut").alias("cut")).select("rid", "copies", "buckets", "whole", F.col("cut.bucket").alias("key"), F.col("cut.blocks").alias("blocks"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    groups = dealt.join(sets, "rid").select("whole", "key", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "rid", "copies", "buckets", "set")
    groups = groups.repartition(4 * common.parallelism(spark), "whole", "key", "low", "high").sortWithinPartitions("whole", "key", "low", "high")
    linked = common.saved(groups.mapInArrow(_verify(threshold), "rid bigint, links bigint, root bigint"), f"{at}/linked")

    links = linked.groupBy("rid").agg(F.sum("links").alias("links"))
    final = components(linked.select(F.col("rid").alias("u"), F.col("root").alias("v")), f"{at}/final")
    named = classes.join(final.withColumnRenamed("node", "rid"), "rid", "left").join(links, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    named = common.saved(named, f"{at}/named")
    best = common.saved(named.groupBy("root").agg(F.min("lead").alias("class_id"), F.min_by("rid", F.struct("lead", "rid")).alias("best"), F.count("*").alias("n")), f"{at}/best")
    lines = common.join_split(named, best, "root", "n").select("tkey", "class_id", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), (F.col("rid") == F.col("best")).alias("kept"))
    lines = common.saved(lines, f"{at}/lines")
    null_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = common.join_split(signed.select("did", "tkey"), lines, "tkey", "copies").select(null_id("did").alias("doc_id"), null_id("class_id").alias("class_id"), "n_links", "copies", "tkey", "kept")
    out = common.saved(out, common.work_path(spark, "ngram-groups"))
    common.remove(at)
    return out


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, cut: Callable[[str], np.ndarray] = word_hashes) -> DataFrame:
    """The rows of docs without near copies: of each class, the rows of the text with the least doc_id. All columns stay."""
    text, doc = common.fresh(docs, "near_text"), common.fresh(docs, "near_doc")
    kept = jaccard_groups(docs, threshold, words, cut=cut).where("kept").select(F.col("tkey").alias(text), F.coalesce("doc_id", F.lit(NO_ID)).alias(doc))
    least = kept.groupBy(text).agg(F.min(doc).alias(doc))
    body = docs.withColumn(text, F.unhex(F.md5(common.text_or_empty()))).withColumn(doc, F.coalesce("doc_id", F.lit(NO_ID)))
    return body.join(least.hint("shuffle_hash"), [text, doc], "left_semi").drop(text, doc)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_groups(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "n_links", "copies")


#: Compares every pair that shares an n-gram; for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS gram FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9 UNION SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON x.text = y.text AND x.doc_id <> y.doc_id),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, (SELECT min(b) FROM reach r WHERE r.a = d.doc_id) AS class_id, (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links, count(*) OVER (PARTITION BY coalesce(d.text, '')) AS copies FROM documents d
"""
