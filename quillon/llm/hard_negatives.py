"""Hard-negative mining with coordinate pruning over length buckets.

Rows are vectors of whole numbers; a score is an inner product. Rows are dealt by ranges of label and length, written, and
read by tasks in runs of bounded size. A task sorts its run by length and cuts it into buckets of like lengths; a bucket
holds, for each coordinate, its rows' unit values in sorted order. Anchors stream past the run in blocks, read from the
shared folder. From the least score that an anchor still accepts follows the least cosine with a bucket's rows, and from
that, for each coordinate, the range of values that a row can have there. The ranges of the anchor's largest coordinates
(its focus) are slices of the sorted lists; the rows in all of them are the candidates, and their scores are computed in full.
Where no range is narrow, all rows of the bucket are scored. As an anchor finds rows, its least score rises, from long
buckets to short ones.

The same search runs twice: for the best rows of the anchor's own label (its positives), then for the best rows of other
labels whose score lies in the range that each positive sets. A task sends on at most `top` rows for each anchor and
positive, so that the final ranking is of a few rows a task.

Defined results: rows with a null label or vector, or a null or non-finite component, take no part, and neither do rows so
long (2^31 and more, after scaling) that a score could pass 64 bits; a vector ends in as many zeros as it lacks; an empty
vector scores 0; a null vec_id is no anchor and sorts before all others in ties; repeated rows are rows of their own, so
that a copy of an anchor is a positive of it and an anchor that is there twice is mined twice; other columns are not read;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

NO_ID = -(2**63)
#: Components of a run of rows held at once; rows of a bucket; its least length as a share of its greatest.
RUN_VALUES, BUCKET_ROWS, BUCKET_SHARE = 2_000_000, 4096, 0.9
#: Coordinates of an anchor's focus; ranges wider than this share of a bucket do not pay.
FOCUS, WIDEST = 4, 0.5
ANCHOR_ROWS = 1024


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of numbers as rows of doubles, filled up with zeros."""
    lens = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), int(lens.max(initial=0))))
    out[np.arange(out.shape[1]) < lens[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def products(rows: np.ndarray, anchors: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products. bound: of the lengths' products, which no partial sum passes."""
    wide = min(rows.shape[1], anchors.shape[1])
    rows, anchors = rows[:, :wide], anchors[:, :wide]
    if bound < 2**52:
        return (rows @ anchors.T).astype(np.int64)
    return rows.astype(np.int64) @ anchors.T.astype(np.int64)


class Bucket:
    """Rows of like length: their places in the run, and for each coordinate their unit values in order."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray, at: np.ndarray):
        self.at, self.longest, self.shortest = at, lengths[at[0]], lengths[at[-1]]
        if self.shortest > 0:
            unit = (values[at] / lengths[at, None]).T
            self.order = np.argsort(unit, axis=1).astype(np.int32)
            self.sorted = np.take_along_axis(unit, self.order, axis=1)

    def candidates(self, anchor: np.ndarray, length: float, least: float) -> np.ndarray | None:
        """Indices into `at` of the rows that can have a score of `least` or more; None: all."""
        if length <= 0 or self.shortest <= 0 or least == -np.inf:
            return None
        cosine = least / (length * (self.longest if least > 0 else self.shortest)) - 1e-9
        if cosine > 1:
            return np.zeros(0, np.int64)
        if cosine <= -1:
            return None
        wide = min(len(anchor), len(self.sorted))
        unit = anchor[:wide] / length
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        own, turn = np.arccos(np.clip(unit[focus], -1, 1)), np.arccos(cosine)
        low, high = np.cos(np.minimum(np.pi, own + turn)) - 1e-9, np.cos(np.maximum(0, own - turn)) + 1e-9
        ranges = [(np.searchsorted(self.sorted[f], a), np.searchsorted(self.sorted[f], b, side="right"), f) for f, a, b in zip(focus, low, high, strict=True)]
        narrow = [(a, b, f) for a, b, f in ranges if b - a <= WIDEST * len(self.at)]
        if not narrow:
            return None
        held = np.bincount(np.concatenate([self.order[f, a:b] for a, b, f in narrow]), minlength=len(self.at))
        return np.flatnonzero(held == len(narrow))


class Run:
    """Rows held by a task, in buckets from long to short."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        get = lambda c: table.column(c).to_numpy()
        self.rid, self.vid, self.label, self.lengths = get("rid"), get("vid"), get("label"), get("length")
        self.values = matrix(table.column("v").chunk(0)) if len(table) else np.zeros((0, 0))
        order = np.argsort(-self.lengths, kind="stable")
        self.buckets, start = [], 0
        while start < len(order):
            end = start + int(np.searchsorted(-self.lengths[order[start : start + BUCKET_ROWS]], -BUCKET_SHARE * self.lengths[order[start]], side="right"))
            self.buckets.append(Bucket(self.values, self.lengths, order[start:end]))
            start = end


def best(scores: np.ndarray, vids: np.ndarray, top: int) -> np.ndarray:
    """Indices of the top scores, higher first, ties by the smaller id."""
    if len(scores) > 4 * top:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - top)[len(scores) - top])
        return keep[best(scores[keep], vids[keep], top)] if len(keep) < len(scores) else keep[np.lexsort((vids, -scores))[:top]]
    return np.lexsort((vids, -scores))[:top]


class Wanted:
    """What one anchor looks for: the top rows with a score between low and high; least is what still counts."""

    def __init__(self, low: float, high: float, top: int):
        self.low, self.high, self.top = low, high, top
        self.scores, self.at = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> float:
        return max(self.low, self.scores[-1]) if len(self.scores) == self.top else self.low

    def offer(self, scores: np.ndarray, at: np.ndarray, vids: np.ndarray) -> None:
        fits = (scores >= self.least) & (scores <= self.high)
        scores, at = np.concatenate([self.scores, scores[fits]]), np.concatenate([self.at, at[fits]])
        chosen = best(scores, vids[at], self.top)
        self.scores, self.at = scores[chosen], at[chosen]


def anchor_blocks(uri: str, rows: int = ANCHOR_ROWS) -> Iterator[pa.Table]:
    """The anchors written at uri, in blocks."""
    files, path = common.store(uri)
    for name in sorted(f.path for f in files.get_file_info(common.fs.FileSelector(path)) if f.path.endswith(".parquet")):
        with files.open_input_file(name) as src:
            for b in pq.ParquetFile(src).iter_batches(batch_size=rows):
                yield pa.Table.from_batches([b])


def search(run: Run, block: pa.Table, same: bool, top: int) -> dict[str, np.ndarray]:
    """For each anchor of the block (arid, label, length, v, lows, highs) and each of its ranges of scores: its best rows in
    the run, of its own label (same) or of others. Returns arid, place (of the range), rid, vid and score."""
    block = block.combine_chunks()
    arid, label, length = (block.column(c).to_numpy() for c in ("arid", "label", "length"))
    ranges = list(zip(block.column("lows").to_pylist(), block.column("highs").to_pylist(), strict=True))
    use = np.flatnonzero(np.isin(label, run.label)) if same else np.arange(len(arid))
    use = use[[len(ranges[k][0]) > 0 for k in use]] if len(use) else use
    values = matrix(block.column("v").chunk(0))
    wanted = {k: [Wanted(-np.inf if a is None else a, np.inf if b is None else b, top) for a, b in zip(*ranges[k], strict=True)] for k in use}
    for bucket in run.buckets:
        everywhere = []
        for k in use:
            found = bucket.candidates(values[k], length[k], min(w.least for w in wanted[k]))
            if found is None:
                everywhere.append(k)
            elif len(found):
                at = bucket.at[found]
                _offer(run, wanted[k], at, products(run.values[at], values[k : k + 1], bucket.longest * length[k])[:, 0], arid[k], label[k], same)
        if everywhere:
            scores = products(run.values[bucket.at], values[everywhere], bucket.longest * length[everywhere].max()).T
            for k, s in zip(everywhere, scores, strict=True):
                _offer(run, wanted[k], bucket.at, s, arid[k], label[k], same)
    rows = [(arid[k], place, w) for k in use for place, w in enumerate(wanted[k]) if len(w.at)]
    at = np.concatenate([np.zeros(0, np.int64), *(w.at for *_, w in rows)])
    lens = [len(w.at) for *_, w in rows]
    column = lambda c: np.repeat(np.array([r[c] for r in rows], np.int64), lens)
    return {"arid": column(0), "place": column(1), "rid": run.rid[at], "vid": run.vid[at], "score": np.concatenate([np.zeros(0, np.int64), *(w.scores for *_, w in rows)])}


def _offer(run: Run, wanted: list[Wanted], at: np.ndarray, scores: np.ndarray, arid: int, label: int, same: bool) -> None:
    fits = (scores >= min(w.least for w in wanted)) & ((run.label[at] == label) == same)
    fits &= run.rid[at] != arid
    for w in wanted:
        w.offer(scores[fits], at[fits], run.vid)


def _task(anchors: str, same: bool, top: int, run_values: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in (*batches, None):
            if held and (b is None or size > run_values):
                rows = Run(pa.Table.from_batches(held))
                for block in anchor_blocks(anchors):
                    yield pa.RecordBatch.from_pydict(search(rows, block, same, top))
                held, size = [], 0
            if b is not None:
                held.append(b)
                size += len(b.column("v").flatten())

    return run


FOUND = "arid bigint, place bigint, rid bigint, vid bigint, score bigint"


def _ranked(df: DataFrame, top: int, *keys: str) -> DataFrame:
    """The top rows of each key, with rank from 1; a key has at most `top` rows from a task."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vid", "rid")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _scaled(vectors: DataFrame, vector: str, scale: int, vec_id: Column, label: Column) -> DataFrame:
    """rid, vid, label, v (whole numbers) and length of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.col(vector).isNotNull() & label.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    scaled = F.transform(x, lambda c: F.floor(c * scale))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), F.coalesce(vec_id, F.lit(NO_ID)).cast("long").alias("vid"), label.cast("long").alias("label"), scaled.alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    return rows.withColumn("length", length).where(F.col("length") < 2.0**31)


def mine(vectors: DataFrame, anchor: Column, label: Column, vector: str = "embedding", vec_id: str = "vec_id", scale: int = 256, positives: int = 5, negatives: int = 5, least_percent: int = 80, run_values: int = RUN_VALUES) -> DataFrame:
    """Mines hard negatives. Vectors are scaled and rounded down. For each row where `anchor` holds, its best `positives`
    other rows of its label, and for each of those its best `negatives` rows of other labels with a score from least_percent
    of the positive's to all of it. anchor may use vid (the vec_id); label: the label that counts.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank."""
    spark = vectors.sparkSession
    at = common.work_path(spark, "hard-negatives")
    rows = common.saved(_scaled(vectors, vector, scale, F.col(vec_id), label), f"{at}/scaled")
    rows = common.saved(rows.repartitionByRange(common.parallelism(spark), "label", F.desc("length"), "rid").sortWithinPartitions("label", F.desc("length")), f"{at}/rows")
    anchors = rows.where(F.coalesce(anchor, F.lit(False))).select(F.col("rid").alias("arid"), F.col("vid").alias("aid"), "label", "length", "v")
    whole = F.array(F.lit(None).cast("bigint"))
    first = common.saved(anchors.withColumn("lows", whole).withColumn("highs", whole), f"{at}/anchors")

    found = rows.mapInArrow(_task(f"{at}/anchors", True, positives, run_values), FOUND)
    best_of = _ranked(found, positives, "arid").select("arid", (F.col("rank") - 1).alias("place"), F.col("vid").alias("positive"), F.col("score").alias("positive_score"))
    best_of = common.saved(best_of, f"{at}/positives")
    # a score s is in range if least_percent * p <= 100 * s <= 100 * p: from the next whole number, and never below zero
    low = F.ceil(F.col("positive_score").cast("decimal(20,0)") * least_percent / 100).cast("bigint")
    sets = best_of.withColumn("low", low).groupBy("arid").agg(F.sort_array(F.collect_list(F.struct("place", "low", "positive_score"))).alias("sets"))
    second = first.drop("lows", "highs").join(sets, "arid").select("arid", "label", "length", "v", F.col("sets.low").alias("lows"), F.col("sets.positive_score").alias("highs"))
    common.saved(second, f"{at}/ranges")

    found = rows.mapInArrow(_task(f"{at}/ranges", False, negatives, run_values), FOUND)
    last = _ranked(found, negatives, "arid", "place").join(best_of, ["arid", "place"]).join(first.select("arid", "aid"), "arid")
    null_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = last.select(F.col("aid").alias("anchor_id"), null_id("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), null_id("vid").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), (F.col("place") + 1).cast("int").alias("positive_rank"))
    out = common.saved(out, common.work_path(spark, "hard-negatives-found"))
    common.remove(at)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(common.table(spark, sf_dir, "embeddings"), F.col("vid") % 100 == 0, label).drop("positive_rank")


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
