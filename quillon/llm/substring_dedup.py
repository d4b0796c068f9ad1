"""Substring dedup by prefix-partitioned suffix trees over words.

Suffixes are taken at sampled places: of the runs of GRAM words in each window, the one with the least hash (the leftmost of
ties). Equal windows have their place at the same word, so every repeat of a window's length holds a place that is
sampled in all its copies, and a repeat is the common start of two such suffixes together with the common end of what stands before them.

Suffixes are dealt by a prefix of variable length. The first GRAM words are the prefix of most; where these have more
suffixes than a task should hold, the prefix is the whole window, each window being a suffix of its own. A task takes the
groups in order, sorts their suffixes and gets from the longest common prefixes of neighbours the nodes of the groups' trees: at
each depth, the suffixes below a node of at least two leaves share so many words. Below a node they are told apart by the words
to the left. So each window's class and its least doc_id are known, and a document's runs of repeated windows are its
maximal repeats.

A suffix that no other document shares is never sent: first, each part of the corpus names the prefixes that it has, once, with its
least and greatest doc_id; those found in several documents come back to the parts that have them (parts.py), and only their
suffixes go to trees, equal ones of a part once. So a passage that a third of all documents share is one row a part. Texts are not shuffled.

Words are compared by WORD_BYTES bytes of a 64-bit hash, a prefix by all 64 bits.

Defined results: a null or empty text has no words; a text of fewer words than the window loses none; a null doc_id sorts
below all others; rows that share a doc_id take nothing from each other; columns other than doc_id and text are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .ngram_join import POWERS, mix
from .parts import Returned, by_part, give_back, numbered
from .pieces import slices

NO_ID = -(2**63)
WINDOW, GRAM, WORD_BYTES = 13, 5, 6
#: Suffixes with one prefix at most; beyond, the whole window is the prefix. Rows whose trees are built at once.
GROUP_ROWS, FOREST_ROWS = 20_000, 50_000
#: Bytes of text hashed at once; a longer word is hashed by itself.
BLOCK_BYTES = 2_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the texts' words one after the other, and each text's number of words."""
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if off[-1] == off[0]:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8, count=off[-1])[off[0] :]
    off = off - off[0]
    inside = ~SPACE[data]
    edge = np.ones(len(data) + 1, bool)  # whether a text or a space stands before the place, so that no word goes on there
    edge[1:-1] = ~inside[:-1]
    edge[off] = True
    first, last = np.flatnonzero(inside & edge[:-1]), np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
    counts = np.searchsorted(first, off[1:]) - np.searchsorted(first, off[:-1])
    lens, out, start = last - first, np.zeros(len(first), np.uint64), 0
    while start < len(first):
        end = max(start + 1, int(np.searchsorted(last, first[start] + BLOCK_BYTES, side="right")))
        if lens[start] > BLOCK_BYTES:
            out[start] = int.from_bytes(hashlib.blake2b(data[first[start] : last[start]], digest_size=8).digest(), "little")
            end = start + 1
        else:
            a, b, n = first[start], last[end - 1], lens[start:end]
            body = data[a:b][inside[a:b]].astype(np.uint64) + np.uint64(1)
            heads = np.cumsum(n) - n
            at = np.arange(len(body)) - np.repeat(heads, n)
            out[start:end] = mix(np.add.reduceat(body * (POWERS[at & 63] ^ (at >> 6).astype(np.uint64)), heads) + n.astype(np.uint64))
        start = end
    return out, counts


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each start of `width` values, the place of the least one, the leftmost of ties."""
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        n = len(at) - step
        at, size = np.where(values[at[step:]] < values[at[:n]], at[step:], at[:n]), size + step
    return at


class Suffixes:
    """The sampled suffixes of texts. at: the place of the suffix among all words; first, count: its windows' first start and
    number; key: the hash of its first words."""

    def __init__(self, texts: pa.Array, window: int, gram: int):
        self.words, self.counts = word_hashes(texts)
        self.begin = np.cumsum(self.counts) - self.counts
        n, self.window, self.gram = len(self.words), window, gram
        if n < window:
            self.at = self.first = self.count = self.doc = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        total = np.zeros(n - gram + 1, np.uint64)
        for j in range(gram):
            total = mix(total + self.words[j : n - gram + 1 + j] * ODD)
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        starts = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
        at = least_places(total, window - gram + 1)[starts]
        new = np.flatnonzero(np.diff(at, prepend=-1))
        self.at, self.first, self.count = at[new], starts[new], np.diff(np.append(new, len(at)))
        self.doc, self.key = doc[self.at], total[self.at]

    def only(self, keep: np.ndarray) -> None:
        self.at, self.first, self.count, self.doc, self.key = (x[keep] for x in (self.at, self.first, self.count, self.doc, self.key))

    def split(self, wide: np.ndarray) -> np.ndarray:
        """Makes each window of the suffixes `wide` one of its own. Returns which are such windows."""
        times = np.where(wide, self.count, 1)
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        self.at, self.doc, self.key, first = (np.repeat(x, times) for x in (self.at, self.doc, self.key, self.first))
        self.count, self.first = np.where(np.repeat(wide, times), 1, np.repeat(self.count, times)), first + step
        return np.repeat(wide, times)

    def around(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of each suffix's windows outside its first gram words, one after the other; their numbers; the words before the suffix."""
        before, lens = self.at - self.first, self.count + self.window - 1 - self.gram
        k = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
        place = np.repeat(self.first, lens) + k + np.where(k >= np.repeat(before, lens), self.gram, 0)
        return self.words[place], lens, before


def _short(words: np.ndarray) -> np.ndarray:
    """The bytes by which words are compared."""
    return words.astype("<u8").view(np.uint8).reshape(len(words), 8)[:, :WORD_BYTES]


def _names(suffixes: Suffixes, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """For each suffix, the prefix's hash by which it is dealt (the whole window where wide), and a hash that names it within a part."""
    words, lens, before = around = suffixes.around()
    heads = np.cumsum(lens) - lens
    k = np.arange(len(words)) - np.repeat(heads, lens)
    sums = np.add.reduceat(mix(words ^ POWERS[k % 64] + (k // 64).astype(np.uint64)), heads) if len(heads) else np.zeros(0, np.uint64)
    name = mix(sums + suffixes.key * ODD + before.astype(np.uint64) * POWERS[3] + suffixes.count.astype(np.uint64))
    return np.where(wide, name, suffixes.key), name, around


def _runs(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    done, dids = 0, b.column("did").to_numpy()
    for texts in slices(b.column("text"), BLOCK_BYTES):
        yield texts, dids[done : done + len(texts)]
        done += len(texts)


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray):
    """The distinct values with the least of low, the greatest of high and their number, and one place of each."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    if not len(first):
        return values, low[:0], high[:0], first, first
    return values[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first), np.diff(np.append(first, len(values))), order[first]


def _prefixes(window: int, gram: int):
    """(part, did, text) to (key, part, low, high, n): a row for each prefix of a run of texts."""

    def run(part: int, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for texts, dids in _runs(b):
            s = Suffixes(texts, window, gram)
            keys.append(s.key)
            ids.append(dids[s.doc])
        ids = np.concatenate(ids)
        key, low, high, n, _ = _least(np.concatenate(keys), ids, ids)
        yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "part": np.full(len(key), part), "low": low, "high": high, "n": n})

    return by_part(run)


def _shared(table: pa.Table | None) -> tuple[np.ndarray, np.ndarray]:
    """The prefixes of a part that several documents have, sorted, and which of them are wide."""
    if table is None:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    keys, where = np.unique(table.column("key").to_numpy().view(np.uint64), return_index=True)
    return keys, table.column("wide").to_numpy()[where]


def _kept(s: Suffixes, shared: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Leaves the suffixes whose prefix is shared; returns which are whole windows."""
    keys, wide = shared
    where = np.minimum(np.searchsorted(keys, s.key), max(0, len(keys) - 1))
    there = keys[where] == s.key if len(keys) else np.zeros(len(s.key), bool)
    s.only(there)
    return s.split(wide[where[there]] if len(keys) else np.zeros(0, bool))


SUFFIX = "dealt bigint, part bigint, name bigint, before int, windows int, words binary, low bigint, high bigint"


def _suffixes(window: int, gram: int, shared_at: str):
    """(part, did, text) to SUFFIX: the suffixes with shared prefixes, equal ones of a run of texts once."""
    shared = Returned(shared_at, _shared)

    def run(part: int, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for texts, dids in _runs(b):
            s = Suffixes(texts, window, gram)
            wide = _kept(s, shared(part))
            dealt, name, _ = _names(s, wide)
            ids = dids[s.doc]
            name, low, high, _, one = _least(name, ids, ids)
            s.only(one)
            words, lens, before = s.around()
            body = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer((np.append(0, np.cumsum(lens)) * WORD_BYTES).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(_short(words)))])
            columns = [dealt[one].view(np.int64), np.full(len(one), part), name.view(np.int64), before.astype(np.int32), s.count.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), body, pa.array(low), pa.array(high)], [c.split()[0] for c in SUFFIX.split(", ")])

    return by_part(run)


class Forest:
    """The trees of groups of suffixes that have the words outside their prefix given in `words` (rows x 2 * span, the first
    span to the left); missing words are 0. Suffixes are sorted; common[i]: how many words to the right suffix i has in common
    with the one before it (-1: another group)."""

    def __init__(self, group: np.ndarray, words: np.ndarray, span: int):
        self.span = span
        right = words[:, span:]
        self.order = np.lexsort([*(right[:, k] for k in range(span - 1, -1, -1)), group])
        group, right, self.left = group[self.order], right[self.order], words[self.order, :span]
        unlike = np.ones((len(group), span + 1), bool)
        unlike[1:, :span] = right[1:] != right[:-1]
        self.common = unlike.argmax(1)
        self.common[np.append(True, group[1:] != group[:-1])] = -1

    def nodes(self, depth: int) -> np.ndarray:
        """For each suffix in order, the node above it at so many words to the right."""
        return np.cumsum(self.common < depth)

    def least(self, low: np.ndarray, before: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """(rows, span + 1): at j, the least of low over the suffixes that share the window with j words to the left."""
        low, before, windows = low[self.order], before[self.order], windows[self.order]
        out = np.full((len(low), self.span + 1), np.iinfo(np.int64).max)
        same = np.zeros(len(low), np.int64)  # number of the class of suffixes with the same j words to the left
        for j in range(self.span + 1):
            if j:
                word = self.left[:, self.span - j]
                by = np.lexsort((word, same))
                step = np.append(False, (word[by][1:] != word[by][:-1]) | (same[by][1:] != same[by][:-1]))
                same = np.zeros_like(same)
                same[by] = np.cumsum(step)
            has = np.flatnonzero((j <= before) & (j > before - windows))
            if len(has):
                key = self.nodes(self.span - j)[has] * len(low) + same[has]
                by = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1]))
                out[has[by], j] = np.repeat(np.minimum.reduceat(low[has[by]], first), np.diff(np.append(first, len(has))))
        back = np.empty_like(out)
        back[self.order] = out
        return back


def _trees(span: int, rows: int):
    """SUFFIX, sorted by dealt, to (part, name, least): for each window of a suffix the least doc_id with that window."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        group, before, windows, low, high = (t.column(c).to_numpy() for c in ("dealt", "before", "windows", "low", "high"))
        body = t.column("words").chunk(0)
        off = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
        flat = np.zeros(((off[-1] - off[0]) // WORD_BYTES, 8), np.uint8)
        flat[:, :WORD_BYTES] = np.frombuffer(body.buffers()[2], np.uint8)[off[0] : off[-1]].reshape(-1, WORD_BYTES)
        lens = np.diff(off) // WORD_BYTES
        words = np.zeros((len(t), 2 * span), np.uint64)
        k = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        words[np.repeat(np.arange(len(t)), lens), k + np.repeat(span - before, lens)] = flat.view("<u8")[:, 0]
        least = Forest(group, words, span).least(low, before.astype(np.int64), windows.astype(np.int64))
        use = np.flatnonzero(least.min(1) < high)
        size = windows[use].astype(np.int64)
        steps = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        mine = least[np.repeat(use, size), np.repeat(before[use].astype(np.int64), size) - steps]
        lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(size)).astype(np.int32), pa.array(mine))
        return pa.RecordBatch.from_arrays([pa.array(t.column("part").to_numpy()[use]), pa.array(t.column("name").to_numpy()[use]), lists], ["part", "name", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in (*batches, None):
            if b is not None and b.num_rows:
                held.append(b)
            if held and (b is None or sum(x.num_rows for x in held) >= rows):
                t = pa.Table.from_batches(held)
                group = t.column("dealt").to_numpy()
                end = len(t) if b is None else int(np.searchsorted(group, group[-1]))  # the last group may go on
                if end:
                    yield solve(t.slice(0, end))
                held = t.slice(end).to_batches()

    return run


def _found(table: pa.Table | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if table is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists = table.column("least").combine_chunks()
    names, where = np.unique(table.column("name").to_numpy().view(np.uint64), return_index=True)
    return names, lists.offsets.to_numpy()[where].astype(np.int64), lists.values.to_numpy()


REMOVED = "did bigint, n_words bigint, n_removed bigint, kept_text string, starts array<int>, ends array<int>"


def _removed(window: int, gram: int, shared_at: str, found_at: str):
    """(part, did, text) to REMOVED."""
    shared, found = Returned(shared_at, _shared), Returned(found_at, _found)

    def run(part: int, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, at, least = found(part)
        for texts, dids in _runs(b):
            s = Suffixes(texts, window, gram)
            wide = _kept(s, shared(part))
            _, name, _ = _names(s, wide)
            step = np.zeros(len(s.words) + 1, np.int64)
            if len(names) and len(name):
                where = np.minimum(np.searchsorted(names, name), len(names) - 1)
                hit = np.flatnonzero(names[where] == name)
                size = s.count[hit]
                k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                gone = least[np.repeat(at[where[hit]], size) + k] < np.repeat(dids[s.doc[hit]], size)
                start = (np.repeat(s.first[hit], size) + k)[gone]
                np.add.at(step, start, 1)
                np.add.at(step, start + window, -1)
            covered = np.cumsum(step[:-1]) > 0
            ends = np.cumsum(s.counts)
            total = np.append(0, np.cumsum(covered))
            n_gone = total[ends] - total[s.begin]
            body = [b" ".join(compress(w, ~covered[a:z]) if g else w) for w, a, z, g in ((t.encode().split(), a, z, g) for t, a, z, g in zip(texts.to_pylist(), s.begin, ends, n_gone, strict=True))]
            edge = np.zeros(len(covered) + 1, bool)
            edge[s.begin], edge[ends] = True, True
            opens = np.flatnonzero(covered & (edge[:-1] | ~np.append(False, covered[:-1])[: len(covered)]))
            closes = np.flatnonzero(covered & (edge[1:] | ~np.append(covered[1:], False)[: len(covered)])) + 1
            per = np.searchsorted(opens, ends) - np.searchsorted(opens, s.begin)
            lists = [pa.ListArray.from_arrays(np.append(0, np.cumsum(per)).astype(np.int32), pa.array((x - np.repeat(s.begin, per)).astype(np.int32))) for x in (opens, closes)]
            yield pa.RecordBatch.from_arrays([pa.array(dids), pa.array(s.counts), pa.array(n_gone), pa.array(body, pa.binary()).cast(pa.string()), *lists], [c.split()[0] for c in REMOVED.split(", ")])

    return by_part(run)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_rows: int = GROUP_ROWS, forest_rows: int = FOREST_ROWS) -> DataFrame:
    """Removes each word covered by a window of words that also starts in a document with a smaller doc_id.

    Returns for each row of docs: doc_id, n_words, n_removed, kept_text (the kept words, joined by a space), starts and ends
    (the removed runs of words, ends exclusive). window: two words or more; gram: fewer than that. group_rows: suffixes that
    are dealt by one prefix of `gram` words at most."""
    if window < 2:
        raise ValueError("a window has two words or more")
    spark, gram = docs.sparkSession, min(gram, window - 1)
    at = common.work_path(spark, "substrings")
    own = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("did"), common.text_or_empty().alias("text"))
    own.mapInArrow(numbered(lambda b: iter([b])), "part bigint, did bigint, text string").write.option("compression", "zstd").parquet(f"{at}/docs")
    own = spark.read.schema("part bigint, did bigint, text string").parquet(f"{at}/docs")

    key = Window.partitionBy("key")  # a prefix has a row for each batch of texts at most
    prefixes = own.mapInArrow(_prefixes(window, gram), "key bigint, part bigint, low bigint, high bigint, n bigint")
    shared = prefixes.select("key", "part", (F.min("low").over(key) < F.max("high").over(key)).alias("shared"), (F.sum("n").over(key) > group_rows).alias("wide"))
    give_back(shared.where("shared").select("key", "part", "wide"), f"{at}/shared")

    suffixes = own.mapInArrow(_suffixes(window, gram, f"{at}/shared"), SUFFIX)
    dealt = suffixes.repartition(2 * common.parallelism(spark), "dealt").sortWithinPartitions("dealt")
    give_back(dealt.mapInArrow(_trees(window - gram, forest_rows), "part bigint, name bigint, least array<bigint>"), f"{at}/found")

    out = own.mapInArrow(_removed(window, gram, f"{at}/shared", f"{at}/found"), REMOVED)
    return out.withColumn("did", F.when(F.col("did") != NO_ID, F.col("did"))).withColumnRenamed("did", "doc_id")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS k FROM s),
m AS (SELECT doc_id, i FROM v QUALIFY min(doc_id) OVER (PARTITION BY k) < doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM m),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
k AS (SELECT x.doc_id, count(*) AS n_words, count(g.i) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY x.i) FILTER (g.i IS NULL), '')) AS kept_sha256 FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
