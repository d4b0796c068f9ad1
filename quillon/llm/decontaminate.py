"""Benchmark decontamination: which documents hold a passage within a few word edits of a benchmark item.

The CGK embedding walks over a word sequence: at step j it emits the word under it and then stands still or moves on, by a
random bit of (j, word). Sequences at a small edit distance fall back into step, so their embeddings agree at most steps:
edit distance becomes Hamming distance. A table of the index is one random walk with a few sampled steps, and its key is
the words emitted at those steps (bit-sampling LSH). Items are indexed by size class, windows have their items' size, and
tables are added until passages of the class's own items with the greatest number of edits are found with the target recall.
It is measured when the index is built, over all items of the class, on passages edited afresh after the last table was made,
and is a column of the result. A class that cannot get there with MOST_TABLES tables of its own, or
within TABLE_BYTES, is looked up by exact seeds instead: an item with k edits keeps one of k + 1 pieces whole, so all are found.
Candidates are verified by exact edit distance.

A window starts at every STRIDE-th word of a document; an item is indexed from each of its first STRIDE words, so a passage
wherever it begins has a window that starts at one of them: unedited passages are always found. An item of which one of these
is in no table, because the walk outran it, has seeds too. Items of fewer than SHORT words allow no edit and are looked up as a whole.

Items go to blocks of about BLOCK_ITEMS items and BLOCK_BYTES of text. Each block's index is built in a task and written to the
shared folder; documents are read once, and a task holds each run of texts against one index after the other.

Defined results: words are those of unicode_words.py (lower-cased runs of Unicode letters, marks and numbers; each
character of a script written without spaces is a word); null texts and items are empty, and an item without a
word is nowhere; a null item_id or doc_id is reported as null; rows that repeat are searched each; other columns are not
read; empty tables give no rows.
"""

from __future__ import annotations

import json
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .ngram_join import mix
from .unicode_words import word_hashes

STRIDE, SHORT, SAMPLES, CLASSES, MOST_TABLES = 4, 10, 4, 4096, 64
#: A block of items; indexes that a task keeps in memory.
BLOCK_ITEMS, BLOCK_BYTES, MOST_HELD = 5000, 16 << 20, 2
#: Text that is held against one index after the other, where there are more than MOST_HELD.
RUN_BYTES = 64 << 20
#: The walks of one class have at most so many bytes; a seed has at most so many words; a class is judged after FEWEST tables.
TABLE_BYTES, SEED_WORDS, FEWEST = 64 << 20, 8, 8
#: Words of documents handled at once.
RUN_WORDS = 400_000
SCALE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
BLOOM = 1 << 18


def edit_distance(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """(least edit distance of item to any run of words of window, where that run ends)."""
    n = len(window) + 1
    steps = np.arange(n)
    row = np.zeros(n, np.int64)  # a run may begin anywhere
    for i, w in enumerate(item):
        new = np.empty(n, np.int64)
        new[0] = i + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (window != w))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min()), int(row.argmin())


def _class_of(words: int) -> int:
    """The least number of words of the size class of an item."""
    return SHORT << ((words // SHORT).bit_length() - 1)


@dataclass
class Table:
    """One walk with its sampled steps, and the keys of the items (indices into owners)."""

    bits: np.ndarray  # steps x word classes
    at: np.ndarray
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    owners: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))  # item, first word
    first: np.ndarray | None = None  # word classes that some item emits at the first sample
    pairs: np.ndarray | None = None  # bloom of the first two samples

    def key_of(self, words: np.ndarray) -> tuple[int, int, int] | None:
        """(class of the first sampled word, bloom place of the first two, key), or None if the walk ends before the last."""
        i, emitted = 0, []
        for j in range(int(self.at[-1]) + 1):
            if i >= len(words):
                return None
            emitted.append(words[i])
            i += int(self.bits[j, int(words[i] % np.uint64(CLASSES))])
        parts = np.cumsum(np.array(emitted)[self.at] * SCALE)
        return int(emitted[self.at[0]] % np.uint64(CLASSES)), int(mix(parts[1:2])[0] % np.uint64(BLOOM)), int(parts[-1])

    def fill(self, items: list[tuple[int, np.ndarray]]) -> None:
        rows = []
        for k, words in items:
            for o in range(STRIDE):
                if (key := self.key_of(words[o:])) is not None:
                    rows.append((*key, k, o))
        rows.sort(key=lambda r: r[2])
        self.first, self.pairs = np.zeros(CLASSES, bool), np.zeros(BLOOM, bool)
        self.first[[r[0] for r in rows]] = True
        self.pairs[[r[1] for r in rows]] = True
        self.keys = np.array([r[2] for r in rows], np.uint64)
        self.owners = np.array([r[3:] for r in rows], np.int64).reshape(-1, 2)

    def candidates(self, words: np.ndarray, kinds: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, where it would begin, the window's start) for the windows at starts whose key some item has. An item whose first
        words are gone would begin before the text that the window is in."""
        if not len(self.keys):
            return
        pos, begun, key, j = starts, starts, np.zeros(1, np.uint64), 0
        for s, step in enumerate(self.at):
            while j < step:
                pos = pos + self.bits[j].take(kinds.take(pos))
                j += 1
            if s == 0:
                keep = np.flatnonzero(self.first.take(kinds.take(pos)))
                pos, begun = pos[keep], begun[keep]
            key = key + words.take(pos) * SCALE[s]
            if s == 1:
                keep = np.flatnonzero(self.pairs.take((mix(key) % np.uint64(BLOOM)).astype(np.int64)))
                pos, begun, key = pos[keep], begun[keep], key[keep]
            if not len(pos):
                return
        low = np.searchsorted(self.keys, key)
        for w in np.flatnonzero(self.keys[low.clip(0, len(self.keys) - 1)] == key):
            k = low[w]
            while k < len(self.keys) and self.keys[k] == key[w]:
                yield int(self.owners[k, 0]), int(begun[w] - self.owners[k, 1]), int(begun[w])
                k += 1


class Index:
    """Tables over one block of items."""

    def __init__(self, items: list[tuple[int | None, str | None]], max_error: float, recall: float, seed: int = 5):
        self.ids = [i for i, _ in items]
        self.words = [word_hashes(t or "") for _, t in items]
        self.most = [int(max_error * len(w)) if len(w) >= SHORT else 0 for w in self.words]
        self.tables: list[Table] = []
        self.whole: dict[int, dict[int, list[int]]] = {}  # short items: length -> hash -> items
        self.seeds: dict[int, list[tuple[int, int, int]]] = {}  # seed length -> (hash, item, first word)
        self.recalls: dict[int, float] = {}
        sizes: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            if 0 < len(w) < SHORT:
                self.whole.setdefault(len(w), {}).setdefault(int(_sequence(w)), []).append(k)
            elif len(w):
                sizes.setdefault(_class_of(len(w)), []).append(k)
        rng = np.random.default_rng(seed)
        for least, members in sorted(sizes.items()):
            self._add_class(least, members, recall, rng)
        self.pieces = {n: (np.array([r[0] for r in rows], np.uint64), np.array([r[1:] for r in rows], np.int64)) for n, rows in ((n, sorted(r)) for n, r in self.seeds.items())}
        self.pad = 2 + max([int(t.at[-1]) for t in self.tables], default=0)

    def _add_class(self, least: int, members: list[int], recall: float, rng: np.random.Generator) -> None:
        """Tables for the items of least .. 2 least - 1 words, until enough edited passages of all of them are found, or seeds."""
        steps = max(SAMPLES, int(1.5 * (least - STRIDE)))
        most = min(MOST_TABLES, TABLE_BYTES // (steps * CLASSES))
        trials, made = self._trials(members, rng), []
        lost = trials
        while True:
            while len(lost) > (1 - recall) * len(trials):
                # losses fall ever more slowly: at this pace, the last table would not bring the recall
                hopeless = len(made) >= FEWEST and (len(lost) / len(trials)) ** (most / len(made)) > 1 - recall
                if len(made) >= most or hopeless:
                    self._add_seeds(members)
                    self.recalls[least] = 1.0
                    return
                at = np.sort(rng.choice(steps, SAMPLES, replace=False))
                table = Table(rng.integers(0, 2, (int(at[-1]) + 1, CLASSES), dtype=np.int64).astype(np.int8), at)
                table.fill([(k, self.words[k]) for k in members])
                made.append(table)
                lost = [t for t in lost if not self._meets(table, *t)]
            # the passages that told when to stop flatter the tables: others have the last word
            trials = self._trials(members, rng)
            lost = [t for t in trials if not any(self._meets(table, *t) for table in made)]
            if len(lost) <= (1 - recall) * len(trials):
                break
        self.tables += made
        self.recalls[least] = 1 - len(lost) / len(trials)
        placed = {(int(k), int(o)) for table in made for k, o in table.owners}
        self._add_seeds([k for k in members if any((k, o) not in placed for o in range(STRIDE))])

    def _trials(self, members: list[int], rng: np.random.Generator) -> list[tuple[int, np.ndarray, int]]:
        """(item, passage with the item's greatest number of edits, first window): 200 at least, each item at least once."""
        out = []
        for i in range(max(200, len(members))):
            k, (before, after) = members[i % len(members)], ((5, 5), (0, 5), (5, 0), (5, 5))[i % 4]  # in the midst, at the start and at the end of a text
            out.append((k, self._edited(self.words[k], self.most[k], rng, before, after), int(rng.integers(STRIDE)) if before else 0))
        return out

    def _meets(self, table: Table, owner: int, passage: np.ndarray, first: int) -> bool:
        text = np.concatenate([passage, np.zeros(int(table.at[-1]) + 2, np.uint64)])
        return any(k == owner for k, *_ in table.candidates(text, (text % np.uint64(CLASSES)).astype(np.int64), np.arange(first, len(passage), STRIDE)))

    def _add_seeds(self, members: list[int]) -> None:
        """The first words of most + 1 pieces of each item: one piece has no edit."""
        for k in members:
            size = len(self.words[k]) // (self.most[k] + 1)
            if not size:
                raise ValueError("as many edits as words")
            n = min(size, SEED_WORDS)
            for o in range(0, size * (self.most[k] + 1), size):
                self.seeds.setdefault(n, []).append((int(_sequence(self.words[k][o : o + n])), k, o))

    def recall_of(self, item: int) -> float:
        """The measured recall of the item's size class; 1 where look-up is exact."""
        n = len(self.words[item])
        return self.recalls[_class_of(n)] if n >= SHORT else 1.0

    def _seeded(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, where it would begin, the seed's start) for the places of words that hold a seed."""
        for n, (keys, owners) in self.pieces.items():
            if len(words) < n:
                continue
            grams = _sequence(np.lib.stride_tricks.sliding_window_view(words, n))
            low, high = np.searchsorted(keys, grams), np.searchsorted(keys, grams, side="right")
            for p in np.flatnonzero(low < high):
                for k, o in owners[low[p] : high[p]]:
                    yield int(k), int(p - o), int(p)

    def _edited(self, words: np.ndarray, edits: int, rng: np.random.Generator, before: int = 5, after: int = 5) -> np.ndarray:
        """The words with so many random substitutions, insertions and deletions, and so many strange words before and after."""
        out = words.tolist()
        for _ in range(edits):
            i, kind = int(rng.integers(len(out))), int(rng.integers(3))
            new = int(rng.integers(1, 2**62))
            if kind == 0:
                out[i] = new
            elif kind == 1:
                out.insert(i, new)
            else:
                del out[i]
        around = rng.integers(1, 2**62, before + after).tolist()
        return np.array([*around[:before], *out, *around[before:]], np.uint64)

    def _joined(self, places: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, first, last) for sorted places (row, item, where it would begin): those of one passage are one."""
        at = 0
        for i, (r, k, begin) in enumerate(places):
            if i + 1 == len(places) or places[i + 1][:2] != (r, k) or places[i + 1][2] - begin > self.most[k]:
                yield r, k, places[at][2], begin
                at = i + 1

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, edit distance, first word) for the best place of each item in each text that has it."""
        run: list[tuple[int, np.ndarray]] = []
        size = 0
        for row, text in enumerate(texts):
            if text:
                run.append((row, word_hashes(text)))
                size += len(run[-1][1])
            if size >= RUN_WORDS:
                yield from self._find(run)
                run, size = [], 0
        if run:
            yield from self._find(run)

    def _find(self, run: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int, int, int]]:
        gap = np.zeros(self.pad, np.uint64)
        words = np.concatenate([x for _, w in run for x in (w, gap)])
        heads = np.cumsum([0, *(len(w) + self.pad for _, w in run)])
        kinds = (words % np.uint64(CLASSES)).astype(np.int64)
        starts = np.concatenate([np.arange(h, h + len(w), STRIDE) for h, (_, w) in zip(heads, run, strict=False)])
        seen: set[tuple[int, int, int]] = set()
        for table in self.tables:
            seen.update(table.candidates(words, kinds, starts))
        seen.update(self._seeded(words))
        best: dict[tuple[int, int], tuple[int, int]] = {}

        def note(row: int, k: int, distance: int, at: int) -> None:
            best[row, k] = min(best.get((row, k), (1 << 30, 0)), (distance, at))

        found = list(seen)
        rows = (np.searchsorted(heads, [start for *_, start in found], side="right") - 1).tolist()
        places = {(r, k, begin - int(heads[r])) for r, (k, begin, _) in zip(rows, found, strict=True)}
        for r, k, off, last in self._joined(sorted(places)):
            item, most, own = self.words[k], self.most[k], run[r][1]
            low = max(0, off - most)
            window = own[low : max(0, last) + len(item) + most]
            if len(np.intersect1d(item, window)) < 0.5 * (len(np.unique(item)) - 2 * most):
                continue  # each edit takes at most one distinct word away
            distance, end = edit_distance(item, window)
            if distance <= most:
                begins = low + end - edit_distance(item[::-1], window[:end][::-1])[1]
                note(run[r][0], k, distance, begins)
        for n, known in self.whole.items():
            for head, (row, own) in zip(heads, run, strict=False):
                if len(own) >= n:
                    grams = _sequence(np.lib.stride_tricks.sliding_window_view(own, n))
                    for p in np.flatnonzero(np.isin(grams, np.fromiter(known, np.uint64))):
                        for k in known[int(grams[p])]:
                            if (own[p : p + n] == self.words[k]).all():
                                note(row, k, 0, int(p))
        for (row, k), (distance, at) in best.items():
            yield row, k, distance, at


def _sequence(words: np.ndarray) -> np.ndarray:
    """A hash of each row of words in order."""
    out = np.zeros(words.shape[:-1], np.uint64)
    for j in range(words.shape[-1]):
        out = mix(np.atleast_1d(out * np.uint64(0x9E3779B97F4A7C15) + words[..., j])).reshape(words.shape[:-1])
    return out


MANIFEST = "file string, items bigint, classes string"


def build_indexes(items: DataFrame, root: str, max_error: float, recall: float) -> DataFrame:
    """Writes an index for each block of items. Returns file, items and classes (JSON: words of the size class, at least, to
    its measured recall), one row a block."""
    size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-size[0] // BLOCK_ITEMS), -(-size[1] // BLOCK_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
        if rows:
            file = f"{root}/{uuid.uuid4().hex}.index"  # a retried task writes a file of its own; the manifest names the one that counted
            index = Index(sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")), max_error, recall)
            common.write_file(file, pickle.dumps(index))
            yield pa.RecordBatch.from_pydict({"file": [file], "items": [len(rows)], "classes": [json.dumps(index.recalls)]})

    return common.saved(items.select("item_id", "text").repartition(blocks).mapInArrow(run, MANIFEST), f"{root}/manifest")


@lru_cache(maxsize=MOST_HELD)
def _index(file: str) -> Index:
    return pickle.loads(common.read_file(file))  # noqa: S301: written by build_indexes


def _indexed(items: DataFrame, max_error: float, recall: float) -> list[str]:
    """The files of the blocks' indexes: one for BLOCK_ITEMS items or BLOCK_BYTES of text."""
    root = common.work_path(items.sparkSession, "benchmark")
    return [r.file for r in build_indexes(items, root, max_error, recall).select("file").orderBy("file").collect()]


def _together(batches: Iterator, size: Callable[..., int], files: list[str]) -> Iterator[list]:
    """The batches in runs: one by one where all indexes are held, else RUN_BYTES of text, so that each index is read once a run."""
    run, total = [], 0
    for b in batches:
        run.append(b)
        total += size(b)
        if total >= RUN_BYTES or len(files) <= MOST_HELD:
            yield run
            run, total = [], 0
    if run:
        yield run


def find_items(docs: DataFrame, items: DataFrame, max_error: float = 0.1, recall: float = 0.95) -> DataFrame:
    """Returns doc_id, item_id, distance (word edits), first_word, n_words (of the item) and recall (measured, at the greatest
    number of edits, for the item's size class in its block): the best place of each item in each row of docs that holds it
    within max_error of its words."""
    files = _indexed(items, max_error, recall)
    names = ["doc_id", "item_id", "distance", "first_word", "n_words", "recall"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _together(batches, lambda b: b.nbytes, files):
            ids, texts = ([x for b in held for x in b.column(c).to_pylist()] for c in ("doc_id", "text"))
            for file in files:
                own = _index(file)
                rows = [(ids[row], own.ids[k], distance, at, len(own.words[k]), own.recall_of(k)) for row, k, distance, at in own.find(texts)]
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "recall" else pa.int64()) for c, n in zip(columns, names, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint, distance bigint, first_word bigint, n_words bigint, recall double")


def clean_of(docs: DataFrame, items: DataFrame, max_error: float = 0.1, recall: float = 0.95) -> DataFrame:
    """The rows of docs that hold no item. All columns stay."""
    files = _indexed(items, max_error, recall)

    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for held in _together(batches, lambda x: sum(len(t) for t in x if t), files):
            texts = [t for x in held for t in x]
            out = np.zeros(len(texts), bool)
            for file in files:
                left = np.flatnonzero(~out)
                out[left[sorted({row for row, *_ in _index(file).find([texts[i] for i in left])})]] = True
            for part in np.split(out, np.cumsum([len(x) for x in held])[:-1]):
                yield pd.Series(part)

    return docs.where(~holds("text"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
