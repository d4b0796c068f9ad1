"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often in the corpus.

Three looks at the corpus, in parts (parts.py), each a pipeline of Arrow arrays within tasks:

1. A text's tokens of both vocabularies are lists. Flattened, with parent indices, and with sums of the tokens' bytes that start
   anew with each text, they give a row for each token's end; a hash join of the two tables of ends (text, end) finds the
   places where tokens of both end. They cut a text into groups. Ids and the groups' ends are written; texts are not needed again.
2. The pairs of a group are its links. Table.group_by counts, for each part, the documents that link a pair; Spark adds the parts'
   counts up, finds the highest count of each id of the first vocabulary (at most one row an id), and gives each part its pairs back.
3. The links of a part are joined with what came back and summed for each document.

A pair that all documents have is one row a part. A group's pairs are expanded with multiplicities, in blocks of bounded size.

Defined results: a null or empty text, and one whose tokens' bytes are not a space and the text (such as one with U+2581), has
no tokens, zeros, and an empty `groups`; every row is a document of its own, also where rows repeat or doc_id is null; columns
other than doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .parts import Returned, by_part, give_back, numbered
from .pieces import LONGEST, gather, slices, split_coded

#: Bytes of text and tokens handled at once; links expanded at once; groups with more links are expanded by distinct ids.
RUN_BYTES, RUN_TOKENS, MOST_LINKS, LARGE_GROUP = 2_000_000, 250_000, 1_000_000, 4096
#: Pieces of texts whose ids a worker keeps for each vocabulary, and bytes of them.
MOST_PIECES, MOST_BYTES = 600_000, 24_000_000
SPACE = "\u2581"
LOW_BAR = SPACE.encode()


def byte_characters() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Ids of texts and bytes of ids. encode: the ids of pieces one after the other, and their number for each; cut: the pieces
    of texts, as split_coded gives them, that may be encoded apart."""

    def __init__(self, tokens: list[bytes], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], cut: Callable[[pa.Array], tuple[np.ndarray, pa.Array, np.ndarray]]):
        self.size, self.encode, self.cut = len(tokens), encode, cut
        self.body = np.frombuffer(b"".join(tokens), np.uint8)
        self.ends = np.cumsum([0, *map(len, tokens)])
        self.lens = np.diff(self.ends)
        self.dtype = np.uint16 if self.size <= 2**16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.keys = pa.array([], pa.large_string())
        self.ids, self.stops = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def slots(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The slot of each piece, and the ids and ends of the slots. Pieces are kept in Arrow's own form, MOST_PIECES and
        MOST_BYTES at most, and found by its hash tables; those longer than LONGEST hardly come again and are not kept."""
        found = pc.index_in(pieces, value_set=self.keys)
        if len(self.keys) + found.null_count > MOST_PIECES or self.keys.nbytes + pieces.nbytes > MOST_BYTES:
            self.clear()
            found = pc.index_in(pieces, value_set=self.keys)
        slots = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if not found.null_count:
            return slots, self.ids, self.stops
        at = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        long = pc.binary_length(pieces.take(pa.array(at))).to_numpy() > LONGEST
        at, brief = np.concatenate([at[~long], at[long]]), int((~long).sum())
        new = pieces.take(pa.array(at))
        ids, lens = self.encode(new.to_pylist())
        slots[at] = len(self.keys) + np.arange(len(at))
        ids, stops = np.concatenate([self.ids, ids.astype(self.dtype)]), np.concatenate([self.stops, self.stops[-1] + np.cumsum(lens)])
        self.keys = pa.concat_arrays([self.keys, new.slice(0, brief)])
        self.stops = stops[: len(self.keys) + 1]
        self.ids = ids[: self.stops[-1]]
        return slots, ids, stops

    def lists(self, texts: pa.Array) -> pa.ListArray:
        which, pieces, counts = self.cut(texts)
        if not len(pieces):
            return pa.array([[]] * len(texts), pa.list_(pa.from_numpy_dtype(self.dtype)))
        slots, ids, stops = self.slots(pieces)
        ids, lens = gather(ids, stops, slots[which])
        done = np.append(0, np.cumsum(lens))[np.append(0, np.cumsum(counts))]
        return pa.ListArray.from_arrays(done.astype(np.int32), pa.array(ids))

    def spells(self, lists: pa.ListArray, bodies: list[bytes]) -> np.ndarray:
        """Whether the tokens' bytes of each list are the body."""
        ids = lists.values.to_numpy()
        text = gather(self.body, self.ends, ids.astype(np.int64))[0].tobytes()
        at = np.append(0, np.cumsum(self.lens[ids]))[lists.offsets.to_numpy()]
        return np.array([text[a:b] == body for a, b, body in zip(at[:-1], at[1:], bodies, strict=True)], bool)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(lens.sum())), lens


def _spaced(texts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type))


def _whole(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    return np.arange(len(texts)), texts.cast(pa.large_string()), np.ones(len(texts), np.int64)


@lru_cache(maxsize=2)
def byte_level(path: str) -> Vocabulary:
    """A byte-level BPE of the tokenizers library, for texts with a space before them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    chars = byte_characters()
    spelled = {i: bytes(chars[c] for c in t) if all(c in chars for c in t) else t.encode() for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    rules = json.loads(tokenizer.pre_tokenizer.__getstate__()) if tokenizer.pre_tokenizer else {}
    known = tokenizer.normalizer is None and rules.get("type") == "ByteLevel" and rules.get("use_regex") and not rules.get("add_prefix_space")
    encode = lambda pieces: _flat([e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)])
    return Vocabulary([spelled.get(i, b"") for i in range(max(spelled) + 1)], encode, lambda texts: split_coded(_spaced(texts), fold=False) if known else _whole(_spaced(texts)))


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Cuts texts with a space before them before every space that follows something else, and leaves one space out of each
    piece: the vocabulary puts it back. Returns what split_coded does."""
    texts = _spaced(texts).cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8, count=off[-1])[off[0] :] if len(texts) else np.zeros(0, np.uint8)
    off = off - off[:1]
    space = data == 32
    mark = space & ~np.append(False, space[:-1])[: len(data)]
    ends = np.flatnonzero(data == LOW_BAR[2]) + 1  # a text's own U+2581 is a space to the vocabulary: no cut after it
    ends = ends[(ends > 2) & (ends < len(data))]
    mark[ends[(data[ends - 3] == LOW_BAR[0]) & (data[ends - 2] == LOW_BAR[1])]] = False
    mark[off[:-1]] = True
    starts = np.flatnonzero(mark)
    bounds = np.append(starts, len(data)) - np.arange(len(starts) + 1)
    coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[~mark]))]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, np.diff(np.searchsorted(starts, off))


@lru_cache(maxsize=2)
def sentence_pieces(path: str) -> Vocabulary:
    """A BPE of the sentencepiece library, which puts a space before a text by itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
    # no token goes on with a space after something else: then no merge crosses the place before such a space
    apart = not any(SPACE in p.lstrip(SPACE) for p in names)

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library has no ids for an empty text: the space that stands for one is looked up by its name."""
        alone = [model.piece_to_id(SPACE)]
        return _flat([x if p else alone for p, x in zip(pieces, model.encode(pieces, num_threads=1), strict=True)])

    return Vocabulary(tokens, encode, split_words if apart else _whole)


def ends_of(lists: pa.ListArray, lens: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The text of each token and its end within the text: sums of the tokens' bytes that start anew with each text."""
    parent = pc.list_parent_indices(lists)
    total = pc.cumulative_sum(pa.array(lens[lists.values.to_numpy()]))
    before = np.append(0, total.to_numpy())[lists.offsets.to_numpy()[:-1]]
    return parent, pc.subtract(total, pc.take(pa.array(before), parent))


def group_ends(a: pa.ListArray, b: pa.ListArray, va: Vocabulary, vb: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """For each token of a and of b, 1 where it ends a group, else 0."""
    sides = []
    for lists, v, name in ((a, va, "a"), (b, vb, "b")):
        parent, end = ends_of(lists, v.lens)
        key = pc.add(pc.shift_left(pc.cast(parent, pa.int64()), pa.scalar(40, pa.int64())), end)
        sides.append(pa.table({"key": key, name: pa.array(np.arange(len(key)))}))
    met = sides[0].join(sides[1], "key", join_type="inner", use_threads=False)
    ends = []
    for lists, name in ((a, "a"), (b, "b")):
        end = np.zeros(len(lists.values), np.uint8)
        end[met.column(name).to_numpy()] = 1
        ends.append(end)
    return ends[0], ends[1]


def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of values as bytes, one binary for each count."""
    bounds = np.append(0, np.cumsum(counts)) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(body: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of all binaries one after the other, and the offsets of each one's."""
    off = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1]
    size = np.dtype(dtype).itemsize
    if off[-1] == off[0]:
        return np.zeros(0, dtype), np.zeros(len(off), np.int64)
    return np.frombuffer(body.buffers()[2], np.uint8)[off[0] : off[-1]].view(dtype), (off - off[0]).astype(np.int64) // size


ENCODED = "did bigint, a binary, b binary, ends_a binary, ends_b binary"


def _encode(first: str, second: str):
    """(did, text) to ENCODED: ids, and for each whether it ends a group (a byte)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        va, vb = byte_level(first), sentence_pieces(second)
        done = 0
        for texts in slices(batch.column("text").fill_null(""), RUN_BYTES):
            dids = batch.column("did").slice(done, len(texts))
            done += len(texts)
            a, b = va.lists(texts), vb.lists(texts)
            bodies = [x.encode() for x in _spaced(texts).to_pylist()]
            good = va.spells(a, bodies) & vb.spells(b, bodies) & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
            if not good.all():
                bad = pa.array(~good)
                a, b = (pc.if_else(bad, pa.array([[]] * len(bad), x.type), x) for x in (a, b))
                a, b = (pa.ListArray.from_arrays(np.append(0, np.cumsum(x.value_lengths().to_numpy())).astype(np.int32), x.flatten()) for x in (a, b))
            ends = group_ends(a, b, va, vb)
            packed = [_packed(v, np.diff(x.offsets.to_numpy())) for v, x in ((a.values.to_numpy(), a), (b.values.to_numpy(), b), (ends[0], a), (ends[1], b))]
            yield pa.RecordBatch.from_arrays([dids, *packed], ["did", "a", "b", "ends_a", "ends_b"])

    return run


class Aligned:
    """Texts' ids and groups from ENCODED rows. a, b: all ids; off_a, off_b, off_g: where each text's begin; na, nb: sizes of the
    groups; text: each group's text."""

    def __init__(self, rows: pa.RecordBatch, va: Vocabulary, vb: Vocabulary):
        self.a, self.off_a = unpacked(rows.column("a"), va.dtype)
        self.b, self.off_b = unpacked(rows.column("b"), vb.dtype)
        last_a, last_b = (np.flatnonzero(unpacked(rows.column(c), np.uint8)[0]) for c in ("ends_a", "ends_b"))
        self.na, self.nb = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)  # a text's last token ends a group
        self.off_g = np.searchsorted(last_a, self.off_a)
        self.text = np.repeat(np.arange(rows.num_rows), np.diff(self.off_g))

    def links(self, wide: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of links: text, pair (id of a times wide, plus id of b), and how often."""
        ga, gb = np.repeat(np.arange(len(self.na)), self.na), np.repeat(np.arange(len(self.nb)), self.nb)
        a, b = self.a.astype(np.int64), self.b.astype(np.int64)
        ma, mb, na, nb = np.ones(len(a), np.int64), np.ones(len(b), np.int64), self.na, self.nb
        large = na * nb > LARGE_GROUP
        if large.any():
            (ga, a, ma, na), (gb, b, mb, nb) = (self._distinct(g, x, n, large) for g, x, n in ((ga, a, na), (gb, b, nb)))
        start, times = np.cumsum(nb) - nb, nb[ga]
        sums, at = np.cumsum(times), 0
        while at < len(a):
            end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + MOST_LINKS, side="right")))
            n = times[at:end]
            left = np.repeat(np.arange(at, end), n)
            right = start[ga[left]] + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
            yield self.text[ga[left]], a[left] * wide + b[right], ma[left] * mb[right]
            at = end

    def _distinct(self, group: np.ndarray, ids: np.ndarray, sizes: np.ndarray, large: np.ndarray):
        """Tokens with the equal ones of a large group as one, and how many those are."""
        t = pa.table({"group": group, "id": np.where(large[group], ids, 0), "k": np.where(large[group], 0, np.arange(len(ids)) + 1)})
        t = t.append_column("n", pa.array(np.ones(len(ids), np.int64))).group_by(["group", "id", "k"], use_threads=False).aggregate([("n", "sum")]).sort_by([("group", "ascending"), ("k", "ascending"), ("id", "ascending")])
        group, k = t.column("group").to_numpy(), t.column("k").to_numpy()
        return group, np.where(k > 0, ids[k - 1], t.column("id").to_numpy()), t.column("n_sum").to_numpy(), np.bincount(group, minlength=len(sizes))


def _stretches(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in runs of bounded numbers of tokens; a longer text is a run of its own."""
    done = 0
    for x in slices(b.column("a"), RUN_TOKENS * 2):
        yield b.slice(done, len(x))
        done += len(x)


def linked_pairs(rows: pa.RecordBatch, va: Vocabulary, vb: Vocabulary) -> tuple[Aligned, pa.Table]:
    """The rows' tokens, and for each text and pair the number of links: text, pair, links."""
    own, found = Aligned(rows, va, vb), []
    for text, pair, times in own.links(vb.size):
        found.append(pa.table({"text": text, "pair": pair, "links": times}).group_by(["text", "pair"], use_threads=False).aggregate([("links", "sum")]).rename_columns(["text", "pair", "links"]))
    if len(found) == 1:
        return own, found[0]
    schema = pa.schema([("text", pa.int64()), ("pair", pa.int64()), ("links", pa.int64())])
    t = pa.concat_tables([schema.empty_table(), *found])
    return own, t.group_by(["text", "pair"], use_threads=False).aggregate([("links", "sum")]).rename_columns(["text", "pair", "links"])


def _counts(first: str, second: str):
    """(part, ENCODED) to (part, pair, docs): in how many documents of a batch of the part a pair is linked."""

    def run(part: int, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        va, vb = byte_level(first), sentence_pieces(second)
        total = pa.table({"pair": pa.array([], pa.int64()), "docs": pa.array([], pa.int64())})
        for rows in _stretches(b):
            pairs = linked_pairs(rows, va, vb)[1]
            own = pairs.group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "docs"])
            total = pa.concat_tables([total, own]).group_by("pair", use_threads=False).aggregate([("docs", "sum")]).rename_columns(["pair", "docs"])
        for x in total.to_batches(50_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(x.num_rows, part)), *x.columns], ["part", "pair", "docs"])

    return by_part(run)


def written(own: Aligned) -> pa.Array:
    """a1,a2|b1;a3|b2,b3: the groups of each text with their ids."""
    sides = []
    for ids, sizes in ((own.a, own.na), (own.b, own.nb)):
        lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), pc.cast(pa.array(ids), pa.string()))
        sides.append(pc.binary_join(lists, ","))
    groups = pc.binary_join_element_wise(*sides, "|")
    return pc.binary_join(pa.ListArray.from_arrays(own.off_g.astype(np.int32), groups), ";")


ALIGNED = "did bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"


def _sums(first: str, second: str, counts_at: str):
    """(part, ENCODED) to ALIGNED, with the pairs' counts that came back."""
    empty = pa.table({"pair": pa.array([], pa.int64()), "docs": pa.array([], pa.int64()), "best": pa.array([], pa.bool_())})

    def unique(t: pa.Table | None) -> pa.Table:
        if t is None:
            return empty
        pair, where = np.unique(t.column("pair").to_numpy(), return_index=True)
        return pa.table({"pair": pair, "docs": t.column("docs").to_numpy()[where], "best": t.column("best").to_numpy()[where].astype(np.int64)})

    counts = Returned(counts_at, unique)

    def run(part: int, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        va, vb = byte_level(first), sentence_pieces(second)
        known = counts(part)
        for rows in _stretches(b):
            own, pairs = linked_pairs(rows, va, vb)
            met = pairs.join(known, "pair", join_type="inner", use_threads=False)
            if len(met) != len(pairs):
                raise ValueError("a linked pair has no count")
            met = met.append_column("summed", pc.multiply(met["links"], met["docs"])).append_column("of_best", pc.multiply(met["links"], met["best"]))
            sums = met.group_by("text", use_threads=False).aggregate([("links", "sum"), ("of_best", "sum"), ("summed", "sum")])
            out = np.zeros((3, rows.num_rows), np.int64)
            out[:, sums.column("text").to_numpy()] = [sums.column(c).to_numpy() for c in ("links_sum", "of_best_sum", "summed_sum")]
            sizes = [np.diff(x) for x in (own.off_a, own.off_b, own.off_g)]
            yield pa.RecordBatch.from_arrays([rows.column("did"), *map(pa.array, sizes), *map(pa.array, out), written(own)], [c.split()[0] for c in ALIGNED.split(", ")])

    return by_part(run)


def align(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Aligns the tokens of docs' texts: first is the file of a byte-level BPE (space and text), second of a sentencepiece model.

    Returns for each row: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose count is their first id's highest),
    count_sum (of the links' counts) and groups (their ids, written out). A pair's count is the number of documents that link it."""
    spark = docs.sparkSession
    at = common.work_path(spark, "alignment")
    own = docs.select(F.col("doc_id").cast("long").alias("did"), common.text_or_empty().alias("text"))
    own.mapInArrow(numbered(_encode(first, second)), f"part bigint, {ENCODED}").write.option("compression", "zstd").parquet(f"{at}/encoded")
    encoded = spark.read.schema(f"part bigint, {ENCODED}").parquet(f"{at}/encoded")

    wide = sentence_pieces(second).size
    part_counts = common.saved(encoded.mapInArrow(_counts(first, second), "part bigint, pair bigint, docs bigint"), f"{at}/counts")
    totals = common.saved(part_counts.groupBy("pair").agg(F.sum("docs").alias("docs"), F.count("*").alias("rows")), f"{at}/totals")
    of = F.floor(F.col("pair") / wide).cast("int")
    best = totals.groupBy(of.alias("a")).agg(F.max("docs").alias("most"))
    # best has at most a row for each id of the first vocabulary, whatever the input: that bound is why it may be broadcast
    marked = totals.withColumn("a", of).join(F.broadcast(best), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"), "rows")
    marked = common.saved(marked, f"{at}/marked")
    give_back(common.join_split(part_counts.select("part", "pair"), marked, "pair", "rows").select("part", "pair", "docs", "best"), f"{at}/back")

    return encoded.mapInArrow(_sums(first, second, f"{at}/back"), ALIGNED).withColumnRenamed("did", "doc_id")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
