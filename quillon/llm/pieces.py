"""Token ids of texts by way of their pieces: what a text repeats is encoded once.

A text is cut into pieces at places where the tokenizer's own splitting never looks across. A piece's ids are kept in a
table that lives as long as the Python worker, and a batch of texts is a gather from that table. The table starts anew before it
has more than so many pieces or bytes. A long piece (a text without spaces, such as Chinese or minified code, is one) hardly comes
again: it is encoded where it stands and not kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces and bytes (of keys, at four a character, and ids) kept before the table starts anew; bytes of text handled at once.
MOST_PIECES, MOST_BYTES, SLICE_BYTES = 1_000_000, 64_000_000, 8_000_000
#: Characters of a piece that is kept at most.
LONGEST = 128


def gather(ids: np.ndarray, ends: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ids[ends[k] : ends[k + 1]] of the slots k one after the other, and the length of each."""
    starts = ends[slots]
    lens = ends[slots + 1] - starts
    where = np.repeat(starts - (np.cumsum(lens) - lens), lens)
    where += np.arange(len(where))
    return ids[where], lens


class PieceTable:
    """piece -> ids, as slices of one flat array. encode gives the ids of pieces, one after the other, and their number for each."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype=np.uint16, most: int = MOST_PIECES, most_bytes: int = MOST_BYTES):
        self.encode, self.dtype, self.most, self.most_bytes = encode, dtype, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.bytes = 0
        self.ids = np.zeros(1 << 16, self.dtype)
        self.ends = np.zeros(1 << 12, np.int64)  # ends[k], ends[k + 1]: the slice of piece k

    def _put(self, pieces: list[str], k: int) -> int:
        """Encodes pieces into the slots from k on; returns the bytes of their ids."""
        flat, lens = self.encode(pieces)
        end = int(self.ends[k])
        if len(self.ids) < end + len(flat):
            self.ids = np.concatenate([self.ids[:end], np.zeros(max(len(flat), end), self.dtype)])
        if len(self.ends) < k + len(pieces) + 1:
            self.ends = np.concatenate([self.ends[: k + 1], np.zeros(max(len(pieces), k), np.int64)])
        self.ids[end : end + len(flat)] = flat
        self.ends[k + 1 : k + len(pieces) + 1] = end + np.cumsum(lens)
        return len(flat) * self.ids.itemsize

    def slots(self, pieces: list[str]) -> np.ndarray:
        """The slot of each of the pieces, all distinct, until slots are asked for again; new ones are encoded, all at once."""
        brief = [p for p in pieces if len(p) <= LONGEST]
        new = [p for p in brief if p not in self.at]
        if self.at and (len(self.at) + len(new) > self.most or self.bytes + 4 * sum(map(len, new)) > self.most_bytes):
            self.clear()
            new = brief
        if new:
            k = len(self.at)
            self.bytes += 4 * sum(map(len, new)) + self._put(new, k)
            self.at.update(zip(new, range(k, k + len(new)), strict=True))
        if len(brief) == len(pieces):
            return np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))
        long = [p for p in pieces if len(p) > LONGEST]
        self._put(long, len(self.at))  # past the pieces kept: the next ones go over them
        passing = dict(zip(long, range(len(self.at), len(self.at) + len(long)), strict=True))
        return np.fromiter((passing[p] if len(p) > LONGEST else self.at[p] for p in pieces), np.int64, len(pieces))

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the slots one after the other, and their number for each slot."""
        return gather(self.ids, self.ends, slots)


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The texts in runs of about `size` bytes; a longer text is a run of its own."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + size)))
        yield texts.slice(start, end - start)
        start = end


def _classes() -> np.ndarray:
    """0: ASCII white space, 1: letter, 2: digit, 3: other printable ASCII, 4: the rest, next to which nothing is cut but before white space."""
    out = np.full(256, 4, np.uint8)
    out[33:127] = 3
    for low, high, kind in ((9, 13, 0), (32, 32, 0), (48, 57, 2), (65, 90, 1), (97, 122, 1)):
        out[low : high + 1] = kind
    return out


CLASS = _classes()


def _spaced(data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of the last bytes of characters beyond ASCII, those whose character's first byte rules out that it is white space."""
    two, three, four = (data[last - k] for k in (1, 2, 3))  # a place before the start is that of a last byte, never of a first one
    return last[((two >= 0xC3) & (two < 0xE0)) | ((three >= 0xE4) & (three < 0xF0)) | (four >= 0xF0)]


def split_pieces(texts: pa.Array, fold: bool, whole: str | None = None) -> tuple[np.ndarray, list[str], np.ndarray]:
    """split_coded, with the distinct pieces as a list."""
    which, pieces, counts = split_coded(texts, fold, whole)
    return which, pieces.to_pylist(), counts


def split_coded(texts: pa.Array, fold: bool, whole: str | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Cuts texts before ASCII white space that follows something else (beyond ASCII: only where _spaced tells so), and
    between ASCII letters, digits and punctuation (but not after an apostrophe that a letter follows): no match of the
    tokenizers' word patterns crosses such a place.

    fold: plain ASCII pieces are lower-cased and white space becomes spaces. whole: texts that contain this string are not cut.
    Returns for each piece the number of its distinct piece, the distinct pieces, and for each text its number of pieces.
    """
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8, count=off[-1])[off[0] :] if off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    if not len(data):
        return np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
    kind = CLASS[data]
    if whole is not None:
        for i in np.flatnonzero(pc.match_substring(texts, whole).to_numpy(zero_copy_only=False)):
            kind[off[i] : off[i + 1]] = 4
    left, right = kind[:-1], kind[1:]
    mark = np.ones(len(data), bool)
    mark[1:] = (left != right) & (left < 4) & (right < 4) & (left != 0) & ~((data[:-1] == 39) & (right == 1))
    mark[_spaced(data, np.flatnonzero((left == 4) & (right == 0))) + 1] = True
    mark[off[:-1][off[:-1] < len(data)]] = True
    starts = np.flatnonzero(mark)
    counts = np.searchsorted(starts, off[1:]) - np.searchsorted(starts, off[:-1])
    bounds = np.append(starts, len(data))
    if fold:
        plain = np.ones(len(starts), bool)
        plain[np.searchsorted(starts, np.flatnonzero(kind == 4), side="right") - 1] = False
        upper = np.flatnonzero((data >= 65) & (data <= 90))
        upper = upper[plain[np.searchsorted(starts, upper, side="right") - 1]]
        data = np.where(kind == 0, np.uint8(32), data)
        data[upper] += 32
    coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, counts
