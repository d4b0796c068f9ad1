"""Words of a text by Unicode: lower-cased runs of letters, marks and numbers ([\\p{L}\\p{M}\\p{N}]+).

Spaces, quotes, dashes and other punctuation of any script part words. Each letter, mark or number of a script that is written
without spaces (SOLO) is a word of its own. Texts are not normalised.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

from .ngram_join import POWERS, mix
from .ngram_join import word_hashes as ascii_hashes

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
SOLO = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Yi}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]+")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """For each code point: 1 in a word, 2 a word of its own, 0 neither."""
    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(len(every), np.int8)
    for m in WORD.finditer(every):
        out[m.start() : m.end()] = 1
    for m in SOLO.finditer(every):
        out[m.start() : m.end()] *= 2
    return out


def word_hashes(text: str, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word, in order; long texts are read in blocks that end between words."""
    if text.isascii():
        return ascii_hashes(text)
    kinds = _kinds()
    data = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out, start = [], 0
    while start < len(data):
        end = min(len(data), start + block)
        while end < len(data) and kinds[data[end]] == 1:
            end += 1
        part = data[start:end]
        kind = kinds[part]
        inside = kind > 0
        begins = inside.copy()
        begins[1:] &= (kind[1:] == 2) | (kind[:-1] != 1)
        first = np.flatnonzero(begins)
        if len(first):
            body = part[inside].astype(np.uint64) + np.uint64(1)
            heads = (np.cumsum(inside) - 1)[first]
            lens = np.diff(np.append(heads, len(body)))
            at = np.arange(len(body)) - np.repeat(heads, lens)
            scale = POWERS[at & 63] ^ (at >> 6).astype(np.uint64)
            out.append(mix(np.add.reduceat(body * scale, heads) + lens.astype(np.uint64)))
        start = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
