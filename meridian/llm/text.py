"""Words, word hashes and shingles: what the text operators share, for use inside Arrow workers."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import xxhash

_SPACE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _between(*ranges: tuple[int, int]) -> str:
    return "".join(f"{chr(low)}-{chr(high)}" for low, high in ranges)


_MARKS = re.compile(f"[{_between((0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0x2000, 0x206F), (0x3000, 0x303F), (0xFEFF, 0xFEFF), (0xFF00, 0xFF0F))}]+")
_IDEOGRAPHS = re.compile(f"([{_between((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF))}])")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FINISH = np.uint64(0xC2B2AE3D27D4EB4F)
#: Entries of a worker's cache before it starts afresh; a cache never changes a result.
CACHE_ENTRIES = 300_000


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of the whole text as UTF-8: runs of letters and digits; an ideograph is a word.

    Null and empty texts, and those of punctuation only, have none.
    """
    if not text:
        return []
    if not text.isascii():
        text = _IDEOGRAPHS.sub(r" \1 ", _MARKS.sub(" ", text.lower()))
    return text.encode("utf-8", "replace").translate(_SPACE).split()


class WordHashes(dict):
    """Word to 64-bit hash, remembered within a worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word runs, in order; fewer than n words make one shingle, none make none."""
    if not hashes.size:
        return hashes
    n = min(n, hashes.size)
    m = hashes.size - n + 1
    out = hashes[:m].copy()
    for i in range(1, n):
        out ^= out >> np.uint64(29)
        out *= _MULTIPLIER
        out += hashes[i : i + m]
    out ^= out >> np.uint64(32)
    out *= _FINISH
    out ^= out >> np.uint64(29)
    return out


def texts_of(column) -> Iterable[str | None]:
    """Texts of an Arrow column, a slice at a time, so that few are Python objects at once."""
    for start in range(0, len(column), 256):
        yield from column.slice(start, 256).to_pylist()


def type_of(df, column: str) -> str:
    """The type of a column, as DDL."""
    return df.schema[column].dataType.simpleString()
