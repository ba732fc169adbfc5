"""Word conventions shared by the text operators.

A word is a maximal run of characters other than space and U+0009..U+000D, so words are separated by ASCII blanks only.
``bytes.split()`` follows the same rule, and so do the SQL expressions below.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"

#: Odd multiplier of the rolling combination of word hashes.
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: Column) -> Column:
    """Array of the words of a text; a null or blank text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK))


def count_words(text: Column) -> Column:
    """Number of words as a long, by leaving one mark for each word."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), BLANK, "")).cast("long")


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to ``limit`` entries; forgetting costs time only."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, parts: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, parts), np.uint64, len(parts))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that their order is unrelated to their origin (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words; empty where there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _STEP + hashes[k : k + n]
    return mix(out + np.uint64(width))
