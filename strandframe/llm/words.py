"""Portable words: ASCII letters lower-cased, every other ASCII character that is no digit a separator, the rest kept.

Equal to matches of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in the text with A-Z lower-cased, so that SQL
engines and byte strings agree on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Maps A-Z to a-z and ASCII characters other than letters and digits to a space.
WORD_TABLE = bytes((c + 32) if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


class HashCache(dict):
    """64-bit hashes of words; emptied when full, so that memory is bounded."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(tokens: list[bytes], cache: HashCache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of fewer words than k, one hash of them all; of none, nothing."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - k + 1, np.uint64(k), np.uint64)
        for j in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + mixed(hashes[j : n - k + 1 + j])
    return mixed(out)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the strings in one slice are at most max_bytes (a single longer row stands alone)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False), dtype=np.int64)
        start, base = 0, 0
        while start < n:
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])
