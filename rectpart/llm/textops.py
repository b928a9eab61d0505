"""Small vectorised helpers on UTF-8 byte buffers, shared by the operators of this subpackage.

Everything here works on one bounded slice of a column at a time (see ``slices``), so memory
in a task doesn't depend on the size of a partition, only on the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: The only white space that separates words in this subpackage: space and \t \n \v \f \r.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
#: The same set, and all other characters, for regular expressions.
SPACE_CLASS, WORD_CLASS = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]"

_MULT = 0x9E3779B97F4A7C15
_TABLE = np.random.Generator(np.random.PCG64(20240131)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}
#: Powers that a process keeps: two tables of 32 MB at most. Longer texts get tables of their own, which go with them.
KEPT_POWERS = 1 << 22


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n (or more) powers of the hash multiplier, or of its inverse, mod 2^64; tables of up to KEPT_POWERS are kept by each process."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length()) if n <= KEPT_POWERS else n
        have = np.full(size, pow(_MULT, -1, 2**64) if inverse else _MULT, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= KEPT_POWERS:
            _powers[inverse] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """P with P[j] - P[i] = hash of data[i:j] times multiplier**i; see span_hash."""
    table = _TABLE[_LOWER] if lower else _TABLE
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data))[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span [start, end); equal bytes give equal hashes wherever they are."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), True)[start])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length + 1) of a string or binary array; null counts as empty. Without nulls, the bytes are the array's own and aren't copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count or column.type not in (pa.string(), pa.binary(), pa.large_string(), pa.large_binary()):
        column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    wide = column.type in (pa.large_string(), pa.large_binary())
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(off):
        off = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about `most` bytes each; a longer single row stays whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each row (length rows + 1)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SPACES[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def least_hashed(frame: DataFrame, key: str, n: int) -> list[Row]:
    """The n distinct rows with the smallest hashes of a key, and their hashes as `h`.

    Rows above a bound made from the count go before the sort, so that what comes to the driver doesn't grow with the number of tasks; should the bound leave too few, as where
    most rows repeat, all are sorted.
    """
    count = frame.count()
    hashed = frame.withColumn("h", F.shiftrightunsigned(F.xxhash64(key), 1))
    least = lambda x: x.distinct().orderBy("h", *frame.columns).limit(n).collect()
    if count > 4 * n:
        found = least(hashed.filter(F.col("h") < int((3 * n + 500) / count * 2**63)))
        if len(found) == n:
            return found
    return least(hashed)
