"""Terms of texts: maximal runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. Shared by resampling, decontamination and ranked search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rectpart.llm import textops

#: What each byte of a text becomes: a letter or digit of a term in lower case, or 0 between terms. All bytes of characters beyond ASCII belong to terms.
FOLDED = np.zeros(256, np.uint8)
FOLDED[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
FOLDED[65:91] = range(97, 123)
#: The same for bytes.translate, with spaces in between.
_SPACED = bytes(int(x) or 32 for x in FOLDED)
#: For regular expressions, once A-Z are lower-cased.
TERM_CLASS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"


#: What a row counts in a block besides its text.
ROW_BYTES = 64


def split(text: str | None) -> list[bytes]:
    """A text's terms as UTF-8; none of null."""
    return (text or "").encode().translate(_SPACED).split()


def terms_of(column: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All terms of a slice of texts, one after another, and the number of terms before each text (length texts + 1)."""
    data, offsets = textops.buffers(column)
    folded = FOLDED[data]
    inside = np.zeros(len(data) + 2, bool)
    np.not_equal(folded, 0, out=inside[1:-1])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(folded[inside[1:-1]])])
    return words, np.searchsorted(starts, offsets)


def coded(words: pa.LargeBinaryArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The distinct terms, and each word's place among them."""
    found = words.dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False)


def unpacked(data: bytes, ends: bytes) -> pa.LargeBinaryArray:
    """Terms from their bytes and where each ends, as 4-byte numbers."""
    offsets = np.zeros(len(ends) // 4 + 1, np.int64)
    offsets[1:] = np.frombuffer(ends, "<u4")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def blocks(items: DataFrame, text_col: str, most: int) -> Iterator[DataFrame]:
    """The rows of a table of queries in blocks of about `most` bytes of text, dealt by a hash; a table that is smaller is one block, an empty one none."""
    total = items.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_BYTES).alias("n")).first().n
    if total is None:
        return
    n = max(1, -(-total // most))
    part = F.pmod(F.xxhash64(*items.columns), F.lit(n))
    for k in range(n):
        yield items.filter(part == k) if n > 1 else items
