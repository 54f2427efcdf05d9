"""Words of many texts at once, read from Arrow's UTF-8 buffers with numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Texts are worked on in shards of about so many bytes; a longer text is a shard of its own.
SHARD_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: digits, letters and all of characters beyond ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True


class Words(NamedTuple):
    hash: np.ndarray  # 64 bits of each lower-cased word
    doc: np.ndarray  # the text it stands in
    start: np.ndarray  # its bytes in `data`
    end: np.ndarray
    data: np.ndarray  # the shard's bytes
    bounds: np.ndarray  # where each text begins in them, and the end


def shards(texts: pa.Array, most: int = SHARD_BYTES):
    """(first row, data, bounds) of runs of rows; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray = IS_WORD) -> Words:
    """The maximal runs of word bytes, never across two texts, with a hash of the lower-cased bytes."""
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = bounds[1:-1]
    cuts = cuts[cuts < len(data)]
    begins[cuts] = inside[cuts]
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    end = np.flatnonzero(ends) + 1
    doc = np.searchsorted(bounds, start, side="right") - 1
    return Words(hashes(data, start, end), doc, start, end, data, bounds)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each stretch of lower-cased bytes, mixed with its length."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    own = np.repeat(np.arange(len(start)), size)
    at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    powers = np.full(int(size.max()), _BASE)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    terms = (_LOWER[data[start[own] + at]].astype(np.uint64) + np.uint64(1)) * powers[at]
    h = np.add.reduceat(terms, np.cumsum(size) - size)
    h ^= size.astype(np.uint64) * _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))
