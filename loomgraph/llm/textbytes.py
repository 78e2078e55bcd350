"""Words of whole texts as numpy arrays over the UTF-8 bytes of an Arrow batch.

Tasks that need every word of every text (shingles, window search) work on the
byte buffer of the batch instead of on Python strings: a byte table says which
bytes belong to words, and words are hashed eight bytes at a time.  Texts are
taken in groups of ``GROUP_BYTES``, so memory does not follow the batch size;
a longer text forms a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def byte_table(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for every byte outside the (first, last) ranges."""
    table = np.ones(256, dtype=bool)
    for first, last in excluded:
        table[first : last + 1] = False
    return table


#: ``[^\x20\x09-\x0D]+``
SPACED = byte_table([(0x20, 0x20), (0x09, 0x0D)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text
ALNUM = byte_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def text_groups(column: pa.Array, max_bytes: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) of runs of rows; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets.astype(np.int64)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, with eight bytes of padding for wide reads."""
    out = np.zeros(len(data) + 8, dtype=np.uint8)
    np.take(_LOWER, data, out=out[: len(data)])
    return out


def words(low: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, and for each text the number of its first word (one entry more than texts)."""
    inside = table[low[: offsets[-1]]]
    before = np.empty(len(inside), dtype=bool)
    before[:1], before[1:] = False, inside[:-1]
    after = np.empty(len(inside), dtype=bool)
    after[-1:], after[:-1] = False, inside[1:]
    cuts = offsets[1:-1]
    before[cuts[cuts < len(inside)]] = False
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    wide = np.ndarray((len(low) - 7,), dtype="<u8", buffer=low, strides=(1,))
    length = ends - starts
    h = mix((wide[starts] & _BYTE_MASK[np.minimum(length, 8)]) ^ (length.astype(np.uint64) * _GOLD))
    left, k = np.flatnonzero(length > 8), 8
    while left.size:
        part = wide[starts[left] + k] & _BYTE_MASK[np.minimum(length[left] - k, 8)]
        h[left] = mix((h[left] * _STEP) ^ part)
        k += 8
        left = left[length[left] > k]
    return h


def hash_windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes (also those that cross a text's end)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:n].copy()
    for k in range(1, size):
        out = out * _STEP + h[k : k + n]
    return mix(out + np.uint64(size))
