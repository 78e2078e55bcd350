"""Ascending lists of whole numbers as bytes: the gap to the number before, seven bits to a byte.

A list of n numbers below m takes about n bytes where gaps are under 128 and
two where they are under 16,384, so it depends on m / n, not on the eight bytes
of a number.  A number may come twice; its gap is then 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def distinct(numbers: np.ndarray) -> np.ndarray:
    """The distinct numbers, ascending; sorting is several times faster here than the hash table of ``np.unique``."""
    ordered = np.sort(numbers)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def pack(lists: pa.ListArray) -> pa.BinaryArray:
    """One byte string per list of ascending numbers, the first 0 at least; no nulls."""
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
    gaps = np.diff(values, prepend=0)
    first = starts[starts < ends]
    gaps[first] = values[first]
    sizes = np.ones(len(gaps), np.int64)
    for bits in range(7, 63, 7):
        sizes += gaps >= (1 << bits)
    after = np.cumsum(sizes)
    at = after - sizes
    out = np.empty(int(after[-1]) if len(after) else 0, np.uint8)
    for j in range(int(sizes.max(initial=0))):
        long = sizes > j
        more = np.where(sizes[long] > j + 1, 128, 0)
        out[at[long] + j] = ((gaps[long] >> (7 * j)) & 127) | more
    offsets = np.concatenate([[0], np.concatenate([[0], after])[ends]]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpack(lists: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the list and number, for every number of every list; a null is an empty list."""
    lists = lists.cast(pa.binary()).fill_null(b"")
    _, offsets, data = lists.buffers()
    offsets = np.frombuffer(offsets, np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
    raw = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    last = raw < 128
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    gaps = np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)
    before = np.concatenate([[0], np.cumsum(last)])[offsets]
    counts = np.diff(before)
    total = np.concatenate([[0], np.cumsum(gaps)])
    return np.repeat(np.arange(len(lists)), counts), total[1:] - np.repeat(total[before[:-1]], counts)
