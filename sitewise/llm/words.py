"""Words and hashes of whole Arrow text columns, computed without a loop over words.

A word is a run of bytes other than the space and tab to carriage return; A-Z counts as a-z.
Work is cut into pieces at separators, so that a very long text needs bounded memory.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Rows of a batch that are worked on at a time, and bytes of their text: what a task holds beside the batch itself.
SLICE_ROWS = 500
PIECE_BYTES = 1 << 20
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACES = mix(np.arange(256, dtype=np.uint64), 7) | np.uint64(1)


def _places(n: int) -> np.ndarray:
    global _PLACES
    if len(_PLACES) < n:
        _PLACES = mix(np.arange(2 * n, dtype=np.uint64), 7) | np.uint64(1)
    return _PLACES


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins (one more entry than texts). Null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the index of the first word of each text (one more entry than texts)."""
    raw, at = text_bytes(column)
    hashes, owners = [], []
    lo = 0
    while lo < len(raw):
        hi = min(len(raw), lo + PIECE_BYTES)
        if hi < len(raw):
            text = at[np.searchsorted(at, hi, "right") - 1]
            if text > lo:
                hi = int(text)
            else:
                gaps = np.flatnonzero(_SEPARATOR[raw[lo:hi]])
                if len(gaps):
                    hi = lo + int(gaps[-1]) + 1
                else:  # one word longer than a piece
                    end = int(at[np.searchsorted(at, lo, "right")])
                    gaps = np.flatnonzero(_SEPARATOR[raw[hi:end]])
                    hi = hi + int(gaps[0]) + 1 if len(gaps) else end
        part = raw[lo:hi]
        inside = ~_SEPARATOR[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = at[(at > lo) & (at < hi)] - lo
        begins[cuts] = inside[cuts]
        kept = np.flatnonzero(inside)
        if len(kept):
            start = np.flatnonzero(begins[kept])
            lengths = np.diff(np.append(start, len(kept)))
            place = np.arange(len(kept)) - np.repeat(start, lengths)
            value = (_LOWER[part[kept]].astype(np.uint64) + np.uint64(1)) * _places(int(lengths.max()))[place]
            hashes.append(mix(np.add.reduceat(value, start)))
            owners.append(np.searchsorted(at, kept[start] + lo, "right") - 1)
        lo = hi
    n = len(at) - 1
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    owner = np.concatenate(owners)
    return np.concatenate(hashes), np.searchsorted(owner, np.arange(n + 1), "left")


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words of one text; of the whole text if it is shorter."""
    n = len(words)
    if n == 0:
        return words
    wide = min(n, width)
    total = np.zeros(n - wide + 1, np.uint64)
    for j in range(wide):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[j:n - wide + 1 + j]
    return mix(total, wide)


def slices(batches):
    """Arrow batches cut into smaller ones, which share their memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def lists(parts: list[np.ndarray | None]) -> pa.Array:
    """One Arrow list of longs per part; null for None."""
    filled = [np.zeros(0, np.int64) if p is None else p for p in parts]
    ends = np.cumsum([0, *map(len, filled)]).astype(np.int32)
    flat = np.concatenate(filled) if filled else np.zeros(0, np.int64)
    missing = pa.array([p is None for p in parts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()), mask=missing)
