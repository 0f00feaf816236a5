"""Vectorised words, lines and hashes over the bytes of an Arrow string column.

A word is a run of bytes other than space and the five ASCII controls 0x09-0x0D, so words are found
on the UTF-8 bytes themselves. Everything works on bounded pieces of a batch (``pieces``), so memory
stays in proportion to ``PIECE_BYTES`` and to the longest single text, not to the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19
U64 = np.uint64
_STEP = U64(0xD6E8FEB86659FD93)

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offs = offs.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, bytes, offsets)`` of runs of whole texts of about ``limit`` bytes each."""
    data, offs = buffers(column)
    first, n = 0, len(offs) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        yield first, last, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is."""
    return _LOWER[data]


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    """Word index at which each text begins, and one more for the end."""


def _doc_marks(size: int, offs: np.ndarray) -> np.ndarray:
    marks = np.zeros(size + 1, dtype=bool)
    marks[offs] = True
    return marks


def find_words(data: np.ndarray, offs: np.ndarray) -> Words:
    inside = ~_SEPARATOR[data]
    marks = _doc_marks(len(data), offs)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | marks[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | marks[1:-1]
    starts = np.flatnonzero(begin)
    return Words(starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs))


def find_lines(data: np.ndarray, offs: np.ndarray) -> Words:
    """Pieces between line feeds; a text without any is one line."""
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offs[:-1], feeds + 1]), kind="stable")
    ends = np.sort(np.concatenate([offs[1:], feeds]), kind="stable")
    counts = 1 + np.diff(np.searchsorted(feeds, offs))
    return Words(starts, ends, np.concatenate([[0], np.cumsum(counts)]))


def slice_lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every slice as 8-byte numbers, the last one filled up with zeros; and the first number of each slice."""
    size = (ends - starts).astype(np.int64)
    cuts = np.concatenate([[0], np.cumsum((size + 7) >> 3)])
    place = 8 * (np.arange(cuts[-1]) - np.repeat(cuts[:-1], np.diff(cuts)))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left = np.repeat(size, np.diff(cuts)) - place
    lanes = eight[np.repeat(starts, np.diff(cuts)) + place]
    short = np.flatnonzero(left < 8)
    lanes[short] &= (U64(1) << (8 * left[short]).astype(U64)) - U64(1)
    return lanes, cuts


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte slice: each 8-byte number is mixed, alone and then with its place, before they add up."""
    lanes, cuts = slice_lanes(data, starts, ends)
    place = (np.arange(len(lanes)) - np.repeat(cuts[:-1], np.diff(cuts))).astype(U64)
    total = np.zeros(len(lanes) + 1, U64)
    np.cumsum(mix(mix(lanes) + place * _STEP), out=total[1:])
    return mix(total[cuts[1:]] - total[cuts[:-1]] + (ends - starts).astype(U64) * _STEP)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words (``len(words) - k + 1`` of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    h = np.full(n, k, U64)
    for j in range(k):
        h = (h + words[j : j + n]) * _STEP
    return mix(h)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; a shorter text is one shingle."""
    data = lower(data)
    found = find_words(data, offs)
    hashes = slice_hashes(data, found.starts, found.ends)
    runs = window_hashes(hashes, k)
    out = []
    for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        else:
            out.append(window_hashes(hashes[a:b], b - a) if b > a else np.empty(0, U64))
    return out
