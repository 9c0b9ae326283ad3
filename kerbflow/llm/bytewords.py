"""Words and word shingles of Arrow string columns as 64-bit hashes, by numpy.

Texts are taken in slices of about a megabyte, whole documents each, so that the
arrays beside a batch stay small however large the batch is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, np.ndarray] = {}


@dataclass(frozen=True)
class Slice:
    """Documents ``first`` to ``last - 1`` of a batch: their bytes and offsets."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Runs of whole documents of about ``limit`` bytes; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        cut = offsets[first : last + 1]
        yield Slice(first, last, data[cut[0] : cut[-1]], cut - cut[0])
        first = last


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 8 * SLICE_BYTES:  # tables for giant documents are not kept
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits over each other."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each segment, by one running polynomial sum."""
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=running[1:])
    h = (running[ends] - running[starts]) * _power(_INVERSE, len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def runs(s: Slice, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of marked bytes within a document, and their
    number by document."""
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    before[s.offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(inside) + 1, bool)
    after[:-1] = inside
    after[s.offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.diff(np.searchsorted(starts, s.offsets))


def word_bounds(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(s, ~_SPACE[s.data])


def word_hashes(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words by document."""
    starts, ends, counts = word_bounds(s)
    return segment_hashes(s.data, starts, ends), counts


def shingles(s: Slice, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document in ascending order, and their numbers.

    A document of fewer words has one shingle of all its words; one without words
    has none.
    """
    words, counts = word_hashes(s)
    ends = np.cumsum(counts)
    firsts = ends - counts
    take = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    docs = np.repeat(np.arange(len(counts)), take)
    at = np.arange(len(docs)) - np.repeat(np.cumsum(take) - take, take) + firsts[docs]
    h = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        part = padded[at + k] + np.uint64(k + 1)
        part = np.where(at + k < ends[docs], part, np.uint64(0))
        h = h * np.uint64(0x2545F4914F6CDD1D) + part
    h = mix(h)
    order = np.lexsort((h, docs))
    h, docs = h[order], docs[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (docs[1:] != docs[:-1])
    return h[new], np.bincount(docs[new], minlength=len(counts))
