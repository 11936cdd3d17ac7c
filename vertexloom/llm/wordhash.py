"""Hashes of words and word runs of whole texts, by vector operations over bytes.

Words are what blanks (\x20, \x09-\x0D) part. A word's hash is a polynomial over its bytes, taken from prefix sums; a run's is
one over its words' hashes. Equal words and runs have equal hashes wherever they stand. Texts are read in blocks of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes, words, and documents' bytes that are worked on at once.
BYTES = 1 << 18
WORDS = 1 << 17
GROUP = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_RANDOM = np.random.default_rng(31).integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        while len(out) < max(BYTES, WORDS + 1024):
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def prefixes(values: np.ndarray) -> np.ndarray:
    """Prefix hashes mod 2**64, one more than values."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * _UP[: len(values)], dtype=np.uint64)])


def between(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values from start to end, wherever they stand."""
    with np.errstate(over="ignore"):
        code = (p[end] - p[start]) * _DOWN[start]
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        code ^= code >> np.uint64(32)
    return code


def word_hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its first byte) of UTF-8 bytes; no word goes over a break."""
    hashes, places, at = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], 0
    while at < len(data):
        block = data[at : at + BYTES]
        inside = breaks[np.searchsorted(breaks, at, side="right") : np.searchsorted(breaks, at + len(block))] - at
        blank = _BLANK[block]
        if at + len(block) < len(data) and not blank[-1] and at + len(block) not in breaks[np.searchsorted(breaks, at + len(block)) :][:1]:
            gaps = np.flatnonzero(blank[-4096:])
            gap = len(block) - len(blank[-4096:]) + gaps[-1] + 1 if len(gaps) else np.flatnonzero(blank).max(initial=-1) + 1
            cut = max(int(gap), int(inside.max(initial=0)))
            if not cut:  # a word of BYTES bytes or more
                end = at + BYTES
                later = breaks[np.searchsorted(breaks, end) :][:1]
                stop = int(later[0]) if len(later) else len(data)
                while end < stop and not _BLANK[data[end]]:
                    found = np.flatnonzero(_BLANK[data[end : min(stop, end + BYTES)]])
                    end = end + int(found[0]) if len(found) else min(stop, end + BYTES)
                hashes.append(np.array([xxhash.xxh64_intdigest(data[at:end].tobytes())], dtype=np.uint64))
                places.append(np.array([at]))
                at = end
                continue
            block, blank, inside = block[:cut], blank[:cut], inside[inside < cut]
        first = ~blank
        last = first.copy()
        first[1:] &= blank[:-1]
        last[:-1] &= blank[1:]
        if len(inside):
            first[inside] = ~blank[inside]
            last[inside - 1] = ~blank[inside - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(start) == 1 and end[0] - start[0] >= BYTES:
            hashes.append(np.array([xxhash.xxh64_intdigest(block[start[0] : end[0]].tobytes())], dtype=np.uint64))
        else:
            hashes.append(between(prefixes(_RANDOM[block]), start, end))
        places.append(start + at)
        at += len(block)
    return np.concatenate(hashes), np.concatenate(places)


def grouped(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, words before each row and after the last) of some rows at a time; ``lower``: A-Z as a-z."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP, side="right")) - 1)
        breaks = offsets[at:to] - offsets[at]
        some = data[offsets[at] : offsets[to]]
        hashes, places = word_hashes(_LOWER[some] if lower else some, breaks[1:])
        yield at, hashes, np.append(np.searchsorted(places, breaks), len(hashes))
        at = to
