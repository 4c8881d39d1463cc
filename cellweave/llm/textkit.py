"""Vectorised text kernels over Arrow string batches.

Every kernel works on the UTF-8 bytes of a whole batch at once: delimiters are
ASCII, so a word over code points and a word over bytes have the same borders.
Fingerprints are 64-bit; operators that need certainty use two of them or
compare the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes handled at once, so that temporaries stay in cache and memory bounded.
CHUNK_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_MASK = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=8)
def _letters(seed: int) -> np.ndarray:
    return np.random.default_rng(977 + seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_powers_cache: dict[tuple[int, bool], np.ndarray] = {}


def powers(seed: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of a seed's base (or of its inverse) modulo 2**64."""
    got = _powers_cache.get((seed, inverse))
    if got is None or len(got) < n:
        size = max(n, 1 << 16)
        base = _BASES[seed] if not inverse else pow(_BASES[seed], -1, 1 << 64)
        got = np.empty(size, np.uint64)
        got[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            got[done : done + step] = got[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        if size <= 1 << 23:
            _powers_cache[(seed, inverse)] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def runs_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Order-sensitive fingerprint of values[start:end] for each pair."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(seed, n), out=total[1:])
    return mix((total[end] - total[start]) * powers(seed, n + 1, True)[start] + (end - start).astype(np.uint64))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch between texts into runs of about ``chunk`` bytes: (first, last, bytes, offsets)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + chunk, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def parts(data: np.ndarray, offsets: np.ndarray, chunk: int, step: int, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """``pieces`` that also cut a text longer than ``chunk``: (texts, bytes, offsets, own bytes of a cut text's part).

    A part of a cut text starts at a multiple of ``step`` and has up to
    ``overlap`` bytes of the next one behind its own.
    """
    chunk -= chunk % step
    for a, b, d, o in pieces(data, offsets, chunk):
        n = int(o[-1])
        if n <= chunk:
            yield np.arange(a, b), d, o, n
            continue
        for x in range(0, n, chunk):
            end = min(n, x + chunk + overlap)
            yield np.array([a]), d[x:end], np.array([0, end - x]), chunk


@dataclass
class Words:
    """Words of a run of texts, in order: byte borders, text number, fingerprints."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    #: Number of the first word of each text, and one more at the end.
    first: np.ndarray

    def hashes(self, seed: int = 0) -> np.ndarray:
        return runs_hash(_letters(seed)[self.data], self.start, self.end, seed)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split_words(data: np.ndarray, offsets: np.ndarray, delimiter: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are not delimiters, never across texts."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, none, np.zeros(len(offsets), np.int64))
    inside = ~delimiter[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    borders = offsets[(offsets > 0) & (offsets < n)]
    before[borders] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[borders - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, start, end, text, first)


def windows(words: Words, hashes: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """First word and fingerprint of each run of ``width`` words inside one text."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.text[: n - width + 1] == words.text[width - 1 :])
    return at, runs_hash(hashes, at, at + width, seed)


def short_texts(words: Words, hashes: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Number and fingerprint of each text of at least one but fewer than ``width`` words."""
    counts = words.counts()
    text = np.flatnonzero((counts > 0) & (counts < width))
    return text, runs_hash(hashes, words.first[text], words.first[text + 1], seed)


def covered(n: int, at: np.ndarray, width: int) -> np.ndarray:
    """Which of n items lie in any of the runs of ``width`` that start at ``at``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, at, 1) if len(at) < 64 else step.__iadd__(np.bincount(at, minlength=n + 1).astype(np.int32))
    np.subtract.at(step, at + width, 1) if len(at) < 64 else step.__isub__(np.bincount(at + width, minlength=n + 1).astype(np.int32))
    return np.cumsum(step[:-1]) > 0


def per_text_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
