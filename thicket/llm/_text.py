"""Array kernels over Arrow text columns: words, hashes and shingle sets without a Python loop over words.

Words are runs of bytes other than space and 0x09-0x0D. Those bytes never occur inside a longer UTF-8 code point, so the
kernels work on bytes. Long texts are taken in slices that end at white space, so temporaries stay at some SLICE bytes
times 40, whatever the length of a text (a single word longer than that is held whole)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_ODD = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 2**64)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and the bytes of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offs, (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    out = []
    for base in (_P, _PINV):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _slices(offs: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first text, texts, cuts): cuts are offsets of whole texts, or of a part of one text that ends at white space."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + SLICE, "right")) - 1
        if j > i:
            yield i, j - i, offs[i : j + 1]
            i = j
            continue
        at, end = int(offs[i]), int(offs[i + 1])
        while at < end:
            to = min(at + SLICE, end)
            while to < end:
                gap = np.flatnonzero(SPACE[data[max(at, to - SLICE) : to]])
                if len(gap):
                    to = max(at, to - SLICE) + int(gap[-1]) + 1
                    break
                to = min(to + SLICE, end)
            yield i, 1, np.array([at, to])
            at = to
        i += 1


def word_hashes(offs: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, texts, hash of each word in order, number of the word's text) of each slice, lower-cased A-Z.

    A text in parts comes as several slices with the same first text."""
    for first, n, cuts in _slices(offs, data):
        b = LOWER[data[cuts[0] : cuts[-1]]]
        word = ~SPACE[b]
        starts = word.copy()
        starts[1:] &= ~word[:-1]
        edges = cuts[1:-1] - cuts[0]
        edges = edges[edges < len(b)]
        starts[edges] = word[edges]
        begin = np.flatnonzero(starts)
        if not len(begin):
            yield first, n, np.zeros(0, np.uint64), np.zeros(0, np.int64)
            continue
        stop = ~word
        stop[edges] = True
        gaps = np.append(np.flatnonzero(stop), len(b))
        end = gaps[np.searchsorted(gaps, begin, "right")]
        power, inverse = _powers(max(21, len(b).bit_length()))
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * power[: len(b)], out=sums[1:])
        h = mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
        yield first, n, h, np.searchsorted(cuts - cuts[0], begin, "right") - 1


def words_by_text(offs: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(text, hashes of its words in order), for every text, also those without words."""
    held, at = [], -1
    for first, n, h, of in word_hashes(offs, data):
        if held and at != first:
            yield at, np.concatenate(held)
            held = []
        if n == 1:
            held.append(h)
            at = first
            continue
        bounds = np.searchsorted(of, np.arange(n + 1))
        for k in range(n):
            yield first + k, h[bounds[k] : bounds[k + 1]]
    if held:
        yield at, np.concatenate(held)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of `size` words; of the whole sequence if it has fewer; none without words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(size, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h += words[k : len(words) - n + 1 + k] * _ODD[k]
    h = np.sort(mix(h + np.uint64(n)))
    return h[np.append(True, h[1:] != h[:-1])]


def by_bytes(batches, most: int = 8 << 20):
    """The batches, cut into runs of rows of some `most` bytes at most (one row at least)."""
    for batch in batches:
        per = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, most // per)
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
