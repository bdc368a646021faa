"""Vectorised word and shingle fingerprints of a batch of texts, for use inside tasks.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A word's fingerprint is a polynomial
hash of its bytes, taken for all words at once from one running sum; a shingle's mixes those of five words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
# Texts are worked on in slices of about this many bytes, one text at least, so memory does not follow the batch.
SLICE_BYTES = 1 << 20

_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WEIGHTS = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return values, space


_VALUES, _SPACE = _byte_tables()


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of consecutive runs of texts; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_prints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words in order, and the number of words before each text's start (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    edges = offsets[(offsets > 0) & (offsets < n)]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    starts[edges] = solid[edges]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    with np.errstate(over="ignore"):
        powers = np.full(n, _BASE)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        back = np.full(n, _INVERSE)
        back[0] = 1
        back = np.multiply.accumulate(back)
        terms = _VALUES[data] * powers
        sums = np.cumsum(terms)
        prints = mix((sums[ends] - sums[starts] + terms[starts]) * back[starts])
    return prints, np.searchsorted(starts, offsets)


def shingle_prints(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, fingerprint) of every shingle, repeats included; a shorter text is one shingle."""
    words, first = word_prints(data, offsets)
    counts = np.diff(first)
    with np.errstate(over="ignore"):
        n_out = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
        text = np.repeat(np.arange(len(counts)), n_out)
        at = np.arange(len(text)) - np.repeat(np.cumsum(n_out) - n_out, n_out) + first[text]
        last = first[text + 1] - 1
        out = np.zeros(len(text), np.uint64)
        for k in range(size):
            there = at + k <= last
            out += np.where(there, words[np.minimum(at + k, last)] * _WEIGHTS[k % len(_WEIGHTS)] + np.uint64(k), np.uint64(0))
        return text, mix(out)


def shingle_counts(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, fingerprint, count) of each text's different shingles, sorted."""
    text, prints = shingle_prints(data, offsets, size)
    order = np.lexsort((prints, text))
    text, prints = text[order], prints[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (prints[1:] != prints[:-1])
    at = np.flatnonzero(new)
    return text[at], prints[at], np.diff(np.append(at, len(text)))
