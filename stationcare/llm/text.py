"""Vectorised helpers on UTF-8 bytes, shared by the text operators.

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z have become a-z: digits, a-z and every
byte above 127. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
SHINGLE_WORDS = 5

_rng = np.random.default_rng(20240527)
BYTE_VALUES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
WORD_WEIGHTS = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
BASE = int(_rng.integers(0, 2**63)) * 2 + 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_WORD_VALUES = BYTE_VALUES[_LOWER]


def powers(n: int, base: int = BASE) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(1 << 12)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column, and the offsets of its values (null: empty)."""
    wide = column.cast(pa.large_binary())
    if wide.null_count:
        wide = wide.fill_null(b"")
    _, at, data = wide.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[wide.offset:wide.offset + len(wide) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text",
           size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about ``size`` bytes of text, so that work arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(column))
        cuts = np.searchsorted(offsets, np.arange(size, offsets[-1] + size, size), side="left")
        cuts = np.unique(np.clip(np.concatenate([[0], cuts, [batch.num_rows]]), 0, batch.num_rows))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of every text, and the offsets of the texts in that list."""
    global _POWERS
    n = len(offsets) - 1
    inside = _IS_WORD[data]
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[:-1][np.diff(offsets) > 0]
    first[cut] = inside[cut]  # a word never crosses texts
    starts = np.flatnonzero(first)
    packed = data[inside]
    rank = np.cumsum(inside, dtype=np.int64)
    begin = rank[starts] - 1
    lengths = np.diff(np.append(begin, len(packed)))
    if lengths.max() > len(_POWERS):
        _POWERS = powers(1 << int(lengths.max()).bit_length())
    local = np.arange(len(packed), dtype=np.int64)
    local -= np.repeat(begin, lengths)
    values = _WORD_VALUES[packed]
    values *= _POWERS[local]
    hashes = mix(np.add.reduceat(values, begin))
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray,
                   words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every run of ``words`` words; a text of fewer words, but some, is one shingle."""
    hashes, at = word_hashes(data, offsets)
    counts = np.diff(at)
    total = len(hashes)
    ends = np.repeat(at[1:], counts)
    place = np.arange(total, dtype=np.int64)
    out = np.zeros(total, np.uint64)
    for j in range(min(words, total)):
        ahead = np.zeros(total, np.uint64)
        ahead[:total - j] = hashes[j:]
        ahead *= WORD_WEIGHTS[j]
        if j:
            ahead[place + j >= ends] = 0
        out += ahead
    kept = place < np.maximum(ends - (words - 1), np.repeat(at[:-1], counts) + 1)
    per_text = np.maximum(counts - (words - 1), np.minimum(counts, 1))
    return mix(out[kept]), np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)


class Permutations:
    """Multiply-add hash functions on 32-bit keys (universal: the upper half of a*x + b modulo 2**64)."""

    def __init__(self, count: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**64, count, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 2**64, count, dtype=np.uint64)
        self.count = count

    def signatures(self, shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Per text the smallest value of each function (texts x functions, 32 bits); all ones without shingles."""
        out = np.full((len(at) - 1, self.count), 0xFFFFFFFF, dtype=np.uint32)
        some = np.flatnonzero(np.diff(at) > 0)
        if len(some):
            keys = shingles >> np.uint64(32)
            begin = at[:-1][some]
            work = np.empty_like(keys)
            for k in range(self.count):
                np.multiply(keys, self.a[k], out=work)
                work += self.b[k]
                out[some, k] = np.minimum.reduceat(work, begin) >> np.uint64(32)
        return out
