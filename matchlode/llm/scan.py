"""Columnar word scanning: Arrow text columns to word offsets and 64-bit hashes, in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D. No white-space byte occurs inside a
multi-byte UTF-8 character, so bytes can be scanned. Blocks bound the memory whatever the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 2 << 20
WORD = np.ones(256, bool)
WORD[[0x20, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x >> np.uint64(30) ^ x
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd multipliers of the two lanes of a word's hash, and of the windows over them.
_LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_STEPS = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x8EBC6AF09C88C6E3))
_UPTO = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer ranges are hashed one by one.
LONG = 64


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on, as one number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lanes: int = 1) -> list[np.ndarray]:
    """64 bits a lane of data[start:end] for each pair; two lanes are a 128-bit identity.

    Eight bytes at a time are mixed into each lane, so that ranges of equal length up to eight bytes
    never collide in one; ranges above LONG bytes take XXH3's 128 bits.
    """
    size = end - start
    view = eights(data)
    cell = view[start] & _UPTO[np.minimum(size, 8)]
    length = size.astype(np.uint64)
    out = [mix((cell ^ length * k) * k) for k in _LANES[:lanes]]
    at = np.flatnonzero((size > 8) & (size <= LONG))
    begin, left = start[at] + 8, size[at] - 8
    while len(at):
        cell = view[begin] & _UPTO[np.minimum(left, 8)]
        for lane, k in zip(out, _LANES):
            lane[at] = mix((lane[at] ^ cell) * k)
        more = left > 8
        at, begin, left = at[more], begin[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        whole = xxhash.xxh3_128_intdigest(data[start[i] : end[i]])
        for j, lane in enumerate(out):
            lane[i] = np.uint64(whole >> 64 * j & _MASK)
    return out


@dataclass
class Block:
    """Some rows of a batch: their bytes, the words in them, and the rows' first words."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # rows + 1: index of each row's first word

    def hashes(self, lower: bool = False, lanes: int = 1) -> list[np.ndarray]:
        """Lanes of the words' hashes."""
        return range_hashes(LOWER[self.data] if lower else self.data, self.start, self.end, lanes)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row in the block of each word."""
        return np.repeat(np.arange(self.hi - self.lo), self.counts())


def grams(words: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hash of words[i:i+n] for each i; at the end there are n - 1 fewer than words.

    A polynomial in one lane's step, put together from windows of doubling width.
    """
    if len(words) < n:
        return np.zeros(0, np.uint64)
    power, done, have, width = words, None, 0, 1
    factor = int(_STEPS[lane])
    while True:
        if n & width:
            done = power if done is None else done[: len(power) - have] * np.uint64(factor) + power[have:]
            have += width
        if have == n:
            return mix(done[: len(words) - n + 1] + np.uint64(n))
        power = power[: len(power) - width] * np.uint64(factor) + power[width:]
        width, factor = 2 * width, factor * factor & _MASK


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data, offsets


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole rows with at most limit bytes, or one longer row."""
    if not len(column):
        return
    data, offsets = text_column(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        own = offsets[lo : hi + 1] - offsets[lo]
        piece = data[offsets[lo] : offsets[hi]]
        is_word = WORD[piece]
        begins, ends = is_word.copy(), np.zeros(len(piece) + 1, bool)
        if len(piece):
            begins[1:] &= ~is_word[:-1]
            ends[1:-1] = is_word[:-1] & ~is_word[1:]
            ends[-1] = is_word[-1]
            cut = own[(own > 0) & (own < len(piece))]
            begins[cut] |= is_word[cut]
            ends[cut] |= is_word[cut - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends)
        yield Block(lo, hi, piece, own, start, end, np.searchsorted(start, own))
        lo = hi


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of batches with at most `rows` rows and `limit` bytes of a string or binary column, or one longer row."""
    for batch in batches:
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends, lo = np.cumsum(size), 0
        while lo < batch.num_rows:
            fits = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right"))
            hi = min(max(lo + 1, fits), lo + rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i+width]) for each i, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x
