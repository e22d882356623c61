"""Elias-Fano sequences in numpy: compact monotone numbers, queried in bulk, mapped from files."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyarrow import fs as arrow_fs

U8 = np.uint64
_STEPS = [(s, U8(s), U8((1 << s) - 1)) for s in (32, 16, 8, 4, 2, 1)]
_HINT = 6


def _select_in(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of one-bit number r (from 0) of each word."""
    place = np.zeros(len(word), np.int64)
    for s, shift, mask in _STEPS:
        below = np.bitwise_count(word & mask).astype(np.int64)
        up = r >= below
        r = r - below * up
        word = np.where(up, word >> shift, word)
        place += s * up
    return place


class EliasFano:
    """A non-decreasing sequence of numbers below `universe`: low bits packed, high bits in unary."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.low_bits, self.universe = (int(x) for x in arrays[f"{name}.head"])
        self.low, self.high = arrays[f"{name}.low"], arrays[f"{name}.high"]
        self.ones, self.hint0, self.hint1 = arrays[f"{name}.ones"], arrays[f"{name}.hint0"], arrays[f"{name}.hint1"]

    @staticmethod
    def build(values: np.ndarray, universe: int, name: str) -> dict[str, np.ndarray]:
        n, values = len(values), values.astype(U8)
        width = max(0, (universe // max(1, n)).bit_length() - 1)
        high = (values >> U8(width)).astype(np.int64)
        top = (universe >> width) + 1
        bits = np.zeros(-(-(n + top + 1) // 64) * 64, bool)
        bits[high + np.arange(n)] = True
        words = np.packbits(bits, bitorder="little").view(U8)
        low = np.zeros(n * width // 64 + 2, U8)
        if n and width:
            part = values & U8((1 << width) - 1)
            at = np.arange(n, dtype=np.int64) * width
            word, shift = at >> 6, (at & 63).astype(U8)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low[word[first]] = np.bitwise_or.reduceat(part << shift, first)
            over = (at & 63) + width > 64
            low[word[over] + 1] |= part[over] >> (U8(64) - shift[over])  # one value at most runs into a word
        count = np.bitwise_count(words).astype(np.int64)
        ones = np.cumsum(count) - count
        zeros = np.arange(len(words)) * 64 - ones
        hints = [np.r_[np.searchsorted(b, np.arange(0, total + 1, 1 << _HINT), "right") - 1, len(words) - 1] for b, total in ((zeros, len(words) * 64 - n), (ones, n))]
        parts = {"head": np.array([n, width, universe], U8), "low": low, "high": words, "ones": ones.astype(np.uint32 if len(words) < 1 << 26 else U8)}
        parts |= {f"hint{i}": h.astype(np.uint32 if len(words) < 1 << 32 else U8) for i, h in enumerate(hints)}
        return {f"{name}.{k}": v for k, v in parts.items()}

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        hint = self.hint1 if one else self.hint0
        w, end = hint[k >> _HINT].astype(np.int64), hint[(k >> _HINT) + 1].astype(np.int64)

        def before(at):
            ones = self.ones[at].astype(np.int64)
            return ones if one else at * 64 - ones

        todo = np.flatnonzero(w < end)  # between two hints: the last word that begins at k or earlier
        while len(todo):
            lo, hi = w[todo], end[todo]
            mid = (lo + hi + 1) >> 1
            on = before(mid) <= k[todo]
            w[todo], end[todo] = np.where(on, mid, lo), np.where(on, hi, mid - 1)
            todo = todo[w[todo] < end[todo]]
        word = self.high[w]
        return w * 64 + _select_in(word if one else ~word, k - before(w))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U8)
        at = i * self.low_bits
        w, s = at >> 6, (at & 63).astype(U8)
        return ((self.low[w] >> s) | ((self.low[w + 1] << U8(1)) << (U8(63) - s))) & U8((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, True) - i).astype(U8) << U8(self.low_bits)) | self._low(i)

    def find(self, value: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """The place of each value among places lo to hi - 1 (all by default), or -1."""
        out = np.full(len(value), -1, np.int64)
        ask = np.flatnonzero(value < U8(self.universe)) if self.n else np.zeros(0, np.int64)
        if not len(ask):
            return out
        high = (value[ask] >> U8(self.low_bits)).astype(np.int64)
        want = value[ask] & U8((1 << self.low_bits) - 1)
        begin = np.zeros(len(ask), np.int64)
        up = high > 0
        begin[up] = self._select(high[up] - 1, False) + 1 - high[up]
        end = self._select(high, False) - high
        if lo is not None:
            begin, end = np.maximum(begin, lo[ask]), np.minimum(end, hi[ask])
        stop = end.copy()
        todo = np.flatnonzero(begin < end)
        while len(todo):
            mid = (begin[todo] + end[todo]) >> 1
            less = self._low(mid) < want[todo]
            begin[todo] = np.where(less, mid + 1, begin[todo])
            end[todo] = np.where(less, end[todo], mid)
            todo = todo[begin[todo] < end[todo]]
        at = np.flatnonzero(begin < stop)
        at = at[self._low(begin[at]) == want[at]]
        out[ask[at]] = begin[at]
        return out


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of aligned arrays after a JSON head; appears whole or not at all."""
    system, path = arrow_fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 64) * 64
    raw = json.dumps(head).encode()
    raw = raw.ljust(-(-(len(raw) + 8) // 64) * 64 - 8)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(len(raw).to_bytes(8, "little") + raw)
        for a in arrays.values():
            f.write(a.tobytes())
            f.write(bytes(-a.nbytes % 64))
    system.move(part, f"{path}/{name}")


def remove_folder(folder: str) -> None:
    system, path = arrow_fs.FileSystem.from_uri(folder)
    if system.get_file_info(path).type == arrow_fs.FileType.Directory:
        system.delete_dir(path)


def _arrays(data: np.ndarray) -> dict[str, np.ndarray]:
    size = int(data[:8].view(np.uint64)[0])
    return {k: data[8 + size + at : 8 + size + at + n * np.dtype(t).itemsize].view(t) for k, (t, n, at) in json.loads(bytes(data[8 : 8 + size])).items()}


class Shelf:
    """Arrays of the files in a folder, each memory-mapped when first asked for.

    Files of file systems that cannot be mapped are read whole, and those longest unused are let go
    so that at most `limit` bytes (and one file) are held.
    """

    def __init__(self, folder: str, limit: int = 1 << 29):
        self.system, self.path = arrow_fs.FileSystem.from_uri(folder)
        self.near, self.limit, self.held = isinstance(self.system, arrow_fs.LocalFileSystem), limit, 0
        self.open: dict[str, tuple[dict[str, np.ndarray] | None, int]] = {}

    def get(self, name: str) -> dict[str, np.ndarray] | None:
        """None: there is no such file."""
        if name in self.open:
            if not self.near:
                self.open[name] = self.open.pop(name)  # the latest used comes last
            return self.open[name][0]
        path = f"{self.path}/{name}"
        info = self.system.get_file_info(path)
        if info.type != arrow_fs.FileType.File:
            self.open[name] = None, 0
        elif self.near:
            self.open[name] = _arrays(np.memmap(path, np.uint8, "r").view(np.ndarray)), 0
        else:
            for old, (_, size) in list(self.open.items()):
                if self.held + info.size <= self.limit:
                    break
                if size:
                    del self.open[old]
                    self.held -= size
            with self.system.open_input_stream(path) as f:
                self.open[name] = _arrays(np.frombuffer(f.readall(), np.uint8)), info.size
            self.held += info.size
        return self.open[name][0]


def map_arrays(folder: str, name: str) -> dict[str, np.ndarray] | None:
    """Arrays of one file."""
    return Shelf(folder).get(name)
