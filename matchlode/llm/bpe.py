"""Byte-level BPE with two tiers: whole pre-tokens through a minimal perfect hash, the rest through a heap.

The hash is built level by level: keys that share a slot of a level's bitmap go to the next level,
and a key's index is the rank of its bit; the stored key tells members from strangers. A pre-token
that is not in the vocabulary is merged over a doubly linked list of its bytes, the pair of lowest
rank and then of lowest place first, from a heap whose stale entries are skipped.

Defined results: null and empty texts have no ids and decode to no bytes; other columns are ignored;
a row is encoded as often as it occurs. Ids decode to exactly the bytes of the text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import pieces

#: Pre-tokens remembered by a worker, in each of two generations.
REMEMBERED = 300_000


class PerfectHash:
    """Byte strings to 0 .. n - 1, one to one; strangers to None."""

    def __init__(self, keys: list[bytes], gamma: float = 2.0):
        left, self.levels, placed = list(keys), [], 0
        self.keys: list[bytes] = []
        while left:
            size = max(64, int(gamma * len(left)))
            slot = np.array([self._slot(k, len(self.levels), size) for k in left], np.int64)
            used = np.bincount(slot, minlength=size)
            alone = used == 1
            rank = np.cumsum(alone) - alone + placed
            own = alone[slot]
            order = np.argsort(slot[own], kind="stable")
            kept = [k for k, o in zip(left, own) if o]
            self.keys += [kept[i] for i in order]
            bits = np.packbits(alone, bitorder="little")
            marks = rank[::8].astype(np.uint32)
            self.levels.append((size, bits.tobytes(), marks))
            placed += int(alone.sum())
            left = [k for k, o in zip(left, own) if not o]

    @staticmethod
    def _slot(key: bytes, level: int, size: int) -> int:
        return xxhash.xxh3_64_intdigest(key, level) % size

    def find(self, key: bytes) -> int | None:
        for level, (size, bits, marks) in enumerate(self.levels):
            slot = self._slot(key, level, size)
            byte = bits[slot >> 3]
            if byte >> (slot & 7) & 1:
                at = int(marks[slot >> 3]) + (byte & ((1 << (slot & 7)) - 1)).bit_count()
                return at if self.keys[at] == key else None
        return None


class Tokenizer:
    """Encodes as a reference implementation of ranked byte-pair merges would, without special tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).findall
        self.whole = PerfectHash(list(ranks))
        self.rank_at = [ranks[k] for k in self.whole.keys]
        self.byte = [ranks[bytes([i])] for i in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a, b] = rank
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        byte, get = self.byte, self.pairs.get
        ids = [byte[b] for b in piece]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        want = list(map(get, zip(ids, ids[1:])))  # rank of the pair that starts at a place
        want.append(None)
        heap = [r << 32 | i for i, r in enumerate(want) if r is not None]
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            entry = pop(heap)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            if want[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], want[j], want[i] = rank, -1, None, None
            if k < n:
                before[k] = i
                r = want[i] = get((rank, ids[k]))
                if r is not None:
                    push(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = want[h] = get((ids[h], rank))
                if r is not None:
                    push(heap, r << 32 | h)
        return [x for x in ids if x >= 0]

    def piece(self, token: str) -> bytes:
        """The ids of one pre-token as 32-bit numbers; kept for a while."""
        found = self.young.get(token) or self.old.get(token)
        if found is None:
            raw = token.encode()
            at = self.whole.find(raw)
            found = np.array([self.rank_at[at]] if at is not None else self.merge(raw), np.int32).tobytes()
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[token] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        tokens = self.split(text)
        out = list(map(self.young.get, tokens))
        if None in out:
            piece = self.piece
            out = [piece(t) if x is None else x for t, x in zip(tokens, out)]
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - n), n)
        return self.bytes[at].tobytes()


_kept: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    if (path, pattern) not in _kept:
        _kept[path, pattern] = Tokenizer(path, pattern)
    return _kept[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, *keep: str) -> DataFrame:
    """The columns `keep` of docs, ids (array of int) and decoded (binary, the bytes of the ids)."""
    fields = [docs.schema[c] for c in keep]
    names = [f"keep_{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in pieces(batches, rows=1000):
            ids = [own.encode(t or "") for t in batch.column("text").to_pylist()]
            decoded = pa.array([own.decode(x) for x in ids], pa.binary())
            offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), lists, decoded], names=[*names, "ids", "decoded"])

    schema = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields)), "ids array<int>", "decoded binary"])
    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), "ids", "decoded")
