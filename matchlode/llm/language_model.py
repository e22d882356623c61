"""Language-model scoring from an Elias-Fano n-gram trie.

Level 1 holds the words: 128-bit hashes of their bytes, the upper 64 bits in Elias-Fano form, whose
ranks are word ids, with exact counts and quantised probabilities. Level 2 holds each word's
successors, level 3 those of each pair of words that has any: monotone pointers to the ranges of all
contexts, and successor ids made monotone by their context's offset, both in Elias-Fano form, with
quantised probabilities and back-off weights. A successor is searched in its context's range only.

Levels 2 and 3 are cut into cells, by range of first words and slice of second words, so that the
successors of a frequent word lie in many cells and a cell has a bounded number of tokens, whatever
the size of the corpus. Cells are written to the shared folder by the tasks that count them, and
memory-mapped by scorers when asked for, so that no task and not the driver ever holds the corpus's
counts.

P3(w | u v) = (c(u v w) - D3) / c(u v) + b(u v) * P2(w | v), P2(w | v) = (c(v w) - D2) / c(v) +
b(v) * P1(w), P1(w) = (c(w) + a) / (N + a (V + 1)), where b is what the stored successors of a
context leave over and D = n1 / (n1 + 2 n2) of all n-grams of an order. Sequences of three words
below `least` occurrences are counted but not stored (1: store all); their mass is part of b. An
end token closes each text and is the context of its first word. Scores do not depend on how rows,
cells or partitions are cut.

Defined results: null texts are empty and have the end token alone; rows with null doc_id are scored
and not learned from; repeated rows count as often as they occur; without any row to learn from all
words are unknown. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .elias_fano import EliasFano, Shelf, remove_folder, write_arrays
from .language_id import held_out
from .packed import by_bucket, dealt, pack, runs, schema, unpack
from .scan import Block, blocks
from .shared import freeing, new_folder

#: Words that a task holds before it sends them.
HELD = 1 << 20
#: Bytes of text that are counted or scored together.
AT_ONCE = 8 << 20
#: Bytes that Spark hands to a worker at once while the trie is built; the JVM and the worker hold copies.
BATCH_BYTES = 16 << 20
#: Tokens of a cell, on average.
CELL_TOKENS = 1 << 21
#: The fewest occurrences of a stored sequence of three words.
LEAST = 2
U8, I8 = np.uint64, np.int64
END = U8(0xE7D0_0D0E_57A9_1C3B), U8(0x5A1F_93C6_0B7D_2E48)
ADDED = 0.1
#: Of quantised log10-probabilities.
GRAIN = 4096
DECODED = 10.0 ** (np.arange(1 << 16) / -GRAIN)


def encoded(p: np.ndarray) -> np.ndarray:
    return np.round(-GRAIN * np.log10(p)).clip(0, 65535).astype(np.uint16)


def narrow(n: np.ndarray) -> np.ndarray:
    """Counts in the least type that holds them."""
    return n.astype(np.min_scalar_type(int(n.max()) if len(n) else 0))


def stream(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both lanes of the hashes of a block's tokens, row after row, and each row's first token."""
    rows = len(b.first) - 1
    at = np.arange(len(b.start)) + b.rows()
    out = []
    for lane, end in zip(b.hashes(lower=True, lanes=2), END):
        x = np.full(len(b.start) + rows, end, U8)
        x[at] = lane
        out.append(x)
    return out[0], out[1], b.first + np.arange(rows + 1)


def ordered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order by a, then b."""
    order = np.argsort(a)
    x, y = a[order], b[order]
    return np.lexsort((b, a)) if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any() else order


def _summed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = ordered(a, b)
    a, b, n = a[order], b[order], n[order]
    at = runs(a, b)
    return a[at], b[at], np.add.reduceat(n, at) if len(at) else n


def vocabulary(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words in the order of their ids, and the place of each token's word among them."""
    order = ordered(a, b)
    x, y = a[order], b[order]
    at = runs(x, y)
    own = np.empty(len(a), I8)
    own[order] = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(a)]))
    return x[at], y[at], own


def sorted_keys(key: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (below bound) in order, and where each was; in one sort if both fit 64 bits."""
    bits = max(1, (len(key) - 1).bit_length())
    if bound << bits > 1 << 64:
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = key.astype(U8) << U8(bits) | np.arange(len(key), dtype=U8)
    both.sort()
    return (both >> U8(bits)).astype(I8), (both & U8((1 << bits) - 1)).astype(I8)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U8(32)) * U8(shards) >> U8(32)).astype(np.int32)


def _start(shard: int, shards: int) -> int:
    """The least hash of a shard."""
    return -(-(shard << 32) // shards) << 32


def _count_words(shards: int):
    def send(held):
        a, b, n = _summed(*(np.concatenate(x) for x in zip(*held)))
        return pack(0, _shard(a, shards), [a.view(I8), b, n.astype(np.uint32)], 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for block in blocks(batch.column("text")):
                a, b, _ = stream(block)
                held.append(_summed(a, b, np.ones(len(a), I8)))
                total += len(held[-1][0])
                if total >= HELD:
                    yield from send(held)
                    held, total = [], 0
        if total:
            yield from send(held)

    return run


def _write_words(folder: str, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in by_bucket(batches, 3):
            a, b, n = unpack(rows[0], [I8, U8, np.uint32])
            a, b, n = _summed(a.view(U8), b, n.astype(I8))
            begin = _start(shard, shards)
            parts = EliasFano.build(a - U8(begin), _start(shard + 1, shards) - begin, "hash")
            write_arrays(folder, f"words-{shard}", parts | {"check": b, "count": narrow(n)})
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(a)], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=["shard", "words", "tokens"])

    return run


class Trie:
    """The levels in a folder; files are mapped when asked for.

    bases: the first word id of each shard of level 1; ranges x slices: the cells of levels 2 and 3.
    """

    def __init__(self, folder: str, bases: list[int], tokens: int, cell_tokens: int = CELL_TOKENS):
        self.folder, self.bases, self.shards, self.tokens = folder, bases, len(bases) - 1, tokens
        self.size = bases[-1]
        if self.size >= 1 << 31:
            raise ValueError("more words than keys of pairs can hold")
        cells = max(1, -(-tokens // cell_tokens))
        self.slices = isqrt(cells - 1) + 1
        self.ranges = -(-cells // self.slices)
        self.shelf = Shelf(folder)

    def words(self, shard: int) -> dict[str, np.ndarray] | None:
        return self.shelf.get(f"words-{shard}") if self.bases[shard + 1] > self.bases[shard] else None

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id (-1: unknown) and count of each word; words in order of their hashes."""
        ids, counts = np.full(len(a), -1, I8), np.zeros(len(a), I8)
        cuts = np.searchsorted(_shard(a, self.shards), np.arange(self.shards + 1))
        for s in range(self.shards):
            own = slice(cuts[s], cuts[s + 1])
            if cuts[s] < cuts[s + 1] and (arrays := self.words(s)):
                level, want = EliasFano(arrays, "hash"), b[own]
                value = a[own] - U8(_start(s, self.shards))
                found = level.find(value)
                todo = np.flatnonzero(found >= 0)
                todo = todo[arrays["check"][found[todo]] != want[todo]]
                while len(todo):  # words of equal upper halves lie side by side
                    found[todo] += 1
                    inside = todo[found[todo] < level.n]
                    same = level.get(found[inside]) == value[inside]
                    found[np.setdiff1d(todo, inside[same], assume_unique=True)] = -1
                    todo = inside[same]
                    todo = todo[arrays["check"][found[todo]] != want[todo]]
                hit = found >= 0
                ids[own][hit] = self.bases[s] + found[hit]
                counts[own][hit] = arrays["count"][found[hit]]
        return ids, counts

    def of_words(self, name: str, key: str, begin: int, stop: int, dtype) -> np.ndarray:
        """A column of level 1 for the words begin to stop - 1."""
        out = np.zeros(stop - begin, dtype)
        for s in range(np.searchsorted(self.bases, begin, "right") - 1, self.shards):
            lo, hi = max(begin, self.bases[s]), min(stop, self.bases[s + 1])
            if lo < hi:
                out[lo - begin : hi - begin] = self.shelf.get(f"{name}-{s}")[key][lo - self.bases[s] : hi - self.bases[s]]
            if self.bases[s + 1] >= stop:
                break
        return out

    def cell(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return (u * self.ranges // self.size * self.slices + v * self.slices // self.size).astype(np.int32)

    def range(self, i: int) -> tuple[int, int]:
        """The first words of a range."""
        return -(-i * self.size // self.ranges), -(-(i + 1) * self.size // self.ranges)


_open: dict[str, Trie] = {}


def _trie(*key) -> Trie:
    if key[0] not in _open:
        _open.clear()
        _open[key[0]] = Trie(*key)
    return _open[key[0]]


def _before(own: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token (the end token before a row's first), and the tokens that are not first."""
    last = np.roll(own, 1)
    last[first[:-1]] = own[first[1] - 1]
    inner = np.ones(len(own), bool)
    inner[first[:-1]] = False
    return last, np.flatnonzero(inner)


def _identified(trie: Trie, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and counts of a block's distinct words, the place among them of each token, and each row's first token."""
    a, b, first = stream(block)
    a, b, own = vocabulary(a, b)
    return *trie.find(a, b), own, first


def _sent(trie: Trie, kind: int, u: np.ndarray, v: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
    return pack(kind, trie.cell(u, v), [u * trie.size + v, *(x.astype(np.uint32) for x in more)], 3)


def _grams_of(trie: Trie, block: Block, order: int) -> Iterator[pa.RecordBatch]:
    """What is worked on is let go as soon as it is used, and no block's arrays outlive it: executors have little room beside the JVM."""
    ids, _, own, first = _identified(trie, block)
    many = len(ids)
    pair, inner = _before(own, first)
    pair *= many
    pair += own
    found = np.sort(pair)
    at = runs(found)
    n, found = np.diff(np.r_[at, len(found)]), found[at]
    if order > 2:
        three = pair[inner - 1]
        last = own[inner]
    del pair, own, inner, at
    yield from _sent(trie, 0, ids[found // many], ids[found % many], n)
    if order < 3:
        return
    if many**3 > 1 << 63:  # ranks are shorter than pairs
        three = np.searchsorted(found, three)
    else:
        del found
    three *= many
    three += last
    del last
    three.sort()
    at = runs(three)
    n, three = np.diff(np.r_[at, len(three)]), three[at]
    w, three = ids[three % many], three // many
    if many**3 > 1 << 63:
        three = found[three]
    yield from _sent(trie, 1, ids[three // many], ids[three % many], w, n)


def _count_grams(key: tuple, order: int):
    """Pairs (kind 0) and, for order 3, sequences of three words (kind 1) of each block, by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(*key)
        for batch in batches:
            for block in blocks(batch.column("text"), AT_ONCE):
                yield from _grams_of(trie, block, order)

    return run


def _totals(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = runs(keys)
    return keys[at], np.add.reduceat(n, at, dtype=I8) if len(at) else n.astype(I8)


def _write_cell(trie: Trie, cell: int, rows: dict[int, list[tuple]], least: int) -> list[int]:
    """Writes a cell and returns how many pairs and threes occur once and twice; rows are used up, other arrays go with it."""
    size = trie.size
    begin, stop = trie.range(cell // trie.slices)
    two, n2 = _totals(*unpack([r[:2] for r in rows.pop(0)], [I8, np.uint32]))
    sent = rows.pop(1, [])
    three, n3, at = np.empty(sum(len(n) for _, _, n in sent) // 4, I8), [], 0
    while sent:
        context, w, n = unpack([sent.pop()], [I8, np.uint32, np.uint32])
        three[at : at + len(n)] = np.searchsorted(two, context) * size + w
        n3.append(n)
        at += len(n)
    three, n3 = _totals(three, np.concatenate([np.zeros(0, np.uint32), *n3]))
    seen = [int((n == k).sum()) for n in (n2, n3) for k in (1, 2)]
    three, n3 = three[n3 >= least], n3[n3 >= least]
    two -= begin * size
    pointers = np.cumsum(np.r_[0, np.bincount(two // size, minlength=stop - begin)])
    context = three // size
    at = runs(context)
    parts = EliasFano.build(pointers, len(two) + 1, "pointer2") | EliasFano.build(two, (stop - begin) * size + 1, "successor2")
    parts |= EliasFano.build(context[at], len(two) + 1, "context3") | EliasFano.build(np.r_[at, len(three)], len(three) + 1, "pointer3")
    rank = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(three)]))
    parts |= EliasFano.build(rank * size + three % size, len(at) * size + 1, "successor3")
    write_arrays(trie.folder, f"grams-{cell}", parts)
    write_arrays(f"{trie.folder}/counts", str(cell), {"n2": narrow(n2), "n3": narrow(n3)})
    return seen


def _write_grams(key: tuple, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(*key)
        for cell, rows in by_bucket(batches, 3):
            seen = _write_cell(trie, cell, rows, least)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (cell, *seen)], names=["cell", "one2", "two2", "one3", "two3"])

    return run


def discount(ones: int, twos: int) -> float:
    return min(0.99, max(0.1, ones / (ones + 2 * twos) if ones else 0.5))


def _smooth(key: tuple, d2: float, d3: float):
    """Writes quantised probabilities: a row a cell, and -1 - shard for words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(*key)
        counts = Shelf(f"{trie.folder}/counts")
        for batch in batches:
            for cell in batch.column("id").to_pylist():
                if cell < 0:
                    if words := trie.words(-1 - cell):
                        write_arrays(trie.folder, f"codes-{-1 - cell}", {"code1": encoded((words["count"] + ADDED) / (trie.tokens + ADDED * (trie.size + 1)))})
                    continue
                begin, stop = trie.range(cell // trie.slices)
                total = trie.of_words("words", "count", begin, stop, I8)
                parts = {}
                if cell % trie.slices == 0:
                    kinds = np.zeros(stop - begin, I8)
                    for c in range(cell, cell + trie.slices):
                        if grams := trie.shelf.get(f"grams-{c}"):
                            kinds += np.diff(EliasFano(grams, "pointer2").get(np.arange(stop - begin + 1)).astype(I8))
                    write_arrays(trie.folder, f"back-{cell}", {"back2": encoded(np.maximum(kinds, 1) * d2 / np.maximum(total, 1))})
                if grams := trie.shelf.get(f"grams-{cell}"):
                    n2, n3 = (counts.get(str(cell))[k].astype(I8) for k in ("n2", "n3"))
                    per = np.diff(EliasFano(grams, "pointer2").get(np.arange(stop - begin + 1)).astype(I8))
                    parts["code2"] = encoded((n2 - d2) / np.repeat(total, per))
                    context, pointer = EliasFano(grams, "context3"), EliasFano(grams, "pointer3")
                    own = n2[context.get(np.arange(context.n)).astype(I8)]
                    at = pointer.get(np.arange(pointer.n)).astype(I8)
                    parts["code3"] = encoded((n3 - d3) / np.repeat(own, np.diff(at)))
                    left = own - np.add.reduceat(n3, at[:-1]) + d3 * np.diff(at) if len(own) else np.zeros(0)
                    parts["back3"] = encoded(left / np.maximum(own, 1))
                    write_arrays(trie.folder, f"levels-{cell}", parts)
            yield pa.RecordBatch.from_arrays([batch.column("id")], names=["id"])

    return run


def _runs_of(cells: np.ndarray, many: int) -> Iterator[tuple[int, slice]]:
    cuts = np.searchsorted(cells, np.arange(many + 1))
    return ((c, slice(cuts[c], cuts[c + 1])) for c in np.flatnonzero(np.diff(cuts)).tolist())


class Scorer:
    """P of each token of a block."""

    def __init__(self, trie: Trie, order: int):
        self.trie, self.order = trie, order
        self.unknown = ADDED / (trie.tokens + ADDED * (trie.size + 1))

    def level1(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P1 of the words with these ids (ascending, but for -1) and their back-off weight."""
        trie, one, back = self.trie, np.full(len(ids), self.unknown), np.ones(len(ids))
        known = np.flatnonzero(ids >= 0)
        own = ids[known]
        for s, here in _runs_of(np.searchsorted(trie.bases, own, "right") - 1, trie.shards):
            one[known[here]] = DECODED[trie.shelf.get(f"codes-{s}")["code1"][own[here] - trie.bases[s]]]
        for r, here in _runs_of(own * trie.ranges // trie.size, trie.ranges):
            back[known[here]] = DECODED[trie.shelf.get(f"back-{r * trie.slices}")["back2"][own[here] - trie.range(r)[0]]]
        return one, back

    def level2(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, place in it (-1: none) and stored probability of each distinct pair; pairs in order."""
        trie, cell = self.trie, self.trie.cell(u, v)
        place, direct = np.full(len(u), -1, I8), np.zeros(len(u))
        order = np.argsort(cell.astype(np.uint16) if trie.ranges * trie.slices <= 1 << 16 else cell, kind="stable")
        for c, here in _runs_of(cell[order], trie.ranges * trie.slices):
            if not (grams := trie.shelf.get(f"grams-{c}")):
                continue
            at = order[here]
            context, word = u[at] - trie.range(c // trie.slices)[0], v[at]
            first = runs(context)
            lo, hi = self._bounds(grams, "pointer2", context[first], np.diff(np.r_[first, len(at)]))
            found = EliasFano(grams, "successor2").find((context * trie.size + word).astype(U8), lo, hi)
            hit = found >= 0
            place[at] = found
            direct[at[hit]] = DECODED[trie.shelf.get(f"levels-{c}")["code2"][found[hit]]]
        return cell, place, direct

    def level3(self, cell: np.ndarray, place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stored probability of each word (-1: unknown) after the pair at a place, and the pair's back-off weight; in order of cell, place and word."""
        trie, direct, back = self.trie, np.zeros(len(cell)), np.ones(len(cell))
        for c, here in _runs_of(cell, trie.ranges * trie.slices):
            grams = trie.shelf.get(f"grams-{c}")
            first = runs(place[here])
            many = np.diff(np.r_[first, here.stop - here.start])
            rank = EliasFano(grams, "context3").find(place[here][first].astype(U8))
            has = rank >= 0
            if not has.any():
                continue
            codes = trie.shelf.get(f"levels-{c}")
            at = here.start + np.flatnonzero(np.repeat(has, many))
            back[at] = DECODED[np.repeat(codes["back3"][rank[has]], many[has])]
            lo, hi = self._bounds(grams, "pointer3", rank[has], many[has])
            known = word[at] >= 0
            at, lo, hi, own = at[known], lo[known], hi[known], np.repeat(rank[has], many[has])[known]
            found = EliasFano(grams, "successor3").find((own * trie.size + word[at]).astype(U8), lo, hi)
            hit = found >= 0
            direct[at[hit]] = DECODED[codes["code3"][found[hit]]]
        return direct, back

    @staticmethod
    def _bounds(grams: dict[str, np.ndarray], name: str, context: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pointer = EliasFano(grams, name)
        return np.repeat(pointer.get(context).astype(I8), many), np.repeat(pointer.get(context + 1).astype(I8), many)

    def probabilities(self, ids: np.ndarray, own: np.ndarray, first: np.ndarray) -> np.ndarray:
        """ids: of the distinct words, in order; own: the place in ids of each token; first: each row's first token."""
        many, total = len(ids), len(own)
        one, back = self.level1(ids)
        last, inner = _before(own, first)
        p = back[last] * one[own]
        asked = np.flatnonzero((ids[own] >= 0) & (ids[last] >= 0))
        key, where = sorted_keys(last[asked] * many + own[asked], many * many)
        del last
        at = runs(key)
        pair = np.full(total, -1, I8)
        pair[asked[where]] = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(key)]))
        key = key[at]
        del where, at
        cell, place, direct = self.level2(ids[key // many], ids[key % many])
        p[asked] += direct[pair[asked]]
        del key, asked, direct
        if self.order > 2:
            rank = np.empty(len(cell), I8)
            rank[np.lexsort((place, cell))] = np.arange(len(cell))
            asked = inner[pair[inner - 1] >= 0]
            asked = asked[place[pair[asked - 1]] >= 0]
            asked = asked[sorted_keys(rank[pair[asked - 1]] * many + own[asked], len(cell) * many)[1]]
            context = pair[asked - 1]
            del inner, pair, rank
            direct, back = self.level3(cell[context], place[context], ids[own[asked]])
            p[asked] = direct + back * p[asked]
        return p


def _scored(trie: Trie | None, key: tuple, order: int, block: Block) -> list[np.ndarray]:
    """n_tokens, n_known, base_score and score of a block's rows; its arrays go with it."""
    size, tokens = key[1][-1], key[2]
    if trie:
        ids, count, own, first = _identified(trie, block)
    else:  # all tokens are unknown
        first = stream(block)[2]
        count, own = np.zeros(1, I8), np.zeros(first[-1], I8)
    rows = first[:-1]
    known = np.add.reduceat((count > 0).astype(I8)[own], rows)
    base = np.log10((count + ADDED) / (tokens + ADDED * (size + 1)))[own]
    sums = np.add.reduceat(base, rows)
    if not trie:
        return [np.diff(first), known, sums, sums]
    del base, count
    p = Scorer(trie, order).probabilities(ids, own, first)
    return [np.diff(first), known, sums, np.add.reduceat(np.log10(p, out=p), rows)]


def _score(key: tuple, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(*key) if key[1][-1] else None
        for batch in batches:
            for block in blocks(batch.column("text"), AT_ONCE):
                same = [batch.column(c).slice(block.lo, block.hi - block.lo) for c in ("key", "held_out")]
                yield pa.RecordBatch.from_arrays([*same, *map(pa.array, _scored(trie, key, order, block))], names=["key", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _building(spark: SparkSession) -> Iterator[None]:
    """For the actions that write the trie: batches of bounded bytes, and shuffle files that go at once."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        with freeing(spark):
            yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def score_documents(docs: DataFrame, order: int = 3, least: int = LEAST, cell_tokens: int = CELL_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs.

    Learns from rows whose crc32(doc_id) modulo 10 is not 0. order: 2 or 3 words; least: the fewest
    occurrences of a stored sequence of three words, 1 for all; cell_tokens: tokens of a cell.
    """
    if order not in (2, 3) or least < 1 or cell_tokens < 1:
        raise ValueError("order must be 2 or 3, least and cell_tokens at least 1")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id"), 10, 0).alias("held_out"))
    learned = rows.filter("key IS NOT NULL AND NOT held_out").select("text")
    folder, parts = new_folder(spark, "trie"), max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = max(parts, 4 * rows.rdd.getNumPartitions())  # grows with the input's parts
    with _building(spark):
        sizes = dealt(learned.mapInArrow(_count_words(shards), schema(3)), shards).mapInArrow(_write_words(folder, shards), "shard int, words long, tokens long").collect()  # a row a shard
    per = {r.shard: r.words for r in sizes}
    bases = np.cumsum([0, *(per.get(s, 0) for s in range(shards))]).tolist()
    tokens = sum(r.tokens for r in sizes)
    key = (folder, bases, tokens, cell_tokens)
    if tokens:
        trie = Trie(*key)
        cells = trie.ranges * trie.slices
        written = dealt(learned.mapInArrow(_count_grams(key, order), schema(3)), max(parts, cells)).mapInArrow(_write_grams(key, least), "cell long, one2 long, two2 long, one3 long, two3 long")
        with _building(spark):
            seen = written.agg(*(F.sum(c).alias(c) for c in ("one2", "two2", "one3", "two3"))).collect()[0]
        work = spark.range(-shards, cells, 1, min(shards + cells, 4 * parts))
        work.mapInArrow(_smooth(key, discount(seen.one2, seen.two2), discount(seen.one3, seen.two3)), "id long").count()
        remove_folder(f"{folder}/counts")
    out = rows.mapInArrow(_score(key, order), "key long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("key").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
