"""SimHash near-duplicates through meet-in-the-middle balls.

Two fingerprints at most 3 bits apart meet in a word that is at most 1 bit from one and at most 2
bits from the other. Such a word links everything in its ball of radius 2 to any member of its ball
of radius 1, and nothing else: components come from stars around words, never from pairs, and a
word has a bounded number of members. Balls of radius 1 (65 words) are emitted for every distinct
fingerprint and find all links up to 2 bits. Links of 3 bits need the wider ball too; as two of three
bits always lie in the same 32-bit half, it is enough to flip pairs of bits within a half (992 words).
It is emitted only where such a link is still possible: two fingerprints 3 bits apart differ in at
most one bit (half the radius) of one half, so they meet in a variant of that half; components that
are alone in all variants of their halves cannot have one.

Defined results: no words (or null text) give fingerprint 0; one or two words are one shingle; rows
with null doc_id get a fingerprint and component but never name one (a component of only such rows
has a null id); equal rows share a component. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .packed import bucket_count, bucket_of, by_bucket, dealt, pack, part_count, runs, schema, unpack
from .scan import pieces
from .shared import cut

HELD = 1 << 21
SHINGLES_AT_ONCE = 1 << 18
I8, U8 = np.int64, np.uint64
_ONE = U8(1) << np.arange(64, dtype=U8)
RADIUS_1 = np.r_[U8(0), _ONE]
PAIRS = np.concatenate([_ONE[i] | _ONE[i + 1 : 32 * (i // 32) + 32] for i in range(64)])
RADIUS_2 = np.r_[RADIUS_1, PAIRS]
HALF_1 = np.r_[U8(0), _ONE[:32]]
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def shingles(text: bytes | None, words: int) -> list[bytes]:
    found = (text or b"").lower().split()  # bytes: only A-Z changes, only ASCII white space splits
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    return list(map(b" ".join, zip(*(found[i:] for i in range(words)))))


def fingerprint(hashes: list[np.ndarray]) -> np.ndarray:
    """One word for each array of hashes: bits that over half of them have."""
    out = np.zeros(len(hashes), U8)
    full = [i for i, h in enumerate(hashes) if len(h)]
    if full:
        n = np.array([len(hashes[i]) for i in full])
        bits = np.unpackbits(np.concatenate([hashes[i] for i in full]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int32)
        out[full] = np.packbits(count * 2 > n[:, None], axis=1, bitorder="little").view(U8)[:, 0]
    return out


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            held, n, done = [], 0, []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                s = shingles(text, words)
                held.append(np.array(list(map(_hash, s)), U8))
                n += len(s)
                if n >= SHINGLES_AT_ONCE:
                    done.append(fingerprint(held))
                    held, n = [], 0
            done.append(fingerprint(held))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(done).view(I8))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(words), "doc_id long, fp long")


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _balls(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Every word within 1 bit, and which bit it was."""
    step = HELD // len(RADIUS_1)
    for batch in batches:
        fp = _column(batch, "fp").view(U8)
        for lo in range(0, len(fp), step):
            v = (fp[lo : lo + step, None] ^ RADIUS_1).ravel()
            yield from pack(0, bucket_of(v, buckets), [v, np.tile(np.arange(len(RADIUS_1), dtype=np.uint8), len(v) // len(RADIUS_1))], 2)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(I8)), pa.array(b.view(I8))], names=["a", "b"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An edge from each member of a word's ball of radius 1 to the least member."""
    for _, rows in by_bucket(batches, 2):
        v, bit = unpack(rows[0], [U8, np.uint8])
        order = np.argsort(v, kind="stable")
        v, fp = v[order], v[order] ^ RADIUS_1[bit[order]]
        at = runs(v)
        n = np.diff(np.r_[at, len(v)])
        lead = np.repeat(np.minimum.reduceat(fp, at), n) if len(at) else fp
        linked = fp != lead
        if linked.any():
            pairs = np.unique(np.stack([fp[linked], lead[linked]], 1), axis=0)
            yield _edges(np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))


def _halves(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Variants of both halves with the components that have them, each once a task's block."""
    step = HELD // (2 * len(HALF_1))
    for batch in batches:
        fp, comp = _column(batch, "fp").view(U8), _column(batch, "comp").astype(I8)
        for lo in range(0, len(fp), step):
            part, own = fp[lo : lo + step, None], comp[lo : lo + step]
            low = (part & U8(0xFFFFFFFF)) ^ HALF_1
            high = (part >> U8(32)) ^ HALF_1
            key = np.concatenate([_half(low.ravel(), 0), _half(high.ravel(), 1)])
            own = np.tile(np.repeat(own, len(HALF_1)), 2)
            order = np.lexsort((own, key))
            once = order[runs(key[order], own[order])]
            yield from pack(0, bucket_of(key[once], buckets), [key[once], own[once].view(U8)], 2)


def _half(half: np.ndarray, side: int) -> np.ndarray:
    return half | U8(side) << U8(32)


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components that share a half's variant with another component."""
    for _, rows in by_bucket(batches, 2):
        key, comp = unpack(rows[0], [U8, U8])
        order = np.lexsort((comp, key))
        key, comp = key[order], comp[order]
        at = runs(key)
        if len(at):
            n = np.diff(np.r_[at, len(key)])
            last = comp[at + n - 1]
            found = np.unique(comp[np.repeat(comp[at] != last, n)])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(I8))], names=["comp"])


def _wide_balls(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    step = HELD // len(RADIUS_2)
    for batch in batches:
        fp = _column(batch, "fp").view(U8)
        for lo in range(0, len(fp), step):
            v = (fp[lo : lo + step, None] ^ RADIUS_2).ravel()
            yield from pack(0, bucket_of(v, buckets), [v, np.tile(np.arange(len(RADIUS_2), dtype=np.uint16), len(v) // len(RADIUS_2))], 2)


def _wide_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An edge from each member of a word's ball to one of those within 1 bit, if there is any."""
    for _, rows in by_bucket(batches, 2):
        v, flip = unpack(rows[0], [U8, np.uint16])
        order = np.argsort(v, kind="stable")
        v, flip = v[order], flip[order]
        same = v[1:] == v[:-1]
        keep = np.r_[same, False] | np.r_[False, same] if len(v) else np.zeros(0, bool)
        v, flip = v[keep], flip[keep].astype(I8)
        fp = v ^ RADIUS_2[flip]
        order = np.lexsort((fp, flip >= len(RADIUS_1), v))
        v, fp, close = v[order], fp[order], flip[order] < len(RADIUS_1)
        at = runs(v)
        n = np.diff(np.r_[at, len(v)])
        lead = np.repeat(fp[at], n)
        linked = (fp != lead) & np.repeat(close[at], n)
        if linked.any():
            pairs = np.unique(np.stack([fp[linked], lead[linked]], 1), axis=0)
            yield _edges(np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))


def fingerprint_components(nodes: DataFrame) -> DataFrame:
    """fp, comp (a fingerprint of the component) for distinct fingerprints fp, linked at 3 bits or fewer."""
    parts = part_count(nodes)
    buckets = bucket_count(parts)
    one = connected_components(dealt(nodes.mapInArrow(partial(_balls, buckets=buckets), schema(2)), parts).mapInArrow(_stars, "a long, b long"))
    first = cut(nodes.join(one, nodes.fp == one.node, "left").select("fp", F.coalesce("component", "fp").alias("comp")), "near2")
    mixed = dealt(first.mapInArrow(partial(_halves, buckets=buckets), schema(2)), parts).mapInArrow(_mixed, "comp long").distinct()
    open_ = first.join(mixed, "comp", "left_semi").select("fp", "comp")
    links = dealt(open_.select("fp").mapInArrow(partial(_wide_balls, buckets=buckets), schema(2)), parts).mapInArrow(_wide_stars, "a long, b long")
    for side in ("a", "b"):  # links of fingerprints are links of their components
        links = links.join(first.select(F.col("fp").alias(side), F.col("comp").alias(f"comp_{side}")), side)
    two = connected_components(links.filter("comp_a <> comp_b"), "comp_a", "comp_b")
    return first.join(two, first.comp == two.node, "left").select("fp", F.coalesce("component", "comp").alias("comp"))


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links lead to): one row per row of docs."""
    rows = cut(fingerprints(docs, words), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = cut(nodes.join(fingerprint_components(nodes.select("fp")), "fp"), "components")
    names = labels.groupBy("comp").agg(F.min("first").alias("component_id"))
    return rows.join(labels.join(names, "comp").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
