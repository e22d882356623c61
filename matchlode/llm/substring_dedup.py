"""Removal of repeated token spans through a compacted De Bruijn graph.

Every run of `width` words is an edge between two nodes, its first and last width - 1 words. Edges
have 96-bit identities (of two independent lanes) and are dealt out by their minimiser (the least hash of `seed` words in
them), so neighbouring edges of a document meet in one task; only minimisers that two documents hold
are followed. An edge's source is its occurrence in the smallest doc_id. Edges of a bucket that follow
each other in their source are a fragment; Spark joins then count how many fragments lead into and
out of each node, and fragments on both sides of a node that does not branch compact to one path.
Runs of a document along one path are joined to the words at their source coordinates, and removed
only if those words are the same.

Defined results: a null or empty text has no words; fewer words than `width` are kept; a row with
null doc_id is kept whole and is no source; rows of equal doc_id count as one document, whose
windows do not repeat each other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packed import bucket_count, bucket_of, by_bucket, dealt, pack, part_count, runs, schema, unpack
from .scan import Block, blocks, grams, pieces, sliding_min
from .shared import cut

#: Entries that a task holds before it sends them.
HELD = 1 << 20
I8, U8 = np.int64, np.uint64


def _windows(b: Block, width: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of each whole window of a row: both lanes of its hash, minimiser, row, place of its first word in the row."""
    words, more = b.hashes(lanes=2)
    edge, edge2 = grams(words, width), grams(more, width, 1)
    if not len(edge):
        return edge, edge2, edge, np.zeros(0, I8), np.zeros(0, I8)
    row = b.rows()[: len(edge)]
    at = np.arange(len(edge)) - b.first[row]
    least = sliding_min(grams(words, seed), width - seed + 1)[: len(edge)]
    whole = np.arange(len(edge)) + width <= b.first[row + 1]
    return edge[whole], edge2[whole], least[whole], row[whole], at[whole]


def _minimisers(width: int, seed: int, buckets: int):
    def send(held: list) -> Iterator[pa.RecordBatch]:
        h, doc = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        at = runs(h)
        lo, hi = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)
        first = at[by := np.argsort(lo, kind="stable")]
        yield from pack(0, bucket_of(h[first], buckets), [h[first], lo[by]], 2)
        both = np.repeat(lo < hi, np.diff(np.r_[at, len(h)]))
        yield from pack(1, bucket_of(doc[both], buckets), [h[both], doc[both]], 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(I8)
            for b in blocks(batch.column("text")):
                _, _, h, row, _ = _windows(b, width, seed)
                first = runs(row, h)
                held.append((h[first], ids[b.lo + row[first]]))
                n += len(first)
                if n >= HELD:
                    yield from send(held)
                    held, n = [], 0
        if n:
            yield from send(held)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h) for each minimiser h that another document holds too."""
    for _, rows in by_bucket(batches, 2):
        h, doc = unpack(rows.get(0, []), [U8, I8])
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        at = runs(h)
        many = np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at) if len(at) else np.zeros(0, bool)
        many = np.repeat(many, np.diff(np.r_[at, len(h)]))
        found = unpack(rows.get(1, []), [U8, I8])
        for x, d in ((h[many], doc[many]), found):
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(x.view(I8))], names=["doc_id", "h"])


def _paths(doc, at, sdoc, sat, frag) -> list[np.ndarray]:
    """Maximal runs of edges at consecutive places with consecutive places in one source, and the fragment they lie in."""
    order = np.lexsort((at, doc))
    doc, at, sdoc, sat, frag = (x[order] for x in (doc, at, sdoc, sat, frag))
    i = np.arange(len(doc))
    first = runs(doc, at - i, sdoc, sat - i)
    return [doc[first], at[first], np.diff(np.r_[first, len(doc)]), sdoc[first], sat[first], frag[first]]


def _fragments(sdoc, sat) -> tuple[np.ndarray, list[np.ndarray]]:
    """Edges of one bucket at consecutive source coordinates: the start of each edge's fragment, and (sdoc, start, edges) of each fragment."""
    order = np.lexsort((sat, sdoc))
    s, p = sdoc[order], sat[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (p[1:] - p[:-1] > 1)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(s)] - 1 if len(s) else first
    frag = np.empty(len(s), I8)
    frag[order] = np.repeat(p[first], last - first + 1)
    return frag, [s[first], p[first], p[last] - p[first] + 1]


def _sources(edge, edge2, doc, at) -> tuple[np.ndarray, ...]:
    """For each entry, doc and place of the edge's first entry in the smallest doc."""
    order = np.lexsort((doc, edge))
    x, y = edge[order], edge2[order]
    if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():  # half of the identity is shared by two edges
        order = np.lexsort((doc, edge2, edge))
    first = runs(edge[order], edge2[order])
    lead = np.empty(len(edge), I8)
    lead[order] = np.repeat(order[first], np.diff(np.r_[first, len(edge)]))
    return doc[lead], at[lead]


def _edges(width: int, seed: int, buckets: int):
    def send(held: list) -> Iterator[pa.RecordBatch]:
        edge, edge2, h, doc, at = (np.concatenate(x) for x in zip(*held))
        sdoc, sat = _sources(edge, edge2, doc, at)
        found = sdoc < doc
        parts = _paths(doc[found], at[found], sdoc[found], sat[found], sat[found])[:5]
        yield from pack(1, bucket_of(parts[0], buckets), parts, 5)
        left = ~found
        yield from pack(0, bucket_of(h[left], buckets), [edge[left], (edge2[left] >> U8(32)).astype(np.uint32), doc[left], at[left]], 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(I8)
            known = batch.column("known")
            marks = np.asarray(known.flatten()).view(U8)
            of = np.repeat(np.arange(len(known)), np.asarray(known.value_lengths()))
            salt = U8(0x9FB21C651E98DF25)
            for b in blocks(batch.column("text")):
                edge, edge2, h, row, at = _windows(b, width, seed)
                own = (of >= b.lo) & (of < b.hi)
                keep = np.isin(h ^ row.astype(U8) * salt, marks[own] ^ (of[own] - b.lo).astype(U8) * salt)
                row = row[keep]
                tag = np.array([_tag(b.data[i:j]) for i, j in zip(b.offsets, b.offsets[1:])], I8)
                held.append((edge[keep], edge2[keep], h[keep], ids[b.lo + row], at[keep] + tag[row]))
                n += len(row)
                if n >= HELD:
                    yield from send(held)
                    held, n = [], 0
        if n:
            yield from send(held)

    return run


def _tag(text) -> int:
    """Tells apart texts of equal doc_id in the upper bits of a place."""
    return (zlib.crc32(text) & 0x3FFFFF) << 40


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of documents, each with its fragment's start, and fragments of the graph (doc_id null)."""
    names = ["doc_id", "at", "n", "sdoc", "sat", "frag"]
    for _, rows in by_bucket(batches, 5):
        edge, edge2, doc, at = unpack(rows.get(0, []), [U8, np.uint32, I8, I8])
        sdoc, sat = _sources(edge, edge2, doc, at) if len(edge) else (doc, at)
        found = sdoc < doc
        frag, (owner, start, size) = _fragments(sdoc[found], sat[found])
        sent = unpack(rows.get(1, []), [I8] * 5)
        for parts in (_paths(doc[found], at[found], sdoc[found], sat[found], frag), [*sent, sent[4]]):
            if len(parts[0]):
                yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], names=names)
        if len(owner):
            none = pa.nulls(len(owner), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *(pa.array(x) for x in (size, owner, start, start))], names=names)


def _lists(column: pa.Array) -> list[list[tuple]]:
    """Cells of a column of lists of structs as lists of tuples."""
    flat = column.flatten()
    rows = list(zip(*(flat.field(i).to_pylist() for i in range(flat.type.num_fields))))
    out, at = [], 0
    for n in column.value_lengths().fill_null(0).to_pylist():
        out.append(rows[at : at + n])
        at += n
    return out


def _digest(words: list[bytes], place: int, n: int, width: int) -> bytes:
    return hashlib.sha256(b" ".join(words[place : place + n + width - 1])).digest()[:16]


_PLACE = (1 << 40) - 1


def _at_sources(names: list[str], kinds: list, of: Callable):
    """sdoc, sat, n, and what `of` (words, place, n) says of the words at each coordinate that is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for doc, text, asked in zip(batch.column("sdoc").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), _lists(batch.column("asked"))):
                if asked:
                    words, tag = (text or b"").split(), _tag(text or b"")
                    out += [(doc, sat, n, *of(words, sat & _PLACE, n)) for sat, n in asked if sat & ~_PLACE == tag]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 3 + kinds)], names=["sdoc", "sat", "n", *names])

    return run


def _nodes(width: int):
    """The runs of width - 1 words that a fragment leads from and to."""
    node = lambda words: xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)
    return lambda words, place, n: (node(words[place : place + width - 1]), node(words[place + n : place + n + width - 1]))


def _keep(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            total, gone, kept, spans = [], [], [], []
            for text, paths in zip(batch.column("text").cast(pa.binary()).to_pylist(), _lists(batch.column("paths"))):
                text = text or b""
                words, drop = text.split(), []
                if paths:
                    tag = _tag(text)
                    drop = sorted({(at & _PLACE, n) for at, n, digest in paths if at & ~_PLACE == tag and _digest(words, at & _PLACE, n, width) == digest})
                merged: list[list[int]] = []
                for at, n in drop:
                    end = at + n + width - 1
                    if merged and at <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([at, end])
                left, last = [], 0
                for i, j in merged:
                    left += words[last:i]
                    last = j
                left += words[last:]
                total.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left))
                spans.append([{"first": i, "last": j - 1} for i, j in merged])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))],
                names=["doc_id", "n_words", "n_removed", "kept", "spans"],
            )

    return run


def unitigs(fragments: DataFrame) -> DataFrame:
    """sdoc, frag, head: the source coordinate at which the compacted path of each fragment begins.

    fragments: sdoc, sat, n, left, right. Two fragments that follow each other in their source become
    one path if the node between them does not branch: one fragment leads to it and one from it.
    """
    ends = fragments.select(F.col("right").alias("node"), F.lit(1).alias("into"), F.lit(0).alias("out")).unionByName(fragments.select(F.col("left").alias("node"), F.lit(0).alias("into"), F.lit(1).alias("out")))
    straight = ends.groupBy("node").agg(F.sum("into").alias("into"), F.sum("out").alias("out")).filter("into = 1 AND out = 1").select(F.col("node").alias("left"), F.lit(True).alias("straight"))
    along = Window.partitionBy("sdoc").orderBy("sat")  # one document's fragments
    follows = F.coalesce(F.col("straight"), F.lit(False)) & F.coalesce(F.lag(F.col("sat") + F.col("n")).over(along) == F.col("sat"), F.lit(False))
    begun = fragments.join(straight, "left", "left").withColumn("begin", F.when(~follows, F.col("sat")))
    return begun.select("sdoc", F.col("sat").alias("frag"), F.max("begin").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("head"))


def _glued(paths: DataFrame, heads: DataFrame) -> DataFrame:
    """doc_id, at, n, sdoc, sat: paths that follow each other in a document and along one compacted path of the graph, as one.

    paths: those and frag. A path of no known fragment stays by itself.
    """
    own = paths.join(heads, ["sdoc", "frag"], "left").withColumn("head", F.coalesce("head", F.col("sat")))
    along = Window.partitionBy("doc_id", "sdoc", "head", F.col("at") - F.col("sat")).orderBy("at", "n")  # inside one document
    reach = F.max(F.col("at") + F.col("n")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    begun = own.withColumn("begin", F.when(F.coalesce(reach >= F.col("at"), F.lit(False)), None).otherwise(F.col("at")))
    marked = begun.withColumn("begin", F.last("begin", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "sdoc", "head", (F.col("at") - F.col("sat")).alias("shift"), "begin").agg(F.max(F.col("at") + F.col("n")).alias("end")).select(
        "doc_id", F.col("begin").alias("at"), (F.col("end") - F.col("begin")).alias("n"), "sdoc", (F.col("begin") - F.col("shift")).alias("sat")
    )


def remove_repeated_spans(docs: DataFrame, width: int = 13, seed: int = 6) -> DataFrame:
    """doc_id, n_words, n_removed, kept (remaining words joined by spaces), spans (removed words, first and last).

    A word goes if a window of `width` words covers it whose words also start in a document with a
    smaller doc_id. See the module's docstring for nulls, short texts and repeated rows.
    """
    if not 1 <= seed <= width:
        raise ValueError("seed must be from 1 to width")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = part_count(rows)
    buckets = bucket_count(parts)
    known = (
        dealt(rows.filter("doc_id IS NOT NULL").mapInArrow(_minimisers(width, seed, buckets), schema(2)), parts)
        .mapInArrow(_shared, "doc_id long, h long")
        .groupBy("doc_id")
        .agg(F.collect_list("h").alias("known"))
    )
    edges = rows.join(known, "doc_id").mapInArrow(_edges(width, seed, buckets), schema(5))
    found = cut(dealt(edges, parts).mapInArrow(_compact, "doc_id long, at long, n long, sdoc long, sat long, frag long"), "paths")
    # Joins with texts are outer ones over the same rows, so that they read one exchange; rows without id are spread by their text.
    zero = F.pmod(F.col("doc_id"), F.lit(1))  # not a literal, which would leave the exchange
    spread = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(zero))

    def at_sources(asked: DataFrame, names: list[str], kinds: list, types: str, of: Callable) -> DataFrame:
        lists = asked.groupBy("sdoc").agg(F.collect_list(F.struct("sat", "n")).alias("asked"))  # one document's coordinates
        joined = spread.join(lists.withColumnRenamed("sdoc", "doc_id").withColumn("spread", zero), ["doc_id", "spread"], "left").withColumnRenamed("doc_id", "sdoc")
        return joined.mapInArrow(_at_sources(names, kinds, of), f"sdoc long, sat long, n long, {types}")

    fragments = at_sources(found.filter("doc_id IS NULL").select("sdoc", "sat", "n"), ["left", "right"], [pa.int64()] * 2, "left long, right long", _nodes(width))
    paths = cut(_glued(found.filter("doc_id IS NOT NULL"), unitigs(cut(fragments, "fragments"))), "spans")
    source = at_sources(paths.select("sdoc", "sat", "n").distinct(), ["digest"], [pa.binary()], "digest binary", lambda words, place, n: (_digest(words, place, n, width),))
    checked = paths.join(source, ["sdoc", "sat", "n"]).groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", "digest")).alias("paths"))
    return spread.join(checked.withColumn("spread", zero), ["doc_id", "spread"], "left").mapInArrow(
        _keep(width), "doc_id long, n_words long, n_removed long, kept string, spans array<struct<first:long,last:long>>"
    )
