"""Removal of repeated runs of lines, in chunks whose bounds follow the content.

A rolling hash over the last two lines ends a chunk where it falls in one of `divisor` classes, so an
insertion moves only the bounds near it. Chunks of two lines or more that occur again anywhere are
candidates; their bytes are compared by grouping on the text itself, and of equal chunks only the
first (smallest doc_id, then place) stays.

With runs=True every two neighbouring lines are a candidate in place of the chunks, so that bounds lose
nothing: each line of each run of two lines or more that occurs earlier goes, and so does a text of one
line that is an earlier text of one line. A removed line always has an earlier copy, so the first copy
of every line stays.

Defined results: null and empty texts have no chunks; lines are what "\\n" separates, kept byte for
byte, and lines of white space alone do not make a chunk; rows of equal doc_id and text are one
document and stay alike; a row with null doc_id is kept whole and is no first occurrence. Other
columns are ignored, or passed on if named.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import pieces
from .shared import cut

#: One line pair in so many ends a chunk.
DIVISOR = 3


def chunks(text: bytes, divisor: int = DIVISOR) -> list[tuple[int, int, bytes]]:
    """First line, number of lines and bytes of each chunk."""
    lines = text.split(b"\n")
    out, first, last = [], 0, 0
    for i, line in enumerate(lines):
        now = zlib.crc32(line)
        if i > first and xxhash.xxh64_intdigest(last.to_bytes(4, "little") + now.to_bytes(4, "little")) % divisor == 0 or i == len(lines) - 1:
            out.append((first, i + 1 - first, b"\n".join(lines[first : i + 1])))
            first = i + 1
        last = now
    return out


def candidates(text: bytes | None) -> list[tuple[int, int, bytes]]:
    """Chunks of two lines or more with words; their number in the text comes first."""
    return [(k, n, c) for k, (_, n, c) in enumerate(chunks(text)) if n > 1 and c.split()] if text else []


def windows(text: bytes | None) -> list[tuple[int, int, bytes]]:
    """Every two neighbouring lines with words, or the only line; their first line comes first."""
    lines = text.split(b"\n") if text else []
    found = [(0, 1, lines[0])] if len(lines) == 1 else [(i, 2, b"\n".join(lines[i : i + 2])) for i in range(len(lines) - 1)]
    return [w for w in found if w[2].split()]


def _without(text: bytes, known: set[int], stays: set[int]) -> list[bytes]:
    """The lines that are in no repeated window."""
    go, before = set(), (-2, b"")
    for k, n, c in windows(text):
        if k not in stays and _hash(c) in known:
            overlaps = before == (k - 1, c)  # three equal lines: the first two may be a first occurrence
            go |= {k + 1} if overlaps else set(range(k, k + n))
        before = k, c
    return [line for k, line in enumerate(text.split(b"\n")) if k not in go]


def _hash(chunk: bytes) -> int:
    return xxhash.xxh64_intdigest(chunk) - (1 << 63)


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    columns = [batch.column(n) for n in names]
    return zip(*((c.cast(pa.binary()) if n == "text" else c).to_pylist() for n, c in zip(names, columns)))


def _hashes(batches: Iterator[pa.RecordBatch], find) -> Iterator[pa.RecordBatch]:
    """(h, id, version, n): each hash of a text's candidates, and how many have it."""
    for batch in pieces(batches):
        out = [(h, doc, version, n) for doc, version, text in _rows(batch, "id", "version", "text") for h, n in Counter(_hash(c) for _, _, c in find(text)).items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["h", "id", "version", "n"])


def _repeated(batches: Iterator[pa.RecordBatch], find) -> Iterator[pa.RecordBatch]:
    """Bytes and place of each candidate whose hash occurs again."""
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    for batch in pieces(batches):
        out = []
        for doc, version, text, hs in _rows(batch, "id", "version", "text", "hs"):
            known = set(hs or ())
            out += [] if not known else [(h, c, doc, version, k) for k, _, c in find(text) if (h := _hash(c)) in known]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["h", "chunk", "id", "version", "place"])


def _drop(batches: Iterator[pa.RecordBatch], runs: bool) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        kept, total, gone = [], [], []
        for text, hs, stay in _rows(batch, "text", "hs", "stay"):
            if runs:
                left = _without(text, set(hs), set(stay or ())) if hs else [text or b""]
                total.append(text.count(b"\n") + 1 if text else 0)
                gone.append(total[-1] - len(left) if hs else 0)
                kept.append(None if text is None else b"\n".join(left))
                continue
            parts = chunks(text) if text else []
            left = parts
            if hs:
                known, stays = set(hs), set(stay or ())
                go = {k for k, _, c in candidates(text) if k not in stays and _hash(c) in known}
                left = [p for k, p in enumerate(parts) if k not in go]
            total.append(sum(n for _, n, _ in parts))
            gone.append(total[-1] - sum(n for _, n, _ in left))
            kept.append(None if text is None else b"\n".join(c for _, _, c in left))
        names = [n for n in batch.schema.names if n not in ("text", "hs", "stay")]
        columns = [*(batch.column(n) for n in names), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "text", "n_lines", "n_removed"])


def remove_repeated_lines(docs: DataFrame, *keep: str, runs: bool = False) -> DataFrame:
    """doc_id, the columns `keep`, text (without repeated chunks or runs), n_lines, n_removed: one row per row of docs."""
    names = [f"keep_{i}" for i in range(len(keep))]
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    text, find = F.col("text").cast("string"), windows if runs else candidates
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), *(F.col(c).alias(n) for c, n in zip(keep, names)), F.xxhash64(text).alias("version"), text.alias("text"))
    found = cut(rows.select("id", "version", "text").filter("id IS NOT NULL").mapInArrow(partial(_hashes, find=find), "h long, id long, version long, n long").distinct(), "chunks")  # equal rows are one document
    # A table of its own: a join with it can split a hash that very many documents have.
    again = cut(found.groupBy("h").agg(F.sum("n").alias("times")).filter("times > 1").select("h"), "again")
    known = cut(found.join(again, "h").groupBy("id", "version").agg(F.collect_list("h").alias("hs")), "repeated")
    # Both joins with texts are outer ones over the same rows and columns, so that they read one exchange.
    places = rows.join(known, ["id", "version"], "left").mapInArrow(partial(_repeated, find=find), "h long, chunk binary, id long, version long, place long")
    first = places.groupBy("h", "chunk").agg(F.min(F.struct("id", "version", "place")).alias("f"))
    stay = first.groupBy(F.col("f.id").alias("id"), F.col("f.version").alias("version")).agg(F.collect_list("f.place").alias("stay"))
    marks = known.join(stay, ["id", "version"], "left")
    marked = rows.join(marks, ["id", "version"], "left").select("id", *names, "text", "hs", "stay")
    done = marked.mapInArrow(partial(_drop, runs=runs), ", ".join(["id long", *(f"{n} {k}" for n, k in zip(names, kinds)), "text string, n_lines long, n_removed long"]))
    return done.select(F.col("id").alias("doc_id"), *(F.col(n).alias(c) for n, c in zip(names, keep)), "text", "n_lines", "n_removed")
