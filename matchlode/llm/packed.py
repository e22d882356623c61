"""A packed shuffle: numpy arrays travel as a few binary cells a bucket, not as a row an entry.

Map tasks sort and pre-aggregate what they hold, and send one row for each bucket with the bytes
of every column, as planes of equal bytes, which compress; reduce tasks join the bytes. Buckets come from mixed hashes, so they are even.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scan import mix

#: The fewest buckets; clusters with more shuffle partitions get more.
BUCKETS = 1024


def bucket_count(parts: int) -> int:
    """Several buckets a shuffle partition, so that partitions are even."""
    return max(BUCKETS, 4 * parts)


def part_count(df: DataFrame) -> int:
    """Shuffle partitions that grow with the parts of df's input, so that tasks stay as small on more data."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.rdd.getNumPartitions())


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key.view(np.uint64) ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(buckets)).astype(np.int32)


def schema(columns: int) -> str:
    return "kind int, bucket int, " + ", ".join(f"c{i} binary" for i in range(columns))


def pack(kind: int, bucket: np.ndarray, arrays: list[np.ndarray], columns: int) -> Iterator[pa.RecordBatch]:
    """Rows (kind, bucket, bytes of each array); unused columns are null."""
    if not len(bucket):
        return
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket, kind="stable")  # 16 bits: by radix
    bucket = bucket[order]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[edges[1:], len(bucket)]
    cells = []
    for a in arrays:
        a = a[order]
        if a.dtype == np.int64:  # signed numbers as steps: neighbours are close
            steps = np.diff(a, prepend=0)
            steps[edges] = a[edges]
            a = steps
        raw = a.view(np.uint8).reshape(len(a), -1)
        cells.append(pa.array([raw[i:j].T.tobytes() for i, j in zip(edges, ends)], pa.binary()))
    cells += [pa.nulls(len(edges), pa.binary())] * (columns - len(arrays))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(edges), kind, np.int32)), pa.array(bucket[edges]), *cells],
        names=["kind", "bucket", *(f"c{i}" for i in range(columns))],
    )


def _cell(raw: bytes, t) -> np.ndarray:
    a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(t).itemsize, -1).T).view(t)[:, 0]
    return np.cumsum(a) if t == np.int64 else a


def unpack(rows: list[tuple], types: list) -> list[np.ndarray]:
    return [np.concatenate([_cell(r[i], t) for r in rows]) if rows else np.zeros(0, t) for i, t in enumerate(types)]


def by_bucket(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[int, dict[int, list[tuple]]]]:
    """Each bucket of a partition with its rows by kind, one at a time."""
    own, rows = None, {}
    for b in batches:
        for kind, bucket, *cells in zip(*(b.column(i).to_pylist() for i in range(columns + 2))):
            if bucket != own and rows:
                yield own, rows
                rows = {}
            own = bucket
            rows.setdefault(kind, []).append(tuple(cells))
    if rows:
        yield own, rows


def dealt(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Packed rows by bucket: each in one task, whose buckets follow each other; Spark's sort spills, and holds pointers alone."""
    return (df.repartition(parts, "bucket") if parts else df.repartition("bucket")).sortWithinPartitions("bucket", "kind")


def runs(*columns: np.ndarray) -> np.ndarray:
    """First index of each run of equal rows in sorted columns."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)
