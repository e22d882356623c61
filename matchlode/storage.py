"""The folder that the driver and all executors share, and cuts of lineage in it."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as a URI; a new local folder only where a session of one machine has none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="matchlode-")
        spark.sparkContext.setCheckpointDir(base)
    return base if urlparse(base).scheme else f"file://{base}"


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


#: Spark removes an execution's shuffle files when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """For actions whose results are kept elsewhere: their shuffle files go with them, not at some later garbage collection."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later stages survive lost executors."""
    path = new_folder(df.sparkSession, tag)
    with freeing(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, if its input has fewer parts; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def save_arrays(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Writes arrays to a new file of the shared folder, for map_arrays; its URI."""
    system, path = arrow_fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name, at, heads = uuid.uuid4().hex, 0, []
    for n, a in arrays.items():
        heads.append([n, a.dtype.str, at, len(a)])
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(heads).encode()
    with system.open_output_stream(f"{path}/{name}") as out:
        out.write(len(head).to_bytes(8, "little") + head + bytes(-(8 + len(head)) % 64))
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).view(np.uint8).data)
            out.write(bytes(-a.nbytes % 64))
    return f"{folder}/{name}"


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped; a file elsewhere than in a local folder is copied to a temporary one first."""
    system, path = arrow_fs.FileSystem.from_uri(uri)
    if isinstance(system, arrow_fs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    else:
        with tempfile.TemporaryFile() as near:  # goes with the map
            with system.open_input_stream(path) as source:
                while part := source.read(8 << 20):
                    near.write(part)
            near.flush()
            raw = np.memmap(near, np.uint8, "r")
    size = int.from_bytes(raw[:8].tobytes(), "little")
    base = -(-(8 + size) // 64) * 64
    return {n: raw[base + at : base + at + count * np.dtype(t).itemsize].view(t).view(np.ndarray) for n, t, at, count in json.loads(raw[8 : 8 + size].tobytes())}
