"""What several operators of this package need: work folders, file access, batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under the shared folder that the cluster names.

    Only where the session names none and is of one machine (a test) a temporary
    folder is made and set, so that every later call shares it; on a cluster that
    is an error, as executors would each write to their own disk.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set(CHECKPOINT_DIR, base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage with replicated data."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(filesystem, path) of a folder URI; schemes as pyarrow has them (file, hdfs, s3, gs, abfs)."""
    from pyarrow import fs

    if "://" not in uri:
        # Hadoop prints local paths as file:/x; a bare path is local too.
        uri = "file://" + (uri[5:] if uri.startswith("file:") else os.path.abspath(uri))
    return fs.FileSystem.from_uri(uri)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the named text column of each part holds about max_bytes at most.

    A part has one row at least, so one very long text makes a part of its own.
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def lean(run):
    """A task's function that begins without what other operators keep in its Python worker, and gives free memory back at its end.

    Workers outlive a stage, and an encoder's cache of words that nobody asks for any more counts against the executor.
    """

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillgraph.llm.tokens import forget

        forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return body


def give_back() -> None:
    """Hand freed memory back to the system, where its C library can."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str, max_rows: int = 200_000) -> DataFrame:
    """Join that broadcasts `small` only if a count shows it has max_rows rows at most.

    Beyond that Spark shuffles both sides. `small` must be cheap to count (a written table).
    """
    if small.count() <= max_rows:
        small = F.broadcast(small)
    return big.join(small, on, how)


def smallest_hashes(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The `most` rows with the smallest hashes of columns `by`, ties in `order`: a sample that is the same at any partitioning.

    A count sets a bound that about 2 * most hashes lie under, and only rows under it are
    ordered. Without it every task would send its own `most` rows, however many tasks there are.
    """
    digest, n = F.xxhash64(*by), rows.count()
    if n > 2 * most:
        rows = rows.where(digest < F.lit(int(2**64 * (2 * most / n)) - 2**63))
    return rows.orderBy(digest, *order).limit(most)
