"""What the operators share: the shared folder, tables written to it, raw files, bounded broadcasts.

Tasks write raw files under a name of their own attempt and return that name as a row, so a task that
runs twice leaves two files of which only the returned one is ever read.
"""

from __future__ import annotations

import ctypes
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.shared import discard, free_shuffles, shared_folder, stored  # noqa: F401

#: Bytes of Arrow data handed to Python at once. Rows longer than this travel alone.
BATCH_BYTES = 8 << 20

#: Rows up to which a table of groups is broadcast; beyond it the join is left to the planner.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, records: int = 256) -> None:
    """Bound Arrow batches by rows and bytes, since texts differ in length by five orders of magnitude."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df``, a stored table, has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def gathered(df: DataFrame, rows: int, each: int = 50_000, least: int = 16) -> DataFrame:
    """``df``, about ``rows`` small rows after a shuffle, in tasks of ``each``, where the shuffle has more partitions than that: tables
    that are written many times over would else be hundreds of files of a few rows."""
    return df.coalesce(max(least, rows // each))


def parts_for(spark: SparkSession, n_bytes: int, each: int, least: int = 1) -> int:
    """Partitions so that each gets about ``each`` bytes."""
    return max(least, -(-int(n_bytes) // each))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


#: What this worker keeps between tasks of one operator.
CACHES: weakref.WeakSet = weakref.WeakSet()


def drop_caches() -> None:
    """Empty what another operator's tasks have left in this worker."""
    for cache in list(CACHES):
        cache.clear()


def release() -> None:
    """Give memory that this worker has freed, and other operators' caches, back to the system: the worker lives on
    beside others."""
    drop_caches()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass  # another C library


def buffers(table: pa.Table, column: str) -> list[memoryview]:
    """The values of a binary column without copying them."""
    return [memoryview(x.as_buffer()) for chunk in table.column(column).chunks for x in chunk]


def write_file(uri: str, data: bytes) -> None:
    """Write one file; its folder is made where needed."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        out.write(data)


def open_file(uri: str):
    """A random-access file."""
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def attempt_name() -> str:
    """A name for a file of this task attempt."""
    from pyspark import TaskContext

    context = TaskContext.get()
    part = context.partitionId() if context else 0
    return f"{part:06d}-{uuid.uuid4().hex[:12]}"


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with one function per task: ``make()`` runs on the executor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            out = step(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)
