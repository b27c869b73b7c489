"""Shared folders, word rules and blob helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII characters.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
#: Spark's setting that an execution's shuffle files go when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: bytes.translate table that lower-cases A-Z alone.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder (as a URI or path) that the driver and all executors see.

    It lies in ``spark.checkpoint.dir``; only where that is unset and the master
    is local, as in tests, a temporary folder of this machine becomes the
    session's one. On a cluster without the setting this is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            root = current.get()
        elif not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="colocus-")
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, folder: str) -> DataFrame:
    """Write ``df`` as Parquet under a shared folder and read it back: the cut in the lineage.

    Nothing reads the write's shuffles again, so Spark deletes their files as
    soon as it has ended; else they would stay until the driver happens to
    collect its garbage.
    """
    conf = df.sparkSession.conf
    was = conf.get(CLEAN_UP, "false")
    conf.set(CLEAN_UP, "true")
    try:
        df.write.mode("overwrite").parquet(folder)
    finally:
        conf.set(CLEAN_UP, was)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def drop(spark: SparkSession, *folders: str) -> None:
    """Delete intermediate folders of the shared folder that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI or plain path, on the driver or an executor."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Write a whole file under a private name, then move it: a retried task replaces it with equal bytes."""
    fs, path = store_of(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def get_file(uri: str) -> pa.Buffer:
    """A whole file: mapped into memory where the store is a local folder, else read."""
    fs, path = store_of(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        with pa.memory_map(path) as f:
            return f.read_buffer()
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def partitions_for(df: DataFrame, rows_each: int, least: int = 1) -> int:
    """A number of partitions that grows with the number of rows."""
    return max(least, -(-df.count() // rows_each))


def _sliced(batch: pa.RecordBatch, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most_bytes`` of text each; a single longer row is a slice of its own."""
    if batch.nbytes <= most_bytes:
        yield batch
        return
    size = np.full(batch.num_rows, 16, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, low = np.cumsum(size), 0
    while low < batch.num_rows:
        reached = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, reached + most_bytes, side="right")))
        yield batch.slice(low, high - low)
        low = high


def batches_of(stream: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.Table]:
    """Cuts and joins Arrow batches to about ``most_bytes`` each; a single longer row stays whole."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in stream:
        for batch in _sliced(whole, most_bytes) if whole.num_rows else ():
            if held and size + batch.nbytes > most_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def lean(run):
    """Wraps a partition function: when its rows are out, the worker gives its free memory back.

    Workers live on between tasks; without this each would keep the most that
    any of its tasks ever held, beside whatever the executor's JVM needs next.
    """

    def wrapped(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(stream)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library: nothing to trim

    return wrapped


def planes(x: np.ndarray) -> bytes:
    """The bytes of all values place by place, which packs better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplaned(raw: bytes, kind, n: int, at: int) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n).T).view(kind).reshape(n)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of each run, one run after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    shift = np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)
    return shift + np.arange(total, dtype=np.int64)


def range_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts - 1`` cut points that split a whole-number column into even ranges."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(F.col(column), at, 20_000).alias("q")).first()
    return sorted(set(found["q"] or []))


def range_index(column: Column, bounds: list[int]) -> Column:
    """How many of the cut points lie at or below the value, as a tree of comparisons; 0 for null."""
    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(column < F.lit(bounds[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return F.when(column.isNull(), F.lit(0)).otherwise(tree(0, len(bounds))).cast("int")


def range_search(column: Column, bounds: list[int]) -> Column:
    """As range_index by halving steps through one array, for thousands of cut points: the expression's size stays the same."""
    if not bounds:
        return F.lit(0)
    cuts = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # one literal, once it is folded
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    further = lambda at, step: F.when(F.get(cuts, at + step - 1) <= column, at + step).otherwise(at)
    return F.when(column.isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), further)).cast("int")
