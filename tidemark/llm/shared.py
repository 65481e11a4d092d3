"""Tables, lineage cuts and text helpers that several operators need."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Texts are handed to the vectorised kernels in runs of about so many bytes.
RUN_BYTES = 2_000_000
#: Settings of a query that is cut: its shuffle files go when it ends, not when the driver's garbage happens to be collected,
#: and small shuffle partitions are read together up to the advisory size, so fewer files are written.
CUT_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back, compressed and by column.

    A lost executor costs nothing after this: the rows are in shared storage.
    """
    return Scratch(df.sparkSession).cut(df)


class Scratch:
    """Rows written to the shared folder on the way to a result, and deleted once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, {}

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/rows-{uuid.uuid4().hex}"
        before = {k: self.spark.conf.get(k, None) for k in CUT_CONF}
        try:
            for k, v in CUT_CONF.items():
                self.spark.conf.set(k, v)
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        rows = self.spark.read.schema(df.schema).parquet(path)
        self.folders[id(rows)] = (rows, path)  # holds the frame, so that its id stays its own
        self._collect()
        return rows

    def _collect(self) -> None:
        """Has the driver collect its garbage, as Spark deletes a shuffle's files once no plan refers to it."""
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        """Deletes what cut() wrote for these frames."""
        jvm = self.spark.sparkContext._jvm
        for frame in frames:
            path = jvm.org.apache.hadoop.fs.Path(self.folders.pop(id(frame))[1])
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns what this worker has freed to the machine: workers wait between tasks, and others need the memory."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def runs(batch: pa.RecordBatch, column: str, size: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch where its texts pass so many bytes, so that memory doesn't follow the batch size."""
    if not batch.num_rows:
        return
    ends = np.cumsum(text_lengths(batch.column(column)))
    first = 0
    while first < batch.num_rows:
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + size, "right")))
        yield batch.slice(first, last - first)
        first = last


def text_lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each text; 0 where it is null."""
    return np.diff(text_buffers(column)[1])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the n + 1 places where they begin and end."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    n = len(column)
    if places is None or not n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(places, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]
