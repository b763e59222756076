"""What the operators of this subpackage share: table access, lineage cuts and Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The shared folder for checkpoints and tables: what ``spark.checkpoint.dir`` names.

    A folder is made up only where the session names none and runs in one process; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables that a computation writes to the shared folder to cut its lineage, and deletes once they are spent.

    They outlive any executor. What is returned lazily must not read them: ``cut`` it first.
    """

    #: Lets Spark delete a write's shuffle files when it has ended: the table takes their place.
    CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.count = spark, f"{shared(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        remove(self.spark, self.folder)

    def put(self, df: DataFrame) -> DataFrame:
        """``df`` written and read again."""
        self.count += 1
        path, before = f"{self.folder}/{self.count}", self.spark.conf.get(self.CLEAN, None)
        self.spark.conf.set(self.CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(self.CLEAN, before) if before is not None else self.spark.conf.unset(self.CLEAN)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``put`` returned and that nothing reads any more."""
        for t in tables:
            remove(self.spark, t._scratch)  # type: ignore[attr-defined]


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor loses nothing."""
    shared(df.sparkSession)
    return df.checkpoint()


def utf8(text: Column | str) -> Column:
    """The UTF-8 bytes of a text column, none for null."""
    return F.coalesce(F.encode(F.col(text) if isinstance(text, str) else text, "utf-8"), F.lit(b""))


def buffers(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a string or binary Arrow column, and the n + 1 offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return memoryview(column.buffers()[2] or b""), offsets.astype(np.int64)


def release() -> None:
    """Give memory that a task no longer uses back to the system: Spark keeps its Python workers for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to give back this way
        pass


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of the pieces [start, start + length) one after another."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.arange(ends[-1], dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def blocks(total: int, size: int) -> int:
    """Into how many blocks of about ``size`` rows ``total`` rows go."""
    return max(1, -(-int(total) // size))
