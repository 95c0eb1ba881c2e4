"""What the corpus operators share: intermediate tables, Arrow helpers, text columns."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors reach.

    It is what the session names in ``spark.checkpoint.dir``. Only a local session
    without one, as in tests, gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        named = spark.sparkContext.getCheckpointDir() or ""
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        named = "file://" + tempfile.mkdtemp(prefix="spark-loomspan-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomspan/{name}-{uuid.uuid4().hex[:12]}"


_lock, _holders, _before = threading.Lock(), 0, {}


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20):
    """While this holds, tasks hand Python at most so many rows, or bytes, at a time: texts and
    shingle sets can be long. Once nobody holds it any more, what the session had set before comes back."""
    global _holders
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    with _lock:
        if not _holders:
            _before.update({key: spark.conf.get(key, None) for key in wanted})
            for key, value in wanted.items():
                spark.conf.set(key, value)
        _holders += 1
    try:
        yield
    finally:
        with _lock:
            _holders -= 1
            for key, value in _before.items() if not _holders else ():
                spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage
    ends there, so a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def pieces(batch: pa.RecordBatch, column: int, limit: int = 1_000_000):
    """Slices of a record batch with about ``limit`` bytes of text each (one row at
    least), as (slice, bytes as uint8, row offsets into them). Nulls count as empty."""
    array = batch.column(column)
    if not pa.types.is_string(array.type):
        array = array.cast(pa.string())
    if array.null_count:
        array = array.fill_null("")
    if not len(array):
        return
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < len(array):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high
