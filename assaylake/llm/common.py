"""Shared pieces of the operators: words, positions in a global order, Arrow helpers."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylake.functions.lineage import cut

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(df: DataFrame, rows: int = 500) -> DataFrame:
    """``df``, after the session's Arrow batches are limited to ``rows`` rows: texts can be long, and a batch is held whole."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's variable is bound, an alias may be inlined."""
    return F.transform(F.array(value), body)[0]


def numbered(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """Adds the position, from 0, in the order of ``keys``; rows equal in all keys follow in any order.

    The rows are ranged, written once, numbered inside each range, and offset by the counts of the
    ranges before. Only those counts, one per partition, meet in one task.
    """
    placed = cut(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    inside = placed.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1)
    return inside.join(before, "_part").withColumn(name, (F.col("_at") + F.col("_before")).cast("long")).drop("_part", "_at", "_before")


def binary_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    kind = pa.large_binary() if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else pa.binary()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    width = np.int64 if kind == pa.large_binary() else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and len(buffers[2]) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str, most_bytes: int):
    """Runs of rows of a batch whose ``column`` has about ``most_bytes``; a longer row comes alone."""
    sizes = np.diff(binary_of(batch[column])[1])
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def longs(values) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, dtype=np.int64))


_LIBC: list = []
#: What modules keep in a Python worker between tasks, by name of the module.
KEPT: dict[str, dict] = {}


def give_back(keep: str | None = None) -> None:
    """Forgets what other modules keep in a Python worker and returns freed memory to the system.

    Workers outlive their tasks, and what one stage needed must not stay beside the next one's.
    """
    for name, kept in KEPT.items():
        if name != keep:
            kept.clear()
    if not _LIBC:
        try:
            libc = ctypes.CDLL("libc.so.6")
            _LIBC.append(libc.malloc_trim)
        except (OSError, AttributeError):  # another C library
            _LIBC.append(lambda _: 0)
    pa.default_memory_pool().release_unused()
    _LIBC[0](0)
