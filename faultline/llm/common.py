"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.sources.shared import cut, folder

__all__ = ["cut"]

#: Bytes between words: space and the controls tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]+"


_caches: dict[str, list] = {}


def cached(name: str, store: dict) -> dict:
    """A worker's memory of one operator, which keep_only() of another clears."""
    _caches.setdefault(name, []).append(store)
    return store


_owner: list[str] = []


def keep_only(name: str) -> None:
    """Python workers outlive stages: when another operator begins, what others remember is dropped, and memory that
    is free goes back to the system."""
    if _owner != [name]:
        _owner[:] = [name]
        for other, stores in _caches.items():
            if other != name:
                for store in stores:
                    store.clear()
        gc.collect()
    give_back()


def give_back() -> None:
    """Returns a worker's free memory to the system, which else keeps it for the worker's life."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there is deleted when the application ends."""
    root = f"{folder(spark)}/scratch-{spark.sparkContext.applicationId}"
    files, at = _files(spark, root)
    if files.mkdirs(at):
        files.deleteOnExit(at)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    files, at = _files(spark, path)
    files.delete(at, True)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a compressed table in the shared folder, and read again: computed once, whoever reads it."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as tell it apart from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sql_ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(df: DataFrame, column: str) -> int:
    """The bytes of all texts; one small aggregate over the whole table."""
    return int(df.agg(F.sum(F.octet_length(F.col(column))).alias("n")).first()["n"] or 0)


def bucket_count(df: DataFrame, column: str, target_bytes: int, least: int = 1) -> int:
    """How many blocks of about target_bytes hold the column's bytes."""
    return max(least, -(-text_bytes(df, column) // target_bytes))


def dealt(id_column: str, text_column: str, blocks: int) -> Column:
    """A row's block: by a hash of its id and text, so that neither a hot id nor a hot text alone fills a block. Only
    rows equal in both share one for sure; the same rows are in the same blocks whenever they are dealt."""
    return F.pmod(F.xxhash64(F.col(id_column), F.col(text_column)), F.lit(blocks)).cast("int")


def blocked(df: DataFrame, id_column: str, text_column: str, blocks: int, *more: str) -> DataFrame:
    """(block, doc_id, body): rows dealt to blocks, bodies as UTF-8 bytes, null as empty."""
    return df.select(
        dealt(id_column, text_column, blocks).alias("block"),
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary").alias("body"),
        *more,
    )


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column one after another, and the n + 1 offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct numbers in order, by sorting."""
    return counted(values)[0]


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and how often each occurs."""
    ordered = np.sort(values)
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.diff(np.r_[first, len(ordered)])


def summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and the sum of the counts of each."""
    order = np.argsort(values)
    ordered = values[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.add.reduceat(counts[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are among the ordered ones."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def to_planes(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte plane by byte plane: the high planes compress to almost nothing."""
    steps = np.diff(values, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64)
