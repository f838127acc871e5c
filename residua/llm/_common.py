"""Helpers that the operators of this subpackage share: durable intermediate tables, bounded Arrow chunks, flat text buffers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.sinks.scratch import new_folder

#: Bytes of text that Python code handles at once; a longer text is handled alone and whole.
CHUNK_BYTES = 2 << 20


@contextmanager
def _files_of_shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files are deleted when the query has ended, not whenever the driver's memory is cleaned."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def durable(df: DataFrame) -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it back: lineage ends there and survives lost executors. The files go with let_go(), or when the driver's JVM ends."""
    spark = df.sparkSession
    path = new_folder(spark)
    with _files_of_shuffles_go(spark):
        df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._residua_path = path
    return made


def let_go(*tables: DataFrame | None) -> None:
    """Deletes the files of durable tables that nothing reads any more; others are left alone."""
    for df in tables:
        if path := getattr(df, "_residua_path", None):
            files, where = _path(df.sparkSession, path)
            files.delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold at most limit bytes together; at least one row each."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < n:
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array, one text after another, and the n + 1 offsets of the texts. Nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
