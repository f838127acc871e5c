"""Writers of a run's outputs."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions.scalars import output_file

#: Rows of every output, whatever its type: values in row-major order, shape as the reader sees it.
SCHEMA = "output_type string, layer int, head int, ord long, sequence_id string, shape array<int>, values array<float>"
PARTS = ("output_type", "layer", "head")


def write_parquet(outputs: DataFrame, path: str, mode: str = "errorifexists", flush_mb: int = 128) -> None:
    """Parquet by output type, layer and head: a reader of one of them touches no other file. flush_mb is the size of a row group, which is what a writer holds in memory."""
    outputs.write.mode(mode).option("parquet.block.size", flush_mb << 20).partitionBy(*PARTS).parquet(path)


def write_slices(outputs: DataFrame, path: str, step: int, flush_mb: int = 128) -> None:
    """As write_parquet, below a folder for each slice of `step` rows; slices that have rows here are replaced, others stay."""
    sliced = outputs.withColumn("slice", F.floor(F.col("ord") / step).cast("long") * step)
    sliced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.block.size", flush_mb << 20).partitionBy("slice", *PARTS).parquet(path)


def vectors(outputs: DataFrame) -> DataFrame:
    """Rows (output_type, layer, head, ord, sequence_id, vector): pooled outputs, and others flattened."""
    return outputs.select(*PARTS, "ord", "sequence_id", F.col("values").alias("vector"))


def matrices(outputs: DataFrame, *more: str) -> DataFrame:
    """Rows (output_type, layer, head, ord, sequence_id, matrix array<array<float>>) of two-dimensional outputs, with the columns that are named in more."""
    width = F.element_at("shape", 2)
    rows = F.transform(F.sequence(F.lit(0), F.element_at("shape", 1) - 1), lambda i: F.slice("values", i * width + 1, width))
    return outputs.where(F.size("shape") == 2).select(*PARTS, "ord", "sequence_id", F.when(F.element_at("shape", 1) > 0, rows).otherwise(F.array().cast("array<array<float>>")).alias("matrix"), *more)


def write_index(sequences: DataFrame, path: str, mode: str = "overwrite") -> None:
    """index,sequence_id as CSV, with quotes where an id needs them; index is the row of the dense arrays."""
    sequences.select(F.col("ord").alias("index"), "sequence_id").write.mode(mode).csv(path, header=True)


def write_fasta(sequences: DataFrame, path: str, mode: str = "errorifexists") -> None:
    sequences.select(F.concat(F.lit(">"), "sequence_id", F.lit("\n"), "sequence").alias("value")).write.mode(mode).text(path)


def export_npy(outputs: DataFrame, folder: str, prefix: str, model: str, n_rows: int, dtype: np.dtype, flatten: bool = False) -> list[str]:
    """Dense .npy arrays, a file for each output type, layer and head, on the driver's disk; rows are streamed in order into a memory map, so memory stays bounded.

    Sequences of fewer tokens are filled up with NaN at the end of each axis; with one common length nothing is filled.
    """
    sizes = outputs.groupBy(*PARTS).agg(F.max(F.element_at("shape", 1)).alias("a"), F.max(F.try_element_at("shape", F.lit(2))).alias("b")).collect()
    Path(folder).mkdir(parents=True, exist_ok=True)
    written = []
    for r in sorted(sizes, key=str):
        shape = (r["a"],) if r["b"] is None else (r["a"], r["b"])
        path = str(Path(folder) / output_file(prefix, model, *(r[p] for p in PARTS)))
        array = np.lib.format.open_memmap(path, mode="w+", dtype=dtype, shape=(n_rows, int(np.prod(shape))) if flatten else (n_rows, *shape))
        own = outputs.where(F.col("output_type").eqNullSafe(r["output_type"]) & F.col("layer").eqNullSafe(r["layer"]) & F.col("head").eqNullSafe(r["head"]))
        full = np.full(shape, np.nan, dtype)
        for x in own.select("ord", "shape", "values").orderBy("ord").toLocalIterator(prefetchPartitions=True):
            full[...] = np.nan
            full[tuple(slice(0, k) for k in x["shape"])] = np.asarray(x["values"], dtype).reshape(x["shape"])
            array[x["ord"]] = full.ravel() if flatten else full
        array.flush()
        written.append(path)
    return written


def read_ranges(spark, path: str) -> DataFrame:
    """Completed ranges of a run (output_type, layer, head, start, end); none if nothing was recorded or a record is broken."""
    schema = "output_type string, layer int, head int, start long, end long"
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where("start IS NOT NULL AND `end` IS NOT NULL AND output_type IS NOT NULL")


def record_ranges(spark, path: str, keys: Sequence[tuple[str, int | None, int | None]], ranges: Sequence[tuple[int, int]]) -> None:
    """Records ranges as complete, once their rows are written. Each record is a file of its own, so a broken write can't spoil others."""
    rows = [(*k, start, end) for start, end in ranges for k in keys]
    spark.createDataFrame(rows, "output_type string, layer int, head int, start long, end long").coalesce(1).write.mode("append").json(path)


def remove(spark, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
