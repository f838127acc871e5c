"""FASTA files as tables. Files are read as lines in splits, so one huge file is read by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residua.operators.sequences import auto_id, dedup_last, row_offsets

#: Records of a file that are numbered in one group.
_GROUP = 100_000


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (file, record, line, sequence_id, sequence), as they stand: duplicates kept, record from 1 and line from 0 within a file.

    Lines are stripped. A line that begins with > starts a record; its id is the rest of the line, or seqnum and the
    line's number if that is empty. Other lines are joined to the record's sequence; those before the first record are
    dropped. A record without such lines has the empty sequence.
    """
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    lines = spark.read.text(path).select(
        text.alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    lines = lines.withColumn("head", F.col("text").startswith(">").cast("long"))
    # Lines and headers are counted within blocks of a file; only the table of blocks is summed up in order.
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.sum("head").alias("heads"))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("heads").over(order), F.lit(0)).alias("heads_before"))
    within = Window.partitionBy("file", "block").orderBy("at")
    placed = lines.withColumn("line", F.row_number().over(within) - 1).withColumn("record", F.sum("head").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(blocks, ["file", "block"]).select("file", "text", "head", (F.col("line") + F.col("lines_before")).alias("line"), (F.col("record") + F.col("heads_before")).alias("record"))
    parts = F.array_sort(F.collect_list(F.when(F.col("head") == 0, F.struct("line", "text"))))
    records = placed.where("record > 0").groupBy("file", "record").agg(
        F.min(F.when(F.col("head") == 1, F.struct("line", F.substr("text", F.lit(2)).alias("id")))).alias("header"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("sequence"),
    )
    return records.select("file", "record", F.col("header.line").alias("line"), auto_id(F.col("header.id"), F.col("header.line")).alias("sequence_id"), "sequence")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (ord, sequence_id, sequence): files by name, records in order, numbered from 0. Of a repeated id the last sequence stays, at the first one's place."""
    records = read_records(spark, path).withColumn("place", F.struct("file", "record"))
    unique = dedup_last(records, "sequence_id", "place", ["sequence"])
    numbered = row_offsets(unique, ["place"], F.struct(F.col("place.file").alias("file"), F.floor(F.col("place.record") / _GROUP).alias("group")), "ord")
    return numbered.select("ord", "sequence_id", "sequence")


def range_bucket(df: DataFrame, column: str, number: int = 256) -> Column:
    """The range of values that a row's value falls in, of about `number` ranges of about equal size, cut at values of a bounded sample. How even they are doesn't bear on results."""
    sample = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).orderBy(F.xxhash64(column)).limit(16 * number).collect()]
    sample.sort()
    cuts = sorted(set(sample[:: max(1, len(sample) // number)]))
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(column))) if cuts else F.lit(0)


def from_table(df: DataFrame, id_col: str, sequence_col: str, order_col: str | None = None) -> DataFrame:
    """Rows (ord, sequence_id, sequence) of any table; repeated ids as in read_fasta. order_col, an integer, gives the order (the id's own order without it)."""
    base = df.select(F.col(id_col).cast("string").alias("sequence_id"), F.col(sequence_col).cast("string").alias("sequence"), (F.col(order_col) if order_col else F.col(id_col)).alias("place"))
    unique = dedup_last(base, "sequence_id", "place", ["sequence"])
    group = F.floor(F.col("place") / _GROUP) if order_col else range_bucket(unique, "place")
    return row_offsets(unique, ["place"], group, "ord").select("ord", "sequence_id", F.coalesce("sequence", F.lit("")).alias("sequence"))
