"""Completed row ranges: merging, containment, totals; and batches by a token budget."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("output_type", "layer", "head")


#: Starts of ranges that are sorted in one group, together with their key.
SPAN = 1 << 20


def _running(groups: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """groups (key, bucket, columns...) with the largest of each column over all buckets before: as many rows as there are buckets, never the ranges themselves."""
    before = Window.partitionBy(*key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return groups.select(*key, "__bucket", *[F.max(c).over(before).alias(f"{c}_before") for c in columns])


def _bucketed(df: DataFrame, groups: DataFrame, key: Sequence[str]) -> DataFrame:
    """df joined to the rows of its buckets; keys may be null."""
    names = [*key, "__bucket"]
    of = groups.select(*[F.col(k).alias(f"__of_{k}") for k in names], *[c for c in groups.columns if c not in names])
    on = [df[k].eqNullSafe(of[f"__of_{k}"]) for k in names]
    return df.join(of, functools.reduce(Column.__and__, on), "left").drop(*[f"__of_{k}" for k in names])


def merge(ranges: DataFrame, key: Sequence[str] = KEY, span: int = SPAN) -> DataFrame:
    """Half-open ranges (key, start, end) that touch or overlap, as one each.

    Ranges are sorted within buckets of `span` starts. What reaches over from earlier buckets comes from the table of
    buckets: the farthest end, and the start of the last merged range, which ranges of later buckets may go on with.
    """
    by = Window.partitionBy(*key, "__bucket").orderBy("start")
    ranges = ranges.groupBy(*key, "start").agg(F.max("end").alias("end")).withColumn("__bucket", F.floor(F.col("start") / span))  # one row for each start: no ties in the order below
    reach = _running(ranges.groupBy(*key, "__bucket").agg(F.max("end").alias("__reach")), key, ["__reach"])
    placed = _bucketed(ranges, reach, key).withColumn("__reach", F.greatest(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), "__reach_before"))
    fresh = placed.withColumn("__fresh", F.when(F.col("__reach").isNull() | (F.col("start") > F.col("__reach")), F.col("start")))
    last = _running(fresh.groupBy(*key, "__bucket").agg(F.max("__fresh").alias("__last")), key, ["__last"])
    begun = F.coalesce(F.max("__fresh").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "__last_before")
    return _bucketed(fresh, last, key).withColumn("__begun", begun).groupBy(*key, "__begun").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__begun")


def pending(wanted: DataFrame, completed: DataFrame, key: Sequence[str] = KEY, span: int = SPAN) -> DataFrame:
    """Wanted ranges that no completed range of their key contains. Keys may be null.

    A range is contained if, of the completed ones that start no later, one reaches its end: one sort by start within
    each key and bucket of starts, and no comparison of each range with each other.
    """
    done = completed.select(*key, "start", "end").withColumn("__asked", F.lit(0))
    both = wanted.withColumn("__asked", F.lit(1)).unionByName(done, allowMissingColumns=True).withColumn("__bucket", F.floor(F.col("start") / span))
    end = F.when(F.col("__asked") == 0, F.col("end"))
    reach = _running(both.groupBy(*key, "__bucket").agg(F.max(end).alias("__reach")), key, ["__reach"])
    before = Window.partitionBy(*key, "__bucket").orderBy("start", "__asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = _bucketed(both, reach, key).withColumn("__reach", F.greatest(F.max(end).over(before), "__reach_before"))
    return reached.where((F.col("__asked") == 1) & (F.col("__reach").isNull() | (F.col("__reach") < F.col("end")))).select(*wanted.columns)


def summary(ranges: DataFrame, key: Sequence[str] = KEY, row_bytes: DataFrame | None = None) -> DataFrame:
    """Ranges and rows for each key, and in all (all keys null and is_total). row_bytes (key, row_bytes) adds n_bytes: the bytes that the rows take."""
    size = F.col("end") - F.col("start")
    if row_bytes is not None:
        of = row_bytes.select(*[F.col(k).alias(f"__of_{k}") for k in key], "row_bytes")
        ranges = ranges.join(F.broadcast(of), functools.reduce(Column.__and__, [ranges[k].eqNullSafe(of[f"__of_{k}"]) for k in key]), "left")
    sums = {"n_rows": size, **({"n_bytes": size * F.col("row_bytes")} if row_bytes is not None else {})}
    rolled = ranges.withColumn("k", F.struct(*key)).rollup("k").agg(F.count("*").alias("n_ranges"), *[F.coalesce(F.sum(v), F.lit(0)).alias(n) for n, v in sums.items()], F.grouping("k").cast("int").alias("is_total"))
    return rolled.select(*[F.col(f"k.{k}").alias(k) for k in key], "n_ranges", *sums, "is_total")


def batch_id(row: Column, token_budget: int, length: Column | int) -> Column:
    """Number of a row's batch: batches hold budget // length rows, one at least."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.floor(row / F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(length, F.lit(1))))).cast("long")
