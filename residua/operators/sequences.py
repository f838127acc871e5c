"""Sequence tables: order, duplicate ids, tokenisation, validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.functions import tokens as T
from residua.functions.vocabulary import Vocabulary


def row_offsets(df: DataFrame, order: Sequence[str], bucket: Column, name: str = "row") -> DataFrame:
    """df with its 0-based row number in `order`.

    bucket must not fall along the order. Rows are numbered within buckets, and the sizes of the buckets before are
    added: only the table of buckets passes through one task, never the rows.
    """
    rows = df.withColumn("__bucket", bucket)
    sizes = rows.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = sizes.select(F.col("__bucket").alias("__of"), (F.sum("__n").over(Window.orderBy("__bucket")) - F.col("__n")).alias("__before"))
    number = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    numbered = rows.withColumn("__number", number).join(before, F.col("__bucket").eqNullSafe(F.col("__of")))
    return numbered.withColumn(name, (F.col("__before") + F.col("__number") - 1).cast("long")).drop("__bucket", "__number", "__before", "__of")


def dedup_last(df: DataFrame, key: str, order: str, values: Sequence[str]) -> DataFrame:
    """One row for each key: the values of its last row, and the place of its first (`order`)."""
    last = F.max_by(F.struct(*values), F.col(order)).alias("__last")
    return df.groupBy(key).agg(F.min(order).alias(order), last).select(key, order, *[F.col(f"__last.{v}").alias(v) for v in values])


def auto_id(header: Column, line: Column) -> Column:
    """The header, or seqnum and the nine-digit line number where it is empty."""
    return F.coalesce(F.nullif(header, F.lit("")), F.format_string("seqnum%09d", line))


def tokenise(df: DataFrame, vocabulary: Vocabulary, specials: bool = True, sequence: str = "sequence") -> DataFrame:
    """df with tokens, input_ids (with special tokens, not padded) and pooling_mask."""
    with_tokens = df.withColumn("tokens", T.split_tokens(F.col(sequence), vocabulary.bracket))
    ids = T.add_specials(T.encode(F.col("tokens"), vocabulary), vocabulary, specials)
    return with_tokens.withColumn("input_ids", ids).withColumn("pooling_mask", T.pooling_mask(F.col("input_ids"), vocabulary))


def longest(df: DataFrame, ids: str = "input_ids") -> int:
    """The most ids of a row, 0 for no rows: one aggregate."""
    return df.agg(F.max(F.size(ids)).alias("n")).first()["n"] or 0


def invalid(df: DataFrame, vocabulary: Vocabulary, id_col: str = "sequence_id", limit: int | None = None) -> DataFrame:
    """Rows (id, n_tokens, unknown): sequences with tokens outside the vocabulary, or with more tokens than the limit."""
    own = df.select(id_col, F.size("tokens").alias("n_tokens"), T.unknown_tokens(F.col("tokens"), vocabulary).alias("unknown"))
    bad = F.size("unknown") > 0
    return own.where(bad | (F.col("n_tokens") > limit) if limit is not None else bad)


def require_valid(df: DataFrame, vocabulary: Vocabulary, id_col: str = "sequence_id", limit: int | None = None) -> None:
    """Raises for the first few invalid sequences."""
    bad = invalid(df, vocabulary, id_col, limit).take(5)
    if bad:
        raise ValueError("sequences with unknown tokens or too many: " + "; ".join(f"{r[id_col]} ({r['n_tokens']} tokens): {', '.join(r['unknown'])}" for r in bad))
