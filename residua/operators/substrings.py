"""Substring tables: joins with sequences, completeness, masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions import subsequence as S
from residua.functions import tokens as T
from residua.functions.vocabulary import Vocabulary


def join(sequences: DataFrame, substrings: DataFrame, key: str = "sequence_id") -> DataFrame:
    """Sequences that have a substring, with it; substrings of other ids are ignored. Sides are sized by the optimizer, not by a hint."""
    return sequences.join(substrings, key)


def missing(sequences: DataFrame, substrings: DataFrame, key: str = "sequence_id") -> DataFrame:
    """Ids of sequences without a substring."""
    return sequences.join(substrings, key, "left_anti").select(key)


def require_complete(sequences: DataFrame, substrings: DataFrame, key: str = "sequence_id") -> None:
    bad = [r[0] for r in missing(sequences, substrings, key).take(5)]
    if bad:
        raise ValueError(f"sequences without a substring: {', '.join(map(str, bad))}")


def with_mask(sequences: DataFrame, vocabulary: Vocabulary, context: int = 0, specials: bool = True) -> DataFrame:
    """sequences (tokens, substring) with substring_mask over input_ids: all occurrences with their context, special tokens never."""
    sub = T.split_tokens(F.col("substring"), vocabulary.bracket)
    rows = sequences.withColumn("__sub", sub).withColumn("__starts", S.starts(F.col("tokens"), F.col("__sub")))
    own = S.mask(F.col("tokens"), F.col("__starts"), F.size("__sub"), context)
    return rows.withColumn("substring_mask", S.with_specials(own, *T.n_specials(vocabulary, specials))).drop("__sub", "__starts")
