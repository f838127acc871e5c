"""Contiguous subsequence search over token arrays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def starts(tokens: Column, sub: Column) -> Column:
    """1-based places at which sub stands in tokens; overlapping ones included, none for an empty or null sub."""
    n, m = F.size(tokens), F.size(sub)
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), n - m + 1))
    found = F.filter(places, lambda s: F.slice(tokens, s, m) == sub)
    return F.when((m > 0) & (m <= n), found).otherwise(F.array().cast("array<int>"))


def mask(tokens: Column, places: Column, length: Column, context: int = 0) -> Column:
    """True for each token of an occurrence or within `context` tokens of one; the union over occurrences, clipped to the tokens."""
    return F.transform(tokens, lambda _, i: F.exists(places, lambda s: (i + 1 >= s - context) & (i + 1 < s + length + context)))


def first_span(tokens: Column, sub: Column, context: int = 0, before: int = 0) -> Column:
    """struct<start, end> (0-based, end exclusive) of the first occurrence with context, clipped to the tokens and moved by the special tokens before them; null if there is none."""
    first = F.element_at(starts(tokens, sub), 1) - 1
    start = F.greatest(first - context, F.lit(0))
    end = F.least(first + F.size(sub) + context, F.size(tokens))
    return F.when(F.size(starts(tokens, sub)) > 0, F.struct((start + before).alias("start"), (end + before).alias("end")))


def degap(substring: Column) -> Column:
    return F.replace(substring, F.lit("-"), F.lit(""))


def with_specials(row_mask: Column, before: int, after: int) -> Column:
    """A mask over residues as a mask over residues and the special tokens around them."""
    no = lambda n: F.array_repeat(F.lit(False), n)
    return F.concat(no(before), row_mask, no(after))
