"""Extractors in relational form: pooling, attention averages, logits. Long tables, so the optimizer sees all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_by(df: DataFrame, keys: Sequence[str], value: str = "value", mask: str | None = None, name: str = "mean") -> DataFrame:
    """Mean of a value by keys over the rows that the mask selects; NaN for keys without such a row, so no key is lost."""
    value_in = F.when(F.col(mask), F.col(value)) if mask else F.col(value)
    return df.groupBy(*keys).agg(F.coalesce(F.avg(value_in), F.lit(float("nan"))).alias(name))


def masked_mean(rows: Column, mask: Column, width: int) -> Column:
    """Mean vector of the rows (array of arrays of `width`) that the mask selects, NaN without any."""
    kept = F.transform(F.filter(F.arrays_zip(rows.alias("r"), mask.alias("m")), lambda x: x["m"]), lambda x: x["r"])
    n = F.size(kept)
    total = F.aggregate(kept, F.array_repeat(F.lit(0.0), width), lambda acc, r: F.zip_with(acc, r, lambda a, b: a + b))
    return F.transform(total, lambda s: F.coalesce(F.try_divide(s, n), F.lit(float("nan"))))


def per_token(df: DataFrame, keys: Sequence[str], rows: str = "matrix", attention_mask: str | None = None, mask: str | None = None) -> DataFrame:
    """Rows (keys, pos, dim, value) of matrices; with an attention mask, places of padding are dropped. A mask (array) is laid beside the places: rows have its value in a column of its name."""
    beside = [attention_mask] if attention_mask else []
    if mask:
        places = F.arrays_zip(F.col(rows).alias("row"), F.col(mask).alias("mask"))
        each = df.select(*keys, *beside, F.posexplode(places).alias("pos", "at")).select(*keys, *beside, "pos", "at.row", F.col("at.mask").alias(mask))
    else:
        each = df.select(*keys, *beside, F.posexplode(rows).alias("pos", "row"))
    if attention_mask:
        each = each.where(F.element_at(attention_mask, F.col("pos") + 1) == 1)
    return each.select(*keys, *([mask] if mask else []), "pos", F.posexplode("row").alias("dim", "value"))


def attention_layer(df: DataFrame) -> DataFrame:
    """Mean over heads of rows (ord, layer, head, i, j, weight)."""
    return df.groupBy("ord", "layer", "i", "j").agg(F.avg("weight").alias("weight"))


def attention_model(df: DataFrame) -> DataFrame:
    """Mean over all layers and heads."""
    return df.groupBy("ord", "i", "j").agg(F.avg("weight").alias("weight"))


def _mean_of(arrays: Column) -> Column:
    """Mean of arrays of one length, place by place, in double."""
    zeros = F.transform(F.element_at(arrays, 1), lambda x: F.lit(0.0))
    total = F.aggregate(arrays, zeros, lambda acc, a: F.zip_with(acc, a, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(arrays))


def attention_rollup(heads: DataFrame) -> DataFrame:
    """Head, layer and model weights of attention heads (ord, layer, head, shape, values): rows (output_type, ord, layer, head, i, j, weight).

    A sequence's planes meet in one row, as they left the encoder, and are averaged as arrays; cells are rows at the end
    only, after the one shuffle.
    """
    plane = F.struct("layer", "head", "values")
    of = heads.groupBy("ord").agg(F.array_sort(F.collect_list(plane)).alias("planes"), F.max(F.element_at("shape", 2)).alias("width"))
    values = lambda planes: F.transform(planes, lambda p: p["values"])
    level = lambda name, layer, head, cells: F.struct(F.lit(name).alias("output_type"), layer.cast("int").alias("layer"), head.cast("int").alias("head"), cells.alias("cells"))
    none = F.lit(None)
    single = F.transform("planes", lambda p: level("attention_head", p["layer"], p["head"], F.transform(p["values"], lambda x: x.cast("double"))))
    layers = F.array_distinct(F.transform("planes", lambda p: p["layer"]))
    by_layer = F.transform(layers, lambda k: level("attention_layer", k, none, _mean_of(values(F.filter("planes", lambda p: p["layer"] == k)))))
    whole = F.array(level("attention_model", none, none, _mean_of(values(F.col("planes")))))
    each = of.select("ord", "width", F.inline(F.concat(single, by_layer, whole)))
    cells = each.select("output_type", "ord", "layer", "head", "width", F.posexplode("cells").alias("at", "weight"))
    return cells.select("output_type", "ord", "layer", "head", F.floor(F.col("at") / F.col("width")).cast("int").alias("i"), (F.col("at") % F.col("width")).alias("j"), "weight")


def vocabulary_plane(logits: DataFrame, token_id: int) -> DataFrame:
    """One token's logits at every place, of rows (ord, pos, token_id, logit)."""
    return logits.where(F.col("token_id") == token_id).select("ord", "pos", "logit")
