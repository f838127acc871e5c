"""Mixing sources to target weights by Poisson replication.

A source's rows are repeated at a mean rate that brings its share to its target. Each row's count inverts the Poisson
distribution of that rate at a uniform number hashed from its key and a seed: counts are the same in every run and need
no random state. Rows are then exploded by their counts and shuffled by a hashed order.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.llm._common import durable

#: Bytes up to which the table of rates is broadcast; beyond it, rates are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: A larger mean rate is the sum of the counts of parts of equal rates, so no row has more than about MOST_RATE copies at
#: once. PART numbers the copies of a part: no count of MOST_RATE reaches it.
MOST_RATE, PART = 500, 1024


def uniform(seed: int, key: Column, fallback: Column, part: Column | None = None) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of seed and key, and of the part's number but for the first part."""
    text = [F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.concat(F.lit("null:"), F.coalesce(fallback.cast("string"), F.lit(""))))]
    if part is not None:
        text.append(F.when(part == 0, "").otherwise(F.concat(F.lit("#"), part.cast("string"))))
    digest = F.md5(F.concat(*text))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def poisson_steps(rate: Column) -> tuple[Column, Column]:
    """First count and cumulative probabilities from it on: the count of u is first + how many of them are below u. Covers all but 1e-16 of the mass for any rate."""
    far = 9 * F.sqrt(rate) + 30
    first = F.greatest(F.lit(0), F.floor(rate - far)).cast("int")
    last = F.ceil(rate + far).cast("int")
    # log k! by Stirling's series above 20, and as a sum below.
    small = [0.0]
    for k in range(1, 21):
        small.append(small[-1] + math.log(k))
    table = F.array(*[F.lit(x) for x in small])

    def log_factorial(k: Column) -> Column:
        x = k.cast("double")
        series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
        return F.when(k <= 20, F.element_at(table, k + 1)).otherwise(series)

    mass = F.transform(F.sequence(first, last), lambda k: F.exp(k * F.log(rate) - rate - log_factorial(k)))
    empty = F.array().cast("array<double>")
    sums = F.aggregate(mass, F.struct(F.lit(0.0).alias("s"), empty.alias("all")), lambda a, p: F.struct((a.s + p).alias("s"), F.concat(a["all"], F.array(a.s + p)).alias("all")), lambda a: a["all"])
    return first, sums


def rates(docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, source_col: str = "source", total: float | None = None) -> DataFrame:
    """Rows (source, n, rate): rate * n is the source's share of `total` rows (the number of rows of docs unless given) by its weight. Sources without a given weight have the default; a null source is a source of its own."""
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if any(w < 0 for w in [*weights.values(), default_weight]):
        raise ValueError("weights must not be negative")
    given = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]) if weights else None
    weight = F.coalesce(F.try_element_at(given, F.col("source")), F.lit(float(default_weight))) if weights else F.lit(float(default_weight))
    weighed = durable(counts.withColumn("weight", weight))
    sums = weighed.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    if not sums["n"] or not sums["weight"]:
        return weighed.select("source", "n", F.lit(0.0).alias("rate"))
    return weighed.select("source", "n", (F.col("weight") / F.lit(float(sums["weight"])) * F.lit(float(total if total is not None else sums["n"])) / F.col("n")).alias("rate"))


def mix(docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, total: float | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy_name: str = "copy", shuffle: bool = True) -> DataFrame:
    """docs with each row repeated by its Poisson count (0 drops it) and a column `copy` (long, different for each copy of a row), in a global random order.

    A count at a mean rate over MOST_RATE is the sum of the counts of parts, each inverted at a number of its own: sums of
    Poisson counts are Poisson counts. The rows of such sources are dealt out by their parts before they are copied.
    copy is the number within the part, plus PART for each part before.

    Nulls: rows without id are drawn by their text (null: empty); a null source is a source of its own. Texts are not
    changed, however long. Repeated rows of an id get equal counts. A column of docs named like `copy_name` is replaced.
    An empty table gives an empty table.
    """
    known = rates(docs, weights, default_weight, source_col, total).where("rate > 0")
    parts = F.greatest(F.ceil(F.col("rate") / MOST_RATE), F.lit(1)).cast("long")
    first, steps = poisson_steps(F.col("rate") / parts)
    of = durable(known.select(F.col("source").alias("__residua_source"), parts.alias("__residua_parts"), first.alias("__residua_first"), steps.alias("__residua_steps")))
    sizes = of.agg(F.sum(8 * F.size("__residua_steps") + F.coalesce(F.length("__residua_source"), F.lit(0)) + 80).alias("bytes"), F.max("__residua_parts").alias("parts")).first()
    of = F.broadcast(of) if (sizes["bytes"] or 0) <= BROADCAST_BYTES else of
    kept = [c for c in docs.columns if c != copy_name]
    columns = [F.col(f"`{c}`") for c in kept]
    # Uniform numbers are made below the join, and for parts below the shuffle, so that they are made once for each row.
    rows = docs.withColumn("__residua_u", uniform(seed, F.col(id_col), F.col(text_col))).join(of, F.col(source_col).cast("string").eqNullSafe(F.col("__residua_source"))).drop("__residua_source")

    def copied(rows: DataFrame, part: Column) -> DataFrame:
        count = F.col("__residua_first") + F.size(F.filter("__residua_steps", lambda p: p < F.col("__residua_u")))
        drawn = rows.withColumn("__residua_n", count).where("__residua_n > 0")
        number = F.explode(F.expr("sequence(0, __residua_n - 1)")).alias("__residua_k")
        return drawn.select(*columns, part.alias("__residua_part"), number).select(*columns, (F.col("__residua_part") * PART + F.col("__residua_k")).alias(copy_name))

    copies = copied(rows.where("__residua_parts = 1"), F.lit(0).cast("long"))
    if (sizes["parts"] or 0) > 1:
        # Parts are numbered in two steps, so that no row holds an array of all of them.
        many = rows.where("__residua_parts > 1").withColumn("__residua_block", F.explode(F.expr("sequence(0, (__residua_parts - 1) div 10000)")))
        many = many.withColumn("__residua_part", F.explode(F.expr("sequence(__residua_block * 10000, least(__residua_block * 10000 + 9999, __residua_parts - 1))")))
        many = many.withColumn("__residua_u", uniform(seed, F.col(id_col), F.col(text_col), F.col("__residua_part")))
        dealt = many.repartition(F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col)), "__residua_part"))
        copies = copies.unionByName(copied(dealt, F.col("__residua_part")))
    if not shuffle:
        return copies
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col)), F.col(copy_name))
    return copies.withColumn("__residua_order", order).repartition("__residua_order").sortWithinPartitions("__residua_order").drop("__residua_order")
