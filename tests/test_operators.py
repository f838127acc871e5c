import random

import pytest

from residua.operators import ranges, sequences, substrings
from residua.functions.vocabulary import protein
from pyspark.sql import functions as F

RANGE = "output_type string, layer int, head int, start long, end long"


def brute_merge(rows):
    out = {}
    for *key, s, e in sorted(rows, key=lambda r: (str(r[:3]), r[3], r[4])):
        own = out.setdefault(tuple(key), [])
        if own and s <= own[-1][1]:
            own[-1][1] = max(own[-1][1], e)
        else:
            own.append([s, e])
    return sorted(((*k, *r) for k, v in out.items() for r in v), key=str)


def test_merge_pending_summary(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "b"]), draw.choice([None, 1]), None, s := draw.randrange(60), s + draw.randint(1, 6)) for _ in range(60)] + [("c", 1, 1, 0, 4), ("c", 1, 1, 4, 8)]
    df = spark.createDataFrame(rows, RANGE)
    merged = [tuple(r) for r in ranges.merge(df).collect()]
    assert sorted(merged, key=str) == brute_merge(rows) and ("c", 1, 1, 0, 8) in merged
    assert sorted(map(tuple, ranges.merge(ranges.merge(df)).collect()), key=str) == brute_merge(rows)
    asked = [(k, l, None, s, s + 3) for k in ("a", "b") for l in (None, 1) for s in range(0, 66, 3)]
    got = {tuple(r) for r in ranges.pending(spark.createDataFrame(asked, RANGE), spark.createDataFrame(merged, RANGE)).collect()}
    assert got == {q for q in asked if not any(m[:3] == q[:3] and m[3] <= q[3] and q[4] <= m[4] for m in merged)}
    total = [r for r in ranges.summary(spark.createDataFrame(merged, RANGE)).collect() if r.is_total]
    assert len(total) == 1 and total[0].n_ranges == len(merged) and total[0].n_rows == sum(m[4] - m[3] for m in merged)


def test_batches(spark):
    got = spark.range(10).select(ranges.batch_id(F.col("id"), 1024, 300).alias("a"), ranges.batch_id(F.col("id"), 10, 300).alias("b")).collect()
    assert [r.a for r in got] == [i // 3 for i in range(10)] and [r.b for r in got] == list(range(10))


def test_row_offsets(spark):
    draw = random.Random(2)
    values = sorted(draw.sample(range(10**6), 500))
    df = spark.createDataFrame([(v,) for v in draw.sample(values, 500)], "v long")
    got = {r.v: r["row"] for r in sequences.row_offsets(df, ["v"], F.floor(F.col("v") / 10_000)).collect()}
    assert got == {v: i for i, v in enumerate(values)}


def test_dedup_last_and_auto_id(spark):
    df = spark.createDataFrame([(0, "a", "1"), (1, "b", "2"), (2, "a", "3")], "ord long, id string, seq string")
    assert sorted(tuple(r) for r in sequences.dedup_last(df, "id", "ord", ["seq"]).collect()) == [("a", 0, "3"), ("b", 1, "2")]
    got = spark.createDataFrame([("x y>z", 3), ("", 7)], "h string, n long").select(sequences.auto_id(F.col("h"), F.col("n"))).collect()
    assert [r[0] for r in got] == ["x y>z", "seqnum000000007"]


def test_validation(spark):
    v = protein(True)
    rows = sequences.tokenise(spark.createDataFrame([("ok", "ACX"), ("bad", "AC*"), ("long", "A" * 300)], "sequence_id string, sequence string"), v, False)
    assert {r.sequence_id: r.unknown for r in sequences.invalid(rows, v).collect()} == {"bad": ["*"]}
    assert {r.sequence_id for r in sequences.invalid(rows, v, limit=256).collect()} == {"bad", "long"}
    with pytest.raises(ValueError, match="bad"):
        sequences.require_valid(rows, v)
    sequences.require_valid(rows.where("sequence_id <> 'bad'"), v)
    assert sequences.longest(rows) == 300 and sequences.longest(rows.where("false")) == 0


def test_substring_completeness(spark):
    seqs = spark.createDataFrame([("a",), ("b",)], "sequence_id string")
    subs = spark.createDataFrame([("a", "x"), ("z", "y")], "sequence_id string, substring string")
    assert [tuple(r) for r in substrings.join(seqs, subs).collect()] == [("a", "x")]
    with pytest.raises(ValueError, match="b"):
        substrings.require_complete(seqs, subs)
    substrings.require_complete(seqs.where("sequence_id = 'a'"), subs)
