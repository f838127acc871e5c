import random

import pytest

from residua.llm._common import chunks, durable, flat
from residua.llm._components import components
import pyarrow as pa


def brute(edges):
    group = {}
    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        x, y = group.setdefault(a, a), group.setdefault(b, b)
        if x != y:
            low, high = min(x, y), max(x, y)
            group = {k: low if v == high else v for k, v in group.items()}
    return group


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components_against_brute_force(spark, shape):
    draw = random.Random(7)
    edges = {
        "random": [(draw.randrange(120), draw.randrange(120)) for _ in range(70)] + [(5, 5), (None, 3), (1, 2), (1, 2), (2, 1)],
        "path": [(k, k + 1) for k in draw.sample(range(64), 64)],
        "star": [(500, k) for k in range(60)],
        "none": [(4, 4)],
    }[shape]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == brute(edges) and len(got) == len({r.node for r in got})


def test_durable_keeps_rows_and_schema(spark):
    df = spark.range(5).selectExpr("id", "array(id) AS x", "cast(null AS string) AS s")
    kept = durable(df)
    assert kept.schema.names == df.schema.names and sorted(kept.collect()) == sorted(df.collect())
    assert "Scan parquet" in kept._jdf.queryExecution().toString() or "FileScan parquet" in kept._jdf.queryExecution().toString()


def test_chunks_hold_every_row_once():
    texts = ["a" * n for n in (3, 50, 1, 0, 200, 2)] + [None]
    batch = pa.record_batch({"text": texts, "n": list(range(7))})
    parts = list(chunks([batch, batch.slice(0, 0), batch.slice(2)], "text", 60))
    assert [x for p in parts for x in p.column("n").to_pylist()] == [*range(7), *range(2, 7)]
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 60 for p in parts)
    for p in parts:
        data, offsets = flat(p.column("text"))
        assert [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])] == [t or "" for t in p.column("text").to_pylist()]
