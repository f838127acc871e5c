import random

import numpy as np
import pytest
import xxhash

from residua.llm import simhash
from residua.llm.simhash import _sampled, bit_sliced_pairs, keep_one_of_each, links, near_groups
from tests.llm.test_pipeline import one_of_each

SCHEMA = "doc_id long, text string, id string, w0 string, `group` int"


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    comp = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius and comp[i] != comp[j]:
                comp = [comp[j] if c == comp[i] else c for c in comp]
    return comp


def corpus():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefÉÜ") for _ in range(draw.randint(1, 6)))
    texts = [None, "", "  \n\t ", "one", "One", "two  words", "TWO words", "x" * 50_000, "　a b c"]
    for _ in range(12):
        base = [word() for _ in range(draw.randint(40, 900))]
        texts.append(" ".join(base))
        for _ in range(5):
            copy = list(base)
            copy[draw.randrange(len(copy))] = word()
            texts.append("\n".join(copy))
    return [(1000 - i, t, "a", "b", 1) for i, t in enumerate(texts)] + [(5, texts[9], "a", "b", 1), (5, texts[9], "a", "b", 1), (None, texts[9], None, None, None), (None, "alone here now", None, None, None)]


def test_near_groups_against_brute_force(spark):
    rows = corpus()
    got = near_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    comp = brute_components(fps, 2)
    least = {c: min((r[0] for r, k in zip(rows, comp) if k == c and r[0] is not None), default=None) for c in comp}
    want = sorted(((r[0], f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, comp)), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_near_groups_of_an_empty_table(spark):
    assert near_groups(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("radius,width", [(0, 1), (2, 1), (7, 1), (27, 2)])
def test_bit_sliced_pairs(radius, width):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (40, width), dtype=np.uint64)
    words = base[rng.integers(0, 40, 300)]
    for _ in range(radius):
        words[:, rng.integers(0, width)] ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    low, high = np.arange(300) + 1, np.full(300, 300)
    high[:100] = 100
    got = {(int(a), int(b)): int(d) for x in bit_sliced_pairs(words, low, high, radius, slab=64) for a, b, d in zip(*x)}
    dist = np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2)
    want = {(i, j): int(dist[i, j]) for i in range(300) for j in range(i + 1, high[i]) if dist[i, j] <= radius}
    assert got == want and want


def test_split_buckets_lose_no_link(spark):
    rng = np.random.default_rng(2)
    values = np.unique((rng.integers(0, 1 << 62, 60)[:, None] ^ (1 << rng.integers(0, 60, (60, 8)))).ravel())
    df = spark.createDataFrame([(int(v), int(v)) for v in values], "id long, w0 long")
    parts = [set(), set()]
    for out, block in zip(parts, (10_000, 16)):
        for a, b in links(df, [0], 2, block=block).collect():
            assert bin(a ^ b).count("1") <= 2
            out.add((a, b))
    fps = [int(v) for v in values]
    want = brute_components(fps, 2)
    for got in parts:
        comp = {f: f for f in fps}
        for a, b in got:
            x, y = comp[a], comp[b]
            comp = {f: y if c == x else c for f, c in comp.items()}
        assert len(set(comp.values())) == len(set(want))


def test_keep_one_of_each(spark):
    draw = random.Random(5)
    base = [[f"w{draw.randrange(10**6)}" for _ in range(200)] for _ in range(20)]
    rows = []
    for k, words in enumerate(base):
        rows.append((k, " ".join(words), "en"))
        rows.append((100 + k, " ".join(words), "fr"))
        copy = list(words)
        for _ in range(3):
            copy[draw.randrange(200)] = "edit"
        rows.append((200 + k, " ".join(copy), "en"))
        rows.append((300 + k, " ".join(words[:100] + [f"z{draw.randrange(10**6)}" for _ in range(100)]), "en"))
    rows += [(400, None, None), (401, "", None), (None, base[0][0], None), (7, " ".join(base[7]), "en")]
    got = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, w0 string")).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted([*range(20), *range(300, 320), 400, None], key=str)
    assert keep_one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sampled_masks_are_deterministic_and_grow():
    assert _sampled(128, 0.15, 1000, 0.97) == _sampled(128, 0.15, 1000, 0.97)
    assert len(_sampled(128, 0.15, 10**8, 0.97)) > len(_sampled(128, 0.15, 1000, 0.97))
    assert len(_sampled(256, 0.1515, 50_000, 0.998)) == len(_sampled(256, 0.1515, 250_000, 0.998)) and len(_sampled(256, 0.1515, 13_500_000, 0.998)) < 64


def test_rejected_links_hide_no_pair(spark):
    rows = []
    for family in range(6):
        draw = random.Random(family)
        base = [f"w{draw.randrange(10**6)}" for _ in range(200)]
        for k in range(60):
            copy = list(base)
            for _ in range(3):
                copy[draw.randrange(200)] = f"e{draw.randrange(10**6)}"
            rows.append((family * 100 + k, " ".join(copy)))
    want = one_of_each([{"doc_id": i, "text": t} for i, t in rows])
    got = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == want


def test_families_near_the_threshold(spark):
    """Recall against the exact Jaccard similarity of all pairs, for families of copies at similarities around 0.8."""
    rows = []
    for family in range(300):
        draw = random.Random(family)
        base = [f"w{draw.randrange(10**6)}" for _ in range(draw.randint(60, 260))]
        for k in range(8):
            copy = list(base)
            edits = max(1, round(len(base) * draw.uniform(0.004, 0.03)))
            for _ in range(edits if k else 0):
                copy[draw.randrange(len(copy))] = f"e{draw.randrange(10**6)}"
            rows.append((draw.randrange(10**9) * 2400 + family * 8 + k, " ".join(copy)))
    want = one_of_each([{"doc_id": i, "text": t} for i, t in rows])
    got = {r.doc_id for r in keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = {i for i, _ in rows} - want
    assert len(gone) > 1000
    print("wrongly kept", len(got - want), "of", len(gone), "wrongly dropped", len(want - got))
    assert len(got - want) <= 0.005 * len(gone) and not want - got


def test_rows_that_share_an_id(spark):
    draw = random.Random(4)
    a, b, c = (" ".join(f"w{draw.randrange(10**6)}" for _ in range(80)) for _ in range(3))
    rows = [("x", a, 1), ("x", b, 2), ("x", b, 1), ("y", b, 3), ("y", c, None), ("z", a, 5), (None, a, 6), (None, a, 6)]
    want = sorted([("x", a), ("x", b), ("y", c), (None, a), (None, a)], key=str)
    for parts in (1, 5):
        got = keep_one_of_each(spark.createDataFrame(rows, "doc_id string, text string, n int").repartition(parts)).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == want
    groups = {(r.doc_id, r.component_id) for r in near_groups(spark.createDataFrame(rows, "doc_id string, text string, n int")).collect()}
    assert groups == {("x", "x"), ("y", "x"), ("y", "y"), ("z", "x"), (None, "x")}


def test_groups_of_masks_find_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 40)
    df = spark.createDataFrame([(k, int(base[k % 40] ^ (1 << (k % 60)))) for k in range(400)], "id long, w0 long")
    masks = _sampled(64, 0.05, 400, 0.99)
    found = []
    for size in (100, 3):
        monkeypatch.setattr(simhash, "MASKS_AT_ONCE", size)
        found.append({tuple(r) for r in simhash.found_links(df, masks, 3).collect()})
    assert found[0] == found[1] and len(found[0]) > 300


@pytest.mark.parametrize("block,shingles", [(1024, 1 << 20), (7, 1 << 20), (1024, 90)])
def test_joining_links_against_brute_force(spark, block, shingles):
    draw = random.Random(6)
    rows = []
    for cluster in range(6):
        base = [draw.randrange(1 << 60) for _ in range(40)]
        for k in range(25):
            own = sorted(set(base[draw.randrange(6) :]) | {draw.randrange(1 << 60) for _ in range(draw.randrange(5))})
            rows.append((len(rows), cluster, len(rows) if draw.random() < 0.6 else 1000 + cluster, draw.randrange(4), own))
    df = spark.createDataFrame(rows, "id long, cluster long, component long, w0 long, shingles array<long>")
    got = [tuple(r) for r in simhash.joining_links(df, 1, 2, 0.8, block, shingles).collect()]
    alike = lambda x, y: len({*x} & {*y}) >= 0.8 * len({*x} | {*y})
    assert all(alike(rows[a][4], rows[b][4]) and rows[a][2] != rows[b][2] and rows[a][1] == rows[b][1] for a, b in got) and got
    group = {}

    def top(c):
        while group.get(c, c) != c:
            c = group[c]
        return c

    def groups(pairs):
        group.clear()
        for a, b in pairs:
            group[top(rows[a][2])] = top(rows[b][2])
        return sorted(min(r[0] for r in rows if top(r[2]) == c) for c in {top(r[2]) for r in rows})

    every = [(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and x[2] != y[2] and bin(x[3] ^ y[3]).count("1") <= 2 and alike(x[4], y[4])]
    assert groups(got) == groups(every) and len(got) < len(every)
