"""Secret scans, sharding and mixing against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from residua.llm import mixing, secrets, sharding

PATTERNS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]
KINDS = ["assign", "access", "hex", "owned"]


def base_spans(text):
    return sorted((m.start(), k, m.end(), m.group(g)) for k, (_, p, g, least) in enumerate(PATTERNS) for m in p.finditer(text) if len(m.group(g)) >= least)


def brute_scan(rows):
    found, owners, repositories = [], {}, {}
    for i, t, source, lang, *_ in rows:
        t = t or ""
        base = base_spans(t)
        wide = [(m.start(), 3, m.end(), m.group()) for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t)]
        wide = [w for w in wide if re.search("[0-9]", w[3]) and re.search("[A-Za-z]", w[3]) and re.search("[^0-9a-f]", w[3]) and not any(b[0] < w[2] and w[0] < b[2] for b in base)]
        for s in base + wide:
            owners.setdefault(s[3], set()).add(source or "")
            repositories.setdefault(s[3], set()).add((source or "", lang or ""))
        found.append((i, base, wide))
    out = []
    for i, base, wide in found:
        live = lambda s: len(owners[s[3]]) == 1 and len(repositories[s[3]]) <= 2 and len(set(s[3])) >= 10
        copied = lambda s: len(owners[s[3]]) >= 3 or len(repositories[s[3]]) >= 4
        most = lambda of: max((len(of[s[3]]) for s in base + wide), default=0)
        text = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in sorted(spans))
        added = [w for w in wide if live(w)]
        n = Counter(KINDS[s[1]] for s in base)
        out.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(text(base).encode()).hexdigest(), text(base + added), len(added), sum(map(copied, base)), sum(map(live, base)), most(owners), most(repositories)))
    return sorted(out, key=str)


def test_secrets_against_brute_force(spark):
    draw = random.Random(4)
    hexes = ["".join(draw.choice("0123456789abcdef") for _ in range(n)) for n in (31, 32, 40, 64)]
    bits = [
        'password: "token": "abcdefghijk"', "API_KEY='Abc_123=/x.'", "apikey=short", "Secret  :  xyzxyzxyz", "token=secret=abcdefghij", "AKIAABCDEFGHIJKL", "AKIASHORT", "xAKIAAKIA0123456789Z", *hexes,
        "tOkEn = " + hexes[2], "Xk39dkEOd02lsKDoe93kdlLA0s", "aaaaaaaaaaaaaaaaaaaaaaaa1", "passwordſecret=longenoughvalue", "é" * 5, "ſecret=12345678", "\n", "plain words",
    ]
    rows = [(k, " ".join(draw.choice(bits) for _ in range(draw.randint(0, 9))), draw.choice(["a", "b", "c", "d", None]), draw.choice(["en", None]), "x") for k in range(150)]
    rows += [(900, None, None, None, None), (901, "", "a", "en", "x"), (902, " ".join(f"{hexes[1]} token={k}abcdefgh" for k in range(700)), "a", "en", "x"), (7, rows[7][1], "e", "en", "x"), (7, rows[7][1], "e", "en", "x"), (None, "token=abcdefgh1", "a", "en", "x")]
    rows += [(1000 + k, "api_key: 9f8Kd02lsQz7x11 and Zk39dkEOd02lsKDoe93kdlLA0s", "one", f"l{k % n}", "x") for n in (5,) for k in range(6)] + [(1100 + k, "api_key: 7f8Kd02lsQz7x11", "two", f"l{k % 2}", "x") for k in range(4)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, owner string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_scan(rows)
    of = {r.doc_id: r for r in got.collect()}
    assert (of[1000].n_copied, of[1000].n_specific, of[1000].n_owned, of[1000].most_owners, of[1000].most_repositories) == (1, 0, 0, 1, 5)
    assert (of[1100].n_copied, of[1100].n_specific, of[1100].most_repositories) == (0, 1, 2)
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string, source string, lang string")).count() == 0


def brute_table(names, slots):
    """Turn by turn, over written-out preference lists."""
    lists = []
    for n in names:
        offset, skip = sharding.preference(n, slots)
        lists.append([(offset + j * skip) % slots for j in range(slots)])
    table = {}
    while len(table) < slots:
        for k, prefer in enumerate(lists):
            free = next((s for s in prefer if s not in table), None)
            if free is not None:
                table[free] = k
    return [table[s] for s in range(slots)]


@pytest.mark.parametrize("n,slots", [(1, 7), (3, 101), (7, 251), (13, 13)])
def test_lookup_table_against_brute_force(n, slots):
    names = [f"s{k}" for k in range(n)]
    assert sharding.lookup_table(names, slots) == brute_table(names, slots)


def test_lookup_table_is_even_and_stable():
    names = [f"s{k}" for k in range(20)]
    table = sharding.lookup_table(names, 65537)
    count = Counter(table)
    assert max(count.values()) - min(count.values()) <= 1
    less = sharding.lookup_table(names[:-1], 65537)
    assert sum(a != b for a, b in zip(table, less)) < 65537 * 0.15
    for bad in ((["a", "a"], 7), ([], 7), (["a"], 8), (list("abcdefgh"), 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placement(spark, tmp_path):
    rows = [(k, f"t{k}", "kept", 1) for k in range(500)] + [(None, f"n{k}", "kept", 1) for k in range(50)] + [(None, None, None, None), (3, "t3", "kept", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __x string, shard int")
    names = [f"s{k}" for k in range(5)]
    got = sharding.place(df, names, slots=1009).collect()
    table = sharding.lookup_table(names, 1009)
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "__x", "slot", "shard"}
    for r in got:
        key = str(r.doc_id) if r.doc_id is not None else "null:" + (r.text or "")
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 1009
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    assert len({r.shard for r in got if r.doc_id is None}) > 1
    sharding.write_shards(df, str(tmp_path / "out"), names, slots=1009)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
    assert sharding.place(df.where("false"), names).count() == 0


def brute_count(u, rate):
    k, p, below = 0, math.exp(-rate), 0.0
    while (below := below + p) < u and k < 5000:
        k += 1
        p = math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return k


def test_mixing_against_brute_force(spark):
    draw = random.Random(5)
    rows = [(k, f"t{k}", draw.choice(["a"] * 6 + ["b", "c", None]), "y", 2) for k in range(600)] + [(5000 + k, "tiny", "tiny", "y", 2) for k in range(2)] + [(None, "x", "b", None, None), (None, None, "b", None, None), (3, "t3", "a", "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `copy` string, n int")
    weights = {"a": 1.0, "b": 2.0, "tiny": 1.5, "zero": 3.0, "c": 0.0}
    got = mixing.mix(df, weights).collect()
    by = Counter(r[2] for r in rows)
    total = sum(weights.get(s, 1.0) for s in by)
    want = Counter()
    for i, t, s, *_ in rows:
        rate = weights.get(s, 1.0) / total * len(rows) / by[s]
        key = str(i) if i is not None else "null:" + (t or "")
        u = (int(hashlib.md5(f"17:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        for c in range(brute_count(u, rate) if rate else 0):
            want[i, t, s, c] += 1
    assert Counter((r.doc_id, r.text, r.source, r["copy"]) for r in got) == want
    assert not any(r.source == "c" for r in got) and sum(r.source == "tiny" for r in got) > 100
    shares = Counter(r.source for r in got)
    assert abs(shares["b"] / len(got) - 2 / total) < 0.1
    assert [r.doc_id for r in got if r.doc_id] != sorted(r.doc_id for r in got if r.doc_id)
    assert mixing.mix(df.where("false"), weights).count() == 0 and mixing.mix(df, {}, default_weight=0.0).count() == 0
    with pytest.raises(ValueError):
        mixing.rates(df, {"a": -1.0})


def test_large_rates_are_sums_of_parts(spark):
    rows = [(k, "heavy") for k in range(3)] + [(100 + k, "light") for k in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("text", F.lit("t"))
    got = mixing.mix(df, {"heavy": 1.0, "light": 1.0}, total=12_000, shuffle=False)
    counts = Counter(r.doc_id for r in got.where("source = 'heavy'").select("doc_id").collect())
    parts = -(-2000 // mixing.MOST_RATE)
    for i in range(3):
        want = 0
        for j in range(parts):
            u = (int(hashlib.md5(f"17:{i}{f'#{j}' if j else ''}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            want += brute_count(u, 2000 / parts)
        assert counts[i] == want and abs(want - 2000) < 300
    assert got.where("source = 'heavy'").select("doc_id", "copy").distinct().count() == sum(counts.values())


def test_one_document_at_a_rate_of_ten_million(spark):
    df = spark.createDataFrame([(1, "tiny", "t"), (2, "big", "t")], "doc_id long, source string, text string")
    got = mixing.mix(df, {"tiny": 1.0, "big": 1.0}, total=2e7, shuffle=False).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert all(abs(r.n - 10**7) < 20_000 for r in got) and len(got) == 2


def test_poisson_steps_cover_small_and_large_rates(spark):
    for rate in (0.001, 0.7, 19.5, 400.0, 30_000.0):
        first, steps = mixing.poisson_steps(F.lit(rate))
        r = spark.range(1).select(first.alias("f"), steps.alias("s")).first()
        assert abs(r.s[-1] - 1) < 1e-9
        for u in (0.01, 0.5, 0.99):
            count = r.f + sum(x < u for x in r.s)
            below = lambda k: sum(math.exp(j * math.log(rate) - rate - math.lgamma(j + 1)) for j in range(max(0, int(rate - 12 * rate**0.5) - 40), k + 1))
            assert below(count) >= u - 1e-9 and (count == 0 or below(count - 1) < u + 1e-9)
