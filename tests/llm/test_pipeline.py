import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import xxhash

import corpus_pipeline
from residua.llm import toxicity
from residua.llm._common import table
from residua.llm.queries import SHARDS, WEIGHTS
from residua.llm.sharding import SLOTS, lookup_table
from tests.llm.test_decontamination import brute_alignment


def shingles(text):
    words = text.encode().lower().split()
    return {xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))} if words else {0}


def one_of_each(docs):
    sets, first = {}, {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        s = shingles(d["text"])
        sets[d["doc_id"]] = s
    ids = sorted(sets)
    group = {i: i for i in ids}
    holders = {}
    for i in ids:
        for x in sets[i]:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for v in holders.values() for k, a in enumerate(v) for b in v[k + 1 :]}
    for a, b in pairs:
        shared = len(sets[a] & sets[b])
        if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
            x, y = sorted((group[a], group[b]))
            if x != y:
                group = {i: x if g == y else g for i, g in group.items()}
    for i in ids:
        first.setdefault(group[i], i)
    return set(first.values())


def copies_of(bench, docs):
    """Plain alignment of every item with every document, but for pairs that share too few words for the score, whatever their order."""
    words = lambda t: re.findall(r"[0-9a-z\u0080-\uffff]+", (t or "").lower())
    found = set()
    items = [words(r["text"]) for r in bench]
    for d in docs:
        own = words(d["text"])
        there = set(own)
        for item in items:
            if item and sum(w in there for w in item) >= 0.6 * len(item) and brute_alignment(item, own) >= 0.6 * 2 * len(item):
                found.add(d["doc_id"])
                break
    return found


def poisson(u, rate):
    k, p, below = 0, math.exp(-rate), 0.0
    while (below := below + p) < u and k < 1000:
        k += 1
        p *= rate / k
    return k


def test_every_stage_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    now = [r.asDict() for r in docs.collect()]

    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scores = model.score(pa.array([d["text"] for d in now], pa.string()))
    want = {d["doc_id"] for d, s in zip(now, scores) if s < 0.3}
    steps = dict(corpus_pipeline.STAGES)
    frame = steps["toxicity"](spark, docs, sf_dir)
    assert frame.columns == columns and {r.doc_id for r in frame.collect()} == want
    now = [d for d in now if d["doc_id"] in want]

    want = one_of_each(now)
    frame = steps["simhash near-dedup"](spark, frame, sf_dir)
    assert frame.columns == columns and {r.doc_id for r in frame.collect()} == want and frame.count() == len(want) < len(now)
    now = [d for d in now if d["doc_id"] in want]

    gone = copies_of(table(spark, sf_dir, "benchmark").collect(), now)
    frame = steps["benchmark decontamination"](spark, frame, sf_dir)
    assert gone and frame.columns == columns and {d["doc_id"] for d in now} - {r.doc_id for r in frame.collect()} == gone
    now = [d for d in now if d["doc_id"] not in gone]

    by = Counter(d["source"] for d in now)
    total = sum(WEIGHTS.get(s, 1.0) for s in by)
    want = Counter()
    for d in now:
        rate = WEIGHTS.get(d["source"], 1.0) / total * len(now) / by[d["source"]]
        u = (int(hashlib.md5(f"17:{d['doc_id']}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        if n := poisson(u, rate):
            want[d["doc_id"]] = n
    frame = steps["mixing to target weights"](spark, frame, sf_dir)
    assert frame.columns == columns and Counter(r.doc_id for r in frame.collect()) == want

    lookup = lookup_table(SHARDS)
    got = steps["sharding"](spark, frame, sf_dir).collect()
    assert Counter(r.doc_id for r in got) == want
    for r in got:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % SLOTS
        assert (r.slot, r.shard) == (slot, SHARDS[lookup[slot]])
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.columns == [*columns, "slot", "shard"] and Counter(r.doc_id for r in whole.collect()) == want
