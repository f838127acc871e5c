import random
import re

import numpy as np
import pyarrow as pa

from residua.llm._words import gram_hashes, word_hashes
from residua.llm.decontamination import drop_copies, matches, smith_waterman


def brute_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_smith_waterman_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 20)), rng.integers(0, 5, rng.integers(1, 30))
        assert smith_waterman(a, b) == brute_alignment(a.tolist(), b.tolist())


def test_word_hashes():
    texts = ["The cat, THE Écat!", "", None, "cat", " x9 the\ncat", "y" * 5000]
    words, offsets = word_hashes(pa.array(texts))
    plain = [w for t in texts for w in re.findall(r"[0-9a-z\u0080-￿]+", (t or "").lower())]
    assert len(words) == len(plain) and offsets.tolist() == [0, 4, 4, 4, 5, 8, 9]
    for i, x in enumerate(plain):
        for j, y in enumerate(plain):
            assert (words[i] == words[j]) == (x == y)
    assert len(gram_hashes(words, 20)) == 0 and gram_hashes(words, 2)[0] == gram_hashes(word_hashes(pa.array(["the cat"]))[0], 2)[0]


def made(spark):
    draw = random.Random(11)
    vocabulary = [f"w{draw.randrange(4000)}" for _ in range(1500)] + ["the", "of"] * 400
    say = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [say(draw.randint(15, 60)) for _ in range(30)] + [["lone"], ["two", "words"]]
    docs, want = [], set()
    for i in range(400):
        words = say(draw.randint(20, 400))
        if i % 4 == 0:
            k = draw.randrange(30)
            copy = list(items[k])
            if i % 8 == 0:
                for _ in range(len(copy) // 8):
                    copy[draw.randrange(len(copy))] = "edited"
                copy.insert(len(copy) // 2, "inserted")
            at = draw.randrange(len(words))
            words[at:at] = copy
            want.add((i, k))
        docs.append((i, " ".join(words), "x", 1.0))
    docs += [(900, "a lone voice", "", 0.0), (901, None, None, None), (902, "", "", 0.0), (None, " ".join(items[3]), "", 0.0), (903, " ".join(items[5]), "", 0.0), (903, " ".join(items[5]), "", 0.0)]
    bench = [(k, " ".join(w).upper()) for k, w in enumerate(items)] + [(40, None), (41, ""), (None, "no id"), (3, " ".join(items[3]).upper())]
    want |= {(900, 30), (None, 3), (903, 5)}
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string, score double"), spark.createDataFrame(bench, "item_id long, text string"), want


def test_copies_and_edited_copies_are_found(spark):
    docs, bench, want = made(spark)
    got = matches(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {(r.doc_id, r.item_id): r.score for r in got}[4, [k for i, k in want if i == 4][0]] == 1.0
    small = matches(docs, bench, block_words=100).collect()
    assert {(r.doc_id, r.item_id) for r in small} == want
    kept = drop_copies(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {*range(400), 901, 902} - {i for i, _ in want}


def test_an_item_that_is_everywhere_is_still_found(spark):
    docs = spark.createDataFrame([(i, f"start {i} alpha beta gamma delta epsilon zeta eta theta end") for i in range(200)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    assert matches(docs, bench).count() == 200 and drop_copies(docs, bench).count() == 0


def test_empty_tables(spark):
    docs, bench, _ = made(spark)
    assert matches(docs.where("false"), bench).count() == 0 and matches(docs, bench.where("false")).count() == 0
    assert drop_copies(docs, bench.where("false")).count() == docs.count()


def test_heavily_edited_copies_keep_seeds(spark):
    draw = random.Random(2)
    items = [[f"i{k}w{j}" for j in range(draw.choice([3, 4, 5, 6, 12, 30, 40]))] for k in range(24)]
    edits = [
        lambda w: [x if j % 5 else "changed" for j, x in enumerate(w)],
        lambda w: [y for j, x in enumerate(w) for y in ([x, "more"] if j % 3 == 2 else [x])],
        lambda w: [y for j, x in enumerate(w) for y in ([x, f"more{j}"] if j % 2 else [x])],
        lambda w: [x for j, x in enumerate(w) if j % 4],
        lambda w: [y for x in w[:-1] for y in (x, "and")] + w[-1:],
        lambda w: w[: len(w) * 2 // 3],
        lambda w: [x if j % 3 else "changed" for j, x in enumerate(w)],
    ]
    docs = [(k * 10 + n, ["before"] * 30 + edit(w) + ["after"] * 30) for k, w in enumerate(items) for n, edit in enumerate(edits)]
    docs += [(1000 + k, w) for k, w in enumerate(items[:12])]
    want = {(i, k): s / 2 / len(w) for i, d in docs for k, w in enumerate(items) if (s := brute_alignment(w, d)) >= 0.6 * 2 * len(w)}
    docs = spark.createDataFrame([(i, " ".join(d)) for i, d in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.score for r in matches(docs, bench).collect()} == want and len(want) > 100
    assert {r.doc_id for r in drop_copies(docs, bench).collect()} == {r.doc_id for r in docs.collect()} - {i for i, _ in want}
