import random
import zlib

import numpy as np
import pyarrow as pa

from residua.llm import _subwords
from residua.llm._bag_model import logistic, sigmoid, train
from residua.llm.toxicity import BITS, PRIOR, bounded, classify, drop_toxic, fit, score


def small_corpus(n=900):
    draw = random.Random(8)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(30, 300))]
        toxic = i % 8 == 0
        if toxic:
            for k in range(0, len(words), 12):
                words[k] = draw.choice(["vilkrast", "odiumpex", "hatzorn"])
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, score string, weights string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_unseen_misspellings(spark):
    docs, labels = small_corpus()
    d, l = frames(spark, docs, labels)
    got = classify(d, l).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 8 == 0) for r in held]) > 0.97
    model = fit(d, l)
    clean = docs[1][1]
    odd = " ".join(w if k % 8 else "vilkrrast odiumpexx" for k, w in enumerate(clean.split()))
    a, b = model.score(pa.array([clean, odd]))
    assert a < 0.3 < b


def test_scores_do_not_depend_on_labels_held_out_or_on_other_columns(spark):
    docs, labels = small_corpus(300)
    d, l = frames(spark, docs, labels)
    changed = [(i, q, 1 - t) if zlib.crc32(str(i).encode()) % 4 == 2 else (i, q, t) for i, q, t in labels]
    one = {r.doc_id: r.score for r in classify(d, l).collect()}
    two = {r.doc_id: r.score for r in classify(*frames(spark, [(i, t, None, "other") for i, t, *_ in docs], changed)).collect()}
    assert one == two


def test_scores_against_brute_force():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=1 << BITS).astype(np.float32)
    texts = ["Ab cd-ÉÉ  x", "", None, " word", "word ", "y" * 3000, "two\nlines 1d10t"]
    got = _subwords.bag_scores(_subwords.ngrams(pa.array(texts), BITS), weights, PRIOR)
    for text, value in zip(texts, got):
        raw = (text or "").lower().encode()
        words = __import__("re").findall(rb"[0-9a-z\x80-\xff]+", raw)
        found = []
        for w in words:
            w = b"_" + w + b"_"
            for n in _subwords.ORDERS:
                for k in range(len(w) - n + 1):
                    code = int.from_bytes(w[k : k + n], "little") * (0x9E3779B97F4A7C15 + 2 * n) % 2**64
                    found.append(weights[code >> 64 - BITS])
        assert abs(value - sum(map(float, found)) / (len(found) + PRIOR)) < 1e-6


def test_odd_tables(spark):
    docs, labels = small_corpus(200)
    odd = [*docs, (None, None, None, None), (1, "", "", ""), (1, "", "", ""), (5000, "x " * 50_000, "", "")]
    d, l = frames(spark, odd, [*labels, (None, 1, 1), (3, None, None), (9999, 1, 1)])
    assert classify(d, l).count() == len(odd)
    kept = drop_toxic(d, l)
    assert kept.columns == d.columns and len(docs) * 0.8 < kept.count() < len(odd)
    nothing = l.where("false")
    assert {r.predicted for r in classify(d, nothing).collect()} <= {0, 1}
    assert classify(d.where("false"), l).count() == 0 and drop_toxic(d.where("false"), l).count() == 0
    assert score(d, fit(d, nothing)).count() == len(odd)


def test_training_pieces():
    bags = [(np.array([0, i % 2 + 1], np.int32), np.array([0.5, 0.5], np.float32)) for i in range(100)]
    weights, bias = train(bags, np.arange(100) % 2, 4)
    assert weights[2] > weights[1]
    x = np.linspace(-3, 3, 200)[:, None]
    y = (np.random.default_rng(0).random(200) < sigmoid(2 * x[:, 0] - 0.5)).astype(float)
    w = logistic(x, y)
    assert 1 < w[0] < 3


def test_bounded_samples(spark):
    rows = [(i, "x" * (5000 if i == 3 else 10)) for i in range(400)] + [(7, "of the same id")] * 20_000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 390)) for i in range(500)], "doc_id long, label int")
    got = bounded(docs, labels, 50, 1000, "label").collect()
    assert len(got) == len({r.doc_id for r in got}) == 50 and {r.label for r in got} == {0, 1} and all(len(r.text) < 5000 for r in got)
    assert sum(len(r.text) for r in got) <= 1000
    assert len(bounded(docs, labels, 5000, 10**9, "label").collect()) == 400
    assert bounded(docs.where("false"), labels, 50, 1000, "label").count() == 0
