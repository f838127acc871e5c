import random

import zlib

import numpy as np
import pytest

from residua.llm._common import table
from residua.llm.quality import VALUES, _views, fit, score


def made(spark, n=800):
    draw = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(draw.randint(30, 200))]
        bad = i % 6 == 0
        text = " | ".join(words) if bad and i % 12 else "".join(w.upper() + "!! " for w in words) if bad else " ".join(words)
        docs.append((i, text, draw.choice(["en", "de"]), f"src{draw.randrange(9)}", len(text), "extra"))
        if i % 2 or i % 12 < 7:
            labels.append((i, int(not bad), 0))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_unlabelled_documents_are_scored_right(spark):
    docs, labels = made(spark)
    got = score(docs, fit(docs, labels)).collect()
    known = {r.doc_id for r in labels.collect()}
    fresh = [r for r in got if r.doc_id not in known]
    assert len(got) == 800 and len(fresh) > 100
    assert np.mean([r.keep == (r.doc_id % 6 != 0) for r in fresh]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_same_result_twice(spark):
    docs, labels = made(spark, 300)
    a, b = ({r.doc_id: r.score for r in score(docs.repartition(n), fit(docs.repartition(n), labels)).collect()} for n in (2, 5))
    assert a == b


def test_odd_tables(spark):
    docs, labels = made(spark, 200)
    odd = docs.union(spark.createDataFrame([(None, None, None, None, None, None), (1, "", None, None, None, None), (1, "", None, None, None, None), (7, "x" * 100_000, "en", "", -5, "")], docs.schema))
    assert score(odd, fit(odd, labels)).count() == 204
    assert score(docs.where("false"), fit(docs, labels)).count() == 0
    none = fit(docs, labels.where("false"))
    assert {0 <= r.score <= 1 for r in score(docs, none).collect()} == {True}
    assert 0 <= score(docs, fit(docs, labels.where("quality = 1"))).first().score <= 1
    assert fit(docs.where("false"), labels)


def test_metadata_is_a_view_of_its_own(spark):
    rows = [(1, "some text", "en", "a", 9), (2, "OTHER, 12!\n", "en", "a", 9), (3, None, None, None, None), (4, "", "en", "b", 10_000)]
    pages = {r.doc_id: r.page for r in _views(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "doc_id", "text", ("source", "lang", "n_chars")).collect()}
    assert pages[1] == pages[2] and len(pages[3]) == 5 and pages[1][1] == pages[4][1] and pages[1][0] != pages[4][0]
    assert all(k * VALUES <= b < (k + 1) * VALUES for p in pages.values() for k, b in enumerate(p))


def test_views_teach_each_other(spark):
    """Labels for few documents; the source tells the class, and the text does by words that labelled documents seldom have."""
    draw = random.Random(9)
    docs, labels = [], []
    for i in range(3000):
        bad = i % 3 == 0
        words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(40)]
        if draw.random() < 0.8:
            words[3:3] = [f"{'zz' if bad else 'yy'}{draw.randrange(400)}"] * 3
        docs.append((i, " ".join(words), "en", f"{'bad' if bad else 'good'}{draw.randrange(3)}", 100))
        if i % 25 == 0:
            labels.append((i, int(not bad)))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    l = spark.createDataFrame(labels, "doc_id long, quality int")
    right = lambda model: np.mean([(r.score_text >= 0.5) == (r.doc_id % 3 != 0) for r in score(d, model).collect()])
    alone, taught = right(fit(d, l, rounds=0)), right(fit(d, l, rounds=2, certain=0.9))
    assert taught > alone + 0.02 and taught > 0.8, (alone, taught)


def test_held_out_accuracy_of_each_view(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    model = fit(docs, spark.createDataFrame([(i, q) for i, q in truth.items() if not held(i)], "doc_id long, quality int"))
    rows = [r for r in score(docs, model).collect() if r.doc_id in truth and held(r.doc_id)]
    share = {n: np.mean([(r[n] >= 0.5) == (truth[r.doc_id] != 0) for r in rows]) for n in ("score", "score_text", "score_page")}
    print(len(rows), share)
    assert share["score"] > 0.9 and share["score_text"] > 0.9 and share["score_page"] > 0.7


@pytest.mark.parametrize("times", [100_000])
def test_one_id_many_times(spark, times):
    docs, labels = made(spark, 300)
    many = spark.range(times).selectExpr("1L AS doc_id", "'a text of one id' AS text", "'en' AS lang", "'s' AS source", "5L AS n_chars", "'x' AS score")
    assert score(docs.union(many), fit(docs.union(many), labels, rounds=1)).count() == times + 300
