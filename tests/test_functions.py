import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.functions import scalars
from residua.functions import subsequence as S
from residua.functions import tokens as T
from residua.functions.vocabulary import Vocabulary, esm, from_files, protein, without_word_marks
from residua.operators import extract


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_flags():
    assert [scalars.parse_bool(x) for x in ("TRUE", "y", "0", "No", True)] == [True, True, False, False, True]
    with pytest.raises(ValueError):
        scalars.parse_bool("maybe")
    assert scalars.parse_layers("all") is None and scalars.parse_layers("last") == [-1] and scalars.parse_layers("1 -2") == [1, -2]


def test_layers():
    assert scalars.normalise_layers(None, 3) == scalars.normalise_layers([], 3) == [1, 2, 3]
    assert scalars.normalise_layers([-1, 0, 3, -4, 1], 3) == [3, 0, 1]
    for bad in (4, -5):
        with pytest.raises(ValueError):
            scalars.normalise_layers([bad], 3)


def test_output_types_and_precision():
    assert scalars.output_types(["logits", "per_token", "logits"], ("per_token",)) == ["per_token"]
    with pytest.raises(ValueError):
        scalars.output_types(["pooled"])
    assert {scalars.dtype_of(p).name for p in ("float16", "16", "half")} == {"float16"}
    assert {scalars.dtype_of(p).name for p in ("float32", "32", "full")} == {"float32"}
    with pytest.raises(ValueError):
        scalars.dtype_of("64")


def test_names():
    assert scalars.model_name("user/some/model", False) == "some/model" and scalars.model_name("/a/b/model.pt", True) == "model"
    assert scalars.output_file("x", "m", "attention_head", 2, 0) == "x_m_attention_head_layer_2_head_1.npy"
    assert scalars.output_file("x", "m", "attention_model") == "x_m_attention_model.npy"
    assert [scalars.max_length(r, 10) for r in ("max_length", None, 4, "20")] == [10, 10, 10, 20]


def test_half_precision(spark):
    got = spark.createDataFrame([([0.1, 1.0],), (None,)], "v array<float>").select(scalars.half_precision("v")).collect()
    assert got[0][0] == [float(np.float16(0.1)), 1.0] and got[1][0] is None


@pytest.mark.parametrize("style,pattern", [("[", r"\[.*?\]|."), ("<", r"<.*?>|.")])
def test_token_split(spark, style, pattern):
    texts = ["AB[MASK]C", "A<mask>B", "A[B", "A<B", "", "x\ny", "é😀[a]]", "\r\u0085 "]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "s string").select("s", T.split_tokens(F.col("s"), style).alias("t")).collect()
    for r in rows:
        assert r.t == re.findall(pattern.replace(".", "[^\n]"), r.s or "")


def test_encode_and_unknown(spark):
    v = protein()
    tokens = T.split_tokens(F.lit("aC<pad>Zz"), "<")
    r = one(spark, T.encode(tokens, v).alias("ids"), T.unknown_tokens(tokens, v).alias("bad"))
    assert r.ids == [4, 8, 0, 3, 3] and "Z" in r.bad
    strict = protein(True)
    assert one(spark, T.encode(T.split_tokens(F.lit("aX")), strict).alias("x")).x == [3, 24]


def test_specials_padding_masks(spark):
    v = protein(True)
    ids = F.array(F.lit(4), F.lit(24), F.lit(3))
    full = T.add_specials(ids, v)
    r = one(spark, full.alias("f"), T.add_specials(ids, v, False).alias("plain"), T.pad(full, 7, 0).alias("p"), T.pad(full, 2, 0).alias("q"), T.attention_mask(full, 7).alias("a"), T.pooling_mask(full, v).alias("m"), T.truncate(full, 2).alias("t"), T.gap(F.split(F.lit("A,B"), ",")).alias("g"))
    assert r.f == [1, 4, 24, 3, 2] and r.plain == [4, 24, 3] and r.p == [1, 4, 24, 3, 2, 0, 0] and r.q == r.f
    assert r.a == [1, 1, 1, 1, 1, 0, 0] and r.m == [False, True, True, False, False] and r.t == [1, 4] and r.g == "A B"
    first = esm(True)
    assert one(spark, T.add_specials(ids, first).alias("x")).x == [first.ids["<cls>"], 4, 24, 3]
    assert T.n_specials(first) == (1, 0) and T.n_specials(v) == (1, 1) and T.n_specials(v, False) == (0, 0)


def test_vocabularies():
    assert list(protein().ids.values()) == list(range(24)) and protein(True).ids["X"] == 24
    assert len(esm().ids) == 33 and esm().ids["<mask>"] == 32 and esm().ids["L"] == 4 and esm().special_ids == [0, 1, 2, 3, 32]
    assert len(esm(True).ids) == 35 and esm(True).ids["<cls>"] == 32
    assert protein().bracket == "<" and Vocabulary({"[PAD]": 0, "[CLS]": 1}, pad="[PAD]", cls="[CLS]", sep=None, unk=None, specials=("[PAD]", "[CLS]")).bracket == "["
    with pytest.raises(ValueError):
        _ = Vocabulary({"pad": 0}, pad="pad", specials=("pad",)).bracket
    with pytest.raises(ValueError):
        Vocabulary({"A": 0})
    made = from_files({"<pad>": 0, "<eos>": 1, "A": 2}, {"eos_token": "<eos>", "pad_token": "<pad>"})
    assert made.pad_id == 0 and made.special_ids == [0, 1] and made.cls is None
    assert without_word_marks({"▁A": 3, "B": 4}) == {"A": 3, "B": 4}


def brute_mask(full, sub, context):
    inside = [False] * len(full)
    for s in range(len(full) - len(sub) + 1):
        if sub and full[s : s + len(sub)] == sub:
            for p in range(max(0, s - context), min(len(full), s + len(sub) + context)):
                inside[p] = True
    return inside


@pytest.mark.parametrize("context", [0, 1, 5])
def test_subsequence_masks(spark, context):
    cases = [("AAA", "AA"), ("ABCABC", "BC"), ("ABC", "X"), ("ABC", ""), ("", "A"), ("AB", "ABC"), ("A<mask>B", "<mask>"), ("QABCAB", "AB")]
    split = lambda c: T.split_tokens(F.col(c))
    rows = spark.createDataFrame(cases, "f string, s string").select("f", "s", split("f").alias("a"), split("s").alias("b"))
    rows = rows.withColumn("starts", S.starts(F.col("a"), F.col("b"))).withColumn("mask", S.mask(F.col("a"), F.col("starts"), F.size("b"), context)).withColumn("span", S.first_span(F.col("a"), F.col("b"), context, 1))
    for r in rows.collect():
        assert r["mask"] == brute_mask(r.a, r.b, context)
        assert (r.span is None) == (not any(r["mask"]))


def test_masked_mean(spark):
    rows = F.array(*[F.array(F.lit(float(i)), F.lit(float(i * 2))) for i in range(4)])
    some, none = (F.array(*[F.lit(x) for x in m]) for m in ([True, False, True, False], [False] * 4))
    r = one(spark, extract.masked_mean(rows, some, 2).alias("a"), extract.masked_mean(rows, none, 2).alias("b"), S.with_specials(some, 1, 2).alias("c"), S.degap(F.lit("A-B-")).alias("d"))
    assert r.a == [1.0, 2.0] and np.isnan(r.b).all() and r.c == [False, True, False, True, False, False, False] and r.d == "AB"
