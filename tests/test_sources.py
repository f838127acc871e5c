import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.functions.vocabulary import protein
from residua.operators.substrings import with_mask
from residua.operators.sequences import tokenise
from residua.sinks.outputs import write_fasta
from residua.sources.fasta import from_table, read_fasta, read_records
from residua.sources.files import infer_config, read_substrings, read_vocabulary, read_weights


def brute_fasta(text):
    found, name = {}, None
    for n, line in enumerate(text.split("\n")):
        line = line.strip()
        if line.startswith(">"):
            name = line[1:] or f"seqnum{n:09d}"
            found[name] = ""
        elif name is not None:
            found[name] += line
    return found


CASES = {
    "plain": ">a\nACD\nEF\n>b x>y\nGG\n",
    "junk": "junk\nmore\n>a\nAC\n\n>\nDD\n>none\n>last\nX",
    "crlf": ">a\r\nAC\r\nDE\r\n>b\r\nF\r\n",
    "repeated": ">a\nAA\n>b\nBB\n>a\nCC\n  >c\n d d \n",
    "empty": "",
}


@pytest.mark.parametrize("name", CASES)
def test_fasta_against_brute_force(spark, tmp_path, name):
    path = tmp_path / f"{name}.fasta"
    path.write_bytes(CASES[name].encode())
    got = read_fasta(spark, str(path)).orderBy("ord").collect()
    want = brute_fasta(CASES[name])
    assert [(r.sequence_id, r.sequence) for r in got] == list(want.items())
    assert [r.ord for r in got] == list(range(len(want)))


def test_fasta_in_many_splits(spark, tmp_path):
    draw = random.Random(3)
    text = "".join(f">id{draw.randrange(900)} {k}\n" + "".join("".join(draw.choice("ACDE") for _ in range(60)) + "\n" for _ in range(draw.randrange(4))) for k in range(1500))
    for k in range(2):
        (tmp_path / f"{k}.fasta").write_text(text if k else ">first\nAAA\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        records = read_records(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = read_fasta(spark, str(tmp_path)).orderBy("ord").collect()
        assert records.count() == 1501
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [(r.sequence_id, r.sequence) for r in got] == [("first", "AAA"), *brute_fasta(text).items()]


def test_fasta_round_trip(spark, tmp_path):
    rows = from_table(spark.createDataFrame([(3, "x", "AC"), (1, "y", None), (2, "z z", "GG")], "n long, i string, s string"), "i", "s", "n")
    write_fasta(rows.orderBy("ord").coalesce(1), str(tmp_path / "out"))
    back = read_fasta(spark, str(tmp_path / "out")).orderBy("ord").collect()
    assert [(r.ord, r.sequence_id, r.sequence) for r in back] == [(0, "y", ""), (1, "z z", "GG"), (2, "x", "AC")]


def test_substrings_by_place(spark, tmp_path):
    (tmp_path / "s.csv").write_text("whatever,substring_aa,more\na,AC,1\nb,,2\na,DD,3\n")
    assert sorted(tuple(r) for r in read_substrings(spark, str(tmp_path / "s.csv")).collect()) == [("a", "DD"), ("b", "")]


def test_antibody_example_shapes(spark):
    seq = "EVQLVESGGGLVQ" * 7 + "XXXX" + "CSRWAAGRFYTVDYW" + "GQ"
    rows = tokenise(spark.createDataFrame([(seq, "CSRWAAGRFYTVDYW"), (seq, "WWWW")], "sequence string, substring string"), protein(True))
    masks = [r.substring_mask for r in with_mask(rows, protein(True)).select("substring_mask").collect()]
    assert [i for i, x in enumerate(masks[0]) if x] == list(range(96, 111)) and not any(masks[1])


def test_vocabulary_and_weights(spark, tmp_path):
    assert read_vocabulary(spark, str(tmp_path)).ids == protein().ids
    (tmp_path / "vocab.txt").write_text("<pad>\n<cls>\n<sep>\n<unk>\nA\n")
    assert read_vocabulary(spark, str(tmp_path)).ids["A"] == 4
    (tmp_path / "vocab.json").write_text(json.dumps({"[PAD]": 0, "[CLS]": 1, "B": 2}))
    (tmp_path / "special_tokens_map.json").write_text(json.dumps({"pad_token": "[PAD]", "cls_token": {"content": "[CLS]"}}))
    v = read_vocabulary(spark, str(tmp_path))
    assert (v.bracket, v.pad_id, v.cls, v.sep) == ("[", 0, "[CLS]", None)
    with pytest.raises(FileNotFoundError):
        read_weights(spark, str(tmp_path))
    np.savez(tmp_path / "model.npz", **{"embed.weight": np.zeros((25, 128)), "layers.0.attention.weight": np.zeros((4, 128)), "layers.3.x": np.zeros(2)})
    assert read_weights(spark, str(tmp_path))[1] == {"num_layers": 4, "num_attention_heads": 2, "hidden_size": 128}
    (tmp_path / "config.json").write_text(json.dumps({"num_layers": 9}))
    assert read_weights(spark, str(tmp_path))[1]["num_layers"] == 9
    assert infer_config({}) == {"num_layers": 12, "num_attention_heads": 12, "hidden_size": 768}
