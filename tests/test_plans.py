import json
import random

import numpy as np
import pytest

from residua.encoders.base import Output, Wanted, batches_by_budget, encode_with_retry
from residua.encoders.registry import ESM_MODELS, choose, load
from residua.encoders.synthetic import LookupEncoder, SyntheticEncoder
from residua.encoders.transformer import NumpyTransformer
from residua.functions.tokens import TextCodec
from residua.functions.vocabulary import Vocabulary, protein
from residua.operators import extract
from residua.operators.sequences import tokenise
from residua.plans import cli
from residua.plans.pipeline import encode_table, manifest, read_outputs, report, represent, require_space, run
from residua.plans.spec import EmbedSpec, resolve
from residua.sinks import outputs as sink
from residua.sources.fasta import read_fasta
from residua.streaming.embed import embed_stream

V = protein(True)


def fasta(path, n=40, seed=1):
    draw = random.Random(seed)
    seqs = {f"s{k}": "".join(draw.choice("ACDEFGHIKLMNPQRSTVWYX") for _ in range(draw.randint(1, 30))) for k in range(n)}
    path.write_text("".join(f">{k}\n{v}\n" for k, v in seqs.items()))
    return seqs


def naive_layers(model, ids, mask):
    """The transformer one sequence, head and place at a time."""
    w, d, heads = {k: v.astype(np.float64) for k, v in model.w.items()}, model.hidden_size, model.num_heads
    norm = lambda x, n: (x - x.mean()) / np.sqrt(x.var() + 1e-5) * w[f"{n}.weight"] + w[f"{n}.bias"]
    x = np.array([norm(w["token_embedding"][t] + w["position_embedding"][p], "norm") for p, t in enumerate(ids)])
    hidden, attention = [x], []
    for k in range(model.num_layers):
        lin = lambda v, n: w[f"layers.{k}.{n}.weight"] @ v + w[f"layers.{k}.{n}.bias"]
        qkv = np.array([lin(v, "in") for v in x])
        size, out, maps = d // heads, np.zeros_like(x), []
        for h in range(heads):
            q, key, val = (qkv[:, part * d + h * size : part * d + (h + 1) * size] for part in range(3))
            a = np.zeros((len(ids), len(ids)))
            for i in range(len(ids)):
                e = np.array([np.exp(q[i] @ key[j] / np.sqrt(size)) if mask[j] else 0.0 for j in range(len(ids))])
                a[i] = e / e.sum()
            out[:, h * size : (h + 1) * size] = a @ val
            maps.append(a)
        x = np.array([norm(v + lin(o, "out"), f"layers.{k}.norm1") for v, o in zip(x, out)])
        x = np.array([norm(v + lin(np.maximum(lin(v, "up"), 0), "down"), f"layers.{k}.norm2") for v in x])
        hidden.append(x)
        attention.append(maps)
    return hidden, attention, np.array([w["head.weight"] @ v + w["head.bias"] for v in x])


def test_transformer_against_a_naive_one():
    model = NumpyTransformer.seeded(hidden_size=8, num_layers=2, num_heads=2)
    ids = np.array([[1, 4, 9, 2, 0, 0], [1, 5, 6, 7, 8, 2]])
    mask = ids != 0
    out = model(ids, mask, Wanted((0, 1, 2), (1, 2), True))
    for b in range(2):
        n = mask[b].sum()
        hidden, attention, logits = naive_layers(model, ids[b], mask[b])
        for k in range(3):
            np.testing.assert_allclose(out.hidden[k][b, :n], hidden[k][:n], atol=1e-4)
        for k in range(2):
            np.testing.assert_allclose(out.attention[k + 1][b, :, :n], np.array(attention[k])[:, :n], atol=1e-4)
        np.testing.assert_allclose(out.logits[b, :n], logits[:n], atol=1e-3)
    assert set(model(ids, mask, Wanted((1,))).hidden) == {1}
    with pytest.raises(ValueError):
        NumpyTransformer.seeded(max_length=4)(ids, mask, Wanted((1,)))


def test_layers_are_not_computed_in_vain():
    model = NumpyTransformer.seeded(hidden_size=8, num_layers=3, num_heads=2)
    for k in list(model.w):
        if k.startswith("layers.2"):
            model.w[k] = None
    assert model(np.array([[1, 4, 2]]), np.ones((1, 3), bool), Wanted((2,))).hidden[2].shape == (1, 3, 8)


def test_memory_errors_halve_a_batch():
    sizes = []

    def encoder(ids, mask, wanted):
        sizes.append(len(ids))
        if len(ids) > 2:
            raise MemoryError
        return Output({0: ids})

    parts = encode_with_retry(encoder, np.arange(7)[:, None], np.ones((7, 1), bool), Wanted())
    assert np.concatenate([o.hidden[0][:, 0] for _, o in parts]).tolist() == list(range(7)) and max(s for s in sizes[1:]) < 7
    with pytest.raises(MemoryError):
        encode_with_retry(lambda *a: (_ for _ in ()).throw(MemoryError()), np.zeros((1, 1)), np.zeros((1, 1)), Wanted())


def test_token_budget():
    lengths = [5, 3, 9, 1, 200]
    groups = batches_by_budget(lengths, 20)
    assert sorted(np.concatenate(groups).tolist()) == list(range(5))
    assert all(len(g) == 1 or len(g) * max(lengths[i] for i in g) <= 20 for g in groups)
    assert batches_by_budget([], 20) == []


def test_spec_is_checked():
    for bad in ({"extract": ("pooled",)}, {"precision": "8"}, {"extract": ("substring_pooled",)}, {"context": -1}, {"batch_size": 0}, {"max_length": "0"}):
        with pytest.raises(ValueError):
            EmbedSpec("synthetic", **bad)
    encoder = SyntheticEncoder(2, 3)
    r = resolve(EmbedSpec("synthetic", layers=(-1, 2, 1), extract=("attention_head", "mean_pooled", "logits", "attention_model")), encoder)
    assert r.layers == (2, 1) and len([k for k in r.keys if k[0] == "attention_head"]) == 6 and r.wanted == Wanted((2, 1), (1, 2), True)
    with pytest.raises(ValueError):
        resolve(EmbedSpec("synthetic", layers=(0,), extract=("attention_layer",)), encoder)
    assert resolve(EmbedSpec("synthetic", extract=("logits", "per_token")), LookupEncoder(np.zeros((4, 2)))).outputs == ("per_token",)
    assert EmbedSpec("a").run_key("x") != EmbedSpec("a", context=1).run_key("x") != EmbedSpec("a").run_key("y")


def test_model_names():
    assert [choose(n).kind for n in ("synthetic", "custom:x", "./esm2_dir", "a/b.pt", "a/esm2/c", "esm2_t6_8M_UR50D", "user/name")] == ["synthetic", "custom", "custom", "custom", "custom", "esm", "hub"]
    assert choose("alchemab/antiberta2").length_limit == 256 and choose(ESM_MODELS[0]).length_limit is None
    with pytest.raises(ValueError):
        choose("nothing")


def pooled(made):
    return {(r.output_type, r.layer, r["head"], r.ord): (tuple(r["shape"]), np.array(r["values"])) for r in made.collect()}


ALL = ("per_token", "mean_pooled", "substring_pooled", "attention_head", "attention_layer", "attention_model", "logits")


def test_results_do_not_depend_on_batches(spark, tmp_path):
    fasta(tmp_path / "x.fasta")
    seqs = read_fasta(spark, str(tmp_path / "x.fasta"))
    subs = seqs.selectExpr("sequence_id", "substring(sequence, 2, 3) AS substring")
    model = NumpyTransformer.seeded(hidden_size=8, num_layers=2, num_heads=2)
    for discard in (True, False):
        found = []
        for budget in (1, 100, 10_000):
            spec = EmbedSpec("synthetic", layers=(1, 2), extract=ALL, substring_path="given", discard_padding=discard, batch_size=budget)
            found.append(pooled(represent(encode_table(seqs, V, spec, subs), model, resolve(spec, model), spec, V.pad_id, 32)))
        for other in found[1:]:
            assert found[0].keys() == other.keys()
            for k, (shape, values) in found[0].items():
                assert shape == other[k][0]
                np.testing.assert_allclose(values, other[k][1], atol=2e-5)
        heads = [np.mean([v for (t, l, h, o), (_, v) in found[0].items() if t == "attention_head" and l == 1 and o == 3], axis=0)]
        np.testing.assert_allclose(heads[0], found[0]["attention_layer", 1, None, 3][1], atol=1e-6)
        np.testing.assert_allclose((found[0]["attention_layer", 1, None, 3][1] + found[0]["attention_layer", 2, None, 3][1]) / 2, found[0]["attention_model", None, None, 3][1], atol=1e-6)


def test_a_whole_run_and_its_arrays(spark, tmp_path):
    seqs = fasta(tmp_path / "in.fasta")
    (tmp_path / "s.csv").write_text("id,sub\n" + "".join(f"{k},{v[:2] if n else 'WWWWW'}\n" for n, (k, v) in enumerate(seqs.items())))
    spec = EmbedSpec("synthetic:3,2,8", str(tmp_path / "out"), str(tmp_path / "in.fasta"), substring_path=str(tmp_path / "s.csv"), layers=(-1, 1), extract=ALL, num_workers=2, precision="half", npy=True, commit_rows=16)
    where = run(spark, spec)
    made = pooled(read_outputs(spark, where))
    encoder, longest = SyntheticEncoder(3, 2, 8), max(map(len, seqs.values())) + 2
    root = tmp_path / "out" / "synthetic"
    for what, layer, head in resolve(spec, load(spark, spec.model_name)[0]).keys:
        name = f"in_synthetic_{what}" + (f"_layer_{layer}" if layer is not None else "") + (f"_head_{head + 1}" if head is not None else "")
        array = np.load(root / what / f"{name}.npy")
        assert array.dtype == np.float16 and len(array) == len(seqs)
        for o in range(len(seqs)):
            np.testing.assert_array_equal(array[o].ravel(), made[what, layer, head, o][1].astype(np.float16))
    ids = [V.ids[c] for c in seqs["s5"]]
    full = np.array([[1, *ids, 2, *[0] * (longest - len(ids) - 2)]])
    hidden = encoder(full, full > 0, Wanted((3,))).hidden[3][0]
    np.testing.assert_array_equal(np.load(root / "mean_pooled/in_synthetic_mean_pooled_layer_3.npy")[5], hidden[1 : len(ids) + 1].astype(np.float64).mean(axis=0).astype(np.float16))
    assert np.isnan(np.load(root / "substring_pooled/in_synthetic_substring_pooled_layer_1.npy")[0]).all()
    index = [r for r in spark.read.csv(str(root / "in_idx"), header=True).collect()]
    assert {int(r["index"]): r.sequence_id for r in index} == dict(enumerate(seqs))
    bytes_ = {(r.output_type, r.layer, r["head"]): r.bytes for r in spark.read.json(str(root / f"manifest-{where[-16:]}")).selectExpr("output_type", "int(layer) layer", "int(head) head", "bytes").collect()}
    assert bytes_["per_token", 3, None] == len(seqs) * longest * 8 * 2


def test_a_stopped_run_goes_on(spark, tmp_path, monkeypatch):
    fasta(tmp_path / "in.fasta")
    spec = EmbedSpec("synthetic", str(tmp_path / "out"), str(tmp_path / "in.fasta"), commit_rows=10, num_workers=4)
    written = []
    real = sink.write_slices

    def failing(made, path, *rest):
        if len(written) == 2:
            raise RuntimeError("stopped")
        real(made, path, *rest)
        written.append(made.selectExpr("min(ord)").first()[0])

    monkeypatch.setattr("residua.plans.pipeline.sink.write_slices", failing)
    with pytest.raises(RuntimeError):
        run(spark, spec)
    monkeypatch.setattr("residua.plans.pipeline.sink.write_slices", lambda made, path, *rest: (written.append(made.selectExpr("min(ord)").first()[0]), real(made, path, *rest)))
    where = run(spark, spec)
    assert sorted(written) == [0, 10, 20, 30]
    whole = run(spark, EmbedSpec("synthetic", str(tmp_path / "other"), str(tmp_path / "in.fasta"), streaming_output=False, commit_rows=16))
    a, b = pooled(read_outputs(spark, where)), pooled(read_outputs(spark, whole))
    assert a.keys() == b.keys() and all((a[k][1] == b[k][1]).all() for k in a)


def test_a_run_in_steps_and_its_report(spark, tmp_path):
    fasta(tmp_path / "in.fasta")
    spec = EmbedSpec("synthetic", str(tmp_path / "out"), str(tmp_path / "in.fasta"), commit_rows=16, num_workers=2, slices_at_most=2)
    where = run(spark, spec)
    assert read_outputs(spark, where).count() == 32
    encoder = SyntheticEncoder(vocab_size=25)
    progress = sink.read_ranges(spark, where.replace("outputs-", "_progress-"))
    lines = [r for r in report(spark, spec, resolve(spec, encoder), encoder, progress, 40, 32).collect()]
    assert [(r.n_ranges, r.n_rows, r.n_bytes) for r in lines if r.is_total] == [(1, 32, 32 * 16 * 4)]
    assert run(spark, spec) == where and read_outputs(spark, where).count() == 40 and read_outputs(spark, where).select("ord").distinct().count() == 40


def test_other_weights_or_tokens_are_another_run(spark, tmp_path):
    fasta(tmp_path / "in.fasta", 5)
    spec = EmbedSpec("synthetic", str(tmp_path / "out"), str(tmp_path / "in.fasta"))
    one, two = (NumpyTransformer.seeded(hidden_size=8, num_layers=1, num_heads=2, seed=k) for k in (0, 1))
    paths = {run(spark, spec, encoder=m, vocabulary=v) for m, v in ((one, V), (two, V), (one, Vocabulary(V.ids, upper=True)))}
    assert len(paths) == 3 and run(spark, spec, encoder=one, vocabulary=V) in paths

    class Plain(SyntheticEncoder):
        fingerprint = None

    assert run(spark, spec, encoder=Plain(), vocabulary=V) not in paths


def test_space_is_checked_before_encoding(spark, tmp_path, monkeypatch):
    fasta(tmp_path / "in.fasta", 5)
    monkeypatch.setattr("residua.plans.pipeline.shutil.disk_usage", lambda path: type("usage", (), {"free": 10}))
    monkeypatch.setattr("residua.plans.pipeline.sink.write_slices", lambda *a: pytest.fail("encoded"))
    with pytest.raises(ValueError, match="free"):
        run(spark, EmbedSpec("synthetic", str(tmp_path / "out"), str(tmp_path / "in.fasta"), npy=True))


def test_whole_texts_are_tokenised_as_columns_are(spark):
    draw = random.Random(5)
    texts = [None, "", "\n", "<cls>A", "A<mask>B<x\n>C<", "a\u0131\u017fb", "AC" * 50, "\U0001f600A\u00e9", "<>", "[A]<A>"]
    texts += ["".join(draw.choice("ACDXacd<>[]\n \u00e9") for _ in range(draw.randint(0, 40))) for _ in range(60)]
    rows = spark.createDataFrame([(k, str(k), t) for k, t in enumerate(texts)], "ord long, sequence_id string, sequence string")
    square = Vocabulary({"[PAD]": 0, "[CLS]": 1, "[UNK]": 2, "A": 3, "C": 4, "[A]": 5}, pad="[PAD]", cls="[CLS]", sep=None, unk="[UNK]", specials=("[PAD]", "[CLS]", "[UNK]"))
    for v in (protein(), protein(True), square):
        for specials in (True, False):
            codec = TextCodec(v, specials)
            want = tokenise(rows, v, specials).orderBy("ord").select("input_ids", "pooling_mask").collect()
            for t, r in zip(texts, want):
                ids = codec.ids(t)
                assert ids.tolist() == r.input_ids and codec.counted(ids).tolist() == r.pooling_mask, t
    spec, encoder = EmbedSpec("synthetic", extract=("mean_pooled", "per_token"), discard_padding=True, batch_size=50), SyntheticEncoder()
    a = pooled(represent(encode_table(rows, protein(), spec), encoder, resolve(spec, encoder), spec, 0, 0))
    b = pooled(represent(rows, encoder, resolve(spec, encoder), spec, 0, 0, TextCodec(protein())))
    assert a.keys() == b.keys() and all(np.array_equal(a[k][1], b[k][1], equal_nan=True) for k in a)


def test_masks_come_with_the_outputs(spark):
    seqs = spark.createDataFrame([(0, "a", "ACDE"), (1, "b", ""), (2, "c", "AC*DEFGH")], "ord long, sequence_id string, sequence string")
    encoder, longest = SyntheticEncoder(), 10
    masks = {r.ord: r.pooling_mask for r in tokenise(seqs, V).collect()}
    for discard in (True, False):
        spec = EmbedSpec("synthetic", extract=("mean_pooled", "per_token"), discard_padding=discard, batch_size=16)
        own = {k: m + [False] * (0 if discard else longest - len(m)) for k, m in masks.items()}
        given = encode_table(seqs, V, spec), seqs
        for rows, codec in zip(given, (None, TextCodec(V))):
            made = represent(rows, encoder, resolve(spec, encoder), spec, V.pad_id, longest, codec, "pooling_mask")
            got = made.collect()
            assert len(got) == 6 and all(r.pooling_mask == own[r.ord] for r in got)
            tokens = extract.per_token(sink.matrices(made, "pooling_mask"), ["ord"], mask="pooling_mask").where("dim = 0").collect()
            assert sorted((r.ord, r.pos, r.pooling_mask) for r in tokens) == [(k, i, x) for k, m in sorted(own.items()) for i, x in enumerate(m)]


def test_errors_of_a_run(spark, tmp_path):
    (tmp_path / "in.fasta").write_text(">a\nAC*\n")
    with pytest.raises(ValueError, match="a"):
        run(spark, EmbedSpec("synthetic", str(tmp_path / "o"), str(tmp_path / "in.fasta")))
    (tmp_path / "in.fasta").write_text(">a\nAC\n")
    (tmp_path / "s.csv").write_text("id,sub\nb,C\n")
    with pytest.raises(ValueError, match="substring"):
        run(spark, EmbedSpec("synthetic", str(tmp_path / "o"), str(tmp_path / "in.fasta"), substring_path=str(tmp_path / "s.csv"), extract=("substring_pooled",)))
    for name, library in (("esm2_t6_8M_UR50D", "torch"), ("user/name", "torch")):
        with pytest.raises(ImportError, match=library):
            load(spark, name)
    spec = EmbedSpec("synthetic", "o", "x.fasta")
    m = manifest(spark, spec, resolve(spec, SyntheticEncoder()), SyntheticEncoder(), 10, 5)
    assert require_space(m, 10**6) == 640
    with pytest.raises(ValueError):
        require_space(m, 639)


def test_empty_input(spark, tmp_path):
    (tmp_path / "in.fasta").write_text("")
    assert read_outputs(spark, run(spark, EmbedSpec("synthetic", str(tmp_path / "o"), str(tmp_path / "in.fasta")))).count() == 0


def test_custom_weights(spark, tmp_path):
    model = NumpyTransformer.seeded(hidden_size=8, num_layers=2, num_heads=2)
    np.savez(tmp_path / "model.npz", **model.w)
    (tmp_path / "config.json").write_text(json.dumps({"num_attention_heads": 2}))
    (tmp_path / "vocab.json").write_text(json.dumps(dict(V.ids)))
    got, vocabulary = load(spark, f"custom:{tmp_path}")
    assert (got.num_layers, got.num_heads, vocabulary.ids["X"]) == (2, 2, 24)
    fasta(tmp_path / "in.fasta", 5)
    assert read_outputs(spark, run(spark, EmbedSpec(f"custom:{tmp_path}", str(tmp_path / "o"), str(tmp_path / "in.fasta")))).count() == 5


def test_weights_by_torch_names():
    model = NumpyTransformer.seeded(hidden_size=8, num_layers=2, num_heads=2)
    names = {"token_embedding": "token_embedding.weight", "position_embedding": "position_embedding.weight", "norm.": "layer_norm.", "head.": "output_head."}
    parts = {"in.": "self_attn.in_proj_", "out.": "self_attn.out_proj.", "up.": "linear1.", "down.": "linear2."}
    theirs = {}
    for k, v in model.w.items():
        if k.startswith("layers."):
            head, part = "transformer." + k[:9], k[9:]
            theirs[head + next((t + part.removeprefix(o) for o, t in parts.items() if part.startswith(o)), part)] = v
        else:
            theirs[next(t + k.removeprefix(o) for o, t in names.items() if k.startswith(o))] = v
    assert "transformer.layers.1.self_attn.in_proj_weight" in theirs
    other, ids = NumpyTransformer(theirs, 2), np.array([[1, 4, 9, 2]])
    np.testing.assert_array_equal(other(ids, ids > 0, Wanted((2,))).hidden[2], model(ids, ids > 0, Wanted((2,))).hidden[2])


def test_lookup_encoder():
    out = LookupEncoder(np.arange(8).reshape(4, 2))(np.array([[1, 9, 3]]), np.ones((1, 3), bool), Wanted((0, 1)))
    assert out.hidden[1][0].tolist() == [[2, 3], [0, 0], [6, 7]]


def test_command_line():
    spec = cli.to_spec("--model_name synthetic --fasta_path a.fasta --output_path o --layers all --extract_embeddings per_token logits --flatten true --max_length 300 --streaming_output no --precision half --discard_padding".split())
    assert spec.layers is None and spec.extract == ("per_token", "logits") and spec.flatten and spec.max_length == "300" and not spec.streaming_output and spec.discard_padding
    assert cli.to_spec("--model_name m --fasta_path a --output_path o --layers -1 2".split()).layers == (-1, 2)
    with pytest.raises(SystemExit):
        cli.to_spec(["--model_name", "x"])


def test_stream_equals_batch(spark, tmp_path):
    fasta(tmp_path / "in.fasta", 20)
    seqs = read_fasta(spark, str(tmp_path / "in.fasta"))
    spec, encoder = EmbedSpec("synthetic", extract=("mean_pooled", "per_token"), discard_padding=True), SyntheticEncoder()
    for part in range(2):
        seqs.where(f"ord % 2 = {part}").write.mode("append").parquet(str(tmp_path / "source"))
        if part:
            spark.createDataFrame([(99, "bad", "A*")], seqs.schema).write.mode("append").parquet(str(tmp_path / "source"))
        q = embed_stream(spark, str(tmp_path / "source"), str(tmp_path / "target"), str(tmp_path / "check"), encoder, V, spec)
        q.awaitTermination(120)
        assert q.exception() is None
    got = spark.read.schema(sink.SCHEMA).parquet(str(tmp_path / "target" / "outputs"))
    a, b = pooled(got), pooled(represent(encode_table(seqs, V, spec), encoder, resolve(spec, encoder), spec, V.pad_id, 0))
    assert a.keys() == b.keys() and all((a[k][1] == b[k][1]).all() for k in a)
    assert spark.read.parquet(str(tmp_path / "target" / "rejected")).first().sequence_id == "bad"


def test_views_and_fills(spark, tmp_path):
    rows = [("per_token", 1, None, 0, "a", [2, 2], [1.0, 2.0, 3.0, 4.0]), ("per_token", 1, None, 1, "b", [1, 2], [5.0, 6.0]), ("mean_pooled", 1, None, 0, "a", [2], [7.0, 8.0])]
    made = spark.createDataFrame(rows, sink.SCHEMA)
    assert {r.ord: r.matrix for r in sink.matrices(made).collect()} == {0: [[1.0, 2.0], [3.0, 4.0]], 1: [[5.0, 6.0]]}
    assert sink.vectors(made).count() == 3
    paths = sink.export_npy(made, str(tmp_path), "p", "m", 2, np.dtype(np.float32))
    array = np.load([p for p in paths if "per_token" in p][0])
    assert array.shape == (2, 2, 2) and np.isnan(array[1, 1]).all() and array[1, 0].tolist() == [5.0, 6.0]
