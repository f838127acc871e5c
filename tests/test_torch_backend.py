"""The torch backends against stand-ins of the libraries, which record what they are asked and return known tensors."""

import sys
from contextlib import nullcontext
from types import ModuleType, SimpleNamespace

import numpy as np
import pytest

from residua.encoders import torch_backend
from residua.encoders.base import Wanted, encode_with_retry
from residua.encoders.registry import load

IDS, MASK = np.array([[1, 4, 2], [1, 5, 0]]), np.array([[True, True, True], [True, True, False]])


class Tensor:
    def __init__(self, x, device="cpu"):
        self.x, self.device = np.asarray(x, np.float64), device

    def to(self, device):
        return Tensor(self.x, device)

    def float(self):
        return self

    def cpu(self):
        return Tensor(self.x)

    def numpy(self):
        assert self.device == "cpu"
        return self.x.astype(np.float32)

    def __getitem__(self, key):
        return Tensor(self.x[key], self.device)


class OutOfMemory(Exception):
    pass


class Model:
    """Hidden states of layer k are the ids plus k; attentions of layer k are all k / 10; logits are the ids doubled."""

    calls: list = []

    def __init__(self, layers=2, heads=2, **config):
        self.layers, self.heads, self.device = layers, heads, "cpu"
        self.config = SimpleNamespace(vocab_size=7, **config)
        self.num_layers, self.embed_dim, self.attention_heads = layers, 5, heads

    def eval(self):
        return self

    def to(self, device):
        self.device = device
        return self

    def _hidden(self, ids, k):
        return Tensor(np.repeat(ids.x[:, :, None] + k, 5, axis=2), ids.device)

    def __call__(self, tokens=None, input_ids=None, **asked):
        ids = tokens if tokens is not None else input_ids
        Model.calls.append((ids.device, self.device, asked))
        if len(ids.x) > 1 and getattr(self, "small", False):
            raise OutOfMemory("full")
        n = ids.x.shape[1]
        maps = [Tensor(np.full((len(ids.x), self.heads, n, n), k / 10), ids.device) for k in range(1, self.layers + 1)]
        if tokens is not None:
            stacked = Tensor(np.stack([m.x for m in maps], axis=1), ids.device)
            return {"representations": {k: self._hidden(ids, k) for k in asked["repr_layers"]}, "attentions": stacked, "logits": Tensor(np.repeat(ids.x[:, :, None] * 2, 7, axis=2), ids.device)}
        return SimpleNamespace(hidden_states=[self._hidden(ids, k) for k in range(self.layers + 1)], attentions=maps, logits=Tensor(np.repeat(ids.x[:, :, None] * 2, 7, axis=2), ids.device))


class Tokenizer:
    special_tokens_map = {"pad_token": "<pad>", "eos_token": "</s>", "unk_token": "<unk>", "additional_special_tokens": ["<x>"]}

    def get_vocab(self):
        return {"<pad>": 0, "</s>": 1, "<unk>": 2, "▁A": 3, "▁C": 4, "<x>": 5}

    def build_inputs_with_special_tokens(self, ids):
        return [*ids, 1]


@pytest.fixture
def libraries(monkeypatch):
    torch = ModuleType("torch")
    torch.as_tensor, torch.no_grad = Tensor, nullcontext
    torch.cuda = SimpleNamespace(is_available=lambda: torch.has_cuda, OutOfMemoryError=OutOfMemory, empty_cache=lambda: None)
    torch.has_cuda = True
    esm = ModuleType("esm")
    esm.pretrained = SimpleNamespace(load_model_and_alphabet_hub=lambda link: (Model(3, 2), SimpleNamespace(all_toks=list("abcdefg"))))
    transformers = ModuleType("transformers")
    models = {
        "x/t5": ("t5", Model(d_model=5, num_layers=2, num_heads=2)), "x/roformer": ("roformer", Model(hidden_size=5, num_hidden_layers=2, num_attention_heads=2)),
        "x/gpt": ("gpt2", Model(n_embd=5, n_layer=2, n_head=2)), "x/bert": ("bert", None), "x/odd": ("odd", Model()),
    }

    def loader(only, never=()):
        def from_pretrained(link, **more):
            assert not more  # code of a model's repository is never run
            if link in never or (only and link not in only):
                raise ValueError(f"no such class for {link}")
            return models[link][1]

        return SimpleNamespace(from_pretrained=from_pretrained)

    transformers.AutoConfig = SimpleNamespace(from_pretrained=lambda link: SimpleNamespace(model_type=models[link][0].upper()))
    transformers.T5EncoderModel, transformers.AutoModel, transformers.AutoModelForCausalLM = loader(["x/t5"]), loader(None, ["x/t5", "x/gpt"]), loader(["x/gpt"])
    transformers.AutoTokenizer = SimpleNamespace(from_pretrained=lambda link: Tokenizer())
    for name, module in (("torch", torch), ("esm", esm), ("transformers", transformers)):
        monkeypatch.setitem(sys.modules, name, module)
    for cached in (torch_backend._esm, torch_backend._hub):
        cached.cache_clear()
    Model.calls.clear()
    yield SimpleNamespace(torch=torch, models=models)
    for cached in (torch_backend._esm, torch_backend._hub):
        cached.cache_clear()


def check(out, hidden, attention, logits):
    assert set(out.hidden) == set(hidden) and set(out.attention) == set(attention)
    for k in hidden:
        np.testing.assert_array_equal(out.hidden[k], np.repeat(IDS[:, :, None] + k, 5, axis=2))
    for k in attention:
        np.testing.assert_allclose(out.attention[k], np.full((2, 2, 3, 3), k / 10), rtol=1e-6)
    assert (out.logits is None) == (not logits)
    if logits:
        np.testing.assert_array_equal(out.logits[:, :, 0], IDS * 2)


@pytest.mark.parametrize("device", ["cpu", "cuda"])
def test_esm(spark, libraries, device):
    encoder, vocabulary = load(spark, "esm2_t6_8M_UR50D", device=device)
    assert (encoder.num_layers, encoder.num_heads, encoder.hidden_size, encoder.vocab_size) == (3, 2, 5, 7) and "logits" in encoder.outputs
    assert (vocabulary.cls, vocabulary.sep, vocabulary.ids["L"]) == ("<cls>", "<eos>", 4)
    check(encoder(IDS, MASK, Wanted((1, 3), (2,), True)), (1, 3), (2,), True)
    assert Model.calls == [(device, device, {"repr_layers": [1, 3], "return_contacts": True})]
    check(encoder(IDS, MASK, Wanted((3,))), (3,), (), False)
    assert Model.calls[-1][2]["return_contacts"] is False


def test_without_a_device_the_cpu_is_used(spark, libraries):
    libraries.torch.has_cuda = False
    encoder, _ = load(spark, "esm2_t6_8M_UR50D", device="cuda")
    encoder(IDS, MASK, Wanted((1,)))
    assert Model.calls[0][:2] == ("cpu", "cpu")


@pytest.mark.parametrize("link,logits", [("x/t5", False), ("x/roformer", False), ("x/gpt", True)])
def test_hub_models(spark, libraries, link, logits):
    encoder, vocabulary = load(spark, link, device="cuda")
    assert (encoder.num_layers, encoder.num_heads, encoder.hidden_size, encoder.vocab_size) == (2, 2, 5, 7)
    assert ("logits" in encoder.outputs) == logits
    check(encoder(IDS, MASK, Wanted((0, 2), (1,), logits)), (0, 2), (1,), logits)
    device, _, asked = Model.calls[0]
    assert device == "cuda" and asked["output_hidden_states"] and asked["output_attentions"] and asked["attention_mask"].x.tolist() == MASK.astype(int).tolist()
    assert (vocabulary.cls, vocabulary.sep, vocabulary.pad, vocabulary.unk) == (None, "</s>", "<pad>", "<unk>")
    assert vocabulary.ids["A"] == 3 and vocabulary.special_ids == [0, 1, 2]


def test_models_that_are_not_read(spark, libraries):
    with pytest.raises(ValueError, match="custom"):
        load(spark, "x/bert")
    with pytest.raises(ValueError, match="configuration"):
        load(spark, "x/odd")


def test_full_memory_halves_the_batch(spark, libraries):
    libraries.models["x/roformer"][1].small = True
    encoder, _ = load(spark, "x/roformer", device="cuda")
    parts = encode_with_retry(encoder, IDS, MASK, Wanted((1,)))
    assert [p.start for p, _ in parts] == [0, 1]
    np.testing.assert_array_equal(np.concatenate([o.hidden[1][:, :, 0] for _, o in parts]), IDS + 1)


def test_torch_weights(spark, libraries, tmp_path):
    from residua.sources.files import read_weights

    (tmp_path / "model.pt").write_bytes(b"weights")
    seen = []

    def read(content, **how):
        seen.append((content.read(), how))
        return {"state_dict": {"token_embedding.weight": Tensor(np.ones((4, 6)))}}

    libraries.torch.load = read
    weights, config = read_weights(spark, str(tmp_path / "model.pt"))
    assert weights["token_embedding.weight"].shape == (4, 6) and config["hidden_size"] == 6
    assert seen == [(b"weights", {"map_location": "cpu", "weights_only": True})]


def test_missing_libraries_are_named(spark):
    with pytest.raises(ImportError, match="torch"):
        load(spark, "esm2_t6_8M_UR50D")
