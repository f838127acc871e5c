"""Encoders of public models through torch. The libraries are imported on use, on the driver for the sizes and once in each Python worker for the weights. Code of model repositories is never run."""

from __future__ import annotations

import functools

import numpy as np

from residua.encoders.base import Output, Wanted
from residua.functions.vocabulary import Vocabulary, from_files, without_word_marks

# Architectures of hub models that are read by a loader of their own, and those that must come as weights.
ENCODER_TYPES = ("t5", "mt5")
UNSUPPORTED_TYPES = ("bert",)
# The names that configurations give their sizes.
SIZES = {"num_layers": ("num_hidden_layers", "num_layers", "n_layer"), "num_heads": ("num_attention_heads", "num_heads", "n_head"), "hidden_size": ("hidden_size", "d_model", "embed_dim", "n_embd")}


def _need(name: str):
    try:
        return __import__(name)
    except ImportError as e:
        raise ImportError(f"this model needs the library {name}, which isn't installed") from e


def place(device: str) -> str:
    """The device that a run gets: the one asked for where torch has it, else the CPU."""
    torch = _need("torch")
    return device if device != "cpu" and torch.cuda.is_available() else "cpu"


@functools.cache
def _esm(link: str, device: str):
    _need("torch")
    _need("esm")
    from esm import pretrained

    model, alphabet = pretrained.load_model_and_alphabet_hub(link)
    return model.eval().to(device), alphabet


@functools.cache
def _hub(link: str, device: str):
    """(model, whether it gives logits). A model without a plain form is loaded with its language-model head."""
    _need("torch")
    transformers = _need("transformers")
    kind = transformers.AutoConfig.from_pretrained(link).model_type.lower()
    if kind in UNSUPPORTED_TYPES:
        raise ValueError(f"{link} is a {kind} model; give its weights as a custom model")
    if kind in ENCODER_TYPES:
        return transformers.T5EncoderModel.from_pretrained(link).eval().to(device), False
    try:
        return transformers.AutoModel.from_pretrained(link).eval().to(device), False
    except ValueError:
        return transformers.AutoModelForCausalLM.from_pretrained(link).eval().to(device), True


class TorchEncoder:
    """Holds names and sizes; the weights are loaded in the worker that runs it, once for each device."""

    def __init__(self, kind: str, link: str, num_layers: int, num_heads: int, hidden_size: int, vocab_size: int, has_logits: bool = False, device: str = "cpu"):
        self.kind, self.link, self.device = kind, link, device
        self.num_layers, self.num_heads, self.hidden_size, self.vocab_size = num_layers, num_heads, hidden_size, vocab_size
        pooled = ("per_token", "mean_pooled", "substring_pooled", "attention_head", "attention_layer", "attention_model")
        self.outputs = (*pooled, "logits") if has_logits else pooled

    @property
    def fingerprint(self) -> str:
        return f"{self.kind}:{self.link}"

    def __call__(self, ids: np.ndarray, mask: np.ndarray, wanted: Wanted) -> Output:
        import torch

        device = place(self.device)
        tokens, host = torch.as_tensor(ids).to(device), lambda x: x.float().cpu().numpy()
        with torch.no_grad():
            try:
                if self.kind == "esm":
                    found = _esm(self.link, device)[0](tokens, repr_layers=list(wanted.hidden), return_contacts=bool(wanted.attention))
                    attention = {k: host(found["attentions"][:, k - 1]) for k in wanted.attention}
                    return Output({k: host(found["representations"][k]) for k in wanted.hidden}, attention, host(found["logits"]) if wanted.logits else None)
                real = torch.as_tensor(mask.astype(np.int64)).to(device)
                found = _hub(self.link, device)[0](input_ids=tokens, attention_mask=real, output_hidden_states=True, output_attentions=bool(wanted.attention))
                hidden = {k: host(found.hidden_states[k]) for k in wanted.hidden}
                return Output(hidden, {k: host(found.attentions[k - 1]) for k in wanted.attention}, host(found.logits) if wanted.logits else None)
            except torch.cuda.OutOfMemoryError as e:
                torch.cuda.empty_cache()
                raise MemoryError(str(e)) from e


def _size(config, name: str) -> int:
    found = next((v for n in SIZES[name] if (v := getattr(config, n, None))), None)
    if found is None:
        raise ValueError(f"the model's configuration has none of {', '.join(SIZES[name])}")
    return found


def load(kind: str, link: str, device: str = "cpu") -> TorchEncoder:
    if kind == "esm":
        model, alphabet = _esm(link, "cpu")
        size = getattr(model, "embed_dim", None) or model.args.embed_dim
        heads = getattr(model, "attention_heads", None) or model.args.attention_heads
        return TorchEncoder(kind, link, model.num_layers, heads, size, len(alphabet.all_toks), True, device)
    model, has_logits = _hub(link, "cpu")
    config = model.config
    return TorchEncoder(kind, link, *(_size(config, n) for n in SIZES), config.vocab_size, has_logits, device)


def vocabulary(link: str) -> Vocabulary:
    """A hub tokenizer's vocabulary; a missing pad token is the end token, else the unknown one. The tokens around a sequence are those that the tokenizer itself puts around one."""
    tokenizer = _need("transformers").AutoTokenizer.from_pretrained(link)
    ids = tokenizer.get_vocab()
    made = from_files(without_word_marks(ids), {k: v for k, v in tokenizer.special_tokens_map.items() if isinstance(v, str)})
    names = {i: t for t, i in ids.items()}
    mark = -1
    around = list(tokenizer.build_inputs_with_special_tokens([mark]))
    at = around.index(mark)
    before, after = [names[i] for i in around[:at]], [names[i] for i in around[at + 1 :]]
    if len(before) > 1 or len(after) > 1:
        raise ValueError(f"{link}: more than one special token on a side of a sequence")
    return Vocabulary(made.ids, made.pad, before[0] if before else None, after[0] if after else None, made.unk, made.specials, made.upper, made.extra)
