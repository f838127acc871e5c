"""A transformer encoder in NumPy: token and position embeddings, post-norm blocks of self-attention and a ReLU network, a linear head for logits."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np

from residua.encoders.base import Output, Wanted, digest
from residua.functions.scalars import OUTPUT_TYPES


def layer_norm(x: np.ndarray, weight: np.ndarray, bias: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    centred = x - x.mean(axis=-1, keepdims=True)
    return centred / np.sqrt((centred * centred).mean(axis=-1, keepdims=True) + eps) * weight + bias


# Parts of the names that torch's encoder layers give their weights, and ours.
TORCH_NAMES = {
    "token_embedding.weight": "token_embedding",
    "position_embedding.weight": "position_embedding",
    "layer_norm.": "norm.",
    "output_head.": "head.",
    "transformer.layers.": "layers.",
    "self_attn.in_proj_": "in.",
    "self_attn.out_proj.": "out.",
    "linear1.": "up.",
    "linear2.": "down.",
}


def own_names(weights: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Weights by our names, from ours or torch's."""

    def own(name: str) -> str:
        for theirs, ours in TORCH_NAMES.items():
            name = name.replace(theirs, ours)
        return name

    return {own(k): v for k, v in weights.items()}


class NumpyTransformer:
    """Weights are named token_embedding, position_embedding, norm.{weight,bias}, layers.{k}.{in,out,up,down}.{weight,bias}, layers.{k}.{norm1,norm2}.{weight,bias}, head.{weight,bias}; a weight matrix is outputs x inputs, and `in` stacks query, key and value."""

    outputs = OUTPUT_TYPES

    def __init__(self, weights: Mapping[str, np.ndarray], num_heads: int):
        self.w = {k: np.asarray(v, np.float32) for k, v in own_names(weights).items()}
        self.num_heads = num_heads
        self.vocab_size, self.hidden_size = self.w["token_embedding"].shape
        self.num_layers = 1 + max((int(k.split(".")[1]) for k in self.w if k.startswith("layers.")), default=-1)
        if self.hidden_size % num_heads:
            raise ValueError(f"{num_heads} heads don't divide a width of {self.hidden_size}")

    @property
    def fingerprint(self) -> str:
        return f"{self.num_heads}:{digest(self.w)}"

    @classmethod
    def seeded(cls, vocab_size: int = 25, hidden_size: int = 32, num_layers: int = 2, num_heads: int = 4, max_length: int = 512, seed: int = 0) -> NumpyTransformer:
        """A model of random weights, the same for the same seed."""
        rng, d = np.random.default_rng(seed), hidden_size
        w: dict[str, np.ndarray] = {"token_embedding": rng.normal(size=(vocab_size, d)), "position_embedding": rng.normal(size=(max_length, d)), "norm.weight": np.ones(d), "norm.bias": np.zeros(d)}
        shapes = {"in": (3 * d, d), "out": (d, d), "up": (4 * d, d), "down": (d, 4 * d)}
        for k in range(num_layers):
            for name, shape in shapes.items():
                w[f"layers.{k}.{name}.weight"] = rng.normal(size=shape) / np.sqrt(shape[1])
                w[f"layers.{k}.{name}.bias"] = rng.normal(size=shape[0]) * 0.02
            for name in ("norm1", "norm2"):
                w[f"layers.{k}.{name}.weight"], w[f"layers.{k}.{name}.bias"] = np.ones(d), np.zeros(d)
        w["head.weight"], w["head.bias"] = rng.normal(size=(vocab_size, d)) / np.sqrt(d), np.zeros(vocab_size)
        return cls(w, num_heads)

    def _linear(self, x: np.ndarray, name: str) -> np.ndarray:
        return x @ self.w[f"{name}.weight"].T + self.w[f"{name}.bias"]

    def _norm(self, x: np.ndarray, name: str) -> np.ndarray:
        return layer_norm(x, self.w[f"{name}.weight"], self.w[f"{name}.bias"])

    def __call__(self, ids: np.ndarray, mask: np.ndarray, wanted: Wanted) -> Output:
        b, n = ids.shape
        if n > len(self.w["position_embedding"]):
            raise ValueError(f"sequences of {n} tokens; the model has {len(self.w['position_embedding'])} places")
        x = self._norm(self.w["token_embedding"][ids] + self.w["position_embedding"][:n], "norm")
        out = Output({0: x} if 0 in wanted.hidden else {})
        width = self.hidden_size // self.num_heads
        hide = np.where(mask[:, None, None, :], np.float32(0), np.float32(-np.inf))
        # Blocks above the highest wanted layer aren't computed unless logits are wanted.
        top = self.num_layers if wanted.logits else max([*wanted.hidden, *wanted.attention, 0])
        for k in range(top):
            q, key, v = (p.reshape(b, n, self.num_heads, width).transpose(0, 2, 1, 3) for p in np.split(self._linear(x, f"layers.{k}.in"), 3, axis=-1))
            scores = q @ key.transpose(0, 1, 3, 2) / np.float32(np.sqrt(width)) + hide
            scores = np.exp(scores - scores.max(axis=-1, keepdims=True))
            scores /= scores.sum(axis=-1, keepdims=True)
            if k + 1 in wanted.attention:
                out.attention[k + 1] = scores
            mixed = (scores @ v).transpose(0, 2, 1, 3).reshape(b, n, self.hidden_size)
            x = self._norm(x + self._linear(mixed, f"layers.{k}.out"), f"layers.{k}.norm1")
            x = self._norm(x + self._linear(np.maximum(self._linear(x, f"layers.{k}.up"), 0), f"layers.{k}.down"), f"layers.{k}.norm2")
            if k + 1 in wanted.hidden:
                out.hidden[k + 1] = x
        if wanted.logits:
            out.logits = self._linear(x, "head")
        return out
