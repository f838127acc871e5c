"""A deterministic stand-in for a model: exact binary fractions of token, place, width and layer. Not a language model; it makes results that SQL can check bit by bit."""

from __future__ import annotations

import numpy as np

from residua.encoders.base import Output, Wanted, digest
from residua.functions.scalars import OUTPUT_TYPES


class SyntheticEncoder:
    outputs = OUTPUT_TYPES

    def __init__(self, num_layers: int = 6, num_heads: int = 4, hidden_size: int = 16, vocab_size: int = 25):
        self.num_layers, self.num_heads, self.hidden_size, self.vocab_size = num_layers, num_heads, hidden_size, vocab_size

    @property
    def fingerprint(self) -> str:
        return f"synthetic:{self.num_layers},{self.num_heads},{self.hidden_size},{self.vocab_size}"

    def __call__(self, ids: np.ndarray, mask: np.ndarray, wanted: Wanted) -> Output:
        t, pos = ids.astype(np.int64), np.arange(ids.shape[1])
        base = 31 * t + 17 * pos
        d, v = 7 * np.arange(self.hidden_size), 5 * np.arange(self.vocab_size)
        hidden = {k: ((base[:, :, None] + d + 13 * k) % 256 / 256).astype(np.float32) for k in wanted.hidden}
        attention = {}
        if wanted.attention:  # length squared: only on demand
            pair = 5 * t[:, None, :, None] + 3 * t[:, None, None, :] + pos[:, None] + 2 * pos
            heads = 7 * np.arange(self.num_heads)[None, :, None, None]
            attention = {k: ((pair + heads + 11 * k) % 8 / 8).astype(np.float32) for k in wanted.attention}
        logits = ((base[:, :, None] + v) % 256 / 256).astype(np.float32) if wanted.logits else None
        return Output(hidden, attention, logits)


class LookupEncoder:
    """One given vector for each token id (0 for others): real vectors without a model. All layers give the same."""

    outputs = ("per_token", "mean_pooled", "substring_pooled")
    num_heads = 0

    def __init__(self, vectors: np.ndarray, num_layers: int = 1):
        self.vectors = np.asarray(vectors, np.float32)
        self.num_layers, (self.vocab_size, self.hidden_size) = num_layers, self.vectors.shape

    @property
    def fingerprint(self) -> str:
        return digest({"vectors": self.vectors})

    def __call__(self, ids: np.ndarray, mask: np.ndarray, wanted: Wanted) -> Output:
        known = (ids >= 0) & (ids < self.vocab_size)
        found = np.where(known[:, :, None], self.vectors[np.where(known, ids, 0)], np.float32(0))
        return Output({k: found for k in wanted.hidden})
