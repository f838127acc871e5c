"""What an encoder is: token ids of a batch in, the wanted representations out."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np


@dataclass(frozen=True)
class Wanted:
    """What a run needs of a forward pass: nothing else is computed."""

    hidden: tuple[int, ...] = ()
    #: Layers whose attentions are needed, from 1.
    attention: tuple[int, ...] = ()
    logits: bool = False


@dataclass
class Output:
    #: By layer (0 is the input): batch x length x width.
    hidden: dict[int, np.ndarray] = field(default_factory=dict)
    #: By layer: batch x heads x length x length.
    attention: dict[int, np.ndarray] = field(default_factory=dict)
    #: Batch x length x vocabulary.
    logits: np.ndarray | None = None


class Encoder(Protocol):
    num_layers: int
    num_heads: int
    hidden_size: int
    vocab_size: int
    outputs: tuple[str, ...]
    #: Names the weights: a run that was stopped goes on with the same ones only.
    fingerprint: str

    def __call__(self, ids: np.ndarray, mask: np.ndarray, wanted: Wanted) -> Output: ...


def digest(arrays: Mapping[str, np.ndarray]) -> str:
    """A hash of the names and values of arrays."""
    out = hashlib.sha256()
    for name in sorted(arrays):
        value = np.ascontiguousarray(arrays[name])
        out.update(f"{name}:{value.dtype}:{value.shape}:".encode())
        out.update(value.data)
    return out.hexdigest()


def encode_with_retry(encoder: Encoder, ids: np.ndarray, mask: np.ndarray, wanted: Wanted) -> list[tuple[slice, Output]]:
    """Outputs of a batch; a batch that doesn't fit in memory is halved by rows until it does. A single row that doesn't fit is an error."""
    done, todo = [], [(0, len(ids))]
    while todo:
        a, b = todo.pop(0)
        try:
            done.append((slice(a, b), encoder(ids[a:b], mask[a:b], wanted)))
        except MemoryError:
            if b - a <= 1:
                raise
            middle = (a + b) // 2
            todo[:0] = [(a, middle), (middle, b)]
    return done


def batches_by_budget(lengths: Sequence[int], token_budget: int, bucket: bool = True) -> list[np.ndarray]:
    """Row numbers of batches whose rows times longest length stay within the budget, one row at least; by length, so that little is padded."""
    order = np.argsort(lengths, kind="stable") if bucket else np.arange(len(lengths))
    out, start, longest = [], 0, 0
    for k, i in enumerate(order):
        longest_with = max(longest, lengths[i])
        if k > start and (k - start + 1) * longest_with > token_budget:
            out.append(order[start:k])
            start, longest = k, lengths[i]
        else:
            longest = longest_with
    return [*out, order[start:]] if len(order) else []


#: Backends by name: (kind, loader). A loader gets (spark, link) and gives an encoder.
Loader = Callable[[object, str], Encoder]
