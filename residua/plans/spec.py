"""What a run is asked to do, checked before any work."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from residua.encoders.base import Encoder, Wanted
from residua.functions.scalars import dtype_of, normalise_layers, output_types


@dataclass(frozen=True)
class EmbedSpec:
    model_name: str
    output_path: str = ""
    fasta_path: str = ""
    experiment_name: str | None = None
    tokenizer_from: str | None = None
    substring_path: str | None = None
    context: int = 0
    layers: tuple[int, ...] | None = (-1,)
    extract: tuple[str, ...] = ("mean_pooled",)
    #: Tokens of a batch, padding included.
    batch_size: int = 1024
    discard_padding: bool = False
    max_length: str | int = "max_length"
    #: Commit in slices and resume after a stop, instead of one write at the end.
    streaming_output: bool = True
    num_workers: int = 8
    disable_special_tokens: bool = False
    flatten: bool = False
    flush_batches_after: int = 128
    precision: str = "32"
    device: str = "cpu"
    #: Rows of a slice that is committed at once.
    commit_rows: int = 1_000_000
    npy: bool = False
    #: Slices that one call writes at most; a later call goes on. None is all.
    slices_at_most: int | None = None

    def __post_init__(self):
        output_types(self.extract)
        dtype_of(self.precision)
        if "substring_pooled" in self.extract and not self.substring_path:
            raise ValueError("substring_pooled needs a substring table")
        if self.context < 0 or self.batch_size < 1 or self.commit_rows < 1 or self.num_workers < 1 or (self.slices_at_most is not None and self.slices_at_most < 1):
            raise ValueError("context must not be negative; batch_size, commit_rows, num_workers and slices_at_most must be positive")
        if self.max_length != "max_length" and int(self.max_length) < 1:
            raise ValueError("max_length must be positive")

    def run_key(self, fingerprint: str) -> str:
        """Names a run by what its results depend on (fingerprint: of the input, the weights and the vocabulary), so that progress of another one is never taken for this one's."""
        given = {k: v for k, v in asdict(self).items() if k not in ("output_path", "num_workers", "flush_batches_after", "device", "commit_rows", "batch_size", "npy", "slices_at_most")}
        return hashlib.sha256(json.dumps([given, fingerprint], sort_keys=True, default=str).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Resolved:
    """A specification against a model: which layers and outputs there will be."""

    layers: tuple[int, ...]
    outputs: tuple[str, ...]
    wanted: Wanted
    keys: tuple[tuple[str, int | None, int | None], ...]


def resolve(spec: EmbedSpec, encoder: Encoder) -> Resolved:
    """Layers and outputs of a run; outputs that the model lacks are left out. Attentions belong to layers from 1, so layer 0 has none."""
    layers = tuple(normalise_layers(spec.layers, encoder.num_layers))
    outputs = tuple(output_types(spec.extract, encoder.outputs))
    attention = [o for o in outputs if o in ("attention_head", "attention_layer")]
    if attention and 0 in layers:
        raise ValueError(f"layer 0 is the input and has no attentions for {', '.join(attention)}")
    needs = layers if attention else ()
    if "attention_model" in outputs:
        needs = tuple(range(1, encoder.num_layers + 1))
    hidden = layers if {"per_token", "mean_pooled", "substring_pooled"} & set(outputs) else ()
    keys: list[tuple[str, int | None, int | None]] = []
    for o in outputs:
        if o == "attention_head":
            keys += [(o, k, h) for k in layers for h in range(encoder.num_heads)]
        elif o in ("attention_model", "logits"):
            keys.append((o, None, None))
        else:
            keys += [(o, k, None) for k in layers]
    return Resolved(layers, outputs, Wanted(hidden, needs, "logits" in outputs), tuple(keys))
