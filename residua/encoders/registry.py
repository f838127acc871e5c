"""Which encoder a model name stands for."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

from residua.encoders.base import Encoder
from residua.encoders.synthetic import SyntheticEncoder
from residua.encoders.transformer import NumpyTransformer
from residua.functions.vocabulary import Vocabulary, esm, protein
from residua.sources.files import read_vocabulary, read_weights

# Names of the supported public models.
ESM_MODELS = (
    "esm1_t34_670M_UR50S", "esm1_t34_670M_UR50D", "esm1_t34_670M_UR100", "esm1_t12_85M_UR50S", "esm1_t6_43M_UR50S", "esm1b_t33_650M_UR50S",
    "esm1v_t33_650M_UR90S_1", "esm1v_t33_650M_UR90S_2", "esm1v_t33_650M_UR90S_3", "esm1v_t33_650M_UR90S_4", "esm1v_t33_650M_UR90S_5",
    "esm2_t6_8M_UR50D", "esm2_t12_35M_UR50D", "esm2_t30_150M_UR50D", "esm2_t33_650M_UR50D", "esm2_t36_3B_UR50D", "esm2_t48_15B_UR50D",
)
HUB_MODELS = ("Rostlab/prot_t5_xl_half_uniref50-enc", "Rostlab/ProstT5", "alchemab/antiberta2-cssp", "alchemab/antiberta2")
#: Models of names with this part take 256 tokens at most.
SHORT_MODELS, SHORT_LENGTH = "antiberta", 256


@dataclass(frozen=True)
class Choice:
    kind: str  # synthetic, custom, esm or hub
    link: str

    @property
    def local(self) -> bool:
        return self.kind == "custom"

    @property
    def length_limit(self) -> int | None:
        return SHORT_LENGTH if SHORT_MODELS in self.link.lower() else None


def choose(name: str) -> Choice:
    """The kind of a model by its name: synthetic[:layers,heads,width], a path (custom: before it, a suffix, a folder that begins with / or ., or a path of three parts), an ESM name, or user/name."""
    if name.startswith("synthetic"):
        return Choice("synthetic", name.partition(":")[2])
    if name.startswith("custom:"):
        return Choice("custom", name.removeprefix("custom:"))
    if re.search(r"\.(pt|pth|npz)$", name) or re.match(r"[./]|[a-z0-9+]+://", name) or name.count("/") > 1:
        return Choice("custom", name)
    if re.search("esm[12]", name.lower()):
        return Choice("esm", name)
    if re.fullmatch(r"[^/\s]+/[^/\s]+", name):
        return Choice("hub", name)
    raise ValueError(f"no such model: {name!r}; known are synthetic, paths, {', '.join(ESM_MODELS + HUB_MODELS)}, and user/name")


def load(spark: SparkSession, name: str, tokenizer_from: str | None = None, device: str = "cpu") -> tuple[Encoder, Vocabulary]:
    """The encoder and the vocabulary of a model name. Backends of large models import their libraries here, and fail with a plain message where they are missing."""
    choice = choose(name)
    if choice.kind == "synthetic":
        numbers = [int(x) for x in choice.link.split(",")] if choice.link else []
        return SyntheticEncoder(*numbers), read_vocabulary(spark, tokenizer_from) if tokenizer_from else protein(True)
    if choice.kind == "custom":
        weights, config = read_weights(spark, choice.link)
        folder = re.sub(r"/[^/]*\.(pt|pth|npz)$", "", choice.link)
        return NumpyTransformer(weights, config["num_attention_heads"]), read_vocabulary(spark, tokenizer_from or folder)
    from residua.encoders import torch_backend

    encoder = torch_backend.load(choice.kind, choice.link, device)
    if choice.kind == "esm":
        return encoder, esm(bool(re.search(r"esm1_", name)))
    return encoder, torch_backend.vocabulary(tokenizer_from or choice.link)
