"""Other inputs: substring tables, vocabularies, model configuration and weights."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.functions.vocabulary import Vocabulary, from_files, protein
from residua.operators.sequences import dedup_last


def read_substrings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (sequence_id, substring): the first two columns of CSV files by their place, whatever the header says. Of a repeated id the last row stays."""
    rows = spark.read.csv(path, header=True)
    first, second = rows.columns[:2]
    named = rows.select(F.col(f"`{first}`").alias("sequence_id"), F.coalesce(F.col(f"`{second}`"), F.lit("")).alias("substring"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"))
    return dedup_last(named, "sequence_id", "place", ["substring"]).select("sequence_id", "substring")


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A file's content through Spark's file systems, so that any store works; None if there is none. For small files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    if not fs.exists(where) or fs.getFileStatus(where).isDirectory():
        return None
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def read_json(spark: SparkSession, path: str) -> dict:
    found = read_bytes(spark, path)
    return json.loads(found) if found else {}


def read_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    """A vocabulary from a folder with vocab.json or vocab.txt (a token a line) and special_tokens_map.json; the default protein vocabulary if there is none."""
    ids: Mapping[str, int] = read_json(spark, f"{path}/vocab.json")
    if not ids and (text := read_bytes(spark, f"{path}/vocab.txt")):
        ids = {t: i for i, t in enumerate(text.decode().splitlines())}
    if not ids:
        return protein()
    special = read_json(spark, f"{path}/special_tokens_map.json")
    extra = special.pop("additional_special_tokens", [])
    made = from_files(ids, {k: v if isinstance(v, str) else v.get("content", "") for k, v in special.items()})
    return Vocabulary(made.ids, made.pad, made.cls, made.sep, made.unk, made.specials, extra={str(i): t if isinstance(t, str) else t.get("content", "") for i, t in enumerate(extra)})


@dataclass(frozen=True)
class _Rule:
    """Reads a value off the first weight, by rank of `parts`, whose name has all of one of them and whose shape gives one; 0 stands for the default."""

    parts: tuple[tuple[str, ...], ...]
    value: Callable[[tuple[int, ...]], int | None]
    default: int

    def read(self, shapes: Mapping[str, tuple[int, ...]]) -> int:
        for wanted in self.parts:
            for name, shape in shapes.items():
                if all(p in name.lower() for p in wanted) and (found := self.value(shape)) is not None:
                    return found or self.default
        return self.default


# Sizes of a model whose weights don't tell, and the width of a head.
_LAYERS, _HEADS, _WIDTH, _HEAD_WIDTH = 12, 12, 768, 64
_RULES = {
    "num_attention_heads": _Rule((("attention", "weight"),), lambda s: None if len(s) < 2 else 0 if s[1] % _HEAD_WIDTH else s[1] // _HEAD_WIDTH, _HEADS),
    "hidden_size": _Rule((("embed", "weight"), ("output", "weight")), lambda s: s[-1] if s else None, _WIDTH),
}


def infer_config(shapes: Mapping[str, tuple[int, ...]]) -> dict[str, int]:
    """Layers, heads and hidden size by the names, in either case, and the shapes of weights; see _RULES. Layers are one more than the highest number between dots in a name with `layer`."""
    numbers = pd.Series(list(shapes), dtype=str).str.lower().loc[lambda n: n.str.contains("layer")].str.extractall(r"(?:^|\.)(\d+)(?=\.|$)")[0].astype(int)
    return {"num_layers": int(numbers.max()) + 1 if len(numbers) else _LAYERS, **{name: rule.read(shapes) for name, rule in _RULES.items()}}


def read_weights(spark: SparkSession, path: str) -> tuple[dict[str, np.ndarray], dict]:
    """Weights (.npz) and configuration of a model folder or file. config.json overrides what the shapes imply. Torch files are read only where torch is installed, as plain tensors."""
    folder = None if re.search(r"\.(npz|pt|pth)$", path) else path
    for name in ("model.npz", "pytorch_model.pt", "model.pt", "model.pth") if folder else ("",):
        where = f"{path}/{name}" if folder else path
        if (content := read_bytes(spark, where)) is None:
            continue
        if where.endswith(".npz"):
            weights = dict(np.load(io.BytesIO(content)))
        else:
            import torch  # only where it is installed

            state = torch.load(io.BytesIO(content), map_location="cpu", weights_only=True)
            state = state.get("state_dict", state.get("model", state))
            weights = {k: v.numpy() for k, v in state.items()}
        config = infer_config({k: v.shape for k, v in weights.items()}) | (read_json(spark, f"{folder}/config.json") if folder else {})
        return weights, config
    raise FileNotFoundError(f"no model weights at {path}")
