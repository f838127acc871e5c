"""Small functions on flags, layers, names and precision, and their column forms."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

OUTPUT_TYPES = ("per_token", "mean_pooled", "substring_pooled", "attention_head", "attention_layer", "attention_model", "logits")


# Spellings of the command line's switches.
SWITCHES = {word: state for state, words in ((False, "0 f false n no"), (True, "1 t true y yes")) for word in words.split()}
#: Words for layers, and what they stand for; None is all of them.
LAYER_WORDS: dict[str, list[int] | None] = {"all": None, "last": [-1]}


def parse_bool(text: str | bool) -> bool:
    """A switch by its spelling, in either case."""
    state = SWITCHES.get(str(text).lower())
    if state is None:
        raise ValueError(f"a switch is one of {', '.join(sorted(SWITCHES))}; not {text!r}")
    return state


def parse_layers(text: str) -> list[int] | None:
    """A word for layers, or their numbers apart by spaces."""
    words = text.lower().split()
    if len(words) == 1 and words[0] in LAYER_WORDS:
        return LAYER_WORDS[words[0]]
    return list(map(int, words))


def normalise_layers(layers: Iterable[int] | None, n: int) -> list[int]:
    """Layers from 0 (input) to n; none given means 1 to n; negative ones count from the end, -1 being n. Repeated ones count once."""
    layers = list(layers or ())
    if not layers:
        return list(range(1, n + 1))
    wrong = [i for i in layers if not -(n + 1) <= i <= n]
    if wrong:
        raise ValueError(f"layers out of range for {n} layers: {wrong}")
    return list(dict.fromkeys((i + n + 1) % (n + 1) for i in layers))


def layer_column(layer: Column, n: Column | int) -> Column:
    """normalise_layers as a column; null out of range."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(layer.between(-(n + 1), n), F.pmod(layer + n + 1, n + 1))


def output_types(wanted: Sequence[str], available: Sequence[str] = OUTPUT_TYPES) -> list[str]:
    """Known output types once each, in the order given; those that the model lacks are left out."""
    unknown = [w for w in wanted if w not in OUTPUT_TYPES]
    if unknown:
        raise ValueError(f"unknown output types: {unknown}")
    return [w for w in dict.fromkeys(wanted) if w in available]


# Names of the precisions that arrays are written in.
PRECISIONS = {"16": np.float16, "float16": np.float16, "half": np.float16, "32": np.float32, "float32": np.float32, "full": np.float32}


def dtype_of(precision: str) -> np.dtype:
    if precision not in PRECISIONS:
        raise ValueError(f"a precision is one of {', '.join(PRECISIONS)}; not {precision!r}")
    return np.dtype(PRECISIONS[precision])


@F.pandas_udf(ArrayType(FloatType()))
def half_precision(values: pd.Series) -> pd.Series:
    """Values rounded to half precision, kept as float: Spark has no narrower type."""
    return values.map(lambda v: None if v is None else np.asarray(v, np.float16).astype(np.float32))


def max_length(requested: str | int | None, longest: int) -> int:
    """The padded length: the longest sequence unless a longer one is asked for."""
    if requested in (None, "max_length"):
        return longest
    return max(int(requested), longest)


def model_name(link: str, local: bool) -> str:
    """The last part of a local path without its suffix; of a link, what follows the first slash."""
    return PurePosixPath(link).stem if local else link.split("/", 1)[-1]


def model_name_column(link: Column) -> Column:
    return F.regexp_replace(link, "^[^/]*/", "")


def output_file(prefix: str, model: str, output_type: str, layer: int | None = None, head: int | None = None) -> str:
    """{prefix}_{model}_{type}[_layer_{L}][_head_{H+1}].npy"""
    parts = [prefix, model, output_type, *([f"layer_{layer}"] if layer is not None else []), *([f"head_{head + 1}"] if head is not None else [])]
    return "_".join(parts) + ".npy"


def output_file_column(prefix: Column, model: Column, output_type: Column, layer: Column, head: Column) -> Column:
    """output_file as a column; null layers and heads are left out."""
    return F.concat(F.concat_ws("_", prefix, model, output_type, F.concat(F.lit("layer_"), layer.cast("string")), F.concat(F.lit("head_"), (head + 1).cast("string"))), F.lit(".npy"))
