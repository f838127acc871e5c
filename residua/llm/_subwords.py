"""Character n-grams of many texts at once, as buckets of a hash table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from residua.llm._common import flat

#: Lengths of n-grams in bytes; a word's both ends count as a byte.
ORDERS = (4, 5, 6, 7, 8)
_EDGE = 0x5F
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts in lower case, with one edge byte before each word and at the end; n + 1 offsets of the texts."""
    lower = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    data, offsets = flat(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), lower, pa.scalar("", pa.large_string())))
    word = _WORD[data]
    keep = word.copy()
    keep[:-1] |= word[1:]
    places = np.concatenate([[0], np.cumsum(keep)])
    kept = np.where(word, data, np.uint8(_EDGE))[keep]
    return np.append(kept, np.uint8(_EDGE)), places[offsets]


def ngrams(texts: pa.Array, bits: int, orders: Sequence[int] = ORDERS):
    """Yields for each order (bucket, valid) of every place of the joined texts, after first yielding the texts' offsets into them."""
    data, offsets = _words(texts)
    n = len(data) - 1
    yield offsets
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((n,), "<u8", padded, strides=(1,)).copy()
    edges = np.flatnonzero(data == _EDGE)
    room = np.repeat(edges[1:], np.diff(edges))[:n] - np.arange(n)
    for order in orders:
        bucket = ((eight & np.uint64((1 << 8 * order) - 1)) * (_MULTIPLY + np.uint64(2 * order))) >> np.uint64(64 - bits)
        yield bucket.astype(np.int32), room >= order - 1


def raw_ngrams(texts: pa.Array, bits: int, orders: Sequence[int]):
    """As ngrams(), over the texts' bytes as they are."""
    data, offsets = flat(texts)
    n = len(data)
    yield offsets
    eight = np.ndarray((n,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,)).copy()
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    for order in orders:
        bucket = ((eight & np.uint64((1 << 8 * order) - 1)) * (_MULTIPLY + np.uint64(2 * order))) >> np.uint64(64 - bits)
        yield bucket.astype(np.int32), room >= order


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets; 0 for an empty text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def bags(steps, prior: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, its distinct buckets and their shares of its n-grams and `prior` neutral ones. steps: from ngrams() or raw_ngrams()."""
    offsets = next(steps)
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    keys = [(text << 32 | bucket[: len(text)])[valid[: len(text)]] for bucket, valid in steps]
    keys, counts = np.unique(np.concatenate(keys), return_counts=True)
    bounds = np.searchsorted(keys, np.arange(len(offsets), dtype=np.int64) << 32)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        n = counts[a:b]
        out.append(((keys[a:b] & 0xFFFFFFFF).astype(np.int32), (n / max(n.sum() + prior, 1)).astype(np.float32)))
    return out


def bag_scores(steps, weights: np.ndarray, prior: float) -> np.ndarray:
    """For each text, the weights of its n-grams averaged over them and `prior` neutral ones."""
    offsets = next(steps)
    total, count = np.zeros(len(offsets) - 1), np.full(len(offsets) - 1, float(prior))
    for bucket, valid in steps:
        total += per_text(np.where(valid, weights[bucket], 0), offsets)
        count += per_text(valid, offsets)
    return total / np.maximum(count, 1)
