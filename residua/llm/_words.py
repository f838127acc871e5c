"""Hashes of all words of many texts at once, without a loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from residua.llm._common import flat, mix

_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of R and of its inverse modulo 2^64, for at least n places."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(20, int(n).bit_length())
        made = []
        for r in (_R, _RINV):
            table = np.ones(size, np.uint64)
            done = 1
            while done < size:
                table[done : 2 * done] = table[:done] * np.uint64(pow(r, done, 1 << 64))
                done *= 2
            made.append(table)
        _powers[:] = made
    return _powers


def forget_tables() -> None:
    """Drops the tables that were made in this process, so that functions shipped to executors don't carry them along."""
    _powers.clear()


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the texts (runs of letters and digits; bytes above ASCII are letters; case doesn't count) and the n + 1 offsets of the texts in them."""
    lower = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    data, offsets = flat(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), lower, pa.scalar("", pa.large_string())))
    word = np.append(_WORD[data], False)
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1  # data begins with a space
    start, end = edge[::2], edge[1::2]
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, offsets)


SPACE = np.zeros(256, bool)
SPACE[[*range(9, 14), 32]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case, plus one, as wide numbers for hashing."""
    return _LOWER[data]


def word_edges(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word of the flat texts (what stands between ASCII white space, and from one break to the next), and the n + 1 offsets of the texts in the words."""
    word = ~SPACE[data]
    filled = np.flatnonzero(np.diff(offsets))
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    if breaks is not None:
        first |= breaks & word
        last[:-1] |= breaks[1:] & word[:-1]
    first[offsets[filled]] = word[offsets[filled]]
    last[offsets[filled + 1] - 1] = word[offsets[filled + 1] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def spaced_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and 64-bit hash of each word of the flat texts (what stands between ASCII white space; A-Z in lower case), and the n + 1 offsets of the texts in the words."""
    start, end, bounds = word_edges(data, offsets)
    return start, end, range_hashes(lowered(data), start, end), bounds


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each start and end."""
    up, down = _power_tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD1342543DE82EF95) + words[k : len(words) - n + 1 + k]
    return mix(out)
