"""Tokenisation: as column expressions, and of whole texts at once for the encoder's pass."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from residua.functions.vocabulary import Vocabulary

# One bracketed token or one character; a bracket that isn't closed is a character. Line feeds are no tokens.
SQUARE = r"\[[^\n]*?\]|[^\n]"
ANGLE = r"<[^\n]*?>|[^\n]"


def split_tokens(sequence: Column, bracket: str = "<") -> Column:
    """Array of tokens; an empty or null sequence has none."""
    pattern = {"<": ANGLE, "[": SQUARE}[bracket]
    return F.regexp_extract_all(F.coalesce(sequence, F.lit("")), F.lit(pattern), F.lit(0))


def gap(tokens: Column) -> Column:
    """Tokens joined by single spaces."""
    return F.array_join(tokens, " ")


def encode(tokens: Column, vocabulary: Vocabulary) -> Column:
    """Token ids; a token outside the vocabulary gets the unknown token's id (null without one).

    One ASCII character is looked up by its code in an array, other tokens in a map: a map literal is searched key by key.
    """
    ids, unk = vocabulary.as_map(), vocabulary.id_of(vocabulary.unk)
    spell = str.upper if vocabulary.upper else str
    codes = F.array(*[F.lit(vocabulary.ids.get(spell(chr(c)), vocabulary.ids.get(chr(c)))).cast("int") for c in range(128)])
    key = F.upper if vocabulary.upper else lambda t: t

    def lookup(t: Column) -> Column:
        plain = (F.length(t) == 1) & (F.ascii(t) < 128)
        return F.coalesce(F.when(plain, F.get(codes, F.ascii(t))).otherwise(F.coalesce(F.try_element_at(ids, key(t)), F.try_element_at(ids, t))), F.lit(unk).cast("int"))

    return F.transform(tokens, lookup)


def unknown_tokens(tokens: Column, vocabulary: Vocabulary) -> Column:
    """Sorted distinct tokens that the vocabulary lacks."""
    own = F.transform(tokens, lambda t: F.upper(t)) if vocabulary.upper else tokens
    known = F.array(*[F.lit(t) for t in vocabulary.valid_tokens])
    return F.array_sort(F.array_except(F.array_distinct(own), known))


def add_specials(ids: Column, vocabulary: Vocabulary, enabled: bool = True) -> Column:
    """Ids with the start token before and the end token after them, as far as the vocabulary has them."""
    if not enabled:
        return ids
    ends = [F.array(F.lit(i)) if (i := vocabulary.id_of(t)) is not None else None for t in (vocabulary.cls, vocabulary.sep)]
    return F.concat(*[x for x in (ends[0], ids, ends[1]) if x is not None])


def n_specials(vocabulary: Vocabulary, enabled: bool = True) -> tuple[int, int]:
    """How many special tokens stand before and after a sequence."""
    return (int(vocabulary.cls is not None), int(vocabulary.sep is not None)) if enabled else (0, 0)


def truncate(ids: Column, length: Column | int) -> Column:
    return F.slice(ids, 1, length)


def pad(ids: Column, length: Column | int, pad_id: int) -> Column:
    """Ids filled up at the right to a length; longer ones stay as they are."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(ids, F.array_repeat(F.lit(pad_id), F.greatest(length - F.size(ids), F.lit(0))))


def attention_mask(ids: Column, length: Column | int) -> Column:
    """1 for each id and 0 for each place of padding up to a length."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.greatest(length - F.size(ids), F.lit(0)))).cast("array<tinyint>")


def pooling_mask(ids: Column, vocabulary: Vocabulary) -> Column:
    """True where an id is no special token."""
    special = F.array(*[F.lit(i) for i in vocabulary.special_ids])
    return F.transform(ids, lambda x: ~F.array_contains(special, x))


class TextCodec:
    """Ids of whole texts by a lookup of code points: the ids and masks of encode(), add_specials() and pooling_mask(), without a token in a row of its own."""

    def __init__(self, vocabulary: Vocabulary, specials: bool = True):
        spell = str.upper if vocabulary.upper else str
        unk = vocabulary.id_of(vocabulary.unk)
        self._unk = -1 if unk is None else unk
        self._ids, self._spell = dict(vocabulary.ids), spell
        self._table = np.full(max([1 << 16, *(ord(t) + 1 for t in vocabulary.ids if len(t) == 1)]) + 1, self._unk, np.int32)  # the last one is for all beyond
        for code in range(len(self._table) - 1):
            found = self._ids.get(spell(chr(code)), self._ids.get(chr(code)))
            if found is not None:
                self._table[code] = found
        self._bracket = re.compile({"<": f"({ANGLE.split('|')[0]})", "[": f"({SQUARE.split('|')[0]})"}[vocabulary.bracket])
        ends = [vocabulary.id_of(t) if specials else None for t in (vocabulary.cls, vocabulary.sep)]
        self._before, self._after = (np.array([] if e is None else [e], np.int32) for e in ends)
        self._special = np.array(vocabulary.special_ids, np.int32)

    def _plain(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self._table[np.minimum(codes[codes != 10], len(self._table) - 1)]

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a text with the special tokens around it; -1 for an unknown token where the vocabulary has none for it."""
        text = text or ""
        parts = [self._before]
        for k, piece in enumerate(self._bracket.split(text) if self._bracket.search(text) else [text]):
            if k % 2:
                parts.append(np.array([self._ids.get(self._spell(piece), self._ids.get(piece, self._unk))], np.int32))
            elif piece:
                parts.append(self._plain(piece))
        return np.concatenate([*parts, self._after])

    def counted(self, ids: np.ndarray) -> np.ndarray:
        """True where an id is no special token."""
        return ~np.isin(ids, self._special)
