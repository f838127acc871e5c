"""Vocabularies: token to id, special tokens and their roles."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special tokens and residues in the order of their ids.
PROTEIN_SPECIALS = ("<pad>", "<cls>", "<sep>", "<unk>")
PROTEIN_RESIDUES = "ARNDCQEGHILKMFPSTWYV"
# The public ESM alphabet's residues and marks in the order of their ids.
ESM_RESIDUES = "LAGVSERTIDPKQNFYMHWCXBUZO.-"


@dataclass(frozen=True)
class Vocabulary:
    ids: Mapping[str, int]
    pad: str = "<pad>"
    cls: str | None = "<cls>"
    sep: str | None = "<sep>"
    unk: str | None = "<unk>"
    specials: tuple[str, ...] = PROTEIN_SPECIALS
    #: Tokens are looked up in upper case.
    upper: bool = False
    extra: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.pad not in self.ids:
            raise ValueError(f"the pad token {self.pad} is not in the vocabulary")

    @property
    def special_ids(self) -> list[int]:
        """Ids of the special tokens, the unknown token included: they never count in a mean."""
        return sorted(self.ids[t] for t in self.specials if t in self.ids)

    @property
    def pad_id(self) -> int:
        return self.ids[self.pad]

    def id_of(self, token: str | None) -> int | None:
        return None if token is None else self.ids.get(token)

    @property
    def bracket(self) -> str:
        """'<' or '[': the style of bracketed tokens, by the first special token; anything else is an error."""
        first = next(iter([*self.extra.values(), *self.specials]), "")[:1]
        if first not in ("<", "["):
            raise ValueError(f"special tokens begin with neither < nor [: {first!r}")
        return first

    @property
    def valid_tokens(self) -> list[str]:
        return sorted(self.ids)

    @property
    def fingerprint(self) -> str:
        parts = [sorted(self.ids.items()), self.pad, self.cls, self.sep, self.unk, self.specials, self.upper, sorted(self.extra.items())]
        return hashlib.sha256(repr(parts).encode()).hexdigest()

    def as_map(self) -> Column:
        """A map literal, folded once; a vocabulary has tens of entries."""
        return F.create_map(*itertools.chain.from_iterable((F.lit(t), F.lit(i)) for t, i in self.ids.items()))


def protein(unknown_residue: bool = False) -> Vocabulary:
    """The default protein vocabulary: 4 specials and 20 residues, with X as a 25th token on demand."""
    tokens = [*PROTEIN_SPECIALS, *PROTEIN_RESIDUES, *("X" if unknown_residue else "")]
    return Vocabulary({t: i for i, t in enumerate(tokens)}, upper=not unknown_residue)


def esm(first_generation: bool = False) -> Vocabulary:
    """The alphabet of ESM models, filled up with null tokens to a multiple of eight before the last marks; the first generation ends no sequence."""
    before = ["<null_0>", "<pad>", "<eos>", "<unk>"] if first_generation else ["<cls>", "<pad>", "<eos>", "<unk>"]
    after = ["<cls>", "<mask>", "<sep>"] if first_generation else ["<mask>"]
    tokens = [*before, *ESM_RESIDUES]
    tokens += [f"<null_{i + 1}>" for i in range(-len(tokens) % 8)] + after
    specials = ("<cls>", "<pad>", "<eos>", "<unk>", "<mask>")
    return Vocabulary({t: i for i, t in enumerate(tokens)}, sep=None if first_generation else "<eos>", specials=specials)


def without_word_marks(ids: Mapping[str, int]) -> dict[str, int]:
    """Vocabulary keys without a leading word mark (U+2581), as sentence-piece vocabularies have them."""
    return {t.removeprefix("▁"): i for t, i in ids.items()}


def from_files(vocab: Mapping[str, int], config: Mapping[str, str] | None = None) -> Vocabulary:
    """A vocabulary from a token map and a special-token map (pad_token, cls_token, ...). Sequences begin with the cls token, else the bos token, and end with the sep token, else the eos token, as far as there are such."""
    given = {k.removesuffix("_token"): v for k, v in (config or {}).items() if k.endswith("_token") and isinstance(v, str)}
    known = {n: t for n in ("pad", "cls", "bos", "sep", "eos", "unk") if (t := given.get(n, f"<{n}>")) in vocab or n in given}
    if "eos" not in known and "</s>" in vocab:
        known["eos"] = "</s>"
    roles = {"cls": known.get("cls", known.get("bos")), "sep": known.get("sep", known.get("eos")), "unk": known.get("unk")}
    pad = known.get("pad") or roles["sep"] or roles["unk"] or "<pad>"
    specials = tuple(dict.fromkeys([*given.values(), *known.values()]))
    return Vocabulary(dict(vocab), pad=pad, specials=specials, **roles)
