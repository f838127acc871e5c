"""Benchmark decontamination: rare n-gram seeds join training passages to test items, and Smith-Waterman alignment scores them.

An alignment with enough score has a least number of the item's n-grams in it unbroken (see `needed`). The n-grams of
test items are counted over all documents, the most frequent ones of an item are left out as seeds, fewer than that
number, and a passage needs as many different seeds as are then still certain. So no copy is lost, however it is edited,
and an item that is copied everywhere keeps seeds too. Such passages are aligned with the item word by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm._common import chunks, text_or_empty
from residua.llm._words import forget_tables, gram_hashes, word_hashes

#: Least score of a copy (1: every word of the item in order), and scores of a match, a mismatch and a gap.
LEAST_SCORE = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of test items that are sent to the executors at once (about 60 bytes each); a larger benchmark is searched in blocks of items, each against all documents.
BLOCK_WORDS = 500_000
#: Pairs of a word and a seed of an item that are held at once; one text alone may have more.
ENTRIES = 1 << 20


def needed(length: int, least_score: float) -> tuple[int, int, int]:
    """(words of a seed, different places of an item that begin a seed which any alignment with the score holds unbroken, least matches).

    With m matches and e other steps of at least -1 the score 2 m - e is least_score * 2 * length or more. So m is at least
    least_score * length. Each of the m - 1 neighbours in the alignment is a pair of words in both texts unless a step
    lies between: m - 1 - e pairs or more, least for m = length. Items too short for a certain pair are sought by words.
    """
    least = max(1, math.ceil(least_score * length - 1e-9))
    pairs = math.ceil((2 * least_score - 1) * length - 1 - 1e-9)
    return (2, pairs, least) if pairs >= 1 else (1, least, least)


@dataclass
class Items:
    """Test items as word hashes, and the index of their seeds: sorted hashes with the item and the place of each."""

    ids: np.ndarray
    words: list[np.ndarray]
    seeds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    maybe: np.ndarray = field(default_factory=lambda: np.zeros(1 << 20, bool))
    sizes: tuple[int, ...] = ()
    need: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def index(self, least_score: float = LEAST_SCORE) -> Items:
        """Indexes the n-grams of all items, of two words or one."""
        bounds = [needed(len(w), least_score) for w in self.words]
        self.need = np.array([b[1] for b in bounds], dtype=np.int64)
        hashes, item, place = [], [], []
        for k, w in enumerate(self.words):
            n = bounds[k][0]
            own = gram_hashes(w, n) + np.uint64(n)
            hashes.append(own)
            item.append(np.full(len(own), k))
            place.append(np.arange(len(own)))
        hashes = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.argsort(hashes, kind="stable")
        self.seeds, self.item, self.place = hashes[order], np.concatenate([np.zeros(0, np.int64), *item])[order], np.concatenate([np.zeros(0, np.int64), *place])[order]
        self.sizes = tuple(sorted({b[0] for b in bounds}))
        return self._filter()

    def _filter(self) -> Items:
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.seeds >> np.uint64(44)] = True
        return self

    def rare(self, counts: dict[int, int]) -> Items:
        """Leaves out each item's most frequent n-grams, less than half of the certain ones, which the number needed falls by."""
        count = np.array([counts.get(int(s), 0) for s in self.seeds.view(np.int64)], dtype=np.int64)
        order = np.lexsort((-count, self.item))
        rank = np.zeros(len(count), np.int64)
        rank[order] = np.arange(len(count)) - np.searchsorted(self.item[order], self.item[order])
        spare = (self.need - 1) // 2
        keep = rank >= spare[self.item]
        self.need = self.need - spare
        self.seeds, self.item, self.place = self.seeds[keep], self.item[keep], self.place[keep]
        return self._filter()

    def hits(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words at which a seed begins, within one text, and the seeds' hashes."""
        places, hashes = [], []
        ends = np.repeat(offsets[1:], np.diff(offsets))
        for n in self.sizes:
            own = gram_hashes(words, n) + np.uint64(n)
            at = np.flatnonzero(self.maybe[own >> np.uint64(44)])
            at = at[(at + n <= ends[at]) & (self.seeds[np.minimum(np.searchsorted(self.seeds, own[at]), len(self.seeds) - 1)] == own[at])]
            places.append(at)
            hashes.append(own[at])
        return np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.uint64), *hashes])


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> int:
    """The best local alignment score of two word sequences."""
    steps = GAP * np.arange(len(passage) + 1)
    above, best = np.zeros(len(passage) + 1, np.int64), 0
    for word in item:
        row = np.zeros(len(passage) + 1, np.int64)
        row[1:] = np.maximum(np.maximum(above[:-1] + np.where(passage == word, MATCH, MISMATCH), above[1:] + GAP), 0)
        row = np.maximum.accumulate(row - steps) + steps  # gaps along the passage
        best = max(best, int(row.max()))
        above = row
    return best


def aligned(words: np.ndarray, offsets: np.ndarray, items: Items, least_score: float = LEAST_SCORE) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, end word) of each text and item with the score or more: its best passage."""
    at, hashes = items.hits(words, offsets)
    if not len(at):
        return []
    lengths = np.array([len(w) for w in items.words])
    first, last = np.searchsorted(items.seeds, hashes, "left"), np.searchsorted(items.seeds, hashes, "right")
    each = last - first
    if each.sum() > ENTRIES and len(offsets) > 2:
        half = len(offsets) // 2
        later = aligned(words[offsets[half] :], offsets[half:] - offsets[half], items, least_score)
        return aligned(words[: offsets[half]], offsets[: half + 1], items, least_score) + [(t + half, *x) for t, *x in later]
    entry = np.repeat(first - np.cumsum(each) + each, each) + np.arange(each.sum())
    at, item, place = np.repeat(at, each), items.item[entry], items.place[entry]
    text = np.searchsorted(offsets, at, "right") - 1
    length = lengths[item]
    slack = np.floor(2 * (1 - least_score) * length + 1e-9).astype(np.int64)  # words that can be inserted into a copy
    low = np.maximum(at - place - slack, offsets[text])
    high = np.minimum(at - place + length + slack, offsets[text + 1])
    order = np.lexsort((low, item, text))
    text, item, place, low, high = text[order], item[order], place[order], low[order], high[order]
    # Passages of one text and item that overlap are one; with low, high grows too.
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1])
    begin, chain = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    ends = np.append(begin[1:], len(text)) - 1
    by = np.lexsort((place, chain))
    new = np.ones(len(by), bool)
    new[1:] = (chain[by][1:] != chain[by][:-1]) | (place[by][1:] != place[by][:-1])
    places = np.bincount(chain[by][new], minlength=len(begin))
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    for i in np.flatnonzero(places >= items.need[item[begin]]).tolist():
        t, k, a, b = int(text[begin[i]]), int(item[begin[i]]), int(low[begin[i]]), int(high[ends[i]])
        own, passage = items.words[k], words[a:b]
        if np.isin(own, passage).sum() < needed(len(own), least_score)[2]:
            continue
        value = smith_waterman(own, passage) / (MATCH * len(own))
        if value >= least_score and value > found.get((t, k), (-1.0,))[0]:
            found[t, k] = (value, a - int(offsets[t]), b - int(offsets[t]))
    return [(*key, *value) for key, value in found.items()]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS, least_score: float = LEAST_SCORE) -> Iterator[Items]:
    """The benchmark's items in blocks whose size is bounded. Items without words or without id are left out; repeated rows of an item count once."""
    rows = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).distinct()
    total = rows.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    number = max(1, -(-total // block_words))
    for k in range(number):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(number)) == k).orderBy("id", "text").collect()  # one block, bounded by block_words
        words, offsets = word_hashes(pa.array([r["text"] for r in own], pa.string()))
        forget_tables()
        parts = [words[a:b] for a, b in zip(offsets, offsets[1:])]
        yield Items(np.array([r["id"] for r, w in zip(own, parts) if len(w)], dtype=np.int64), [w for w in parts if len(w)]).index(least_score)


def seeded(docs: DataFrame, items: Items, text_col: str) -> Items:
    """The items with their rare seeds: each n-gram's count is the number of documents that have it, over all documents."""
    held = docs.sparkSession.sparkContext.broadcast(items)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}  # at most one entry for each n-gram of the block
        for part in chunks(batches, "text"):
            words, offsets = word_hashes(part.column("text"))
            at, hashes = held.value.hits(words, offsets)
            text = np.searchsorted(offsets, at, "right")
            pairs = np.unique(np.stack([text.astype(np.uint64), hashes]), axis=1)
            for h, n in zip(*np.unique(pairs[1].view(np.int64), return_counts=True)):
                total[int(h)] = total.get(int(h), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["seed", "n"])

    counts = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(work, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    return items.rare({r["seed"]: r["n"] for r in counts.collect()})  # bounded by the block's n-grams


def matches(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (doc_id, item_id, score, first_word, end_word) for each document with a copy of a test item: score is the alignment's share of a whole copy's, and the words are those of the passage that was aligned.

    Nulls: null texts are empty; documents without id give rows with a null doc_id, items without id or words give none.
    Empty texts hold no copy; texts of any length are searched whole. Repeated rows of a document or an item give one row
    for each pair of ids, the best. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id long, score double, first_word int, end_word int")
    for block in blocks(benchmark, item_id_col, item_text_col, block_words, least_score):
        if not len(block.ids):
            continue
        held = docs.sparkSession.sparkContext.broadcast(seeded(docs, block, text_col))

        def work(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for part in chunks(batches, "text"):
                rows = aligned(*word_hashes(part.column("text")), held.value, least_score)
                ids = part.column("doc_id").take(pa.array([x[0] for x in rows], pa.int64()))
                items = pa.array(held.value.ids[[x[1] for x in rows]] if rows else [], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, items, pa.array([x[2] for x in rows], pa.float64()), pa.array([x[3] for x in rows], pa.int32()), pa.array([x[4] for x in rows], pa.int32())], ["doc_id", "item_id", "score", "first_word", "end_word"])

        found = found.unionByName(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(work, found.schema))
    best = F.max(F.struct("score", "first_word", "end_word")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.score", "best.first_word", "best.end_word")


def drop_copies(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs without a copy of a test item, unchanged and with all columns; one pass for each block of items, without a shuffle. Null and empty texts hold no copy and stay; repeated rows go or stay together; texts of any length are searched whole. An empty benchmark lets all rows stay."""
    kept = docs
    for block in blocks(benchmark, item_id_col, item_text_col, block_words, least_score):
        if not len(block.ids):
            continue
        held = docs.sparkSession.sparkContext.broadcast(seeded(docs, block, text_col))

        def work(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for part in chunks(batches, text_col):
                keep = np.ones(part.num_rows, bool)
                keep[[x[0] for x in aligned(*word_hashes(part.column(text_col)), held.value, least_score)]] = False
                yield part.filter(pa.array(keep))

        kept = kept.mapInArrow(work, docs.schema)
    return kept
