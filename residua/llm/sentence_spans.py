"""Substring dedup by sliding sentence spans.

Runs of several consecutive sentences are hashed, hashes are joined over the whole corpus, and sentences that a run
covers whose first occurrence is elsewhere are removed. The shortest run from each sentence and, with `whole`, the
shortest one to each sentence stand for all runs: what a longer repeated run covers, shortest ones inside it cover too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm._common import chunks, durable, flat, let_go, mix
from residua.llm._spans import keyed, remove_runs
from residua.llm._words import SPACE, lowered, range_hashes, word_edges

#: A run has at least so many sentences and so many words. A sentence counts once for each so many words.
SENTENCES, WORDS = 2, 20
#: Words that end with one of these end a sentence; the full-width ones do without white space behind them too.
STOPS, WIDE_STOPS = ".!?\u2026", "\u3002\uff01\uff1f\uff0e\uff61"
#: Marks that may stand between a stop and the end of its sentence.
CLOSERS = "\"')]}\u00bb\u2019\u201d\u300d\u300f\uff09\u3011"
#: A text without any stop is cut after words whose first byte and number of bytes add up to a multiple of this.
CUT = 8


def _ends(data: np.ndarray, characters: str) -> np.ndarray:
    """Whether each byte is the last one of one of the characters."""
    out = np.zeros(len(data), bool)
    by_size: dict[int, list[bytes]] = {}
    for c in characters:
        by_size.setdefault(len(c.encode()), []).append(c.encode())
    for n, codes in by_size.items():
        known = np.zeros(256, bool)
        known[[c[-1] for c in codes]] = True
        at = np.flatnonzero(known[data])
        at = at[at >= n - 1]
        if n > 1:
            value = sum(data[at - n + 1 + k].astype(np.int64) << 8 * (n - 1 - k) for k in range(n))
            at = at[np.isin(value, [int.from_bytes(c, "big") for c in codes])]
        out[at] = True
    return out


def _covers(ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    """All bytes of the characters whose last bytes are marked."""
    out = ends.copy()
    for k in (1, 2):
        at = np.flatnonzero(ends & (data >= 0x80))
        at = at[(at >= k)]
        out[at - k] |= (data[at - k] >= 0x80) & ((k == 1) | ((data[at - 1] & 0xC0) == 0x80))
    return out


def sentences(data: np.ndarray, offsets: np.ndarray):
    """Of flat texts: (first byte of each word, hash of each word, first word and end word of each sentence, offsets of the texts in the sentences).

    A sentence ends at a word that ends with a stop and closing marks, at a line's end, or at the text's end.
    """
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    closer, wide = _ends(data, CLOSERS), _ends(data, WIDE_STOPS)
    stop = _ends(data, STOPS) | wide
    inside = _covers(closer, data)
    # The last byte at or before each byte that is in no closing mark.
    body = np.maximum.accumulate(np.where(inside, -1, np.arange(len(data))))
    breaks = np.zeros(len(data), bool)
    if wide.any():
        after = np.flatnonzero((body[:-1] >= 0) & wide[body[:-1]]) + 1
        after = after[body[after - 1] >= offsets[np.searchsorted(offsets, after, "right") - 1]]
        breaks[after] = ~inside[after] & ~_covers(wide, data)[after] & ~SPACE[data[after]]
    start, end, bounds = word_edges(data, offsets, breaks)
    if not len(start):
        return start, none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    hashes = range_hashes(lowered(data), start, end)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    last = (body[end - 1] >= start) & stop[body[end - 1]]
    stopped = np.bincount(text, last, minlength=len(bounds) - 1) > 0
    size = end - start
    last |= ~stopped[text] & ((lowered(data[start]).astype(np.int64) - 1 + size) % CUT == 0)
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    last[:-1] |= feeds[start[1:]] > feeds[end[:-1]]
    last[bounds[1:][np.diff(bounds) > 0] - 1] = True
    to = np.flatnonzero(last) + 1
    first = np.concatenate([[0], to[:-1]])
    return start, hashes, first, to, np.searchsorted(first, bounds)


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each sentence, and the texts' offsets in the sentences."""
    start, _, first, _, bounds = sentences(data, offsets)
    return start[first], bounds


def runs(data: np.ndarray, offsets: np.ndarray, least_sentences: int = SENTENCES, least_words: int = WORDS, whole: bool = False):
    """(text, first sentence, end sentence, hash of 2 x 64 bits) of the run from each sentence: the shortest one with enough sentences and words. Case of A-Z and white space don't count.

    whole: also the shortest run to each sentence where it is another one.
    """
    _, hashes, first, stop, bounds = sentences(data, offsets)
    units = np.maximum(1, (stop - first) // WORDS)
    total = np.cumsum(units)
    end = 1 + np.maximum(np.searchsorted(stop, first + least_words), np.searchsorted(total, total - units + least_sentences))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    own = np.flatnonzero(end <= bounds[text + 1])
    text, end = text[own], end[own]
    if whole and len(first):
        to = np.arange(1, len(first) + 1)
        before = total - units
        start = np.minimum(np.searchsorted(first, stop - least_words, "right"), np.searchsorted(before, total - least_sentences, "right")) - 1
        of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        known = np.zeros(len(first), np.int64)
        known[own] = end
        more = np.flatnonzero((start >= bounds[of]) & (known[np.maximum(start, 0)] != to))
        text, own, end = np.concatenate([text, of[more]]), np.concatenate([own, start[more]]), np.concatenate([end, to[more]])
    words = first[own], stop[end - 1]
    h1, h2 = range_hashes(hashes, *words), range_hashes(mix(hashes + np.uint64(1)), *words)
    return text, own - bounds[text], end - bounds[text], h1, h2


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each sentence, and the texts' offsets in the sentences."""
    start, _, first, _, bounds = sentences(data, offsets)
    return start[first], bounds


def runs(data: np.ndarray, offsets: np.ndarray, least_sentences: int = SENTENCES, least_words: int = WORDS, whole: bool = False):
    """(text, first sentence, end sentence, hash of 2 x 64 bits) of the run from each sentence: the shortest one with enough sentences and words. Case of A-Z and white space don't count.

    whole: also the shortest run to each sentence where it is another one.
    """
    _, hashes, first, stop, bounds = sentences(data, offsets)
    units = np.maximum(1, (stop - first) // WORDS)
    total = np.cumsum(units)
    end = 1 + np.maximum(np.searchsorted(stop, first + least_words), np.searchsorted(total, total - units + least_sentences))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    own = np.flatnonzero(end <= bounds[text + 1])
    text, end = text[own], end[own]
    if whole and len(first):
        to = np.arange(1, len(first) + 1)
        before = total - units
        start = np.minimum(np.searchsorted(first, stop - least_words, "right"), np.searchsorted(before, total - least_sentences, "right")) - 1
        of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        known = np.zeros(len(first), np.int64)
        known[own] = end
        more = np.flatnonzero((start >= bounds[of]) & (known[np.maximum(start, 0)] != to))
        text, own, end = np.concatenate([text, of[more]]), np.concatenate([own, start[more]]), np.concatenate([end, to[more]])
    words = first[own], stop[end - 1]
    h1, h2 = range_hashes(hashes, *words), range_hashes(mix(hashes + np.uint64(1)), *words)
    return text, own - bounds[text], end - bounds[text], h1, h2


def span_hashes(docs: DataFrame, id_col: str, text_col: str, least_sentences: int, least_words: int, whole: bool = False) -> DataFrame:
    """Rows (h1, h2, id, h, start, end): one for each run of each document."""
    rows = keyed(docs, id_col, text_col)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            text, start, end, h1, h2 = runs(*flat(part.column("text")), least_sentences, least_words, whole)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), part.column("id").take(at), part.column("h").take(at), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["h1", "h2", "id", "h", "start", "end"])

    return rows.mapInArrow(work, f"h1 long, h2 long, id {rows.schema['id'].dataType.simpleString()}, h long, start int, end int")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_sentences: int = SENTENCES, least_words: int = WORDS, whole: bool = False) -> DataFrame:
    """docs with repeated runs removed from the texts, and columns __parts (sentences), __removed (of them) and __spans (code points of the old text).

    A run is two or more consecutive sentences with 20 or more words together; its first occurrence is that with the
    smallest (doc_id, hash of the text, sentence number). All later occurrences go, in other documents and in the same
    one. Rows are neither dropped nor added. whole: a repeated run goes to its last sentence, so a text of repeats alone
    becomes empty; without it, sentences behind the last shortest run from a sentence stay. Sentences are whole: they end
    at stops (also full-width ones, and stops before closing quotes and brackets) and at line ends. A sentence of 40 or
    more words counts as several. A text without any stop is cut after words that its content chooses, so that runs meet
    again behind an edit.

    Nulls: a null text stays null; rows without id are not read for runs and stay as they are. Empty texts stay empty, and
    texts of any length are read whole. A document is known by its doc_id and its text: repeated rows are one document, and
    rows that share a doc_id but not their text are documents of their own. doc_id may be of any type with an order. Other
    columns are kept, whatever their names (but for the three added). An empty table gives an empty table.
    """
    each = span_hashes(docs, id_col, text_col, least_sentences, least_words, whole)
    where = F.struct("id", "h", "start")
    # Half of the hash tells most runs of no repeat apart, in the narrowest rows; counts are partial before the shuffle, so
    # a run that everyone has is a few rows. What is left is kept as a table. Joins have a shuffle on both sides: AQE splits
    # their hot keys.
    shared = durable(each.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1"))
    near = durable(each.join(shared, "h1", "left_semi"))
    let_go(shared)
    repeated = durable(near.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(where).alias("first")).where("n > 1").drop("n"))
    later = durable(near.join(repeated, ["h1", "h2"]).where(where > F.col("first")).select("id", "h", "start", "end").distinct())
    let_go(near, repeated)
    return remove_runs(docs, later, parts, id_col, text_col)
