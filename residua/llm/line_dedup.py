"""Line dedup by winnowing.

Of every `window` consecutive line hashes the smallest is selected, so two places that share that many lines have a
selected line in common. Selected lines that occur at several positions are extended both ways to all runs of `window`
lines that hold them; runs join on their line hashes, and lines of runs whose first occurrence is elsewhere are deleted.
A long line counts as several, so a passage on one line is found too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm._common import chunks, durable, flat, let_go, mix
from residua.llm._spans import keyed, remove_runs
from residua.llm._words import range_hashes, spaced_words

#: Lines of the shortest run that is deleted; also the winnowing window, so every such run has a fingerprint.
WINDOW = 3
#: A line counts once for each so many words.
WORDS = 20


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of flat texts: first byte, hash and number of words of each line that isn't blank, and the texts' offsets in the lines. White space at a line's ends and the amount inside don't count."""
    start, end, hashes, bounds = spaced_words(data, offsets)
    if not len(start):
        return start, hashes, start, np.zeros(len(offsets), np.int64)
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    fresh = np.ones(len(start), bool)
    fresh[1:] = feeds[start[1:]] > feeds[end[:-1]]
    fresh[bounds[:-1][np.diff(bounds) > 0]] = True
    first = np.flatnonzero(fresh)
    to = np.append(first[1:], len(start))
    return start[first], range_hashes(hashes, first, to), to - first, np.searchsorted(first, bounds)


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and line (numbered in its text) of each unit: a line once for each WORDS words, and the texts' offsets in the units. Units of equal lines are equal, each in its place."""
    _, hashes, words, bounds = lines(data, offsets)
    times = np.maximum(1, words // WORDS)
    ends = np.concatenate([[0], np.cumsum(times)])
    line = np.repeat(np.arange(len(hashes)), times)
    place = np.arange(len(line)) - ends[line]
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return mix(hashes[line] + place.astype(np.uint64)), line - bounds[text[line]] if len(line) else line, ends[bounds]


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, _, _, bounds = lines(data, offsets)
    return first, bounds


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the smallest hash (the last of equal ones) of each window of consecutive hashes."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views, axis=1))


def anchors(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Rows (hash, id, h, low, around, at): each selected unit, the hashes and the lines from window - 1 units before to as many after; low is the place of the first of those."""
    rows = keyed(docs, id_col, text_col)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            picked, text, low, around, at = [], [], [], [], []
            all_hashes, line, bounds = units(*flat(part.column("text")))
            signed = all_hashes.view(np.int64)
            for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                for k in (winnow(all_hashes[a:b], window) + a).tolist():
                    first = max(k - window + 1, a)
                    last = min(k + window, b)
                    picked.append(int(signed[k]))
                    text.append(i)
                    low.append(first - a)
                    around.append(signed[first:last])
                    at.append(line[first:last])
            of = pa.array(text, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(picked, pa.int64()), part.column("id").take(of), part.column("h").take(of), pa.array(low, pa.int32()), pa.array(around, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32()))], ["hash", "id", "h", "low", "around", "at"]
            )

    return rows.mapInArrow(work, f"hash long, id {rows.schema['id'].dataType.simpleString()}, h long, low int, around array<long>, at array<int>")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with repeated runs of lines deleted from the texts, and columns __parts (lines), __removed (of them) and __spans (code points of the old text).

    A line goes if it is in a run of `window` lines (blank ones don't count, and a line counts once for each WORDS words)
    that occurs before, by (doc_id, hash of the text, line number), in another document or the same one; so maximal
    repeated runs go whole, and a long line that repeats goes alone. Rows are neither dropped nor added.

    Nulls: a null text stays null; rows without id are not read for runs and stay as they are. Empty texts stay empty, and
    texts of any length are read whole. A document is known by its doc_id and its text: repeated rows are one document, and
    rows that share a doc_id but not their text are documents of their own. doc_id may be of any type with an order. Other
    columns are kept, whatever their names (but for the three added). An empty table gives an empty table.
    """
    found = durable(anchors(docs, id_col, text_col, window))
    # Hot lines are summed before the shuffle. Sums are kept as tables, so that joins have a shuffle on both sides and AQE
    # can split their hot keys.
    shared = durable(found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    near = found.join(shared, "hash", "left_semi")
    steps = F.sequence(F.lit(0), F.size("around") - window)
    line = lambda k: F.element_at("at", k.cast("int"))
    run = F.transform(steps, lambda s: F.struct(F.slice("around", s + 1, window).alias("run"), (F.col("low") + s).alias("unit"), line(s + 1).alias("start"), (line(s + window) + 1).alias("end")))
    runs = durable(near.select("id", "h", F.inline(run)).distinct())
    let_go(found, shared)
    where = F.struct("id", "h", "unit")
    repeated = durable(runs.groupBy("run").agg(F.count("*").alias("n"), F.min(where).alias("first")).where("n > 1").drop("n"))
    later = durable(runs.join(repeated, "run").where(where > F.col("first")).select("id", "h", "start", "end").distinct())
    let_go(runs, repeated)
    return remove_runs(docs, later, parts, id_col, text_col)
