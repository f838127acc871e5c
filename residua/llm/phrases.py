"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, phrases into longer phrases, and so on. Phrase ends come from deterministic coin
tossing: a symbol's label is the position and value of the lowest bit in which it differs from the symbol before it; after
a few rounds labels are below eight, neighbours still differ, and local maxima are phrase starts. Labels depend on a few
symbols around a place only, so equal substrings get equal phrases in their interiors wherever they stand. A phrase is
named by a hash of the names it holds. A fingerprint is the bottom-k sketch of a text's phrase names of chosen levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from residua.llm._common import CHUNK_BYTES, mix, text_or_empty

#: Numbers in a fingerprint, of 32 bits each.
SKETCH = 64
#: Levels whose phrases are in a fingerprint: about 12 and 40 bytes long.
LEVELS = (2, 3)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _toss(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One round: 2 * position + value of the lowest bit that differs from the symbol before; the first symbol of a text has the one before it of all zeros."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[starts] = 0
    d = x ^ before
    low = d & (~d + x.dtype.type(1))
    label = np.bitwise_count(low - x.dtype.type(1))
    label <<= 1
    label += (x & low) != 0
    return label


def phrase_level(names: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of each text, given the names of its symbols (of 8 or 64 bits, none of them 0); offsets are those of n texts, none of them empty."""
    n, starts = len(names), offsets[:-1]
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(names[1:], names[:-1], out=fresh[1:])
    fresh[starts] = True
    at = np.flatnonzero(fresh)  # a run of one symbol is one symbol
    symbols, named = names[at], names[at].astype(np.uint64)
    if len(at) < n:
        length = np.diff(np.append(at, n)).astype(np.uint64)
        long = np.flatnonzero(length > 1)
        named[long] = mix(named[long] + length[long] * _STEP)
        starts = np.searchsorted(at, starts)
        n = len(at)
    label = _toss(_toss(_toss(symbols, starts), starts), starts)
    peak = np.zeros(n, bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    peak[np.append(starts[1:] - 1, n - 1)] = False  # the last symbol of a text doesn't stand alone
    peak[starts] = True
    at = np.flatnonzero(peak)
    inside = np.arange(n, dtype=np.uint64) - np.repeat(at, np.diff(np.append(at, n))).astype(np.uint64)
    # A hash of each symbol and its place in the phrase; a phrase's name is the hash of their sum.
    inside *= _STEP
    named += inside
    named *= np.uint64(0xBF58476D1CE4E5B9)
    named ^= named >> np.uint64(32)
    named *= np.uint64(0x94D049BB133111EB)
    named ^= named >> np.uint64(29)
    return mix(np.add.reduceat(named, at)), np.append(np.searchsorted(at, starts), len(at))


def sketches(texts: Sequence[str], levels: Sequence[int] = LEVELS, size: int = SKETCH) -> list[np.ndarray]:
    """For each text, the smallest `size` of its phrases' 32-bit hashes, ascending; empty for an empty text."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    filled = [i for i, d in enumerate(data) if d]
    out = [np.zeros(0, np.uint32)] * len(texts)
    if not filled:
        return out
    names = np.frombuffer(b"".join(data), dtype=np.uint8) + np.uint8(1)
    offsets = np.concatenate([[0], np.cumsum([len(data[i]) for i in filled])])
    kept = []
    for level in range(1, max(levels) + 1):
        names, offsets = phrase_level(names, offsets)
        if level in levels:
            text = np.repeat(np.arange(len(filled), dtype=np.uint64), np.diff(offsets))
            kept.append(text << np.uint64(32) | mix(names + np.uint64(level)) >> np.uint64(32))
    keys = np.sort(np.concatenate(kept))
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    bounds = np.searchsorted(keys, np.arange(len(filled) + 1, dtype=np.uint64) << np.uint64(32))
    for k, i in enumerate(filled):
        out[i] = keys[bounds[k] : min(bounds[k + 1], bounds[k] + size)].astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Estimated share of phrases that two texts have in common (Dice coefficient, 0 to 1) from their sketches; two empty texts are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    again = both[1:] == both[:-1]
    rank = np.arange(1, len(both)) - np.cumsum(again)  # in the union, of all but the first
    j = np.count_nonzero(again & (rank < size)) / min(size, len(both) - np.count_nonzero(again))
    return float(2 * j / (1 + j))


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint): one for each row of docs. Null texts are empty and have the empty fingerprint; texts of any length are parsed whole. Repeated rows give repeated rows, an empty table gives no rows. Other columns are not read, whatever their names."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), 0
            out = []
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held < CHUNK_BYTES // 8):
                    held, end = held + len(texts[end]), end + 1
                out += map(as_text, sketches(texts[at:end]))
                at = end
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def _in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (bucket, ahead, doc_id, text): buckets are ranges of ids, each sorted; after a bucket's rows comes the first row of the next bucket, with ahead = 1. One shuffle of the texts."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("at", F.col("doc_id").cast("double"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = 4 * parts
    cuts = base.where("at IS NOT NULL").approxQuantile("at", [i / number for i in range(1, number)], 1 / (4 * number)) if number > 1 else []
    splits = [-float("inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    base = Bucketizer(splits=splits, inputCol="at", outputCol="bucket", handleInvalid="keep").transform(base).withColumn("bucket", F.coalesce(F.col("bucket").cast("int"), F.lit(len(splits))))
    firsts = base.groupBy("bucket").agg(F.min("doc_id").alias("first")).orderBy("bucket").collect()  # at most one row for each bucket
    table = [(r["bucket"], r["first"], firsts[k - 1]["bucket"]) for k, r in enumerate(firsts)]
    firsts = F.broadcast(spark.createDataFrame(table, "bucket int, first long, before int"))
    # Of the rows with a bucket's first id, the one with the smallest text is copied to the end of the bucket before.
    ahead = base.join(firsts, "bucket").where(F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("before").agg(F.max("doc_id").alias("doc_id"), F.min("text").alias("text"))
    rows = base.select("bucket", F.lit(0).alias("ahead"), "doc_id", "text").unionByName(ahead.select(F.col("before").alias("bucket"), F.lit(1).alias("ahead"), "doc_id", "text"))
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "ahead", F.col("doc_id").asc_nulls_last(), "text")


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document by ascending doc_id; after the last comes the first. Rows without doc_id come last; rows of one doc_id are
    ordered by text, in one task. A null text is empty; texts of any length are parsed whole. A lone document is its own
    next. Repeated rows give repeated rows, an empty table gives no rows. doc_id must be an integer. Other columns are not
    read, whatever their names.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer: the next document is that with the next larger one")


    def rows(held: list[tuple[int, str]], after: str) -> pa.RecordBatch:
        texts = [t for _, t in held] + [after]
        edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, texts[1:])]
        both = sketches(texts + edited)
        own, other = both[: len(texts)], both[len(texts) :]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([i for i, _ in held], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
                "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
                "fingerprint": [as_text(s) for s in own[:-1]],
                "edited_fingerprint": [as_text(s) for s in other],
                "near_edited": [likeness(a, b) for a, b in zip(own, other)],
                "near_next": [likeness(a, b) for a, b in zip(own, own[1:])],
            }
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bucket = [], 0, None
        for batch in batches:
            columns = [batch.column(c) for c in ("bucket", "ahead", "doc_id", "text")]
            for k in range(batch.num_rows):
                b, ahead, i, text = (c[k].as_py() for c in columns)
                if held and (b != bucket or ahead or size >= CHUNK_BYTES // 8):
                    if b == bucket:
                        yield rows(held, text)
                        held, size = [], 0
                if not ahead:
                    held.append((i, text))
                    size += len(text)
                bucket = b

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_order(docs, id_col, text_col).mapInArrow(run, schema)
