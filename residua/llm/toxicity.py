"""Toxicity: embeddings of a text's subwords, averaged into a linear softmax that is trained jointly with them in numpy.

A word is the set of its character n-grams (4 to 8 bytes, its ends included), so a misspelling that was never seen shares
vectors with the word it stands for. The model is fitted on a bounded sample of labelled rows and sent to the executors
as one weight for each bucket of n-grams (1 MB); they score every whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.llm import _subwords
from residua.llm._bag_model import sigmoid, train
from residua.llm._common import chunks, text_or_empty

#: The bounds of the labelled sample: rows, and code points of their texts together. It is taken in the order of a hash of doc_id; texts are used whole.
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 18_000_000
#: So many labelled rows of each class come first.
_EACH_CLASS = 32
#: Neutral n-grams that each text's average has besides its own, so a short text needs more than one odd n-gram.
PRIOR = 1500
BITS = 18
THRESHOLD = 0.3


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(_subwords.bag_scores(_subwords.ngrams(texts, BITS), self.weights, PRIOR) + self.bias)


def is_held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from; rows without id count as not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded(docs: DataFrame, labels: DataFrame, rows: int, chars: int, value: str) -> DataFrame:
    """docs (doc_id, text, ...) with the columns of labels (unique doc_id): one row for each of at most `rows` doc_ids, with at most `chars` code points together.

    doc_ids are taken in the order of a hash, the first few of each `value` before others, so that no class is left out; a
    text that doesn't fit any more is passed over. Documents are chosen by id and length alone, among 64 times as many
    labels at most where labels have no document. Of rows that share a doc_id the one with the smallest hash of its text counts.
    """
    spark, order = docs.sparkSession, F.xxhash64("doc_id")
    classes = [r[0] for r in labels.select(value).distinct().limit(16).collect()]
    ahead = {r[0] for c in classes for r in labels.where(F.col(value) == c).orderBy(order, "doc_id").limit(_EACH_CLASS).select("doc_id").collect()}
    want = 2 * rows
    while True:
        some = ahead | {r[0] for r in labels.orderBy(order, "doc_id").limit(want).select("doc_id").collect()}  # the bound of the sample
        ids = spark.createDataFrame([(i,) for i in some], "doc_id long")
        sized = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max(F.length("text")).alias("n")).withColumn("order", order).collect()
        if len(sized) >= rows or len(some) < want or want >= 64 * rows:
            break
        want *= 8
    total, kept = 0, []
    for r in sorted(sized, key=lambda r: (r["doc_id"] not in ahead, r["order"], r["doc_id"])):
        if len(kept) < rows and (total + r["n"] <= chars or not kept):
            total += r["n"]
            kept.append((r["doc_id"],))
    chosen = docs.join(F.broadcast(spark.createDataFrame(kept, "doc_id long")), "doc_id")
    others = [c for c in docs.columns if c != "doc_id"]
    one = chosen.groupBy("doc_id").agg(F.min_by(F.struct(*others), F.xxhash64(*others)).alias("row")).select("doc_id", "row.*")
    return one.join(F.broadcast(labels.join(F.broadcast(spark.createDataFrame(kept, "doc_id long")), "doc_id")), "doc_id")


def in_one_task(sample: DataFrame, work, schema: str) -> list:
    """Runs work on a bounded sample in one task: its memory and time are an executor's, and a lost executor's task is run again. Rows are in an order of their own, so the result is the same each time."""
    return sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), *sample.columns).mapInArrow(work, schema).collect()


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from labels (doc_id, toxic) that are not held out; ids are integers. Conflicting labels of a document count as toxic; labels without document, id or value don't count. Without labels of both classes all texts get one score, by the labels' share."""
    given = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out())
    given = given.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    sample = bounded(named, given, rows, chars, "label")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, known = [], []
        for part in chunks(batches, "text", 400_000):  # texts are let go as soon as their bags are made
            bags += _subwords.bags(_subwords.ngrams(part.column("text"), BITS), PRIOR)
            known += part.column("label").to_pylist()
        weights, bias = train(bags, np.array(known, np.int64) != 0, 1 << BITS)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([float(bias)])], ["weights", "bias"])

    found = in_one_task(sample, work, "weights binary, bias double")
    return Model(np.frombuffer(found[0]["weights"], np.float32), found[0]["bias"]) if found else Model(*train([], np.zeros(0), 1 << BITS))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score), one for each row of docs. Null and empty texts get the score of a text without words; texts of any length are read whole. Repeated rows give repeated rows, an empty table gives no rows. Other columns are not read."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(held.value.score(part.column("text")))], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs. Scores depend on texts alone.

    Null texts are empty; empty texts get the score of a text without words; texts of any length are scored whole. A row
    without doc_id is scored and not held out. Repeated rows give repeated rows; rows that share a doc_id are scored each.
    Other columns are not read, whatever their names. An empty table gives no rows.
    """
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with a score under the threshold, unchanged and with all columns, in one pass and without a shuffle. Nulls, empty texts, repeated rows and empty tables are as in classify()."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_col):
            keep = held.value.score(part.column(text_col)) < threshold
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
