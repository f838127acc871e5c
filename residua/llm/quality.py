"""Quality classifier by co-training.

Two classifiers see different views of a document: its text's content (byte n-grams), and the metadata that its page came
with (source, language, stated length, or other columns), which say nothing about the text itself. Over some rounds each
view scores all documents without a label, and the other learns those of which it is most certain. A view is certain only
where its calibrated probability is, so a view that knows nothing teaches nothing. Both views are calibrated on labelled
rows that neither has learnt from, combined, and all documents are scored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from residua.llm import _subwords
from residua.llm._bag_model import log_odds, logistic, sigmoid, train
from residua.llm._common import chunks, durable, let_go, text_or_empty
from residua.llm.toxicity import bounded, in_one_task

#: The bounds of the labelled sample: rows, and code points of their texts together. It is taken in the order of a hash of doc_id; texts are used whole.
LABELLED_ROWS, SAMPLE_CHARS = 4000, 8_000_000
ROUNDS = 2
#: Pseudo-labels that each view gives the other in a round, of all documents without a label, and the calibrated probability from which one counts.
PSEUDO_LABELS, CERTAIN = 400, 0.97
BITS, ORDERS, PRIOR = 16, (1, 2, 3), 50
#: Buckets of a field of the metadata view.
VALUES = 1024
#: Columns of the metadata view: numbers count by their order of magnitude, others by their value.
METADATA = ("source", "lang", "n_chars")
THRESHOLD = 0.5


def _views(docs: DataFrame, id_col: str, text_col: str, metadata: Sequence[str]) -> DataFrame:
    """Rows (doc_id, text, page): page has a bucket for each metadata column and for each pair of neighbouring ones."""
    def value(c: str):
        own = F.col(f"`{c}`")
        if isinstance(docs.schema[c].dataType, NumericType):
            own = F.floor(F.log2(F.greatest(own.cast("double"), F.lit(0.0)) + 1) * 2)
        return F.coalesce(own.cast("string"), F.lit("\x00"))

    values = [value(c) for c in metadata]
    fields = [F.struct(x) for x in values] + [F.struct(x, y) for x, y in zip(values, values[1:])]
    page = F.array(*[(F.lit(k * VALUES) + F.pmod(F.xxhash64(F.lit(k), x), F.lit(VALUES))).cast("int") for k, x in enumerate(fields)])
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), page.alias("page"))


def _pages(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("page")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.int32)


@dataclass
class Model:
    text: tuple[np.ndarray, float]
    page: tuple[np.ndarray, float]
    #: Slope and intercept of each calibrated view, and the coefficients of both and the intercept of the combination.
    text_scale: np.ndarray
    page_scale: np.ndarray
    both: np.ndarray
    #: Share of label 1 among the rows that were learnt from.
    share: float

    def odds(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log-odds of quality 1 by the text and by the page metadata."""
        t = _subwords.bag_scores(_subwords.raw_ngrams(batch.column("text"), BITS, ORDERS), self.text[0], PRIOR) + self.text[1]
        p = self.page[0][_pages(batch)].mean(axis=1) + self.page[1]
        return self.text_scale[0] * t + self.text_scale[1], self.page_scale[0] * p + self.page_scale[1]

    def score(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of quality 1: combined, by the text, by the page metadata."""
        t, p = self.odds(batch)
        return sigmoid(np.column_stack([t, p, np.ones(len(t))]) @ self.both), sigmoid(t), sigmoid(p)


def _learn(sample: DataFrame, fields: int) -> Model:
    """A model from rows (doc_id, text, page, y, by_text, by_page): the label, and the labels that each view gave for the other (null: none)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, page, y, by_text, by_page = [], [], [], [], []
        for part in chunks(batches, "text"):
            text += _subwords.bags(_subwords.raw_ngrams(part.column("text"), BITS, ORDERS), PRIOR)
            page += [(b.astype(np.int32), np.full(fields, 1 / fields, np.float32)) for b in _pages(part)]
            for name, column in (("y", y), ("by_text", by_text), ("by_page", by_page)):
                column += part.column(name).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(co_train(text, page, y, by_page, by_text, fields * VALUES))])], ["model"])

    found = in_one_task(sample, work, "model binary")
    return Model(*(pickle.loads(found[0]["model"]) if found else co_train([], [], [], [], [], fields * VALUES)))


def co_train(text: list, page: list, y: list[int | None], for_text: list[int | None], for_page: list[int | None], buckets: int) -> tuple:
    """The fields of a model: one round of learning, from the bags of both views, the labels, and the pseudo-labels for each view (None: none). Every fifth labelled row is for calibration alone."""
    known = np.array([i for i, v in enumerate(y) if v is not None], dtype=np.int64)
    labels = np.array([int(y[i] != 0) for i in known], dtype=np.int64)
    check = np.arange(len(known)) % 5 == 4
    own, own_labels = known[~check], labels[~check]
    models = []
    for view, size, more in ((text, 1 << BITS, for_text), (page, buckets, for_page)):
        extra = [(i, int(v)) for i, v in enumerate(more) if v is not None]
        learnt = np.concatenate([own_labels, np.array([v for _, v in extra], np.int64)])
        models.append(train([view[i] for i in [*own.tolist(), *(i for i, _ in extra)]], learnt, size, epochs=10))
    odds = [log_odds([view[i] for i in known[check]], *m) for view, m in zip((text, page), models)]
    truth = labels[check].astype(float)
    if len(set(truth.tolist())) < 2:  # nothing to calibrate with
        scales, both = [np.array([1.0, 0.0])] * 2, np.array([0.5, 0.5, 0.0])
    else:
        scales = [logistic(z[:, None], truth, ridge=1.0) for z in odds]
        both = logistic(np.column_stack([s[0] * z + s[1] for s, z in zip(scales, odds)]), truth, ridge=1.0)
    return (*models, *scales, both, float(own_labels.mean()) if len(own) else 0.5)


def _odds(rows: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, text, page) to (doc_id, t, p): calibrated log-odds by each view."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, held.value.odds(part))], ["doc_id", "t", "p"])

    return rows.mapInArrow(work, "doc_id long, t double, p double")


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, chars: int = SAMPLE_CHARS, rounds: int = ROUNDS, pseudo_labels: int = PSEUDO_LABELS, certain: float = CERTAIN, id_col: str = "doc_id", text_col: str = "text", metadata: Sequence[str] = METADATA) -> Model:
    """A model from labels (doc_id, quality); ids are integers.

    In each round both views score all documents without a label, and the `pseudo_labels` of which a view is most certain,
    by the classes' shares, are learnt by the other. Conflicting labels of a document count as low; labels without
    document, id or value don't count; rows without id are not learnt from. Null texts are empty and null metadata are a
    value of their own. Of rows that share a doc_id one is learnt from. Without labels all documents get one score.
    """
    given = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("y"))
    rows = _views(docs.where(F.col(id_col).isNotNull()), id_col, text_col, metadata).withColumn("doc_id", F.col("doc_id").cast("long"))
    fields = 2 * len(metadata) - 1
    none = F.lit(None).cast("int")
    sample = durable(bounded(rows, given, labelled_rows, chars, "y").select("doc_id", "text", "page", "y", none.alias("by_text"), none.alias("by_page")))
    model = _learn(sample, fields)
    for _ in range(rounds):
        free = durable(_odds(rows, model).groupBy("doc_id").agg(F.min("t").alias("t"), F.min("p").alias("p")).join(given.select("doc_id"), "doc_id", "left_anti"))
        edge = float(np.log(certain / (1 - certain)))
        high = round(pseudo_labels * model.share)
        picks: dict[int, dict[str, int]] = {}
        for view in ("t", "p"):
            for label, number, order in ((1, high, F.desc(view)), (0, pseudo_labels - high, F.asc(view))):
                sure = free.where(F.col(view) >= edge if label else F.col(view) <= -edge)
                for r in sure.orderBy(order, F.xxhash64("doc_id"), "doc_id").limit(number).collect():  # bounded by pseudo_labels
                    picks.setdefault(r["doc_id"], {})[view] = label
        let_go(free)
        if not picks:
            break
        found = docs.sparkSession.createDataFrame([(i, v.get("t"), v.get("p")) for i, v in sorted(picks.items())], "doc_id long, by_text int, by_page int")
        more = bounded(rows, found.withColumn("__any", F.coalesce("by_text", "by_page")), 2 * pseudo_labels, chars, "__any")
        model = _learn(sample.unionByName(more.select("doc_id", "text", "page", none.alias("y"), "by_text", "by_page")), fields)
    let_go(sample)
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", metadata: Sequence[str] = METADATA) -> DataFrame:
    """Rows (doc_id, score, score_text, score_page, keep), one for each row of docs: probabilities of quality 1 by both views together and by each, and whether the first is at least the threshold.

    Null texts are empty, null metadata are values of their own; texts of any length are scored whole. Repeated rows give
    repeated rows. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = _views(docs, id_col, text_col, metadata)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            both, text, page = map(pa.array, held.value.score(part))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), both, text, page], ["doc_id", "score", "score_text", "score_page"])

    scored = rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, score_text double, score_page double")
    return scored.withColumn("keep", (F.col("score") >= threshold).cast("int"))
