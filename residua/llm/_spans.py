"""Removing parts of texts that another table names."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm._common import chunks, flat, text_or_empty

#: Of flat texts: the first byte of each part, and the n + 1 offsets of the texts in the parts.
Parts = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def text_hash(column: str):
    """60 bits of a text's MD5 as a long: tells rows that share an id but not their text apart, and orders them."""
    return F.conv(F.substring(F.md5(text_or_empty(column)), 1, 15), 16, 10).cast("long")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, h, text) of docs that have both an id and a text."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return rows.select(F.col(id_col).alias("id"), text_hash(text_col).alias("h"), text_or_empty(text_col).alias("text"))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint [start, end) ranges that cover the same numbers."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif b > a:
            out.append((a, b))
    return out


def cut(text: bytes, starts: list[int], runs: list[tuple[int, int]]) -> tuple[bytes, int, list[tuple[int, int]]]:
    """The text without the parts that runs of part numbers cover, how many parts went, and the bytes that went. A part takes what is behind it along, up to the next part."""
    spans = [(starts[a], starts[b] if b < len(starts) else len(text)) for a, b in merged(runs)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join(kept) + text[at:], sum(b - a for a, b in merged(runs)), spans


def remove_runs(docs: DataFrame, runs: DataFrame, parts: Parts, id_col: str, text_col: str) -> DataFrame:
    """docs without the parts (numbered by `parts`) in runs (id, h, start, end); more columns: __parts, __removed (int), __spans (array of start, end in code points of the old text).

    A document's runs are gathered in one row: they are at most as many as its parts. Texts are moved once, by id.
    """
    run = F.struct(F.col("start"), F.col("end"))
    of = runs.groupBy(F.col("id").alias("__residua_id"), F.col("h").alias("__residua_of")).agg(F.collect_set(run).alias("__residua_runs"))
    own = docs.withColumn("__residua_h", text_hash(text_col))
    joined = own.join(of, (F.col(id_col) == F.col("__residua_id")) & (F.col("__residua_h") == F.col("__residua_of")), "left")
    names = [f.name for f in docs.schema.fields]
    added = {"__parts": "int", "__removed": "int", "__spans": "array<struct<start:int,end:int>>"}
    schema = docs.withColumns({c: F.lit(None).cast(kind) for c, kind in added.items()}).schema

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in chunks(batches, text_col):
            columns = [batch.column(k) for k in range(len(names))]
            at = names.index(text_col)
            data, offsets = flat(columns[at])
            first, bounds = parts(data, offsets)
            gone, spans = np.zeros(batch.num_rows, np.int32), [[]] * batch.num_rows
            found = batch.column(len(names))
            hit = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                texts = columns[at].to_pylist()
                for k, own in zip(hit.tolist(), found.take(pa.array(hit)).to_pylist()):
                    starts = (first[bounds[k] : bounds[k + 1]] - offsets[k]).tolist()
                    raw = data[offsets[k] : offsets[k + 1]]
                    new, gone[k], where = cut(raw.tobytes(), starts, [(r["start"], min(r["end"], len(starts))) for r in own])
                    texts[k] = new.decode("utf-8", "surrogatepass")
                    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    spans[k] = [{"start": int(points[a]), "end": int(points[b])} for a, b in where]
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(bounds).astype(np.int32)), pa.array(gone), pa.array(spans, kind)], [*names, *added])

    return joined.select(*[F.col(f"`{c}`") for c in names], "__residua_runs").mapInArrow(work, schema)
