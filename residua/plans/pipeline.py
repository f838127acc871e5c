"""From sequences to outputs: relational stages, one encoder pass in Arrow batches, and durable writes."""

from __future__ import annotations

import hashlib
import math
import shutil
from collections.abc import Iterable, Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.encoders.base import Encoder, Output, batches_by_budget, encode_with_retry
from residua.encoders.registry import choose, load
from residua.functions.scalars import dtype_of, max_length, model_name, output_file
from residua.functions.tokens import TextCodec, n_specials, split_tokens
from residua.functions.vocabulary import Vocabulary
from residua.operators import ranges, substrings
from residua.operators.sequences import require_valid, tokenise
from residua.plans.spec import EmbedSpec, Resolved, resolve
from residua.sinks import outputs as sink
from residua.sources.fasta import read_fasta
from residua.sources.files import read_substrings

#: Bytes of arrays that a task writes, about.
_TASK_BYTES = 256 << 20
#: Bytes or tokens of sequences that are held as arrays at once; a longer sequence is held alone.
_PIECE = 4 << 20
_FIELDS = ["output_type", "layer", "head", "ord", "sequence_id", "shape", "values"]


def encode_table(sequences: DataFrame, vocabulary: Vocabulary, spec: EmbedSpec, table: DataFrame | None = None) -> DataFrame:
    """Rows (ord, sequence_id, input_ids, pooling_mask, substring_mask): all in column expressions."""
    specials = not spec.disable_special_tokens
    if table is not None:
        sequences = substrings.join(sequences, table)
    rows = tokenise(sequences, vocabulary, specials)
    rows = substrings.with_mask(rows, vocabulary, spec.context, specials) if table is not None else rows.withColumn("substring_mask", F.lit(None).cast("array<boolean>"))
    return rows.select("ord", "sequence_id", "input_ids", "pooling_mask", "substring_mask")


def masked_means(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Means over the places that the mask selects, in double; NaN without any."""
    total = np.einsum("bl,bld->bd", mask.astype(np.float64), hidden.astype(np.float64))
    with np.errstate(all="ignore"):
        return total / mask.sum(axis=1, keepdims=True)


def _planes(what: str, out: Output, resolved: Resolved) -> Iterator[tuple[int | None, int | None, np.ndarray]]:
    """(layer, head, batch x a x b) of the two-dimensional outputs."""
    if what == "per_token":
        yield from ((k, None, out.hidden[k]) for k in resolved.layers)
    elif what == "attention_head":
        yield from ((k, h, out.attention[k][:, h]) for k in resolved.layers for h in range(out.attention[k].shape[1]))
    elif what == "attention_layer":
        yield from ((k, None, out.attention[k].mean(axis=1, dtype=np.float64)) for k in resolved.layers)
    elif what == "attention_model":
        yield None, None, np.mean([a.mean(axis=1, dtype=np.float64) for a in out.attention.values()], axis=0)
    elif what == "logits":
        yield None, None, out.logits


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values), kind))


def _slices(column: pa.ListArray) -> list[np.ndarray | None]:
    """The rows of a list column as views of its values; None for nulls."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()  # both as they are: offsets of a slice point into all values
    return [values[a:b] if ok else None for a, b, ok in zip(at, at[1:], column.is_valid().to_numpy(zero_copy_only=False))]


def _filled(mask: np.ndarray, length: int) -> np.ndarray:
    """A mask, false beyond its end up to a length."""
    return np.concatenate([mask, np.zeros(length - len(mask), bool)]) if len(mask) < length else mask


def _pieces(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose values in a column have at most _PIECE bytes or items together; one row at least."""
    for batch in batches:
        lists = pa.types.is_list(batch.column(column).type)
        sizes = (pc.list_value_length if lists else pc.binary_length)(batch.column(column))
        total = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + _PIECE, side="right")))
            yield batch.slice(start, end - start)
            start = end


def represent(encoded: DataFrame, encoder: Encoder, resolved: Resolved, spec: EmbedSpec, pad_id: int, length: int, codec: TextCodec | None = None, keep: str | None = None) -> DataFrame:
    """The outputs of encoded rows (schema sinks.outputs.SCHEMA): one forward pass for all of them, pooled within the pass.

    With a codec, rows are (ord, sequence_id, sequence) instead, and are tokenised in the pass: texts alone go to Python,
    and nothing is kept for each token. Batches are made by length within an Arrow batch and padded to their own longest row; only outputs that show padding
    are padded to the common length. Results don't depend on how rows are batched.

    keep names a mask of the encoded rows that the outputs have as a further column, false for padding: a join would need
    both sides by place.
    """
    dtype = dtype_of(spec.precision)
    fields = [*_FIELDS, keep] if keep else _FIELDS
    full = not spec.discard_padding and bool({"per_token", "attention_head", "attention_layer", "attention_model", "logits"} & set(resolved.outputs))

    def rows(what: str, layer: int | None, head: int | None, ids: pa.Array, names: pa.Array, values: list[np.ndarray], kept: list[pa.Array]) -> pa.RecordBatch:
        n = len(values)
        flat = [v.astype(dtype).astype(np.float32).ravel() for v in values]
        shapes = [np.array(v.shape[:1] if spec.flatten and v.ndim == 1 else (v.size,) if spec.flatten else v.shape, np.int32) for v in values]
        constant = lambda x, kind: pa.array([x] * n, kind)
        return pa.RecordBatch.from_arrays([constant(what, pa.string()), constant(layer, pa.int32()), constant(head, pa.int32()), ids, names, _lists(shapes, pa.int32()), _lists(flat, pa.float32()), *kept], fields)

    def tokens_of(batch: pa.RecordBatch) -> tuple[list[np.ndarray], dict[str, list[np.ndarray]]]:
        if codec is None:
            return _slices(batch.column("input_ids")), {c: _slices(batch.column(c)) for c in ("pooling_mask", "substring_mask")}
        ids = [codec.ids(t) for t in batch.column("sequence").to_pylist()]
        return ids, {"pooling_mask": [codec.counted(x) for x in ids]}

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, "sequence" if codec else "input_ids"):
            ids, masks = tokens_of(batch)
            lengths = [length if full else len(x) for x in ids]
            for group in batches_by_budget(lengths, spec.batch_size, not full):
                wide = max(1, max(lengths[i] for i in group))
                tokens, real = np.full((len(group), wide), pad_id, np.int64), np.zeros((len(group), wide), bool)
                for k, i in enumerate(group):
                    tokens[k, : len(ids[i])], real[k, : len(ids[i])] = ids[i], True
                for part, out in encode_with_retry(encoder, tokens, real, resolved.wanted):
                    own = group[part]
                    at = pa.array(own)
                    ords, names = batch.column("ord").take(at), batch.column("sequence_id").take(at)
                    kept = [_lists([_filled(masks[keep][i], lengths[i]) for i in own], pa.bool_())] if keep else []
                    for what in resolved.outputs:
                        if what in ("mean_pooled", "substring_pooled"):
                            mask = np.zeros((len(own), wide), bool)
                            for k, i in enumerate(own):
                                m = masks["pooling_mask" if what == "mean_pooled" else "substring_mask"][i]
                                mask[k, : len(m)] = m
                            for layer in resolved.layers:
                                yield rows(what, layer, None, ords, names, list(masked_means(out.hidden[layer], mask)), kept)
                            continue
                        for layer, head, plane in _planes(what, out, resolved):
                            square = what.startswith("attention")
                            values = [plane[k] if full else plane[k, : len(ids[i]), : len(ids[i]) if square else None] for k, i in enumerate(own)]
                            yield rows(what, layer, head, ords, names, values, kept)

    return encoded.mapInArrow(work, f"{sink.SCHEMA}, {keep} array<boolean>" if keep else sink.SCHEMA)


def manifest(spark: SparkSession, spec: EmbedSpec, resolved: Resolved, encoder: Encoder, n: int, length: int) -> DataFrame:
    """Rows (output_type, layer, head, path, dtype, shape, bytes) of the dense arrays that the run stands for."""
    dtype, prefix, model = dtype_of(spec.precision), experiment(spec), model_of(spec)
    size = {"per_token": (length, encoder.hidden_size), "logits": (length, encoder.vocab_size)}
    rows = []
    for what, layer, head in resolved.keys:
        shape = size.get(what) or ((encoder.hidden_size,) if what.endswith("pooled") else (length, length))
        shape = (n, int(np.prod(shape))) if spec.flatten else (n, *shape)
        path = f"{spec.output_path}/{model}/{what}/{output_file(prefix, model, what, layer, head)}"
        rows.append((what, layer, head, path, dtype.name, list(shape), int(np.prod(shape, dtype=object)) * dtype.itemsize))
    return spark.createDataFrame(rows, "output_type string, layer int, head int, path string, dtype string, shape array<long>, bytes long")


def require_space(manifest_rows: DataFrame, free_bytes: int) -> int:
    """The bytes that the manifest asks for; an error if there are fewer."""
    needed = manifest_rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    if needed > free_bytes:
        raise ValueError(f"{needed} bytes are needed and {free_bytes} are free")
    return needed


def experiment(spec: EmbedSpec) -> str:
    return spec.experiment_name or PurePosixPath(spec.fasta_path).stem


def model_of(spec: EmbedSpec) -> str:
    choice = choose(spec.model_name)
    return choice.kind if choice.kind == "synthetic" else model_name(choice.link, choice.local)


def _weights_of(encoder: Encoder) -> str:
    found = getattr(encoder, "fingerprint", None)
    return found if found is not None else hashlib.sha256(cloudpickle.dumps(encoder)).hexdigest()


def report(spark: SparkSession, spec: EmbedSpec, resolved: Resolved, encoder: Encoder, progress: DataFrame, n: int, length: int) -> DataFrame:
    """What is done of a run: ranges, rows and bytes of the dense arrays by output, and in all."""
    sizes = manifest(spark, spec, resolved, encoder, max(n, 1), length).select("output_type", "layer", "head", (F.col("bytes") / max(n, 1)).cast("long").alias("row_bytes"))
    return ranges.summary(ranges.merge(progress), row_bytes=sizes)


def run(spark: SparkSession, spec: EmbedSpec, sequences: DataFrame | None = None, table: DataFrame | None = None, encoder: Encoder | None = None, vocabulary: Vocabulary | None = None) -> str:
    """Runs a specification and gives the path of its Parquet outputs. Sequences (ord, sequence_id, sequence) and substrings may be given as tables.

    With streaming_output, rows are written and recorded in slices of commit_rows, as many slices at once as the cluster
    has room for; a run that was stopped goes on behind its last record, and rows of recorded slices aren't encoded again.
    Slices without a record are written anew.
    """
    if encoder is None or vocabulary is None:
        encoder, vocabulary = load(spark, spec.model_name, spec.tokenizer_from, spec.device)
    resolved = resolve(spec, encoder)
    sequences = sequences if sequences is not None else read_fasta(spark, spec.fasta_path)
    if table is None and "substring_pooled" in resolved.outputs:
        table = read_substrings(spark, spec.substring_path)
    root = f"{spec.output_path}/{model_of(spec)}"
    parsed, work = f"{root}/_sequences", f"{root}/_encoded"
    # Parsed once, read by the checks and by the encoding; a slice reads its own files alone.
    step = spec.commit_rows
    sequences.select("ord", "sequence_id", "sequence", F.floor(F.col("ord") / step).cast("long").alias("slice")).write.mode("overwrite").partitionBy("slice").parquet(parsed)
    sequences = spark.read.schema("ord long, sequence_id string, sequence string, slice long").parquet(parsed)
    if table is not None:
        substrings.require_complete(sequences, table)
    require_valid(tokenise(sequences, vocabulary, False), vocabulary, limit=choose(spec.model_name).length_limit)
    specials = n_specials(vocabulary, not spec.disable_special_tokens)
    if table is None:
        codec, encoded = TextCodec(vocabulary, not spec.disable_special_tokens), sequences
        sizes = sequences.select("ord", "sequence_id", "sequence", (F.size(split_tokens(F.col("sequence"), vocabulary.bracket)) + sum(specials)).alias("size"))
        seen = ["ord", "sequence_id", "sequence"]
    else:
        codec = None
        encode_table(sequences, vocabulary, spec, table).withColumn("slice", F.floor(F.col("ord") / step).cast("long")).write.mode("overwrite").partitionBy("slice").parquet(work)
        encoded = spark.read.schema("ord long, sequence_id string, input_ids array<int>, pooling_mask array<boolean>, substring_mask array<boolean>, slice long").parquet(work)
        sizes, seen = encoded.withColumn("size", F.size("input_ids")), ["ord", "sequence_id", "input_ids", "substring_mask"]
    facts = sizes.agg(F.count("*").alias("n"), F.max("size").alias("longest"), F.sum(F.xxhash64(*seen).cast("decimal(38,0)")).alias("hash")).first()
    n, length = facts["n"], max_length(spec.max_length, facts["longest"] or 0)
    key = spec.run_key(f"{n}:{facts['hash']}:{_weights_of(encoder)}:{vocabulary.fingerprint}")
    where, progress = f"{root}/outputs-{key}", f"{root}/_progress-{key}"
    arrays = manifest(spark, spec, resolved, encoder, n, length)
    arrays.write.mode("overwrite").json(f"{root}/manifest-{key}")
    local = spec.output_path.removeprefix("file://")
    if spec.npy and n:
        require_space(arrays, shutil.disk_usage(local).free)
    slices = spark.range(0, max(n, 1), step).select(F.col("id").alias("start"), F.least(F.col("id") + step, F.lit(max(n, 1))).alias("end"))
    wanted = slices.crossJoin(spark.createDataFrame(list(resolved.keys), "output_type string, layer int, head int")) if resolved.keys else slices.limit(0)
    done = ranges.merge(sink.read_ranges(spark, progress))
    # One row for each slice: bounded by rows / commit_rows.
    todo = sorted((r["start"], r["end"]) for r in ranges.pending(wanted, done).select("start", "end").distinct().collect())
    now = todo[: spec.slices_at_most]
    # Heavy outputs get more tasks: each writes about _TASK_BYTES of arrays at most.
    rows_bytes = sum(math.prod(r["shape"][1:]) for r in arrays.select("shape").collect()) * dtype_of(spec.precision).itemsize
    tasks = max(spec.num_workers, -(-rows_bytes * min(step, max(n, 1)) // _TASK_BYTES))
    wave = max(1, spark.sparkContext.defaultParallelism // tasks) if spec.streaming_output else max(1, len(now))
    for k in range(0, len(now), wave):
        some = now[k : k + wave]
        part = encoded.where(F.col("slice").isin([start // step for start, _ in some])).drop("slice").repartition(tasks * len(some))
        made = represent(part, encoder, resolved, spec, vocabulary.pad_id, length, codec)
        sink.write_slices(made, where, step, spec.flush_batches_after)
        sink.record_ranges(spark, progress, resolved.keys, some)
    if len(now) < len(todo):
        return where
    sink.write_index(encoded, f"{root}/{experiment(spec)}_idx")
    if spec.npy and n:
        made = read_outputs(spark, where)
        for what in resolved.outputs:
            sink.export_npy(made.where(F.col("output_type") == what), f"{local}/{model_of(spec)}/{what}", experiment(spec), model_of(spec), n, dtype_of(spec.precision), spec.flatten and not what.endswith("pooled"))
    for path in (progress, work, parsed):
        sink.remove(spark, path)
    return where


def read_outputs(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.schema(f"slice long, {sink.SCHEMA}").parquet(where).drop("slice")
