"""Sequences that arrive over time: the same stateless stages for each micro-batch, with Spark's own checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from residua.encoders.base import Encoder
from residua.functions.vocabulary import Vocabulary
from residua.operators.sequences import invalid, tokenise
from residua.plans.pipeline import encode_table, represent
from residua.plans.spec import EmbedSpec, resolve
from residua.sinks.outputs import write_parquet

SEQUENCES = "ord long, sequence_id string, sequence string"


def stream_outputs(arriving: DataFrame, encoder: Encoder, vocabulary: Vocabulary, spec: EmbedSpec) -> DataFrame:
    """Outputs of a stream of (ord, sequence_id, sequence). There is no longest sequence to pad to, so padding is always discarded."""
    spec = EmbedSpec(**{**spec.__dict__, "discard_padding": True})
    return represent(encode_table(arriving, vocabulary, spec), encoder, resolve(spec, encoder), spec, vocabulary.pad_id, 0)


def embed_stream(spark: SparkSession, source: str, target: str, checkpoint: str, encoder: Encoder, vocabulary: Vocabulary, spec: EmbedSpec, trigger: dict | None = None) -> StreamingQuery:
    """Reads a folder of Parquet files (ord, sequence_id, sequence) as they arrive and appends outputs under target/outputs/batch=N; sequences with unknown tokens go to target/rejected. A repeated batch replaces its own files, so each is written once in effect."""
    arriving = spark.readStream.schema(SEQUENCES).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        bad = invalid(tokenise(batch, vocabulary, False), vocabulary).select("sequence_id", "unknown")
        good = batch.join(bad.select("sequence_id").distinct(), "sequence_id", "left_anti")
        write_parquet(stream_outputs(good, encoder, vocabulary, spec), f"{target}/outputs/batch={number}", "overwrite", spec.flush_batches_after)
        bad.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/rejected/batch={number}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
