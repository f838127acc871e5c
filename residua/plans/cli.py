"""The command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from residua.functions.scalars import OUTPUT_TYPES, PRECISIONS, parse_bool, parse_layers
from residua.plans.pipeline import run
from residua.plans.spec import EmbedSpec


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="residua", description="Extracts representations of sequences with Spark.")
    add = p.add_argument
    add("--model_name", required=True, help="synthetic[:layers,heads,width], a folder or file of weights, custom:path, an ESM name, or user/name")
    add("--fasta_path", required=True)
    add("--output_path", required=True)
    add("--experiment_name", help="prefix of output files; the input file's name without it")
    add("--tokenizer_from", help="folder of a vocabulary, or a hub name")
    add("--substring_path", help="CSV of sequence ids and substrings, by the place of the columns")
    add("--context", type=int, default=0, help="residues before and after a substring that are pooled too")
    add("--layers", nargs="*", type=parse_layers, default=[[-1]], help="layers, 'all' or 'last'; negative ones from the end")
    add("--extract_embeddings", nargs="+", choices=OUTPUT_TYPES, default=["mean_pooled"])
    add("--batch_size", type=int, default=1024, help="tokens of a batch")
    add("--discard_padding", action="store_true")
    add("--max_length", default="max_length")
    add("--streaming_output", type=parse_bool, default=True, help="commit in slices and resume")
    add("--num_workers", type=int, default=8, help="tasks that encode and write a slice")
    add("--disable_special_tokens", type=parse_bool, default=False)
    add("--flatten", type=parse_bool, default=False)
    add("--flush_batches_after", type=int, default=128, help="MB that a writer holds before it flushes")
    add("--precision", default="32", choices=sorted(PRECISIONS))
    add("--device", type=str.lower, default="cpu", choices=["cuda", "cpu"])
    add("--npy", type=parse_bool, default=False, help="also export dense arrays to the driver's disk, by which all rows pass")
    return p


def to_spec(argv: list[str] | None = None) -> EmbedSpec:
    given = vars(parser().parse_args(argv))
    layers = given.pop("layers")
    given["layers"] = None if any(x is None for x in layers) else tuple(i for x in layers for i in x)
    given["extract"] = tuple(given.pop("extract_embeddings"))
    return EmbedSpec(**given)


def main(argv: list[str] | None = None) -> str:
    spec = to_spec(argv)
    spark = SparkSession.builder.appName("residua").getOrCreate()
    where = run(spark, spec)
    print(where)
    return where
