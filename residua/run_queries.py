"""Registered queries of sources, sinks, resumed runs, real encoders' choice and streams, each with DuckDB SQL.

What a query writes goes to a folder of its own in the shared folder, and is read back through the library's readers.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residua.encoders.base import Output, Wanted
from residua.encoders.registry import choose
from residua.encoders.synthetic import LookupEncoder, SyntheticEncoder
from residua.encoders.transformer import NumpyTransformer
from residua.functions import scalars
from residua.functions import tokens as T
from residua.functions.vocabulary import Vocabulary, esm, from_files, without_word_marks
from residua.operators import sequences
from residua.plans.pipeline import experiment, manifest, read_outputs, report, represent, require_space, run
from residua.plans.spec import EmbedSpec, resolve
from residua.queries import _ALL, _HIDDEN, _PADDED, _TOK, ENCODER, VOCABULARY, _double, _long, _parts, _pool_sql, query, table
from residua.sinks.outputs import read_ranges, write_fasta, write_index, write_parquet
from residua.sinks.scratch import new_folder, write_bytes
from residua.sources.fasta import from_table, read_fasta, read_records
from residua.sources.files import infer_config, read_substrings, read_vocabulary
from residua.streaming.embed import embed_stream


def _sequences(spark, sf_dir) -> DataFrame:
    return _parts(spark, sf_dir).select((F.col("ord")).alias("ord"), F.col("ord").cast("string").alias("sequence_id"), "sequence")


def _fasta(spark, sf_dir) -> str:
    """part as FASTA files in the order of their names."""
    path = f"{new_folder(spark)}/in.fasta"
    write_fasta(_sequences(spark, sf_dir).repartitionByRange(4, "ord").sortWithinPartitions("ord"), path)
    return path


# --- sources


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ord, p_partkey::VARCHAR AS sequence_id, p_name AS sequence FROM part")
def fasta_scan(spark, sf_dir):
    return read_fasta(spark, _fasta(spark, sf_dir))


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS n, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_brand ELSE p_partkey || ' x>y' END AS header, p_name FROM part)
SELECT n + 1 AS record, 4 * n + 2 AS line, CASE header WHEN '' THEN printf('seqnum%09d', 4 * n + 2) ELSE header END AS sequence_id, CASE WHEN n % 7 = 0 THEN '' ELSE trim(p_name) || 'AC' END AS sequence FROM r""")
def fasta_records(spark, sf_dir):
    """A file with text before the first header, empty headers, headers with spaces and marks, padded lines, split and missing sequences."""
    path = f"{new_folder(spark)}/odd.fasta"
    rows = sequences.row_offsets(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name"), ["p_partkey"], F.floor(F.col("p_partkey") / 10_000), "n")
    header = F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, F.col("p_brand")).otherwise(F.concat(F.col("p_partkey").cast("string"), F.lit(" x>y")))
    first, second = (F.when(F.col("n") % 7 == 0, "").otherwise(x) for x in (F.concat(F.lit("  "), "p_name", F.lit(" \t")), F.lit("AC")))
    text = F.concat(F.when(F.col("n") == 0, "before any\nheader\n").otherwise(""), F.lit(">"), header, F.lit("\n"), first, F.lit("\n"), second, F.lit("\n"))
    rows.coalesce(1).sortWithinPartitions("n").select(text.alias("value")).write.text(path)
    return read_records(spark, path).drop("file")


@query("SELECT p_brand AS sequence_id, arg_max(p_name, p_partkey) AS sequence, min(p_partkey) AS first_key FROM part GROUP BY 1")
def fasta_repeated_ids(spark, sf_dir):
    """Of a repeated id the last sequence stays, at the first one's place."""
    path = f"{new_folder(spark)}/repeated.fasta"
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("sequence_id"), F.col("p_name").alias("sequence"))
    write_fasta(rows.repartitionByRange(3, "p_partkey").sortWithinPartitions("p_partkey"), path)
    found = read_fasta(spark, path)
    firsts = rows.groupBy("sequence_id").agg(F.min("p_partkey").alias("first_key"))
    ordered = firsts.withColumn("ord", F.rank().over(Window.orderBy("first_key")) - 1)
    return found.join(ordered, ["sequence_id", "ord"]).select("sequence_id", "sequence", "first_key")


@query("SELECT conv_id::VARCHAR AS sequence_id, arg_max(role, turn) AS substring FROM conversations GROUP BY 1")
def substring_csv(spark, sf_dir):
    """The first two columns of CSV files by their place; of a repeated id the last row stays."""
    path = new_folder(spark)
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("whatever"), F.col("role").alias("substring_aa"), F.col("turn").alias("more"))
    rows.coalesce(1).sortWithinPartitions("whatever", "more").write.csv(path, header=True)
    return read_substrings(spark, path)


@query("""SELECT * FROM (VALUES ('[PAD]', 0, true), ('[CLS]', 1, true), ('[SEP]', 2, true), ('[UNK]', 3, true), ('A', 4, false), ('C', 5, false)) AS t(token, id, special)""")
def vocabulary_file(spark, sf_dir):
    """vocab.json with special_tokens_map.json, through Spark's file systems."""
    path = new_folder(spark)
    write_bytes(spark, f"{path}/vocab.json", json.dumps({t: i for i, t in enumerate(["[PAD]", "[CLS]", "[SEP]", "[UNK]", "A", "C"])}).encode())
    write_bytes(spark, f"{path}/special_tokens_map.json", json.dumps({"pad_token": "[PAD]", "cls_token": {"content": "[CLS]"}, "sep_token": "[SEP]", "unk_token": "[UNK]"}).encode())
    v = read_vocabulary(spark, path)
    return spark.createDataFrame([(t, i, i in v.special_ids) for t, i in v.ids.items()], "token string, id int, special boolean")


@query("SELECT * FROM (VALUES ('angle', '<'), ('square', '['), ('extra', '['), ('neither', NULL)) AS t(name, bracket)")
def bracket_style(spark, sf_dir):
    made = {"angle": VOCABULARY, "square": Vocabulary({"[P]": 0}, pad="[P]", specials=("[P]",)), "extra": Vocabulary({"<p>": 0}, pad="<p>", specials=("<p>",), extra={"0": "[X]"}), "neither": Vocabulary({"p": 0}, pad="p", specials=("p",))}

    def style(v):
        try:
            return v.bracket
        except ValueError:
            return None

    return spark.createDataFrame([(n, style(v)) for n, v in made.items()], "name string, bracket string")


@query("""SELECT * FROM (VALUES ('ends', 1, 'A', 0), ('ends', 1, '<pad>', 1), ('ends', 1, '</s>', 2), ('bare', 0, 'B', 0), ('bare', 0, '<pad>', 1)) AS t(name, n_added, token, id)""")
def word_mark_vocabulary(spark, sf_dir):
    """A sentence-piece vocabulary: word marks go, and sequences end with its end token."""
    rows = []
    for name, ids in (("ends", {"▁A": 0, "<pad>": 1, "</s>": 2}), ("bare", {"▁B": 0, "<pad>": 1})):
        v = from_files(without_word_marks(ids), {"pad_token": "<pad>"})
        rows += [(name, sum(v.id_of(t) is not None for t in (v.cls, v.sep)), t, i) for t, i in v.ids.items()]
    return spark.createDataFrame(rows, "name string, n_added int, token string, id int")


_RESIDUES = "LAGVSERTIDPKQNFYMHWCXBUZO.-"


@query(rf"""WITH {_TOK}, b AS (SELECT ord, pos, coalesce(nullif(strpos('{_RESIDUES}', upper(ch)), 0) + 3, 3) AS id FROM tok), n AS (SELECT ord, max(pos) AS n FROM b GROUP BY 1)
SELECT ord, pos::INT AS pos, id::INT AS id FROM (SELECT * FROM b UNION ALL SELECT ord, 0, 0 FROM n UNION ALL SELECT ord, n + 1, 2 FROM n)""")
def esm_ids(spark, sf_dir):
    """Ids of the public ESM alphabet, with its start and end tokens."""
    rows = _parts(spark, sf_dir).withColumn("sequence", F.upper("sequence"))
    return sequences.tokenise(rows, esm()).select("ord", F.posexplode("input_ids").alias("pos", "id"))


@query("""SELECT * FROM (VALUES ('num_layers', 4), ('num_attention_heads', 2), ('hidden_size', 128), ('none num_layers', 12), ('none num_attention_heads', 12), ('none hidden_size', 768)) AS t(name, value)""")
def inferred_config(spark, sf_dir):
    shapes = {"Embed.WEIGHT": (25, 128), "Layers.0.Attention.weight": (4, 128), "layers.3.x": (2,)}
    rows = [*infer_config(shapes).items(), *((f"none {k}", v) for k, v in infer_config({}).items())]
    return spark.createDataFrame(rows, "name string, value int")


@query("""SELECT * FROM (VALUES ('synthetic:2,1,4', 'synthetic', NULL), ('custom:x', 'custom', NULL), ('a/b.pt', 'custom', NULL), ('/models/m', 'custom', NULL), ('esm2_t6_8M_UR50D', 'esm', NULL), ('esm1b_t33_650M_UR50S', 'esm', NULL),
('Rostlab/ProstT5', 'hub', NULL), ('alchemab/antiberta2', 'hub', 256), ('nothing', NULL, NULL)) AS t(name, kind, length_limit)""")
def model_choice(spark, sf_dir):
    def row(name):
        try:
            choice = choose(name)
            return name, choice.kind, choice.length_limit
        except ValueError:
            return name, None, None

    names = ("synthetic:2,1,4", "custom:x", "a/b.pt", "/models/m", "esm2_t6_8M_UR50D", "esm1b_t33_650M_UR50S", "Rostlab/ProstT5", "alchemab/antiberta2", "nothing")
    return spark.createDataFrame([row(n) for n in names], "name string, kind string, length_limit int")


# --- literals, names, precision


@query("""SELECT * FROM (VALUES ('yes', true), ('TRUE', true), ('t', true), ('Y', true), ('1', true), ('no', false), ('False', false), ('f', false), ('n', false), ('0', false), ('maybe', NULL)) AS t(word, switch)""")
def switches(spark, sf_dir):
    def switch(word):
        try:
            return scalars.parse_bool(word)
        except ValueError:
            return None

    return spark.createDataFrame([(w, switch(w)) for w in ("yes", "TRUE", "t", "Y", "1", "no", "False", "f", "n", "0", "maybe")], "word string, switch boolean")


@query("""SELECT * FROM (VALUES ('all', '1 2 3 4'), ('last', '4'), ('0 2', '0 2'), ('-1 -2 4', '4 3'), ('-5', '0')) AS t(words, layers)""")
def layer_words(spark, sf_dir):
    rows = [(w, " ".join(map(str, scalars.normalise_layers(scalars.parse_layers(w), 4)))) for w in ("all", "last", "0 2", "-1 -2 4", "-5")]
    return spark.createDataFrame(rows, "words string, layers string")


@query("""SELECT vec_id, d::INT AS dim, CASE WHEN x = 0 THEN x ELSE round_even(x / s, 0) * s END AS value
FROM (SELECT vec_id, d, x, pow(2.0::DOUBLE, greatest(floor(log2(abs(x))), -14) - 10) AS s FROM (SELECT vec_id, d, embedding[d + 1]::DOUBLE AS x FROM embeddings, range(64) AS t(d)))""")
def half_precision(spark, sf_dir):
    """Values in half precision: 11 significant bits, ties to even."""
    rounded = table(spark, sf_dir, "embeddings").select("vec_id", scalars.half_precision("embedding").alias("v"))
    return rounded.select("vec_id", F.posexplode("v").alias("dim", "value")).select("vec_id", "dim", F.col("value").cast("double").alias("value"))


@query("""SELECT n_name, n_name || '.v1' AS own, 'given' AS named FROM nation""")
def experiment_prefix(spark, sf_dir):
    names = [r[0] for r in table(spark, sf_dir, "nation").select("n_name").collect()]  # a fixed table
    rows = [(n, experiment(EmbedSpec("synthetic", fasta_path=f"/data/{n}.v1.fasta")), experiment(EmbedSpec("synthetic", fasta_path=f"/data/{n}.v1.fasta", experiment_name="given"))) for n in names]
    return spark.createDataFrame(rows, "n_name string, own string, named string")


@query("""SELECT * FROM (VALUES ('all types', 'per_token', 1), ('all types', 'mean_pooled', 1), ('all types', 'attention_head', 2), ('all types', 'attention_model', 1), ('all types', 'logits', 1), ('vectors alone', 'per_token', 1), ('vectors alone', 'mean_pooled', 1)) AS t(model, output_type, n)""")
def output_choices(spark, sf_dir):
    """Repeated outputs count once, and outputs that a model lacks are left out."""
    spec = EmbedSpec("synthetic", extract=("per_token", "mean_pooled", "per_token", "attention_head", "attention_model", "logits", "logits"))
    models = {"all types": SyntheticEncoder(num_heads=2), "vectors alone": LookupEncoder(np.zeros((4, 2), np.float32))}
    rows = [(name, what) for name, model in models.items() for what, _, _ in resolve(spec, model).keys]
    return spark.createDataFrame(rows, "model string, output_type string").groupBy("model", "output_type").agg(F.count("*").cast("int").alias("n"))


@query("""SELECT * FROM (VALUES ('pooled', '2 4', '', false), ('heads', '2', '2', false), ('model', '', '1 2 3 4', false), ('logits', '', '', true)) AS t(name, hidden, attention, logits)""")
def wanted_flags(spark, sf_dir):
    """What a run asks of the forward pass, and nothing else."""
    asked = {"pooled": ("mean_pooled",), "heads": ("mean_pooled", "attention_head"), "model": ("attention_model",), "logits": ("logits",)}
    rows = []
    for name, extract in asked.items():
        w = resolve(EmbedSpec("synthetic", extract=extract, layers=(2, -1) if name == "pooled" else (2,)), ENCODER).wanted
        rows.append((name, " ".join(map(str, w.hidden)), " ".join(map(str, w.attention)), w.logits))
    return spark.createDataFrame(rows, "name string, hidden string, attention string, logits boolean")


@query("""WITH f AS (SELECT count(*) * 8 * 4 AS needed FROM part) SELECT needed::BIGINT AS needed, free, free >= needed AS fits FROM f, (VALUES (0), (1), (1000000000)) AS t(free)""")
def space_check(spark, sf_dir):
    spec = EmbedSpec("synthetic", fasta_path="x.fasta")
    n = table(spark, sf_dir, "part").count()
    rows = manifest(spark, spec, resolve(spec, ENCODER), ENCODER, n, 10)

    def fits(free):
        try:
            return require_space(rows, free) <= free
        except ValueError:
            return False

    needed = require_space(rows, 1 << 60)
    return spark.createDataFrame([(needed, free, fits(free)) for free in (0, 1, 1_000_000_000)], "needed long, free int, fits boolean")


# --- encoders


def _hand_made() -> NumpyTransformer:
    """A model without blocks, of weights that SQL can write: its only layer is the normalised sum of both embeddings."""
    token = np.array([[(3 * t + 5 * d) % 7 for d in range(8)] for t in range(24)]) / 8
    place = np.array([[(p + 2 * d * d) % 5 for d in range(8)] for p in range(64)]) / 8
    return NumpyTransformer({"token_embedding": token, "position_embedding": place, "norm.weight": np.ones(8), "norm.bias": np.zeros(8)}, 2)


@query(f"""WITH {_ALL}, x AS (SELECT ord, pos, id, dim, ((3 * id + 5 * dim) % 7 + (pos + 2 * dim * dim) % 5) / 8.0::DOUBLE AS x FROM full_ids, range(8) AS t(dim)),
m AS (SELECT *, (x - avg(x) OVER p) / sqrt(var_pop(x) OVER p + 0.00001::DOUBLE) AS y FROM x WINDOW p AS (PARTITION BY ord, pos)),
v AS (SELECT ord, dim, avg(y) FILTER (WHERE id > 3) AS v FROM m GROUP BY 1, 2)
SELECT ord % 50 AS rest, dim::INT AS dim, round(avg(v), 3) AS mean FROM v GROUP BY 1, 2""")
def custom_forward(spark, sf_dir):
    """A custom model's forward pass: embeddings and layer normalisation, pooled; means over sequences, rounded to three places, as the model computes in single precision."""
    model = _hand_made()
    spec = EmbedSpec("synthetic", layers=(0,), batch_size=65_536)
    made = represent(_sequences(spark, sf_dir), model, resolve(spec, model), spec, VOCABULARY.pad_id, 0, T.TextCodec(VOCABULARY))
    value = F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))
    return _long(made).groupBy((F.col("ord") % 50).alias("rest"), "dim").agg(F.round(F.avg(value), 3).alias("mean"))


class _Small:
    """The synthetic model with room for four sequences at once."""

    outputs, num_layers, num_heads, hidden_size, vocab_size, fingerprint = ENCODER.outputs, ENCODER.num_layers, ENCODER.num_heads, ENCODER.hidden_size, ENCODER.vocab_size, "small"

    def __call__(self, ids: np.ndarray, mask: np.ndarray, wanted: Wanted) -> Output:
        if len(ids) > 4:
            raise MemoryError
        return ENCODER(ids, mask, wanted)


@query(_pool_sql("(4)"))
def batches_halved(spark, sf_dir):
    """mean_pooled where large batches run out of memory and are halved."""
    spec = EmbedSpec("synthetic", batch_size=1024)
    return _double(_long(represent(_sequences(spark, sf_dir), _Small(), resolve(spec, ENCODER), spec, VOCABULARY.pad_id, 0, T.TextCodec(VOCABULARY))))


@query(f"""WITH {_ALL}, d AS (SELECT unnest(range(8)) AS dim) SELECT ord, dim::INT AS dim, coalesce(avg(CASE WHEN dim = id % 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE id > 3), 'NaN'::DOUBLE)::FLOAT::DOUBLE AS value FROM full_ids, d GROUP BY 1, 2""")
def lookup_pooled(spark, sf_dir):
    """Means of given vectors of the tokens."""
    model = LookupEncoder(np.eye(8)[np.arange(24) % 8])
    spec = EmbedSpec("synthetic")
    made = represent(_sequences(spark, sf_dir), model, resolve(spec, model), spec, VOCABULARY.pad_id, 0, T.TextCodec(VOCABULARY))
    return _double(_long(made)).drop("layer")


# --- sinks, whole runs, resumed runs, streams


@query("""SELECT * FROM (VALUES ('mean_pooled', 2, NULL), ('mean_pooled', 4, NULL), ('attention_head', 2, 0), ('attention_head', 2, 1), ('attention_head', 4, 0), ('attention_head', 4, 1)) AS t(output_type, layer, head), (SELECT count(*) AS n FROM part)""")
def parquet_layout(spark, sf_dir):
    """Rows of each folder of a written run, of its partition columns alone."""
    path = new_folder(spark)
    spec = EmbedSpec("synthetic", extract=("mean_pooled", "attention_head"), layers=(2, 4), discard_padding=True, batch_size=65_536)
    write_parquet(represent(_sequences(spark, sf_dir), ENCODER, resolve(spec, ENCODER), spec, VOCABULARY.pad_id, 0, T.TextCodec(VOCABULARY)), path)
    return spark.read.schema("output_type string, layer int, head int, ord long").parquet(path).groupBy("output_type", "layer", "head").agg(F.count("*").alias("n"))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS \"index\", doc_id || ', \"' || lang || '\"' AS sequence_id FROM documents")
def index_csv(spark, sf_dir):
    """The index of a run, written as CSV with ids that need quotes, and read back."""
    path = new_folder(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(', "'), "lang", F.lit('"')).alias("name"), "text")
    write_index(from_table(docs, "name", "text", "doc_id"), path)
    return spark.read.schema("index long, sequence_id string").csv(path, header=True)


@query("SELECT doc_id::VARCHAR AS sequence_id, row_number() OVER (ORDER BY doc_id::VARCHAR) - 1 AS ord FROM documents")
def table_order(spark, sf_dir):
    """Sequences of a table in the order of their ids as text, numbered in ranges that a sample cuts."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), "text")
    return from_table(docs, "name", "text").select("sequence_id", "ord")


#: The vocabulary of the queries with every other character as an unknown token of its own, so that part can be run.
RUN_VOCABULARY = Vocabulary({**{chr(c): 3 for c in range(32, 127) if chr(c) not in VOCABULARY.ids}, **VOCABULARY.ids}, upper=True)


def _run_spec(spark, sf_dir, **more) -> EmbedSpec:
    return EmbedSpec("synthetic", new_folder(spark), _fasta(spark, sf_dir), **{"batch_size": 65_536, "commit_rows": 1000, "num_workers": 2} | more)


def _run(spark, spec: EmbedSpec, **more) -> DataFrame:
    """Outputs of a run of a FASTA file of part, with the keys of part for the numbers of the rows."""
    made = read_outputs(spark, run(spark, spec, encoder=ENCODER, vocabulary=RUN_VOCABULARY, **more))
    return made.withColumn("ord", F.col("sequence_id").cast("long"))


_CELLS = f"""{_PADDED}, width AS (SELECT l AS w FROM m), dims AS (SELECT unnest(range(8)) AS dim), four AS (SELECT 4 AS layer),
a AS (SELECT ord, max(pos) AS n, list(ch ORDER BY pos) AS tk FROM ids GROUP BY 1), s AS (SELECT ord AS sord, n AS n_tokens, list_filter(range(1, n), lambda q: tk[q] = 'i' AND tk[q + 1] = 'n') AS starts FROM a),
tokens AS (SELECT padded.ord, pos, id, dim, ({_HIDDEN}) AS x, id > 3 AS real, pos BETWEEN 1 AND n_tokens AND len(list_filter(starts, lambda q: pos >= q AND pos < q + 2)) > 0 AS inside FROM padded JOIN s ON padded.ord = sord, dims, four)"""


@query(f"""WITH {_CELLS}
SELECT 'per_token' AS output_type, ord, NULL::INT AS head, (8 * pos + dim)::INT AS at, x AS value FROM tokens
UNION ALL SELECT 'mean_pooled', ord, NULL, dim::INT, coalesce(avg(x) FILTER (WHERE real), 'NaN'::DOUBLE)::FLOAT::DOUBLE FROM tokens GROUP BY ord, dim
UNION ALL SELECT 'substring_pooled', ord, NULL, dim::INT, coalesce(avg(x) FILTER (WHERE inside), 'NaN'::DOUBLE)::FLOAT::DOUBLE FROM tokens GROUP BY ord, dim
UNION ALL SELECT 'attention_head', a.ord, h, (a.pos * w + b.pos)::INT, ((5 * a.id + 3 * b.id + a.pos + 2 * b.pos + 44 + 7 * h) % 8) / 8.0::DOUBLE FROM padded a JOIN padded b ON a.ord = b.ord, width, (VALUES (0), (1)) AS t(h)""")
def whole_run(spark, sf_dir):
    """A run from a FASTA file and a substring table to four kinds of outputs, read back from Parquet."""
    subs = _sequences(spark, sf_dir).select("sequence_id", F.lit("in").alias("substring"))
    path = new_folder(spark)
    subs.write.csv(path, header=True)
    spec = _run_spec(spark, sf_dir, extract=("per_token", "mean_pooled", "substring_pooled", "attention_head"), substring_path=path)
    made = _run(spark, spec).select("output_type", "ord", "head", F.posexplode("values").alias("at", "value"))
    return _double(made)


@query(_pool_sql("(4)"))
def resumed_run(spark, sf_dir):
    """A run that stops after its first slice and goes on."""
    spec = _run_spec(spark, sf_dir, commit_rows=1 + table(spark, sf_dir, "part").count() // 5)
    run(spark, EmbedSpec(**{**spec.__dict__, "slices_at_most": 1}), encoder=ENCODER, vocabulary=RUN_VOCABULARY)
    return _double(_long(_run(spark, spec)))


@query("""WITH n AS (SELECT least(128, count(*)) AS n FROM part)
SELECT 'mean_pooled' AS output_type, k AS layer, 1::BIGINT AS n_ranges, n::BIGINT AS n_rows, (n * 32)::BIGINT AS n_bytes, 0 AS is_total FROM n, (VALUES (2), (4)) AS t(k) UNION ALL SELECT NULL, NULL, 2, (2 * n)::BIGINT, (2 * n * 32)::BIGINT, 1 FROM n""")
def resume_report(spark, sf_dir):
    """Rows and bytes that a stopped run has done."""
    spec = _run_spec(spark, sf_dir, commit_rows=64, layers=(2, 4), slices_at_most=2)
    where = run(spark, spec, encoder=ENCODER, vocabulary=RUN_VOCABULARY)
    n = table(spark, sf_dir, "part").count()
    return report(spark, spec, resolve(spec, ENCODER), ENCODER, read_ranges(spark, where.replace("/outputs-", "/_progress-")), n, 14).drop("head")


@query("SELECT count(*) AS ids, count(*) AS n FROM part")
def repeated_run(spark, sf_dir):
    """A finished run that is run again: the same rows, none twice."""
    spec = _run_spec(spark, sf_dir, commit_rows=100_000)
    _run(spark, spec)
    return _run(spark, spec).agg(F.count_distinct("ord").alias("ids"), F.count("*").alias("n"))


@query(_pool_sql("(4)"))
def streamed_pooled(spark, sf_dir):
    """mean_pooled of sequences that arrive as files, in a stream that has read what is there."""
    root = new_folder(spark)
    _sequences(spark, sf_dir).repartition(3).write.parquet(f"{root}/source")
    spec = EmbedSpec("synthetic", extract=("mean_pooled",), batch_size=65_536)
    embed_stream(spark, f"{root}/source", f"{root}/target", f"{root}/check", ENCODER, RUN_VOCABULARY, spec).awaitTermination()
    made = spark.read.schema("output_type string, layer int, head int, ord long, sequence_id string, shape array<int>, values array<float>").parquet(f"{root}/target/outputs")
    return _double(_long(made))
