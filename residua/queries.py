"""The registered queries of the engine's own operators, each with DuckDB SQL for the same rows.

Tables of the driver stand in for sequences: part.p_name for short ones, documents.text for long ones. Results are
scalars in long form. The encoder of these queries is the synthetic one, whose values SQL can compute.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.encoders.synthetic import SyntheticEncoder
from residua.functions import scalars
from residua.functions import subsequence as S
from residua.functions import tokens as T
from residua.functions.vocabulary import protein
from residua.operators import extract, ranges, sequences, substrings
from residua.plans.pipeline import encode_table, manifest, represent
from residua.plans.spec import EmbedSpec, resolve
from residua.sinks.outputs import matrices
from residua.sources.fasta import from_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

VOCABULARY = protein()
ENCODER = SyntheticEncoder(num_layers=4, num_heads=2, hidden_size=8, vocab_size=24)
_VALUES = ", ".join(f"('{t}', {i})" for t, i in VOCABULARY.ids.items())
# Tokens (ord, pos from 1, ch), ids without special tokens, and ids with them (pos from 0).
_TOK = "tok AS (SELECT p_partkey AS ord, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS ch FROM (SELECT p_partkey, regexp_extract_all(p_name, '<[^\\n]*?>|[^\\n]', 0) AS a FROM part))"
_IDS = f"{_TOK}, vocab(token, id) AS (VALUES {_VALUES}), ids AS (SELECT ord, pos, ch, coalesce(id, 3) AS id FROM tok LEFT JOIN vocab ON upper(ch) = token)"
_ALL = f"{_IDS}, n AS (SELECT ord, max(pos) AS n FROM ids GROUP BY 1), full_ids AS (SELECT ord, pos, id FROM ids UNION ALL SELECT ord, 0, 1 FROM n UNION ALL SELECT ord, n + 1, 2 FROM n)"
_HIDDEN = "((31 * id + 17 * pos + 7 * dim + 13 * layer) % 256) / 256.0::DOUBLE"


def query(sql: str | None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("sequence"))


def _tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.tokenise(_parts(spark, sf_dir), VOCABULARY)


def _represent(spark: SparkSession, sf_dir: str, extract_: tuple[str, ...], layers: tuple[int, ...] | None = (-1,), substring: str | None = None, context: int = 0, keep: str | None = None, **more) -> DataFrame:
    spec = EmbedSpec("synthetic", extract=extract_, layers=layers, substring_path="given" if substring else None, context=context, **{"discard_padding": True, "batch_size": 65_536} | more)
    rows = _parts(spark, sf_dir).select("ord", F.col("ord").cast("string").alias("sequence_id"), "sequence")
    subs = rows.select("sequence_id", F.lit(substring).alias("substring")) if substring else None
    encoded = encode_table(rows, VOCABULARY, spec, subs)
    length = 0 if spec.discard_padding else sequences.longest(encoded)
    return represent(encoded, ENCODER, resolve(spec, ENCODER), spec, VOCABULARY.pad_id, length, keep=keep)


def _long(outputs: DataFrame) -> DataFrame:
    return outputs.select("ord", "layer", F.posexplode("values").alias("dim", "value"))


# --- scans, projections, tokens


@query(f"WITH {_TOK} SELECT ord, pos, ch FROM tok")
def token_split(spark, sf_dir):
    return _parts(spark, sf_dir).select("ord", F.posexplode(T.split_tokens(F.col("sequence"))).alias("at", "ch")).select("ord", (F.col("at") + 1).cast("long").alias("pos"), "ch")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\[[^\n]*?\]|[^\n]', 0))::INT AS n_tokens FROM documents")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.split_tokens(F.col("text"), "[")).alias("n_tokens"))


@query(r"""WITH s AS (SELECT p_partkey, 'A[MASK]' || p_name || '[x' || '<eos>' AS s FROM part)
SELECT p_partkey, array_to_string(regexp_extract_all(s, '\[[^\n]*?\]|[^\n]', 0), '|') AS square, array_to_string(regexp_extract_all(s, '<[^\n]*?>|[^\n]', 0), '|') AS angle FROM s""")
def bracket_tokens(spark, sf_dir):
    s = F.concat(F.lit("A[MASK]"), "p_name", F.lit("[x<eos>"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.split_tokens(s, "["), "|").alias("square"), F.array_join(T.split_tokens(s, "<"), "|").alias("angle"))


@query(r"SELECT p_partkey, array_to_string(regexp_extract_all(p_name, '<[^\n]*?>|[^\n]', 0), ' ') AS gapped FROM part")
def gap_sequence(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.gap(T.split_tokens(F.col("p_name"))).alias("gapped"))


@query("SELECT conv_id, min(turn) AS turn, arg_max(text, turn) AS text FROM conversations GROUP BY 1")
def dedup_last(spark, sf_dir):
    return sequences.dedup_last(table(spark, sf_dir, "conversations"), "conv_id", "turn", ["text"])


@query("SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN printf('seqnum%09d', doc_id) ELSE lang END AS sequence_id FROM documents")
def auto_id(spark, sf_dir):
    header = F.when(F.col("n_chars") % 3 == 0, "").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", sequences.auto_id(header, F.col("doc_id")).alias("sequence_id"))


@query(f"WITH {_IDS} SELECT ord, pos, id FROM ids")
def token_ids(spark, sf_dir):
    ids = T.encode(T.split_tokens(F.col("sequence"), VOCABULARY.bracket), VOCABULARY)
    return _parts(spark, sf_dir).select("ord", F.posexplode(ids).alias("at", "id")).select("ord", (F.col("at") + 1).cast("long").alias("pos"), "id")


@query(f"WITH {_IDS} SELECT ord, pos, ids.id FROM ids")
def token_vocabulary_join(spark, sf_dir):
    """token_ids as a join with the vocabulary's table, a fixed number of rows."""
    vocab = spark.createDataFrame(list(VOCABULARY.ids.items()), "token string, id int")
    each = _parts(spark, sf_dir).select("ord", F.posexplode(T.split_tokens(F.col("sequence"))).alias("at", "ch"))
    return each.join(F.broadcast(vocab), F.upper("ch") == F.col("token"), "left").select("ord", (F.col("at") + 1).cast("long").alias("pos"), F.coalesce("id", F.lit(3)).alias("id"))


@query(f"WITH {_ALL} SELECT ord, pos::INT AS pos, id FROM full_ids")
def special_tokens(spark, sf_dir):
    return _tokenised(spark, sf_dir).select("ord", F.posexplode("input_ids").alias("pos", "id"))


@query(f"WITH {_IDS} SELECT ord, (pos - 1)::INT AS pos, id FROM ids")
def no_special_tokens(spark, sf_dir):
    return sequences.tokenise(_parts(spark, sf_dir), VOCABULARY, specials=False).select("ord", F.posexplode("input_ids").alias("pos", "id"))


@query(f"""WITH {_ALL}, l AS (SELECT max(n) + 2 AS l FROM n)
SELECT n.ord, p.pos::INT AS pos, coalesce(f.id, 0) AS id, (f.id IS NOT NULL)::INT AS attention FROM n, l, unnest(range(l)) AS p(pos) LEFT JOIN full_ids f ON f.ord = n.ord AND f.pos = p.pos""")
def pad_mask(spark, sf_dir):
    rows = _tokenised(spark, sf_dir)
    length = sequences.longest(rows)
    padded = F.arrays_zip(T.pad(F.col("input_ids"), length, VOCABULARY.pad_id).alias("i"), T.attention_mask(F.col("input_ids"), length).alias("a"))
    return rows.select("ord", F.posexplode(padded).alias("pos", "x")).select("ord", "pos", F.col("x.i").alias("id"), F.col("x.a").cast("int").alias("attention"))


@query("""WITH m AS (SELECT max(length(p_name)) + 2 AS longest FROM part), r(requested) AS (VALUES ('max_length'), ('4'), ('64'))
SELECT requested, CASE requested WHEN 'max_length' THEN longest ELSE greatest(requested::BIGINT, longest) END::BIGINT AS length FROM r, m""")
def max_length_policy(spark, sf_dir):
    longest = sequences.longest(_tokenised(spark, sf_dir))
    return spark.createDataFrame([(r, scalars.max_length(r, longest)) for r in ("max_length", "4", "64")], "requested string, length long")


@query(f"WITH {_ALL} SELECT ord, pos::INT AS pos, id FROM full_ids WHERE pos < 6")
def truncate(spark, sf_dir):
    return _tokenised(spark, sf_dir).select("ord", F.posexplode(T.truncate(F.col("input_ids"), 6)).alias("pos", "id"))


@query("""SELECT i::INT AS layer, CASE WHEN i BETWEEN -7 AND 6 THEN ((i + 7) % 7 + 7) % 7 END::INT AS normalised FROM range(-8, 8) AS t(i)""")
def layer_normalise(spark, sf_dir):
    return spark.range(-8, 8).select(F.col("id").cast("int").alias("layer"), scalars.layer_column(F.col("id").cast("int"), 6).cast("int").alias("normalised"))


@query(f"WITH {_TOK}, vocab(token, id) AS (VALUES {_VALUES}) SELECT ord, upper(ch) AS token FROM tok WHERE upper(ch) NOT IN (SELECT token FROM vocab) GROUP BY 1, 2")
def invalid_tokens(spark, sf_dir):
    rows = _tokenised(spark, sf_dir)
    return sequences.invalid(rows, VOCABULARY, "ord").select("ord", F.explode("unknown").alias("token"))


@query(f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '<[^\\n]*?>|[^\\n]', 0)) AS ch FROM documents), vocab(token, id) AS (VALUES {_VALUES})
SELECT doc_id, count(*)::INT AS n_tokens, (count(DISTINCT upper(ch)) FILTER (WHERE upper(ch) NOT IN (SELECT token FROM vocab)))::INT AS n_unknown FROM t GROUP BY 1 HAVING n_tokens > 256 OR n_unknown > 0""")
def length_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.split_tokens(F.col("text")).alias("tokens"))
    return sequences.invalid(rows, VOCABULARY, "doc_id", limit=256).select("doc_id", "n_tokens", F.size("unknown").alias("n_unknown"))


@query(f"WITH {_ALL} SELECT ord, pos::INT AS pos, id NOT IN (0, 1, 2, 3) AS pooled FROM full_ids")
def pooling_mask(spark, sf_dir):
    return _tokenised(spark, sf_dir).select("ord", F.posexplode("pooling_mask").alias("pos", "pooled"))


@query("SELECT p_partkey, printf('run_%s_mean_pooled_layer_%d_head_%d.npy', regexp_replace(p_brand || '/' || p_type || '/x', '^[^/]*/', ''), p_size, p_size % 4 + 1) AS path FROM part")
def output_path(spark, sf_dir):
    model = scalars.model_name_column(F.concat("p_brand", F.lit("/"), "p_type", F.lit("/x")))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.output_file_column(F.lit("run"), model, F.lit("mean_pooled"), F.col("p_size"), F.col("p_size") % 4).alias("path"))


# --- joins and subsequences


@query("SELECT d.doc_id::VARCHAR AS sequence_id, length(d.text) AS n, l.quality::VARCHAR AS substring FROM documents d JOIN labels l USING (doc_id)")
def substring_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sequence_id"), F.length("text").cast("long").alias("n"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("sequence_id"), F.col("quality").cast("string").alias("substring"))
    return substrings.join(docs, labels)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def substring_missing(spark, sf_dir):
    return substrings.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


def _substring_rows(spark: SparkSession, sf_dir: str, context: int) -> DataFrame:
    rows = _tokenised(spark, sf_dir).withColumn("substring", F.lit("in"))
    masked = substrings.with_mask(rows, VOCABULARY, context)
    return masked.select("ord", F.posexplode("substring_mask").alias("pos", "inside"))


_STARTS = f"""WITH {_TOK}, a AS (SELECT ord, max(pos) AS n, list(ch ORDER BY pos) AS tk FROM tok GROUP BY 1),
s AS (SELECT ord, n, list_filter(range(1, n), lambda q: tk[q] = 'i' AND tk[q + 1] = 'n') AS starts FROM a)
SELECT ord, p.pos::INT AS pos, len(list_filter(starts, lambda q: p.pos >= q - {{c}} AND p.pos < q + 2 + {{c}} AND p.pos BETWEEN 1 AND n)) > 0 AS inside FROM s, unnest(range(n + 2)) AS p(pos)"""


@query(_STARTS.format(c=0))
def substring_mask(spark, sf_dir):
    return _substring_rows(spark, sf_dir, 0)


@query(_STARTS.format(c=2))
def substring_context(spark, sf_dir):
    return _substring_rows(spark, sf_dir, 2)


@query("""WITH s AS (SELECT p_partkey, 'AAA' || p_name || 'AA' AS s FROM part),
t AS (SELECT p_partkey, length(s) AS n, list_filter(range(1, length(s)), lambda q: s[q:q + 1] = 'AA') AS starts FROM s)
SELECT p_partkey, len(starts)::INT AS n_starts, len(list_filter(range(1, n + 1), lambda p: len(list_filter(starts, lambda q: p >= q AND p < q + 2)) > 0))::INT AS n_inside FROM t""")
def substring_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", T.split_tokens(F.concat(F.lit("AAA"), "p_name", F.lit("AA"))).alias("t")).withColumn("s", F.split(F.lit("A,A"), ","))
    rows = rows.withColumn("starts", S.starts(F.col("t"), F.col("s"))).withColumn("inside", S.mask(F.col("t"), F.col("starts"), F.lit(2)))
    return rows.select("p_partkey", F.size("starts").alias("n_starts"), F.size(F.filter("inside", lambda x: x)).alias("n_inside"))


@query("""SELECT p_partkey, CASE WHEN p > 0 THEN greatest(p - 1 - 3, 0) + 1 END::INT AS start, CASE WHEN p > 0 THEN least(p - 1 + 2 + 3, length(p_name)) + 1 END::INT AS stop FROM (SELECT *, strpos(p_name, 'in') AS p FROM part)""")
def substring_positions(spark, sf_dir):
    span = S.first_span(T.split_tokens(F.col("p_name")), F.split(F.lit("i,n"), ","), context=3, before=1)
    return table(spark, sf_dir, "part").select("p_partkey", span.alias("x")).select("p_partkey", F.col("x.start").alias("start"), F.col("x.end").alias("stop"))


@query("SELECT p_partkey, replace(p_name || '-a-', '-', '') AS degapped FROM part")
def degap(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.degap(F.concat("p_name", F.lit("-a-"))).alias("degapped"))


# --- extractors


def _pool_sql(layers: str, condition: str = "id > 3", extra: str = "") -> str:
    return f"""WITH {_ALL}{extra}, l(layer) AS (VALUES {layers}), d AS (SELECT unnest(range(8)) AS dim),
v AS (SELECT ord, layer, dim, avg({_HIDDEN}) FILTER (WHERE {condition}) AS m FROM full_ids, l, d GROUP BY ALL)
SELECT ord, layer::INT AS layer, dim::INT AS dim, coalesce(m, 'NaN'::DOUBLE)::FLOAT::DOUBLE AS value FROM v"""


def _double(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.col("value").cast("double"))


@query(_pool_sql("(4)"))
def mean_pooled(spark, sf_dir):
    return _double(_long(_represent(spark, sf_dir, ("mean_pooled",))))


@query(_pool_sql("(0), (2), (4)"))
def mean_pooled_multi_layer(spark, sf_dir):
    return _double(_long(_represent(spark, sf_dir, ("mean_pooled",), (-1, 2, 0, 4))))


@query(_pool_sql("(4)"))
def mean_pooled_relational(spark, sf_dir):
    """mean_pooled from per-token rows by a grouped mean. The mask comes with the rows: Spark takes exploded tables for as small as their files, and would broadcast one side of a join."""
    made = matrices(_represent(spark, sf_dir, ("per_token",), keep="pooling_mask"), "pooling_mask")
    rows = _double(extract.per_token(made, ["ord", "layer"], mask="pooling_mask"))
    return _double(extract.mean_by(rows, ["ord", "layer", "dim"], mask="pooling_mask", name="value").withColumn("value", F.col("value").cast("float")))


_SUB = f", a AS (SELECT ord, max(pos) AS n, list(ch ORDER BY pos) AS tk FROM ids GROUP BY 1), s AS (SELECT ord AS sord, n, list_filter(range(1, n), lambda q: tk[q] = 'i' AND tk[q + 1] = 'n') AS starts FROM a)"


def _sub_sql(c: int) -> str:
    return _pool_sql("(4)", "inside", _SUB).replace("FROM full_ids, l, d", f"FROM (SELECT full_ids.*, pos BETWEEN 1 AND n AND len(list_filter(starts, lambda q: pos >= q - {c} AND pos < q + 2 + {c})) > 0 AS inside FROM full_ids JOIN s ON ord = sord), l, d")


@query(_sub_sql(0))
def substring_pooled(spark, sf_dir):
    return _double(_long(_represent(spark, sf_dir, ("substring_pooled",), substring="in")))


@query(_sub_sql(1))
def substring_pooled_context(spark, sf_dir):
    return _double(_long(_represent(spark, sf_dir, ("substring_pooled",), substring="in", context=1)))


@query("SELECT p_partkey AS ord, dim::INT AS dim, true AS is_nan FROM part, range(8) AS t(dim)")
def empty_mask_nan(spark, sf_dir):
    return _long(_represent(spark, sf_dir, ("substring_pooled",), substring="absent")).select("ord", "dim", F.isnan("value").alias("is_nan"))


@query("SELECT label, d::INT AS dim, round(avg(embedding[d + 1]::DOUBLE), 9) AS mean FROM embeddings, range(64) AS t(d) GROUP BY 1, 2")
def vector_mean_by_label(spark, sf_dir):
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))
    return extract.mean_by(each, ["label", "dim"]).withColumn("mean", F.round("mean", 9))


@query(f"WITH {_ALL}, d AS (SELECT unnest(range(8)) AS dim), layer AS (SELECT 4 AS layer) SELECT ord, pos::INT AS pos, dim::INT AS dim, ({_HIDDEN})::DOUBLE AS value FROM full_ids, d, layer")
def per_token_discard_padding(spark, sf_dir):
    return _double(extract.per_token(matrices(_represent(spark, sf_dir, ("per_token",))), ["ord"]))


_PADDED = f"{_ALL}, m AS (SELECT max(n) + 2 AS l FROM n), padded AS (SELECT n.ord, p.pos, coalesce(f.id, 0) AS id FROM n, m, unnest(range(l)) AS p(pos) LEFT JOIN full_ids f ON f.ord = n.ord AND f.pos = p.pos)"


@query(f"WITH {_PADDED}, d AS (SELECT unnest(range(8)) AS dim), layer AS (SELECT 4 AS layer) SELECT ord, pos::INT AS pos, dim::INT AS dim, ({_HIDDEN})::DOUBLE AS value FROM padded, d, layer")
def per_token(spark, sf_dir):
    return _double(extract.per_token(matrices(_represent(spark, sf_dir, ("per_token",), discard_padding=False)), ["ord"]))


@query(f"WITH {_PADDED}, d AS (SELECT unnest(range(8)) AS dim), layer AS (SELECT 4 AS layer) SELECT ord, (8 * pos + dim)::INT AS dim, 4 AS layer, ({_HIDDEN})::DOUBLE AS value FROM padded, d, layer")
def flatten(spark, sf_dir):
    return _double(_long(_represent(spark, sf_dir, ("per_token",), discard_padding=False, flatten=True)))


_PAIR = f"{_ALL}, w AS (SELECT a.ord, a.pos::INT AS i, b.pos::INT AS j, layer, head, ((5 * a.id + 3 * b.id + a.pos + 2 * b.pos + 11 * layer + 7 * head) % 8) / 8.0::DOUBLE AS weight FROM full_ids a JOIN full_ids b ON a.ord = b.ord, unnest([1, 2, 3, 4]) AS l(layer), unnest([0, 1]) AS h(head))"


def _attention(df: DataFrame, *keys: str) -> DataFrame:
    return extract.per_token(matrices(df), ["ord", *keys]).select("ord", *keys, F.col("pos").alias("i"), F.col("dim").alias("j"), F.col("value").cast("double").alias("weight"))


@query(f"WITH {_PAIR} SELECT ord, layer, head, i, j, weight FROM w WHERE layer = 4")
def attention_head(spark, sf_dir):
    return _attention(_represent(spark, sf_dir, ("attention_head",)), "layer", "head")


@query(f"WITH {_PAIR} SELECT ord, layer, i, j, avg(weight)::FLOAT::DOUBLE AS weight FROM w WHERE layer = 2 GROUP BY ALL")
def attention_layer(spark, sf_dir):
    return _attention(_represent(spark, sf_dir, ("attention_layer",), (2,)), "layer")


@query(f"WITH {_PAIR} SELECT ord, i, j, avg(weight)::FLOAT::DOUBLE AS weight FROM w GROUP BY ALL")
def attention_model(spark, sf_dir):
    return _attention(_represent(spark, sf_dir, ("attention_model",)))


@query(f"""WITH {_PAIR} SELECT CASE WHEN grouping(head) = 0 THEN 'attention_head' WHEN grouping(layer) = 0 THEN 'attention_layer' ELSE 'attention_model' END AS output_type, ord, layer, head, i, j, avg(weight) AS weight
FROM w WHERE layer > 2 GROUP BY GROUPING SETS ((ord, layer, head, i, j), (ord, layer, i, j), (ord, i, j))""")
def attention_rollup(spark, sf_dir):
    return extract.attention_rollup(_represent(spark, sf_dir, ("attention_head",), (3, 4)))


_LOGITS = f"{_ALL}, v AS (SELECT unnest(range(24)) AS token_id)"
_LOGIT = "(((31 * id + 17 * pos + 5 * token_id) % 256) / 256.0::DOUBLE)::DOUBLE"


@query(f"WITH {_LOGITS} SELECT ord, pos::INT AS pos, token_id::INT AS token_id, {_LOGIT} AS logit FROM full_ids, v")
def logits(spark, sf_dir):
    return extract.per_token(matrices(_represent(spark, sf_dir, ("logits",))), ["ord"]).select("ord", "pos", F.col("dim").alias("token_id"), F.col("value").cast("double").alias("logit"))


@query(f"WITH {_LOGITS} SELECT ord, pos::INT AS pos, {_LOGIT} AS logit FROM full_ids, v WHERE token_id = 7")
def logits_vocab_plane(spark, sf_dir):
    return extract.vocabulary_plane(logits(spark, sf_dir), 7)


# --- order, batches, ranges, manifests


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS \"row\" FROM documents")
def row_offsets(spark, sf_dir):
    return sequences.row_offsets(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], F.floor(F.col("doc_id") / 1000))


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // greatest(1, 1024 // 123))::BIGINT AS batch FROM orders")
def token_budget_batches(spark, sf_dir):
    rows = sequences.row_offsets(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], F.floor(F.col("o_orderkey") / 10_000))
    return rows.select("o_orderkey", ranges.batch_id(F.col("row"), 1024, 123).alias("batch"))


_RANGES = "r AS (SELECT l_returnflag AS output_type, (l_suppkey % 7)::INT AS layer, CASE WHEN l_linenumber > 3 THEN l_linenumber END::INT AS head, l_orderkey * 4 AS \"start\", l_orderkey * 4 + l_quantity::BIGINT % 5 + 1 AS \"end\" FROM lineitem)"


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey") * 4
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("output_type"), (F.col("l_suppkey") % 7).cast("int").alias("layer"), F.when(F.col("l_linenumber") > 3, F.col("l_linenumber")).cast("int").alias("head"),
        key.alias("start"), (key + F.col("l_quantity").cast("long") % 5 + 1).alias("end"),
    )


_MERGE = """u AS (SELECT output_type, layer, head, "start", max("end") AS "end" FROM r GROUP BY 1, 2, 3, 4), f AS (SELECT *, CASE WHEN pm IS NULL OR "start" > pm THEN 1 ELSE 0 END AS fresh FROM (SELECT *, max("end") OVER (PARTITION BY output_type, layer, head ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM u)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY output_type, layer, head ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS island FROM f),
m AS (SELECT output_type, layer, head, min("start") AS "start", max("end") AS "end" FROM i GROUP BY output_type, layer, head, island)"""


@query(f"WITH {_RANGES}, {_MERGE} SELECT * FROM m")
def merge_ranges(spark, sf_dir):
    return ranges.merge(_ranges(spark, sf_dir))


@query(f"""WITH {_RANGES}, {_MERGE} SELECT q.* FROM (SELECT output_type, layer, head, "start" + 2 AS "start", "end" + 1 AS "end" FROM r) q
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.output_type = q.output_type AND m.layer = q.layer AND m.head IS NOT DISTINCT FROM q.head AND m."start" <= q."start" AND q."end" <= m."end")""")
def range_covered(spark, sf_dir):
    own = _ranges(spark, sf_dir)
    return ranges.pending(own.withColumn("start", F.col("start") + 2).withColumn("end", F.col("end") + 1), ranges.merge(own))


@query(f"""WITH {_RANGES}, {_MERGE} SELECT output_type, layer, head, count(*) AS n_ranges, sum("end" - "start")::BIGINT AS n_rows, 0 AS is_total FROM m GROUP BY 1, 2, 3
UNION ALL SELECT NULL, NULL, NULL, count(*), sum("end" - "start")::BIGINT, 1 FROM m""")
def resume_summary(spark, sf_dir):
    return ranges.summary(ranges.merge(_ranges(spark, sf_dir)))


_MANIFEST = """WITH n AS (SELECT count(*) AS n, max(length(p_name)) + 2 AS l FROM part), k(output_type, layer, head) AS (
VALUES ('mean_pooled', 2, NULL), ('mean_pooled', 4, NULL), ('per_token', 2, NULL), ('per_token', 4, NULL), ('attention_head', 2, 0), ('attention_head', 2, 1), ('attention_head', 4, 0), ('attention_head', 4, 1), ('attention_model', NULL, NULL)),
b AS (SELECT k.*, 2 * n * CASE output_type WHEN 'mean_pooled' THEN 8 WHEN 'per_token' THEN l * 8 ELSE l * l END AS bytes FROM k, n)"""


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = EmbedSpec("synthetic", output_path="out", experiment_name="run", layers=(2, 4), extract=("mean_pooled", "per_token", "attention_head", "attention_model"), precision="half")
    sizes = _tokenised(spark, sf_dir).agg(F.count("*").alias("n"), F.max(F.size("input_ids")).alias("l")).first()
    return manifest(spark, spec, resolve(spec, ENCODER), ENCODER, sizes["n"], sizes["l"])


@query(f"""{_MANIFEST} SELECT output_type, layer, head, 'out/synthetic/' || output_type || '/run_synthetic_' || output_type || coalesce('_layer_' || layer, '') || coalesce('_head_' || (head + 1), '') || '.npy' AS path, 'float16' AS dtype, bytes::BIGINT AS bytes FROM b""")
def output_manifest(spark, sf_dir):
    return _manifest(spark, sf_dir).drop("shape")


@query(f"{_MANIFEST} SELECT output_type, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM b GROUP BY 1")
def output_bytes(spark, sf_dir):
    return _manifest(spark, sf_dir).groupBy("output_type").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS \"index\", doc_id::VARCHAR AS sequence_id FROM documents")
def sequence_index(spark, sf_dir):
    return from_table(table(spark, sf_dir, "documents"), "doc_id", "text", "doc_id").select(F.col("ord").alias("index"), "sequence_id")


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '<[^\n]*?>|[^\n]', 0)) AS ch FROM documents)
SELECT doc_id, count(DISTINCT ch) AS n_distinct, count(*) AS n_tokens FROM t GROUP BY 1""")
def token_sets(spark, sf_dir):
    tokens = T.split_tokens(F.col("text"))
    filled = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"[^\n]"))  # asked of the text, so that the tokens are split once
    return filled.select("doc_id", F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct"), F.size(tokens).cast("long").alias("n_tokens"))


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean-pooled vectors of whole documents by the fused pass."""
    spec = EmbedSpec("synthetic", extract=("mean_pooled",), layers=(-1,), batch_size=65_536)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("sequence_id"), F.coalesce("text", F.lit("")).alias("sequence"))
    made = represent(rows, ENCODER, resolve(spec, ENCODER), spec, VOCABULARY.pad_id, 0, T.TextCodec(VOCABULARY))
    return made.select("ord", F.posexplode("values").alias("dim", "value")).select("ord", "dim", F.col("value").cast("double").alias("value"))


QUERIES["document_vectors"] = document_vectors
ORACLE_SQL["document_vectors"] = f"""WITH vocab(token, id) AS (VALUES {_VALUES}),
tok AS (SELECT doc_id AS ord, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS ch FROM (SELECT doc_id, regexp_extract_all(text, '<[^\\n]*?>|[^\\n]', 0) AS a FROM documents)),
ids AS (SELECT ord, pos, id FROM tok JOIN vocab ON upper(ch) = token WHERE id > 3),
g AS (SELECT ord, (31 * id + 17 * pos + 52) % 256 AS base, count(*) AS c FROM ids GROUP BY 1, 2),
v AS (SELECT ord, dim, sum(c * ((base + 7 * dim) % 256) / 256.0::DOUBLE) / sum(c) AS m FROM g, range(8) AS t(dim) GROUP BY 1, 2)
SELECT d.doc_id AS ord, dim::INT AS dim, coalesce(m, 'NaN'::DOUBLE)::FLOAT::DOUBLE AS value FROM (SELECT doc_id, t.dim FROM documents, range(8) AS t(dim)) d LEFT JOIN v ON v.ord = d.doc_id AND v.dim = d.dim"""
ORACLE_SQL["document_vectors"] = ORACLE_SQL["document_vectors"].replace("dim::INT AS dim, coalesce", "d.dim::INT AS dim, coalesce")
