"""The registered queries of this subpackage: QUERIES by name, and ORACLE_SQL (DuckDB) where SQL can express them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from residua.llm import decontamination, line_dedup, mixing, phrases, quality, secrets, sentence_spans, sharding, simhash, toxicity
from residua.llm._common import table

ORACLE_SQL: dict[str, str] = {}

#: Production parameters of op8 and the pipeline's last stage.
SHARDS = [f"shard-{k:03d}" for k in range(96)]
#: Production parameters of op10 and the pipeline's mixing stage: sources outside the list have weight 1.
WEIGHTS = {"src0": 8.0, "src1": 4.0, "src2": 2.0, "src3": 0.5, "src4": 0.25}


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, with corpus-wide ownership of their values."""
    return secrets.scan(table(spark, sf_dir, "documents"))


ORACLE_SQL["op1_secret_scans"] = secrets.ORACLE_SQL


def _span_texts(name: str) -> str:
    return f"array_join(transform(__spans, s -> concat_ws(':', s.start, s.end)), ',') AS {name}"


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without sentences of repeated spans; removed_spans are code points start:end of the old text."""
    found = sentence_spans.dedup(table(spark, sf_dir, "documents"), whole=True)
    return found.selectExpr("doc_id", "text", "__parts AS n_sentences", "__removed AS n_removed", _span_texts("removed_spans"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of 64 bits over 3-word shingles, links at 2 bits, one row per document."""
    return simhash.near_groups(table(spark, sf_dir, "documents"), words=3, radius=2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by subword-bag embeddings."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it has a copy of, with the alignment's score."""
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by co-trained text and metadata views."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, with their likeness."""
    return phrases.edited_and_next(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return sharding.place(table(spark, sf_dir, "documents"), SHARDS).select("doc_id", "slot", "shard")


ORACLE_SQL["op8_sharding"] = f"""
WITH filled AS (SELECT string_split('{",".join(map(str, sharding.lookup_table(SHARDS)))}', ',') AS numbers),
placed AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null:' || coalesce(text, ''))), 1, 15))::BIGINT % {sharding.SLOTS} AS slot FROM documents)
SELECT doc_id, slot::INT AS slot, printf('shard-%03d', numbers[slot + 1]::INT) AS shard FROM placed, filled"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeated runs of lines; removed_spans are code points start:end of the old text."""
    found = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "text", "__parts AS n_lines", "__removed AS n_removed", _span_texts("removed_spans"))


_FOLD = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DOCUMENTS = "SELECT DISTINCT doc_id, text, ('0x' || substr(md5(text), 1, 15))::BIGINT AS h FROM documents WHERE text IS NOT NULL"


def _without(parts: str, gone: str, name: str) -> str:
    """SQL for documents without the parts that `gone` (doc_id, h, idx) names; parts: rows (doc_id, h, text, idx, start, stop)."""
    return f"""
e AS (SELECT d.*, g.idx IS NOT NULL AS gone FROM {parts} d LEFT JOIN {gone} g ON g.doc_id = d.doc_id AND g.h = d.h AND g.idx = d.idx),
s AS (SELECT doc_id, h, min(start) AS a, max(stop) AS b FROM (SELECT *, idx - row_number() OVER (PARTITION BY doc_id, h ORDER BY idx) AS island FROM e WHERE gone) GROUP BY doc_id, h, island),
t AS (SELECT doc_id, h, string_agg(a || ':' || b, ',' ORDER BY a) AS removed_spans FROM s GROUP BY 1, 2),
f AS (SELECT doc_id, h, count(*) AS n, count(*) FILTER (WHERE gone) AS m, min(start) AS first, string_agg(substr(text, start + 1, stop - start), '' ORDER BY idx) FILTER (WHERE NOT gone) AS kept FROM e GROUP BY 1, 2)
SELECT o.doc_id, CASE WHEN coalesce(m, 0) = 0 THEN o.text ELSE substr(o.text, 1, first) || coalesce(kept, '') END AS text, coalesce(n, 0)::INT AS {name}, coalesce(m, 0)::INT AS n_removed, coalesce(removed_spans, '') AS removed_spans
FROM (SELECT doc_id, text, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents) o
LEFT JOIN f ON f.doc_id IS NOT DISTINCT FROM o.doc_id AND f.h = o.h LEFT JOIN t ON t.doc_id IS NOT DISTINCT FROM o.doc_id AND t.h = o.h"""


_WIDE, _CLOSERS = sentence_spans.WIDE_STOPS, re.escape(sentence_spans.CLOSERS).replace("'", "''")
_SPACED = r"[^\x20\x09-\x0D" + _WIDE
_WORD = f"{_SPACED}]*[{_WIDE}][{_WIDE}{_CLOSERS}]*|{_SPACED}]+"

# All sentences by their words; the shortest run from and to each; a run's later occurrences take its sentences away.
ORACLE_SQL["op2_substring_dedup"] = rf"""
WITH docs AS ({_DOCUMENTS}),
a AS (SELECT doc_id, h, text, unnest(regexp_extract_all(text, '{_WORD}')) AS w, unnest(list_resize(string_split_regex(text, '{_WORD}'), len(regexp_extract_all(text, '{_WORD}')))) AS gap, unnest(range(len(regexp_extract_all(text, '{_WORD}')))) AS i FROM docs),
b AS (SELECT *, (sum(length(gap) + length(w)) OVER p - length(w))::BIGINT AS start, lead(gap) OVER p AS behind, {_FOLD.format(x="w")} AS low, regexp_matches(w, '[.!?…{_WIDE}][{_CLOSERS}]*$') AS stops FROM a WINDOW p AS (PARTITION BY doc_id, h ORDER BY i)),
c AS (SELECT *, behind IS NULL OR stops OR contains(behind, chr(10)) OR (NOT bool_or(stops) OVER (PARTITION BY doc_id, h) AND (('0x' || substr(hex(low), 1, 2))::INT + strlen(low)) % {sentence_spans.CUT} = 0) AS ends FROM b),
d AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id, h ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS idx FROM c),
q AS (SELECT doc_id, h, text, idx, min(start) AS start, count(*) AS n, greatest(1, count(*) // {sentence_spans.WORDS}) AS u, string_agg(low, ' ' ORDER BY i) AS norm FROM d GROUP BY 1, 2, 3, 4),
v AS (SELECT *, coalesce(lead(start) OVER p, length(text)) AS stop, sum(n) OVER p AS cn, sum(u) OVER p AS cu FROM q WINDOW p AS (PARTITION BY doc_id, h ORDER BY idx)),
pairs AS (SELECT x.doc_id, x.h, x.idx AS a, y.idx AS b FROM v x JOIN v y ON x.doc_id = y.doc_id AND x.h = y.h AND y.idx BETWEEN x.idx AND x.idx + {sentence_spans.WORDS} WHERE y.cn - x.cn + x.n >= {sentence_spans.WORDS} AND y.cu - x.cu + x.u >= {sentence_spans.SENTENCES}),
spans AS (SELECT doc_id, h, a, min(b) AS b FROM pairs GROUP BY 1, 2, 3 UNION SELECT doc_id, h, max(a) AS a, b FROM pairs GROUP BY doc_id, h, b),
r AS (SELECT s.doc_id, s.h, s.a, s.b, string_agg(v.norm, ' ' ORDER BY v.idx) AS norm FROM spans s JOIN v ON v.doc_id = s.doc_id AND v.h = s.h AND v.idx BETWEEN s.a AND s.b GROUP BY 1, 2, 3, 4),
first AS (SELECT norm, min((doc_id, h, a)) AS place FROM r GROUP BY 1),
g AS (SELECT DISTINCT doc_id, h, unnest(range(a, b + 1)) AS idx FROM r JOIN first USING (norm) WHERE (doc_id, h, a) > place),{_without("v", "g", "n_sentences")}"""

ORACLE_SQL["op9_line_dedup"] = rf"""
WITH docs AS ({_DOCUMENTS}),
a AS (SELECT doc_id, h, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM docs),
b AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id, h ORDER BY k) - length(line) - 1 AS off, length(line) - length(regexp_replace(line, '^[\x09-\x0D\x20]+', '')) AS blank,
  array_to_string(list_filter(string_split_regex({_FOLD.format(x="line")}, '[\x09-\x0D\x20]+'), lambda w: w <> ''), ' ') AS norm FROM a),
c AS (SELECT doc_id, h, text, norm, (off + blank)::BIGINT AS start, row_number() OVER (PARTITION BY doc_id, h ORDER BY k) - 1 AS idx FROM b WHERE norm <> ''),
d AS (SELECT *, coalesce(lead(start) OVER w, length(text)) AS stop FROM c WINDOW w AS (PARTITION BY doc_id, h ORDER BY idx)),
u AS (SELECT doc_id, h, idx, norm || ' #' || place AS unit, place FROM (SELECT *, unnest(range(greatest(1, len(string_split(norm, ' ')) // {line_dedup.WORDS}))) AS place FROM d)),
v AS (SELECT *, lead(unit, 1) OVER w AS unit1, lead(unit, 2) OVER w AS unit2, lead(idx, 2) OVER w AS last FROM u WINDOW w AS (PARTITION BY doc_id, h ORDER BY idx, place)),
r AS (SELECT doc_id, h, idx, last, row_number() OVER (PARTITION BY unit, unit1, unit2 ORDER BY doc_id, h, idx, place) AS nth FROM v WHERE unit2 IS NOT NULL AND doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, h, unnest(range(idx, last + 1)) AS idx FROM r WHERE nth > 1),{_without("d", "g", "n_lines")}"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document by Poisson counts at its source's rate, in shuffled order; each copy with a digest of its text."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS)
    return mixed.selectExpr("doc_id", "source", "copy", "md5(coalesce(text, '')) AS text_md5")


ORACLE_SQL["op10_mixing"] = f"""
WITH w AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in WEIGHTS.items())}) AS t(source, weight)),
n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT n.source, coalesce(weight, 1.0) / sum(coalesce(weight, 1.0)) OVER () * sum(n) OVER () / n AS whole FROM n LEFT JOIN w USING (source)),
q AS (SELECT source, ceil(whole / {mixing.MOST_RATE})::BIGINT AS parts, whole / ceil(whole / {mixing.MOST_RATE}) AS rate FROM r),
s AS (SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM q, range(0, (SELECT ceil(max(rate) + 9 * sqrt(max(rate)) + 30)::BIGINT FROM q)) AS x(k)),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS below FROM s),
e AS (SELECT doc_id, documents.source, text, unnest(range(parts)) AS part FROM documents JOIN q ON documents.source IS NOT DISTINCT FROM q.source),
d AS (SELECT doc_id, source, part, md5(coalesce(text, '')) AS text_md5, (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null:' || coalesce(text, '')) || CASE WHEN part = 0 THEN '' ELSE '#' || part END), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM e),
t AS (SELECT d.doc_id, d.source, d.part, d.text_md5, d.u, count(c.k) FILTER (WHERE c.below < d.u) AS times FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source GROUP BY ALL)
SELECT doc_id, source, part * {mixing.PART} + unnest(range(0, times)) AS copy, text_md5 FROM t"""


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_sharding": op8_sharding,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
}
