"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Every document is scanned for base kinds (assign, access, hex) and for broad candidates (long tokens of letters and
digits). The values of all candidates are hashed and counted over the corpus by distinct owners and repositories. A value
that many owners have is a copied example; a value of one owner that looks live is owner-specific, and a broad candidate
of that sort becomes a span of kind "owned".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm._common import durable, text_or_empty

#: Kinds in listed order, with pattern, the group that holds the value, and its least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {
    "assign": (ASSIGN, 2, 8),
    # Runs of a class: asking for the least length in the pattern gives the same spans as dropping short runs.
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
KINDS = [*BASE, "owned"]
BROAD = r"[A-Za-z0-9+/_=-]{20,}"
#: Matches that are placed in one step; a text's spans are joined from such steps, so that the work stays near linear.
_STEP = 256


def _literal(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(kind: int, pattern: str, group: int, least: int) -> str:
    """SQL for an array of struct<s, kind, e, value> (start and end) of a pattern's leftmost non-overlapping matches in t: the parts between matches and the matches add up to their places, in code points."""
    p = _literal(pattern)
    # m: a whole match, v: its value, p: the part between it and the match before
    found = f"zip_with(regexp_extract_all(t, {p}, 0), regexp_extract_all(t, {p}, {group}), (m, v) -> struct(m AS m, v AS v))"
    triples = f"filter(zip_with({found}, split(t, {p}, -1), (f, p) -> struct(f.m AS m, f.v AS v, p AS p)), x -> x.m IS NOT NULL)"
    none = "cast(array() AS array<struct<s:int,kind:int,e:int,value:string>>)"
    place = f"(a, x) -> struct(a.at + length(x.p) + length(x.m) AS at, concat(a.out, array(struct(a.at + length(x.p) AS s, {kind} AS kind, a.at + length(x.p) + length(x.m) AS e, x.v AS value))) AS out)"
    step = f"aggregate(slice(z, i * {_STEP} + 1, {_STEP}), struct(acc.at AS at, {none} AS out), {place})"
    whole = f"aggregate(sequence(0, (size(z) - 1) div {_STEP}), struct(0 AS at, {none} AS out), (acc, i) -> transform(array({step}), s -> struct(s.at AS at, concat(acc.out, s.out) AS out))[0], acc -> acc.out)"
    placed = f"transform(array({triples}), z -> {whole})[0]"
    return f"CASE WHEN t RLIKE {p} THEN filter({placed}, z -> length(z.value) >= {least}) ELSE {none} END"


def _text(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, z -> concat_ws(':', element_at(array({names}), z.kind + 1), z.s, z.e)), ',')"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), copied_owners: int = 3, copied_repositories: int = 4, own_repositories: int = 2, least_signs: int = 10) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_copied, n_specific, most_owners, most_repositories.

    Spans are kind:start:end in code points, end exclusive, by start and then kind; base_sha256 is over the base spans
    alone. A value is copied if at least `copied_owners` owners or `copied_repositories` repositories have it, and specific
    if one owner has it, in `own_repositories` repositories at most, and it looks live (at least `least_signs` different
    characters). n_copied and n_specific count the base spans with such values; n_owned counts the added spans: broad
    candidates that are specific and overlap no base span. most_owners and most_repositories are the largest numbers of
    owners and of repositories that a candidate's value has, 0 without candidates.

    Nulls: a null text is empty; a null owner or repository part counts as the empty name; a row with a null id is
    scanned like others. Texts of any length are scanned whole. Repeated rows give repeated rows and count as one owner.
    Other columns are not read, whatever their names. An empty table gives no rows.
    """
    named = lambda *c: F.concat_ws("/", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c])
    df = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"), named(owner).alias("owner"), named(*repository).alias("repository"))
    for k, (kind, spec) in enumerate(BASE.items()):
        df = df.withColumn(kind, F.expr(_spans(k, *spec)))
    df = df.withColumn("base", F.array_sort(F.concat(*BASE))).withColumn("wide", F.expr(_spans(3, BROAD, 0, 20)))
    free = "NOT exists(base, b -> b.s < z.e AND z.s < b.e)"
    df = df.withColumn("wide", F.expr(f"filter(wide, z -> z.value RLIKE '[0-9]' AND z.value RLIKE '[A-Za-z]' AND z.value RLIKE '[^0-9a-f]' AND {free})"))
    hashed = "transform(concat(base, wide), z -> struct(z.s AS s, z.kind AS kind, z.e AS e, xxhash64(z.value) AS h1, xxhash64(1, z.value) AS h2, size(array_distinct(split(z.value, ''))) AS signs))"
    seen = durable(
        df.select(
            "doc_id", F.xxhash64("t").alias("t_hash"), "owner", "repository", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
            F.sha2(F.expr(_text("base")), 256).alias("base_sha256"), F.expr(hashed).alias("found"),
        )
    )
    each = seen.select("doc_id", "t_hash", "owner", "repository", F.inline("found"))
    # Aggregated level by level, so a value that a third of all rows hold is a few rows before any shuffle.
    value = ["h1", "h2"]
    owners = each.groupBy(*value, "owner", "repository").agg(F.count("*").alias("n")).groupBy(*value, "owner").agg(F.count("*").alias("repositories"))
    owners = owners.groupBy(*value).agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"))
    known = each.join(durable(owners), value)  # a table of its own: AQE can split the join's hot values
    live = (F.col("n_owners") == 1) & (F.col("n_repositories") <= own_repositories) & (F.col("signs") >= least_signs)
    copied = (F.col("n_owners") >= copied_owners) | (F.col("n_repositories") >= copied_repositories)
    base = F.col("kind") < 3
    span = F.struct("s", "kind", "e")
    of = known.groupBy("doc_id", "t_hash").agg(
        F.collect_set(F.when(~base & live, span)).alias("added"),
        F.collect_set(F.when(base & copied, span)).alias("copied"),
        F.collect_set(F.when(base & live, span)).alias("specific"),
        *[F.max(f"n_{n}").alias(f"most_{n}") for n in ("owners", "repositories")],
    )
    of = of.select(F.col("doc_id").alias("of_id"), F.col("t_hash").alias("of_hash"), "added", "copied", "specific", "most_owners", "most_repositories")
    out = seen.join(of, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("t_hash") == F.col("of_hash")), "left")
    none = F.expr("cast(array() AS array<struct<s:int,kind:int,e:int>>)")
    kept = "transform(filter(found, z -> z.kind < 3), z -> struct(z.s AS s, z.kind AS kind, z.e AS e))"
    out = out.withColumn("all", F.array_sort(F.concat(F.expr(kept), F.coalesce("added", none))))
    count = lambda c: F.coalesce(F.size(c).cast("long"), F.lit(0)).alias
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.expr(_text("`all`")).alias("spans"), *[F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias(f"n_{n}") for c, n in (("added", "owned"), ("copied", "copied"), ("specific", "specific"))], *[F.coalesce(f"most_{n}", F.lit(0).cast("long")).alias(f"most_{n}") for n in ("owners", "repositories")])


def _oracle() -> str:
    def spans(kind: int, pattern: str, group: int, least: int) -> str:
        p = "'" + pattern.replace("'", "''") + "'"
        m, parts = f"regexp_extract_all(t, {p}, 0)", f"string_split_regex(t, {p})"
        before = f"coalesce(list_sum(list_transform({parts}[1:i], lambda q: length(q))), 0) + coalesce(list_sum(list_transform({m}[1:i-1], lambda q: length(q))), 0)"
        return f"list_filter(list_transform({m}, lambda x, i: {{'s': ({before})::BIGINT, 'k': {kind}, 'e': ({before} + length(x))::BIGINT, 'v': regexp_extract_all(t, {p}, {group})[i]}}), lambda s: length(s.v) >= {least})"

    kinds = "['assign', 'access', 'hex', 'owned']"
    text = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda s: {kinds}[s.k + 1] || ':' || s.s || ':' || s.e), ','), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repository FROM documents),
b AS (SELECT *, {", ".join(f"{spans(k, *x)} AS {n}" for k, (n, x) in enumerate(BASE.items()))}, {spans(3, BROAD, 0, 20)} AS w FROM d),
c AS (SELECT *, list_sort(list_concat(assign, access, hex)) AS base FROM b),
f AS (SELECT *, list_filter(w, lambda s: regexp_matches(s.v, '[0-9]') AND regexp_matches(s.v, '[A-Za-z]') AND regexp_matches(s.v, '[^0-9a-f]') AND len(list_filter(base, lambda q: q.s < s.e AND s.s < q.e)) = 0) AS wide FROM c),
e AS (SELECT doc_id, owner, repository, unnest(list_concat(base, wide)) AS s FROM f),
o AS (SELECT s.v AS v, count(DISTINCT owner) AS n, count(DISTINCT (owner, repository)) AS m FROM e GROUP BY 1),
k AS (SELECT e.doc_id, e.s, o.n, o.m, n = 1 AND m <= 2 AND len(list_distinct(string_split(e.s.v, ''))) >= 10 AS live FROM e JOIN o ON e.s.v = o.v),
g AS (SELECT doc_id, list(s) FILTER (WHERE s.k = 3 AND live) AS added, max(n) AS n, max(m) AS m,
  count(*) FILTER (WHERE s.k < 3 AND (n >= 3 OR m >= 4)) AS copied, count(*) FILTER (WHERE s.k < 3 AND live) AS spec FROM k GROUP BY 1)
SELECT f.doc_id, len(assign)::BIGINT AS n_assign, len(access)::BIGINT AS n_access, len(hex)::BIGINT AS n_hex, sha256({text("base")}) AS base_sha256,
  {text("list_sort(list_concat(base, coalesce(added, [])))")} AS spans, coalesce(len(added), 0)::BIGINT AS n_owned, coalesce(copied, 0)::BIGINT AS n_copied, coalesce(spec, 0)::BIGINT AS n_specific, coalesce(n, 0)::BIGINT AS most_owners, coalesce(m, 0)::BIGINT AS most_repositories
FROM f LEFT JOIN g ON f.doc_id = g.doc_id"""


ORACLE_SQL = _oracle()
