"""Registered queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    divergence,
    fingerprints,
    line_dedup,
    minmax,
    mixing,
    packing,
    passages,
    simhash,
    tool_calls,
    topk,
    toxicity,
    vector_codes,
)
from tidemark.llm.common import stored, table, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_fingerprints(spark, sf_dir):
    """Phrase fingerprints of all documents and their edited texts."""
    return fingerprints.fingerprint_chain(table(spark, sf_dir, "documents"))


@query
def op2_top_k(spark, sf_dir):
    """The 10 best inner products of every hundredth vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


# An integer vector per row, and the inner products of each query with all other rows.
ORACLES["op2_top_k"] = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""


@query
def op3_packed_matrices(spark, sf_dir):
    """Best-fit-decreasing packing of all documents into rows of 2048 ids."""
    return packing.packed_matrices(table(spark, sf_dir, "documents"), vocabulary(), end_id=1)


@query
def op4_simhash(spark, sf_dir):
    """Near-duplicate groups of all documents by their SimHash fingerprints."""
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query
def op5_toxicity(spark, sf_dir):
    """Toxicity scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_texts(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op6_tool_calls(spark, sf_dir):
    """Questions and answers of all conversations as linked, ordered and checked tool calls."""
    calls, results = tool_calls.turns_as_calls(table(spark, sf_dir, "conversations"))
    out = tool_calls.link(calls, results, tool_calls.TURN_TOOLS, repeats=True)
    return out.select(
        F.col("conv").alias("conv_id"), "turn", "call_id", "name", "status", "wave", "valid", "n_calls", "n_results", "record"
    )


ORACLES["op6_tool_calls"] = """
WITH u AS (
  SELECT c.conv_id, c.turn, c.text, EXISTS (
           SELECT 1 FROM conversations b WHERE b.role = 'user' AND b.conv_id = c.conv_id AND b.turn = c.turn - 2
         ) AS follows
  FROM conversations c WHERE c.role = 'user'
), a AS (
  SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'
), j AS (
  SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.turn, a.turn) AS turn,
         coalesce(u.conv_id, a.conv_id) || ':' || coalesce(u.turn, a.turn - 1) AS call_id,
         CASE WHEN u.turn IS NULL THEN NULL WHEN follows THEN 'follow_up' ELSE 'ask' END AS name,
         CASE WHEN u.turn IS NULL THEN 'no_call' WHEN a.turn IS NULL THEN 'no_result' ELSE 'linked' END AS status,
         u.turn AS ask, u.text AS query, follows, a.turn AS answer, a.text AS content
  FROM u FULL JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
)
SELECT conv_id, turn, call_id, name, status,
       CASE WHEN ask IS NULL THEN NULL ELSE CAST(0 AS BIGINT) END AS wave,
       ask IS NOT NULL AND length(coalesce(query, '')) > 0 AND ask >= 0 AS valid,
       CAST(ask IS NOT NULL AS BIGINT) AS n_calls, CAST(answer IS NOT NULL AS BIGINT) AS n_results,
       '{"arguments":' || CASE WHEN ask IS NULL THEN 'null' ELSE
         '{' || CASE WHEN follows THEN '"previous":"' || conv_id || ':' || (ask - 2) || '",' ELSE '' END ||
         CASE WHEN query IS NULL THEN '' ELSE '"query":' || CAST(to_json(query) AS VARCHAR) || ',' END ||
         '"turn":' || ask || '}' END ||
       ',"id":"' || call_id || '","name":' || coalesce('"' || name || '"', 'null') ||
       ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS record
FROM j
"""


@query
def op7_passages(spark, sf_dir):
    """Passages of all documents that stand in an earlier one as well."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op8_line_windows(spark, sf_dir):
    """All documents without the lines of repeated three-line windows."""
    cleaned = line_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id",
        F.col("ld_lines").cast("long").alias("n_lines"),
        F.col("ld_removed").cast("long").alias("n_removed"),
        "text",
    )


ORACLES["op8_line_windows"] = """
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), n AS (
  SELECT doc_id, text, l, unnest(range(len(l))) AS i FROM d
), w AS (
  SELECT doc_id, i, l[i + 1] AS x, l[i + 2] AS y, l[i + 3] AS z
  FROM n
  WHERE i + 3 <= len(l) AND (trim(l[i + 1]) <> '' OR trim(l[i + 2]) <> '' OR trim(l[i + 3]) <> '')
), r AS (
  SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, i) > 1
), c AS (
  SELECT DISTINCT doc_id, i + o AS i FROM r, (SELECT unnest([0, 1, 2]) AS o)
), k AS (
  SELECT n.doc_id, string_agg(n.l[n.i + 1], chr(10) ORDER BY n.i) AS text, count(*) AS kept
  FROM n ANTI JOIN c ON n.doc_id = c.doc_id AND n.i = c.i
  GROUP BY n.doc_id
)
SELECT d.doc_id, coalesce(len(d.l), 0) AS n_lines,
       CASE WHEN d.text IS NULL THEN 0 ELSE len(d.l) - coalesce(k.kept, 0) END AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM d LEFT JOIN k USING (doc_id)
"""


@query
def op9_source_mix(spark, sf_dir):
    """Words taken of every document by the mix of sources."""
    docs = table(spark, sf_dir, "documents")
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return mixing.mix(sizes, "size").select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_cost_packing(spark, sf_dir):
    """Pieces of all documents in cost-balanced sequences of 2048 tokens."""
    return packing.cost_balanced_pieces(table(spark, sf_dir, "documents"), vocabulary(), end_id=1)


@query
def op11_minmax(spark, sf_dir):
    """Near-duplicate groups of all documents by sets of 4-word shingles, from min-max signatures."""
    return minmax.near_groups(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Shingles of all texts, sizes of all intersections, links, and the least key over any path.
ORACLES["op11_minmax"] = rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, list_distinct([array_to_string(w[i : least(i + 3, len(w))], ' ') FOR i IN range(1, greatest(len(w) - 2, 2))]) AS s
  FROM w WHERE len(w) > 0
), k AS MATERIALIZED (
  SELECT s, min(doc_id) AS least FROM (SELECT doc_id, list_sort(s) AS s FROM s) GROUP BY s
), e AS MATERIALIZED (
  SELECT least, len(s) AS n, unnest(s) AS x FROM k
), c AS MATERIALIZED (
  SELECT a.least AS a, b.least AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS met
  FROM e a JOIN e b ON a.x = b.x AND a.least < b.least
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.least, b.least
), l AS MATERIALIZED (
  SELECT a, b FROM c WHERE 100 * met >= 80 * (na + nb - met)
), g AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT least AS a, least AS b FROM k
  UNION
  SELECT r.a, g.b FROM r JOIN g ON g.a = r.b
), o AS (
  SELECT a, min(b) AS root FROM r GROUP BY a
)
SELECT w.doc_id, CAST(coalesce(len(s.s), 0) AS BIGINT) AS n_shingles, coalesce(o.root, w.doc_id) AS component_id,
       coalesce(o.root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN k ON k.s = list_sort(s.s) LEFT JOIN o ON o.a = k.least
"""


@query
def op12_vector_codes(spark, sf_dir):
    """Codes of all vectors by codebooks that four Lloyd rounds improve."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def _lloyd_sql(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """All distances of every round; exact in doubles while squared distances times 256 stay below 2^53."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT p.id, p.part, arg_min(b.entry, (b.norm - 2 * list_inner_product(p.f, b.f)) * {entries} + b.entry) AS entry
  FROM p JOIN b{r} b ON b.part = p.part GROUP BY p.id, p.part
)""")
        if r < rounds:
            steps.append(f"""
x{r} AS (
  SELECT a.part, a.entry, unnest(p.e) AS x, unnest(range(len(p.e))) AS pos FROM a{r} a JOIN p ON p.id = a.id AND p.part = a.part
), m{r} AS (
  SELECT part, entry, pos, (s - ((s % c) + c) % c) // c AS x
  FROM (SELECT part, entry, pos, sum(x) AS s, count(*)::HUGEINT AS c FROM x{r} GROUP BY part, entry, pos)
), n{r} AS (
  SELECT part, entry, list(x::BIGINT ORDER BY pos) AS e FROM m{r} GROUP BY part, entry
), b{r + 1} AS MATERIALIZED (
  SELECT part, entry, e, e::DOUBLE[] AS f, list_inner_product(e::DOUBLE[], e::DOUBLE[]) AS norm
  FROM (SELECT b.part, b.entry, coalesce(n.e, b.e) AS e FROM b{r} b LEFT JOIN n{r} n ON n.part = b.part AND n.entry = b.entry)
)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label,
         [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), p AS MATERIALIZED (
  SELECT id, part, e, e::DOUBLE[] AS f
  FROM (
    SELECT id, part, e[part * (len(e) // {parts}) + 1 : (part + 1) * (len(e) // {parts})] AS e
    FROM v, (SELECT unnest(range({parts})) AS part)
  )
), b0 AS MATERIALIZED (
  SELECT part, id - 1 AS entry, e, f, list_inner_product(f, f) AS norm FROM p WHERE id <= {entries}
), {",".join(steps).strip()}, d AS (
  SELECT a.id, string_agg(printf('%02x', a.entry), '' ORDER BY a.part) AS code,
         CAST(sum(b.norm - 2 * list_inner_product(p.f, b.f) + list_inner_product(p.f, p.f)) AS BIGINT) AS error
  FROM a{rounds} a JOIN p ON p.id = a.id AND p.part = a.part JOIN b{rounds} b ON b.part = a.part AND b.entry = a.entry
  GROUP BY a.id
), c AS (
  SELECT part, entry, unnest(e) AS x, unnest(range(len(e))) AS pos FROM b{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c) AS codebooks_sha256
FROM v JOIN d USING (id)
"""


ORACLES["op12_vector_codes"] = _lloyd_sql()


@query
def op13_source_divergence(spark, sf_dir):
    """How the sources of each language differ, from one another and from the language, over all documents."""
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op13_source_divergence"] = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), o AS MATERIALIZED (
  SELECT id, lang, source, unnest(t) AS term FROM d
), w AS MATERIALIZED (
  SELECT lang, term, count(*)::HUGEINT AS n FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), a AS MATERIALIZED (
  SELECT lang, sum(n)::HUGEINT AS n, count(*)::HUGEINT AS v FROM w GROUP BY lang
), c AS MATERIALIZED (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM o JOIN w USING (lang, term) GROUP BY lang, source, term
), g AS MATERIALIZED (
  SELECT DISTINCT lang, source FROM d
), p AS MATERIALIZED (
  SELECT g.lang, g.source, w.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (coalesce(sum(c.n) OVER (PARTITION BY g.lang, g.source), 0)::HUGEINT + a.v) AS p,
         1 + (1000000000 * (w.n + 1)) // (a.n + a.v) AS q
  FROM g JOIN w USING (lang) JOIN a USING (lang) LEFT JOIN c USING (lang, source, term)
), r AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item,
         coalesce((
           SELECT sum((s.p - u.p) * (s.p - u.p) // u.p) FROM p s JOIN p u USING (lang, term)
           WHERE s.lang = x.lang AND s.source = x.source AND u.source = y.source
         ), 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
), k AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
         CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
  FROM r
)
SELECT * FROM k WHERE part = 'pair' OR rank <= 200
"""
