"""Registered queries of the text operators. Each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog.llm import (
    decontaminate, extract, language, line_dedup, mixing, odd_sketches, packing, pii, ranked_search, simhash, token_counts,
    topk, turns,
)
from tidelog.llm.common import small_batches, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Register ``fn(*tables) -> DataFrame`` as ``name``."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return fn(*[table(spark, sf_dir, t) for t in tables])

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_packing", "documents")
def op1(documents):
    return packing.pack(documents)


@query("op2_decontamination", "documents", "benchmark")
def op2(documents, benchmark):
    return decontaminate.find(documents, benchmark, least_question=decontaminate.LEAST_QUESTION)


@query("op3_context_mixing", "documents")
def op3(documents):
    return mixing.score(documents)


@query("op4_simhash_dedup", "documents")
def op4(documents):
    return simhash.near_duplicates(documents).drop("fp")


OP5_SQL = """
WITH lines AS (
  SELECT d, i - 1 AS line_no, translate(lower(parts[i]), chr(9) || chr(13) || chr(11) || chr(12), '    ') AS line
  FROM (SELECT d, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id AS d, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
places AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY d, line_no) AS nth FROM lines WHERE trim(line) <> ''),
sets AS (SELECT d, line_no, list_distinct([w FOR w IN string_split(line, ' ') IF w <> '']) AS words FROM places WHERE nth = 1),
flat AS (SELECT d, line_no, len(words) AS n, unnest(words) AS w FROM sets),
df AS (SELECT w, count(*) AS df FROM flat GROUP BY w),
ranked AS (SELECT f.*, row_number() OVER (PARTITION BY d, line_no ORDER BY df, w) AS place FROM flat f JOIN df USING (w)),
prefix AS (SELECT * FROM ranked WHERE place <= n - (4 * n + 4) // 5 + 1),
pairs AS (SELECT DISTINCT a.d AS a_d, a.line_no AS a_line_no, b.d, b.line_no FROM prefix a JOIN prefix b ON a.w = b.w
  AND (a.d < b.d OR (a.d = b.d AND a.line_no < b.line_no)) AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
matched AS (SELECT DISTINCT p.d, p.line_no FROM pairs p JOIN sets a ON a.d = a_d AND a.line_no = a_line_no
  JOIN sets b ON b.d = p.d AND b.line_no = p.line_no
  WHERE 9 * len(list_intersect(a.words, b.words)) >= 4 * (len(a.words) + len(b.words))),
gone AS (SELECT d, line_no FROM places WHERE nth > 1 UNION SELECT d, line_no FROM matched),
by_doc AS (SELECT d, count(*) AS n, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS removed FROM gone GROUP BY d)
SELECT doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS INTEGER) AS n_lines,
  CAST(coalesce(n, 0) AS INTEGER) AS n_removed, coalesce(removed, '') AS removed
FROM documents LEFT JOIN by_doc ON d = doc_id
"""

OP6_SQL = """
WITH rows AS (SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
flat AS (SELECT vec_id, len(v) AS dims, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM rows),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM flat q JOIN flat c ON q.d = c.d AND q.dims = c.dims AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
WHERE rank <= 5
"""


@query("op5_line_dedup", "documents", sql=OP5_SQL)
def op5(documents):
    report = line_dedup.line_report(documents)
    return report.select("doc_id", "n_lines", F.size("removed").alias("n_removed"),
                         F.array_join("removed", ",").alias("removed"))


@query("op6_topk_search", "embeddings", sql=OP6_SQL)
def op6(embeddings):
    return topk.search(embeddings)


@query("op7_pii_pseudonyms", "documents")
def op7(documents):
    """With a fixed key, so that results can be compared; a user's key is a secret."""
    return pii.pseudonyms(documents, b"fixed key of the registered query")


@query("op8_html_extraction", "pages")
def op8(pages):
    return extract.extract(pages)


@query("op9_language_id", "documents")
def op9(documents):
    return language.identify(documents)


@query("op10_token_counts", "documents")
def op10(documents):
    return token_counts.token_counts(documents)


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, [w FOR w IN string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+') IF w <> ''] AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
classes AS (SELECT list_sort(s) AS s, len(s) AS n, min(doc_id) AS id FROM sets WHERE len(s) > 0 GROUP BY 1, 2),
flat AS (SELECT id, n, unnest(s) AS x FROM classes),
common AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM flat a JOIN flat b USING (x)
  WHERE a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM r JOIN edges e ON r.b = e.a)
  SELECT a, min(b) AS low FROM r GROUP BY a),
roots AS (SELECT id, s, least(id, coalesce(low, id)) AS root FROM classes LEFT JOIN reach ON a = id)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id,
  doc_id = coalesce(root, doc_id) AS kept
FROM sets LEFT JOIN roots ON list_sort(sets.s) = roots.s
"""


@query("op11_odd_sketches", "documents", sql=OP11_SQL)
def op11(documents):
    return odd_sketches.near_duplicates(documents)


@query("op12_conversation_repair", "conversations")
def op12(conversations):
    return turns.audited(conversations)


OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT doc_id, w, len(w) AS n FROM words WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS all_terms FROM sizes),
counts AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM sizes) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // all_terms))))) AS BIGINT) AS score
  FROM asked JOIN df USING (term) JOIN counts USING (term), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 50
"""


@query("op13_ranked_search", "documents", "benchmark", sql=OP13_SQL)
def op13(documents, benchmark):
    return ranked_search.search(documents, benchmark)
