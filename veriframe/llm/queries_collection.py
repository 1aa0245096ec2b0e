"""Queries of the operators that work on a whole collection: repeated passages, prefix trie, reversed search. With checking SQL."""

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from veriframe.llm import conversation_trie, reversed_search, suffix_dedup
from veriframe.sources.tables import read_table


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document when repeated 400-byte strings go."""
    found = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = conversation_trie.rebuilt(read_table(spark, sf_dir, "conversations"))
    return conversation_trie.build_trie(turns, convs).drop("name", "parent")


def op13_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversed_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


REPEATS_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents
), chunks AS (
  SELECT row, c, substr(h, 2000 * c + 1, 2798) AS part FROM (SELECT row, h, unnest(range(0, CAST(length(h) // 2000 AS BIGINT) + 1)) AS c FROM docs)
), windows AS (
  SELECT row, 1000 * c + i AS i, md5(substr(part, 2 * i + 1, 800)) AS w
  FROM (SELECT row, c, part, unnest(range(0, least(1000, CAST(length(part) // 2 AS BIGINT) - 399))) AS i FROM chunks)
), twice AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
hits AS (SELECT row, i FROM windows SEMI JOIN twice USING (w)),
marked AS (SELECT row, i, CAST(coalesce(i - lag(i) OVER (PARTITION BY row ORDER BY i) > 400, true) AS INTEGER) AS fresh FROM hits),
numbered AS (SELECT row, i, sum(fresh) OVER (PARTITION BY row ORDER BY i) AS span FROM marked),
spans AS (SELECT row, span, min(i) AS s, max(i) + 400 AS e FROM numbered GROUP BY row, span),
gaps AS (
  SELECT row, s, e, coalesce(lag(e) OVER (PARTITION BY row ORDER BY s), 0) AS before,
    lead(s) OVER (PARTITION BY row ORDER BY s) AS next FROM spans
), kept AS (
  SELECT g.row, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s)
      || max(CASE WHEN next IS NULL THEN substr(h, 2 * e + 1) ELSE '' END) AS k,
    sum(e - s) AS n_removed, count(*) AS n_spans
  FROM gaps g JOIN docs USING (row) GROUP BY g.row
)
SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM docs LEFT JOIN kept USING (row)
"""

TRIE_SQL = """
WITH RECURSIVE plain AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM plain
), crc(conv_id, s, i, v) AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM plain
  UNION ALL
  SELECT conv_id, s, i + 1, xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)
  FROM (SELECT conv_id, s, i, CASE WHEN i % 8 = 0 THEN xor(v, CAST(ascii(substr(s, i // 8 + 1, 1)) AS BIGINT)) ELSE v END AS x
        FROM crc WHERE i < 8 * length(s))
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(v, CAST(4294967295 AS BIGINT)) % 9 AS h FROM crc WHERE i = 8 * length(s)
), joined AS (
  SELECT c.conv_id, 0 AS own, t.p, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.p <= c.h
  UNION ALL SELECT c.conv_id, 1, t.p, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.p > c.h
), said AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY own, p) AS l FROM joined GROUP BY conv_id
), whole AS (
  SELECT conv_id, coalesce(l, []) AS l FROM convs LEFT JOIN said USING (conv_id)
), prefixes AS (
  SELECT conv_id, d, md5(CAST(to_json(l[1:d]) AS VARCHAR)) AS node,
    CASE WHEN d > 0 THEN md5(CAST(to_json(l[1:d - 1]) AS VARCHAR)) END AS parent,
    CASE WHEN d > 0 THEN strlen(l[d].text) ELSE 0 END AS bytes, d = len(l) AS ends
  FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM whole)
), nodes AS (
  SELECT node, parent, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends) AS ids
  FROM prefixes GROUP BY node, parent, d
), children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
sums AS (
  SELECT p.node, count(*) FILTER (WHERE c.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved
  FROM nodes n LEFT JOIN children c USING (node) JOIN prefixes p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY p.node
)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN children USING (node) LEFT JOIN nodes up ON n.parent = up.node
"""

SEARCH_SQL = r"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
cut AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents, letters
), words AS (SELECT row, unnest(t) AS term FROM cut),
totals AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM cut),
sizes AS (SELECT row, doc_id, 100 - 75 + (CAST(75 * len(t) * n AS BIGINT) // l) AS m FROM cut, totals WHERE l > 0),
counts AS (SELECT row, term, count(*) AS tf FROM words GROUP BY row, term),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), up, low),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark, letters
  ) GROUP BY item_id, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts WHERE term IN (SELECT term FROM asked) GROUP BY term), totals
), scored AS (
  SELECT item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (row) GROUP BY item_id, row, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""
