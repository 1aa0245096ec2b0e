"""Queries over fingerprints made from embeddings, with planted copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe import config
from veriframe.functions.hashes import hash_to_hex, pack_bits
from veriframe.operators import dedup
from veriframe.plans.registry import query
from veriframe.sources.tables import read_table

BASE_CTE = """base AS (
  SELECT vec_id, CAST(CAST(array_to_string(list_transform(range(64), lambda i:
      CASE WHEN embedding[i + 1] < embedding[(i + 1) % 64 + 1] THEN '1' ELSE '0' END), '') AS BIT) AS BIGINT) AS hash
  FROM embeddings)"""
HASH_CTES = f"WITH RECURSIVE {BASE_CTE}," + """
items AS (
  SELECT vec_id * 4 + copy AS ord, CAST(vec_id * 4 + copy AS STRING) AS item_id, vec_id % 20 AS entity_id,
    CASE copy WHEN 1 THEN xor(hash, (1::BIGINT << CAST(vec_id % 13 AS INT)) - 1)
      WHEN 2 THEN xor(hash, ((1::BIGINT << CAST(vec_id * 5 % 9 AS INT)) - 1) * 1048576) ELSE hash END AS hash,
    CASE WHEN (vec_id * 4 + copy) % 17 = 0 THEN concat('shared', CAST(vec_id % 3 AS STRING))
      ELSE concat('u', CAST(vec_id * 4 + copy AS STRING)) END AS canonical_url,
    CAST((vec_id * 31 + copy * 17) % 100 AS DOUBLE) AS strength,
    concat('page', CAST((vec_id * 4 + copy) % 300 AS STRING)) AS page
  FROM base, (SELECT unnest([0, 1, 2, 3]) AS copy)),
classes AS (SELECT DISTINCT entity_id, hash FROM items),
pairs AS (
  SELECT a.entity_id, a.hash AS hash_a, b.hash AS hash_b, CAST(bit_count(xor(a.hash, b.hash)) AS BIGINT) AS distance
  FROM classes a JOIN classes b ON a.entity_id = b.entity_id AND a.hash < b.hash AND bit_count(xor(a.hash, b.hash)) <= 6)
"""

GREEDY_CTES = HASH_CTES + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY strength DESC, ord) AS rn FROM items),
greedy AS (
  SELECT entity_id, 1::BIGINT AS rn, [struct_pack(id := item_id, h := hash, u := canonical_url)] AS kept,
    item_id, NULL::VARCHAR AS twin_id
  FROM ranked WHERE rn = 1
  UNION ALL
  SELECT g.entity_id, r.rn,
    CASE WHEN len(list_filter(g.kept, lambda k: k.u = r.canonical_url OR bit_count(xor(k.h, r.hash)) <= 6)) = 0
      THEN list_append(g.kept, struct_pack(id := r.item_id, h := r.hash, u := r.canonical_url)) ELSE g.kept END,
    r.item_id,
    list_filter(g.kept, lambda k: k.u = r.canonical_url OR bit_count(xor(k.h, r.hash)) <= 6)[1].id
  FROM greedy g JOIN ranked r ON r.entity_id = g.entity_id AND r.rn = g.rn + 1),
verdicts AS (
  SELECT entity_id, item_id, CASE WHEN twin_id IS NULL THEN 'keep' ELSE 'drop' END AS verdict, twin_id FROM greedy)
"""


def fingerprints(spark, sf_dir) -> DataFrame:
    """Wrap-around neighbour comparisons of the 64 embedding values."""
    e = F.col("embedding")
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: (F.get(e, i) < F.get(e, (i + 1) % 64)).cast("bigint"),
    )
    return read_table(spark, sf_dir, "embeddings").select("vec_id", pack_bits(bits).alias("hash"), "label")


def items(spark, sf_dir) -> DataFrame:
    """Four copies of each fingerprint: itself twice, and two with a few bits flipped."""
    copies = fingerprints(spark, sf_dir).withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    low = F.expr("shiftleft(1L, cast(vec_id % 13 as int)) - 1")
    high = F.expr("(shiftleft(1L, cast(vec_id * 5 % 9 as int)) - 1) * 1048576")
    ord_ = F.col("vec_id") * 4 + F.col("copy")
    return copies.select(
        ord_.alias("ord"), ord_.cast("string").alias("item_id"), (F.col("vec_id") % 20).alias("entity_id"),
        F.when(F.col("copy") == 1, F.col("hash").bitwiseXOR(low))
        .when(F.col("copy") == 2, F.col("hash").bitwiseXOR(high)).otherwise(F.col("hash")).alias("hash"),
        F.when(ord_ % 17 == 0, F.concat(F.lit("shared"), F.col("vec_id") % 3))
        .otherwise(F.concat(F.lit("u"), ord_)).alias("canonical_url"),
        ((F.col("vec_id") * 31 + F.col("copy") * 17) % 100).cast("double").alias("strength"),
        F.concat(F.lit("page"), ord_ % 300).alias("page"),
    )


@query("dhash_bits", HASH_CTES + """
SELECT vec_id, hash, lower(lpad(hex(hash), 16, '0')) AS hex FROM base""")
def dhash_bits(spark, sf_dir):
    return fingerprints(spark, sf_dir).select("vec_id", "hash", hash_to_hex(F.col("hash")).alias("hex"))


@query("near_dup_pairs", HASH_CTES + "SELECT * FROM pairs")
def near_dup_pairs(spark, sf_dir):
    classes = items(spark, sf_dir).select("entity_id", "hash").distinct()
    return dedup.near_pairs(classes, ["entity_id"], config.NEAR_DUP_HAMMING)


@query("dedup_near", GREEDY_CTES + "SELECT * FROM verdicts")
def dedup_near(spark, sf_dir):
    return dedup.dedup_near(items(spark, sf_dir))


OWN_PAGES = """
, own_pages AS (
  SELECT entity_id, item_id, p AS pos, concat('page', CAST((ord * 3 + p * 7) % 300 AS STRING)) AS page
  FROM items, (SELECT unnest(range(12)) AS p) WHERE ord % 3 = 0 AND (p < 2 OR ord % 30 = 0)),
mentions AS (
  SELECT v.entity_id, v.item_id AS keeper, 0 AS src, 0.0 AS neg, 0::BIGINT AS ord, o.pos, o.page
  FROM verdicts v JOIN own_pages o USING (entity_id, item_id) WHERE v.verdict = 'keep'
  UNION ALL
  SELECT v.entity_id, v.twin_id, 1, -i.strength, i.ord, 0, i.page
  FROM verdicts v JOIN items i USING (entity_id, item_id) WHERE v.verdict = 'drop'
  UNION ALL
  SELECT v.entity_id, v.twin_id, 1, -i.strength, i.ord, o.pos + 1, o.page
  FROM verdicts v JOIN items i USING (entity_id, item_id) JOIN own_pages o USING (entity_id, item_id) WHERE v.verdict = 'drop'),
firsts AS (
  SELECT m.entity_id, m.keeper, m.page, min(struct_pack(src, neg, m.ord, pos)) AS spot
  FROM mentions m JOIN items k ON k.entity_id = m.entity_id AND k.item_id = m.keeper
  WHERE src = 0 OR m.page <> k.page GROUP BY ALL)
"""


def own_pages(rows: DataFrame) -> DataFrame:
    """Pages that every third item brings along: two, or twelve for every thirtieth."""
    listed = rows.filter(F.col("ord") % 3 == 0).select(
        "entity_id", "item_id", "ord", F.explode(F.sequence(F.lit(0), F.lit(11)).cast("array<bigint>")).alias("pos")
    ).filter("pos < 2 OR ord % 30 = 0")
    return listed.select("entity_id", "item_id", "ord", "pos", F.concat(F.lit("page"), (F.col("ord") * 3 + F.col("pos") * 7) % 300).alias("page"))


@query("also_found", GREEDY_CTES + OWN_PAGES + """
SELECT entity_id, keeper AS item_id, page, place FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, keeper ORDER BY spot) AS place FROM firsts)
WHERE spot.src = 0 OR place <= 8""")
def also_found(spark, sf_dir):
    rows = items(spark, sf_dir)
    twins = dedup.dedup_near(rows).filter("verdict = 'drop'").select("entity_id", "item_id", "twin_id")
    own = own_pages(rows).drop("ord")
    return dedup.attach_also_found(rows, twins, own)


@query("cross_source", GREEDY_CTES + OWN_PAGES + """
, placed AS (
  SELECT *, row_number() OVER (PARTITION BY entity_id, keeper ORDER BY spot) AS place FROM firsts),
listed AS (
  SELECT p.entity_id, p.keeper, CASE
    WHEN p.spot.src = 0 THEN concat('d', CAST((k.ord + p.spot.pos) % 3 AS STRING))
    WHEN p.spot.pos = 0 THEN concat('d', CAST(p.spot.ord % 3 AS STRING))
    ELSE concat('d', CAST((p.spot.ord + p.spot.pos - 1) % 3 AS STRING)) END AS domain,
    concat('d', CAST(k.ord % 3 AS STRING)) AS own_domain
  FROM placed p JOIN items k ON k.entity_id = p.entity_id AND k.item_id = p.keeper
  WHERE p.spot.src = 0 OR p.place <= 8)
SELECT entity_id, keeper AS item_id, count(*) AS other_sources FROM listed WHERE domain <> own_domain GROUP BY ALL""")
def cross_source(spark, sf_dir):
    """Dedup, pages of the duplicates, then the count of other domains: one chain."""
    domain = lambda shift: F.concat(F.lit("d"), (F.col("ord") + shift) % 3)
    rows = items(spark, sf_dir).withColumn("domain", domain(0))
    twins = dedup.dedup_near(rows).filter("verdict = 'drop'").select("entity_id", "item_id", "twin_id")
    also = dedup.attach_also_found(rows, twins, own_pages(rows).withColumn("domain", domain(F.col("pos"))).drop("ord"))
    return dedup.cross_sources(rows, also)


@query("dedup_pointer", """
WITH RECURSIVE items AS (
  SELECT o_orderkey AS item_id, o_orderkey % 97 AS entity_id,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey - 97 * (1 + o_orderkey % 2)
         WHEN o_orderkey % 5 = 0 THEN o_orderkey + 97 END AS points_to,
    o_orderstatus <> 'P' AS eligible
  FROM orders),
linked AS (
  SELECT i.*, CASE WHEN t.item_id IS NOT NULL AND i.points_to < i.item_id THEN i.points_to END AS target
  FROM items i LEFT JOIN items t ON t.entity_id = i.entity_id AND t.item_id = i.points_to),
walk AS (
  SELECT entity_id, item_id, target, eligible AS shown, false AS dup FROM linked WHERE target IS NULL
  UNION ALL
  SELECT l.entity_id, l.item_id, l.target, l.eligible AND NOT w.shown, w.shown FROM linked l JOIN walk w
    ON w.entity_id = l.entity_id AND w.item_id = l.target)
SELECT entity_id, item_id, CASE WHEN dup THEN 'duplicate' WHEN shown THEN 'shown' ELSE 'rejected' END AS verdict,
  CASE WHEN dup THEN target END AS duplicate_of FROM walk""")
def dedup_pointer(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = read_table(spark, sf_dir, "orders").select(
        key.alias("item_id"), (key % 97).alias("entity_id"), key.alias("ord"),
        F.when(key % 3 != 0, key - 97 * (1 + key % 2)).when(key % 5 == 0, key + 97).alias("points_to"),
        (F.col("o_orderstatus") != "P").alias("eligible"),
    )
    return dedup.resolve_pointers(rows)


@query("nearest_hash", HASH_CTES + """
, uploads AS (SELECT item_id AS upload_id, ord, entity_id, CASE WHEN ord % 8 = 5 THEN ~hash ELSE hash END AS hash
  FROM items WHERE ord % 2 = 1),
known AS (SELECT entity_id + CASE WHEN ord % 6 = 0 THEN 1 ELSE 0 END AS entity_id, hash, ord FROM items WHERE ord % 2 = 0),
near AS (
  SELECT u.upload_id, u.entity_id, bit_count(xor(u.hash, k.hash)) AS distance, k.entity_id AS known_entity, k.ord
  FROM uploads u JOIN known k ON bit_count(xor(u.hash, k.hash)) <= 10),
best AS (
  SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY distance, known_entity <> entity_id, ord, known_entity) AS rn
  FROM near)
SELECT u.upload_id, u.entity_id, CAST(b.distance AS BIGINT) AS distance,
  CASE WHEN b.distance IS NULL THEN 'none' WHEN b.known_entity = u.entity_id THEN 'own' ELSE 'other' END AS match,
  b.known_entity AS matched_entity
FROM uploads u LEFT JOIN best b ON b.upload_id = u.upload_id AND b.rn = 1""")
def nearest_hash(spark, sf_dir):
    rows = items(spark, sf_dir)
    odd = F.col("ord") % 2 == 1
    uploads = rows.filter(odd).select(
        F.col("item_id").alias("upload_id"), "entity_id",
        F.when(F.col("ord") % 8 == 5, F.bitwise_not("hash")).otherwise(F.col("hash")).alias("hash"),
    )
    known = rows.filter(~odd).select(
        (F.col("entity_id") + F.when(F.col("ord") % 6 == 0, 1).otherwise(0)).alias("entity_id"), "hash", "ord"
    )
    return dedup.nearest_known(uploads, known)


@query("known_pool", HASH_CTES + """
SELECT entity_id, hash, min(ord) AS ord FROM items GROUP BY ALL""")
def known_pool(spark, sf_dir):
    rows = items(spark, sf_dir)
    return dedup.known_pool(rows.filter("ord % 2 = 0"), rows.filter("ord % 2 = 1"))


@query("reuse", HASH_CTES + """
, pool AS (SELECT item_id, (ord * 7) % 5 + entity_id * (ord % 3) AS entity_id, hash, ord % 101 = 0 AS is_stock FROM items),
near AS (
  SELECT a.item_id, a.entity_id, count(DISTINCT b.entity_id) FILTER (b.entity_id <> a.entity_id) AS others, bool_or(b.is_stock) AS stock
  FROM pool a JOIN pool b ON bit_count(xor(a.hash, b.hash)) <= 6 GROUP BY ALL)
SELECT item_id, entity_id, CASE WHEN stock THEN 'stock_reuse' WHEN others >= 2 THEN 'reused_across_universities'
  WHEN others = 1 THEN 'reused_by_one' ELSE 'unique' END AS verdict FROM near""")
def reuse(spark, sf_dir):
    rows = items(spark, sf_dir)
    pool = rows.select(
        "item_id", ((F.col("ord") * 7) % 5 + F.col("entity_id") * (F.col("ord") % 3)).alias("entity_id"), "hash",
        (F.col("ord") % 101 == 0).alias("is_stock"),
    )
    return dedup.reuse(pool)


@query("dedup_bytes", """
SELECT min(doc_id) AS doc_id, sha256(text) AS digest, count(*) AS copies FROM documents GROUP BY sha256(text)""")
def dedup_bytes(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup.dedup_bytes(docs, "text", ["doc_id"])
