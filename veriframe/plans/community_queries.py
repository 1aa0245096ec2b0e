"""Queries over reviews, uploads, wishes, labels and runs."""

from __future__ import annotations

from pyspark.sql import functions as F


from veriframe.functions import text as tx
from veriframe.operators import community, dedup, grounding, profile, quality
from veriframe.operators.ranking import histogram_percentiles
from veriframe.plans.adapters import adapter, ctes
from veriframe.plans.dedup_queries import BASE_CTE, fingerprints
from veriframe.plans.registry import query
from veriframe.plans.scoring_queries import COVERAGE_CTES, SCORED_CTES, photos, scored
from veriframe.sources.tables import read_table

MODERATE_CTES = ctes("reviews") + rf""",
m AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(trim(text), '{tx.EMAIL}', '[удалено]', 'g'), '{tx.PHONE}', '[удалено]', 'g'),
    '(^|[\s(])@[\w.]{{2,}}', '\1[удалено]', 'g') AS masked,
  CASE WHEN aspect NOT IN ('dorm', 'study', 'campus', 'city', 'other') THEN 'bad_aspect' WHEN rating NOT BETWEEN 1 AND 5 THEN 'bad_rating'
    WHEN length(trim(text)) NOT BETWEEN 30 AND 1000 THEN 'bad_text' WHEN report_count >= 3 THEN 'held'
    WHEN label = 'ok' THEN 'published' ELSE 'held' END AS status FROM reviews)
"""


@query("moderate", MODERATE_CTES + "SELECT review_id, status, md5(masked) AS digest FROM m")
def moderate(spark, sf_dir):
    return community.moderate(adapter(spark, sf_dir, "reviews")).select("review_id", "status", F.md5("masked").alias("digest"))


@query("reviews_public", MODERATE_CTES + "SELECT review_id, entity_id, aspect, rating, masked, status FROM m WHERE status = 'published'")
def reviews_public(spark, sf_dir):
    return community.published_only(community.moderate(adapter(spark, sf_dir, "reviews")))


UPLOAD_CTES = ctes("entities") + f""",
{BASE_CTE},
copies AS (
  SELECT DISTINCT CAST(o_orderkey AS STRING) AS upload_id FROM orders JOIN base u ON u.vec_id = o_orderkey % 400
  JOIN base k ON k.vec_id % 2 = 0 AND bit_count(xor(xor(u.hash, (1::BIGINT << CAST(o_orderkey % 23 AS INT)) - 1), k.hash)) <= 10)""" + """,
up AS (SELECT CAST(o_orderkey AS STRING) AS upload_id, o_orderkey AS k, o_custkey % 10 AS entity_id,
    CASE o_orderkey % 3 WHEN 0 THEN 'campus' WHEN 1 THEN 'library' ELSE 'lab' END AS category,
    CASE WHEN o_orderkey % 4 <> 0 THEN 40 + (o_custkey % 10) / 2e1 + (o_orderkey % 9) * (o_orderkey % 9) / 1e2 END AS lat,
    CASE WHEN o_orderkey % 4 <> 0 THEN 60 + (o_custkey % 10) / 2e1 END AS lon FROM orders),
ob AS (SELECT CAST(o_orderkey AS STRING) AS upload_id, CASE o_orderkey % 11 WHEN 0 THEN 'collage' WHEN 1 THEN 'render_or_illustration' ELSE 'photo' END AS image_type,
    o_orderkey % 13 = 0 AS stock_like, o_orderkey % 17 = 0 AS close_up_portrait, CASE o_orderkey % 19 WHEN 0 THEN 'other' ELSE 'none' END AS names_institution,
    CASE o_orderkey % 5 WHEN 0 THEN 'other' WHEN 1 THEN 'sports' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'campus' WHEN 1 THEN 'library' ELSE 'lab' END END AS primary_category
  FROM orders WHERE o_orderkey % 6 <> 0),
j AS (SELECT up.*, ob.* EXCLUDE (upload_id), ob.upload_id IS NOT NULL AS seen, 2 * 6371000 * asin(sqrt(power(sin(radians(e.lat - up.lat) / 2), 2)
    + cos(radians(up.lat)) * cos(radians(e.lat)) * power(sin(radians(e.lon - up.lon) / 2), 2))) AS d
  FROM up LEFT JOIN entities e USING (entity_id) LEFT JOIN ob USING (upload_id)),
checks AS (
  SELECT upload_id, 'geo' AS check_id, CASE WHEN d IS NULL THEN 'unknown' WHEN d <= 1500 THEN 'pass' WHEN d <= 30000 THEN 'unknown' ELSE 'fail' END AS result FROM j
  UNION ALL SELECT upload_id, 'duplicate', CASE WHEN upload_id IN (SELECT upload_id FROM copies) THEN 'fail' ELSE 'pass' END FROM j
  UNION ALL SELECT upload_id, 'vision_unavailable', 'unknown' FROM j WHERE NOT seen
  UNION ALL SELECT upload_id, 'vision_portrait', 'fail' FROM j WHERE seen AND close_up_portrait
  UNION ALL SELECT upload_id, 'vision_type', CASE WHEN image_type = 'photo' THEN 'pass' ELSE 'fail' END FROM j WHERE seen AND NOT close_up_portrait
  UNION ALL SELECT upload_id, 'vision_stock', 'fail' FROM j WHERE seen AND NOT close_up_portrait AND stock_like
  UNION ALL SELECT upload_id, 'vision_institution', 'fail' FROM j WHERE seen AND NOT close_up_portrait AND names_institution = 'other'
  UNION ALL SELECT upload_id, 'vision_category', CASE WHEN primary_category <> category AND primary_category <> 'other' THEN 'unknown' ELSE 'pass' END
    FROM j WHERE seen AND NOT close_up_portrait)
"""


def upload_prints(orders, spark, sf_dir):
    """Uploads are known or unknown pictures with up to 22 bits changed."""
    changed = F.expr("shiftleft(1L, cast(o_orderkey % 23 as int)) - 1")
    prints = fingerprints(spark, sf_dir).select("vec_id", "hash")
    return orders.withColumn("vec_id", F.col("o_orderkey") % 400).join(prints, "vec_id").select(
        F.col("o_orderkey").cast("string").alias("upload_id"), (F.col("o_custkey") % 10).alias("entity_id"),
        F.col("hash").bitwiseXOR(changed).alias("hash"))


def known_prints(spark, sf_dir):
    return fingerprints(spark, sf_dir).filter("vec_id % 2 = 0").select(
        (F.col("vec_id") % 10).alias("entity_id"), "hash", F.col("vec_id").alias("ord"))


def checks(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    k, e = F.col("o_orderkey"), F.col("o_custkey") % 10
    own = F.when(k % 3 == 0, "campus").when(k % 3 == 1, "library").otherwise("lab")
    uploads = orders.select(
        k.cast("string").alias("upload_id"), e.alias("entity_id"), own.alias("category"),
        F.when(k % 4 != 0, 40 + e / 20.0 + (k % 9) * (k % 9) / 100.0).alias("lat"),
        F.when(k % 4 != 0, 60 + e / 20.0).alias("lon"))
    observations = orders.filter(k % 6 != 0).select(
        k.cast("string").alias("upload_id"),
        F.when(k % 11 == 0, "collage").when(k % 11 == 1, "render_or_illustration").otherwise("photo").alias("image_type"),
        (k % 13 == 0).alias("stock_like"), (k % 17 == 0).alias("close_up_portrait"),
        F.when(k % 19 == 0, "other").otherwise("none").alias("names_institution"),
        F.when(k % 5 == 0, "other").when(k % 5 == 1, "sports").otherwise(own).alias("primary_category"))
    matches = dedup.nearest_known(upload_prints(orders, spark, sf_dir), known_prints(spark, sf_dir))
    return community.upload_checks(uploads, adapter(spark, sf_dir, "entities"), matches, observations)


@query("upload_checks", UPLOAD_CTES + "SELECT upload_id, check_id, result FROM checks")
def upload_checks(spark, sf_dir):
    return checks(spark, sf_dir)


@query("upload_status", UPLOAD_CTES + """
SELECT upload_id, CASE WHEN bool_or(check_id = 'vision_unavailable') THEN 'pending_review'
  WHEN bool_or(check_id <> 'geo' AND result = 'fail') THEN 'rejected' WHEN bool_or(check_id = 'geo' AND result = 'pass') THEN 'verified_onsite'
  ELSE 'plausible' END AS status FROM checks GROUP BY upload_id""")
def upload_status(spark, sf_dir):
    return community.upload_status(checks(spark, sf_dir))


@query("match_rank", COVERAGE_CTES + """
, pool AS (SELECT * FROM entities WHERE country_code = 'KZ' ORDER BY sitelinks DESC, entity_id LIMIT 40),
w AS (SELECT entity_id, sum(CASE status WHEN 'good' THEN 15 WHEN 'thin' THEN 6 ELSE 0 END) AS pts, count(*) FILTER (status <> 'none') AS covered
  FROM coverage WHERE category IN ('library', 'sports') GROUP BY entity_id)
SELECT entity_id, floor((40 + CASE WHEN lower(city_name) = 'city 5' THEN 20 ELSE 0 END + least(sitelinks, 80) / 80.0 * 8 + coalesce(pts, 0)) * 10 + 0.5)::BIGINT AS score_tenths,
  concat_ws(',', 'country', CASE WHEN lower(city_name) = 'city 5' THEN 'city' END, CASE WHEN coalesce(covered, 0) > 0 THEN 'covered_sections' ELSE 'no_covered_sections' END) AS reasons
FROM pool LEFT JOIN w USING (entity_id) ORDER BY score_tenths DESC, sitelinks DESC, entity_id LIMIT 30""")
def match_rank(spark, sf_dir):
    entities = adapter(spark, sf_dir, "entities")
    cover = profile.coverage(photos(spark, sf_dir), entities)
    ranked = community.match_rank(entities, cover, "KZ", " City 5", ["library", "sports"], 30)
    return ranked.select("entity_id", F.round(F.col("score") * 10).cast("bigint").alias("score_tenths"), "reasons")


@query("ground_sentences", """
WITH s AS (SELECT conv_id AS doc_id, turn AS pos, trim(regexp_replace(replace(text || ' [1, 2]', chr(10), ' '), '\\s*\\[\\d+(?:\\s*,\\s*\\d+)*\\]', '', 'g')) AS text,
    unnest([conv_id % 3, turn % 4, 9]) AS n FROM conversations),
src AS (SELECT doc_id, unnest([0, 1]) AS n FROM documents),
v AS (SELECT doc_id, pos, text, list_sort(list_distinct(list(n))) AS cited FROM s WHERE EXISTS (SELECT 1 FROM src WHERE src.doc_id = s.doc_id AND src.n = s.n) AND text <> '' GROUP BY ALL)
SELECT doc_id, place, md5(text) AS digest, array_to_string(cited, ',') AS cited FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM v) WHERE place <= 5""")
def ground_sentences(spark, sf_dir):
    sentences = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"),
        F.concat(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" [1, 2]")).alias("text"),
        F.array(F.col("conv_id") % 3, F.col("turn") % 4, F.lit(9).cast("bigint")).alias("cited"))
    sources = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")).alias("n"))
    return grounding.ground_sentences(sentences, sources).select(
        "doc_id", "place", F.md5("text").alias("digest"), F.array_join("cited", ",").alias("cited"))


@query("ground_picks", """
WITH p AS (SELECT o_custkey AS request_id, o_orderkey AS pos, ' Q' || (o_orderkey % 900) || ' ' AS qid, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE o_orderpriority END AS reason FROM orders),
k AS (SELECT request_id, trim(qid) AS qid, min(pos) AS pos, arg_min(reason, pos) AS reason FROM p
  WHERE trim(reason) <> '' AND trim(qid) IN (SELECT 'Q' || p_partkey FROM part) GROUP BY ALL)
SELECT request_id, qid, reason, place FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS place FROM k) WHERE place <= 5""")
def ground_picks(spark, sf_dir):
    k = F.col("o_orderkey")
    picks = read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("request_id"), k.alias("pos"), F.concat(F.lit(" Q"), k % 900, F.lit(" ")).alias("qid"),
        F.when(k % 7 == 0, " ").otherwise(F.col("o_orderpriority")).alias("reason"))
    catalogue = read_table(spark, sf_dir, "part").select(F.concat(F.lit("Q"), "p_partkey").alias("qid"))
    return grounding.ground_picks(picks, catalogue).select("request_id", "qid", "reason", "place")


@query("latency_stats", """
WITH v AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS ms FROM events)
SELECT event_type, count(*) AS n, min(ms) AS min, max(ms) AS max, CAST(round(quantile_cont(ms, 0.5) * 1000) AS BIGINT) AS median_milli,
  CAST(round(quantile_cont(ms, 0.9) * 1000) AS BIGINT) AS p90_milli FROM v GROUP BY event_type""")
def latency_stats(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select("event_type", F.round(F.col("value") * 100).cast("bigint").alias("ms"))
    stats = histogram_percentiles(rows, ["event_type"], "ms", {"median": 0.5, "p90": 0.9})
    milli = lambda c: F.round(F.col(c) * 1000).cast("bigint").alias(f"{c}_milli")
    return stats.select("event_type", "n", "min", "max", milli("median"), milli("p90"))


RUN_CTES = """WITH runs AS (
  SELECT o_orderkey AS run_id, CASE o_orderkey % 12 WHEN 0 THEN 'error' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'not_found' WHEN 3 THEN CAST(NULL AS STRING) ELSE 'done' END AS terminal,
    CASE WHEN o_orderkey % 24 = 0 THEN 'rate_limited' END AS error_code, o_orderkey % 9 = 0 AS simulated, o_orderkey % 4 = 0 AS cached,
    o_orderkey % 5 AS verified, o_orderkey % 7 AS likely, o_orderkey % 3 AS unconfirmed, CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END AS n_fails,
    CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS n_warns, CASE WHEN o_orderkey % 2 = 0 THEN 'profile' ELSE 'ambiguous' END AS expect1,
    o_custkey % 40 AS entity_id, o_orderkey % 37 AS photos, CASE o_orderkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'partial' WHEN 2 THEN 'timeout' END AS vision_status,
    CASE WHEN o_orderkey % 10 <> 4 THEN o_orderkey * 7 % 900 END AS resolved_ms, o_orderkey * 13 % 5000 AS first_photos_ms, CAST(round(o_totalprice) AS BIGINT) AS done_ms
  FROM orders)
"""


def runs(spark, sf_dir):
    k = F.col("o_orderkey")
    flag = lambda m: F.when(k % m == 0, 1).otherwise(0)
    return read_table(spark, sf_dir, "orders").select(
        k.alias("run_id"),
        F.when(k % 12 == 0, "error").when(k % 12 == 1, "ambiguous").when(k % 12 == 2, "not_found")
        .when(k % 12 == 3, F.lit(None).cast("string")).otherwise("done").alias("terminal"),
        F.when(k % 24 == 0, "rate_limited").alias("error_code"), (k % 9 == 0).alias("simulated"), (k % 4 == 0).alias("cached"),
        (k % 5).alias("verified"), (k % 7).alias("likely"), (k % 3).alias("unconfirmed"),
        flag(31).alias("n_fails"), flag(29).alias("n_warns"),
        F.array(F.when(k % 2 == 0, "profile").otherwise("ambiguous"), F.lit("not_found")).alias("expected"),
        (F.col("o_custkey") % 40).alias("entity_id"), (k % 37).alias("photos"),
        F.when(k % 5 == 0, "ok").when(k % 5 == 1, "partial").when(k % 5 == 2, "timeout").alias("vision_status"),
        F.when(k % 10 != 4, k * 7 % 900).alias("resolved_ms"), (k * 13 % 5000).alias("first_photos_ms"),
        F.round("o_totalprice").cast("bigint").alias("done_ms"))


@query("run_summary", RUN_CTES + """
SELECT count(*) FILTER (terminal = 'done') AS profiles, count(*) FILTER (terminal = 'done' AND simulated) AS simulated, count(*) FILTER (terminal = 'ambiguous') AS ambiguous,
  count(*) FILTER (terminal = 'not_found') AS not_found, count(*) FILTER (terminal = 'error') AS errors, count(*) FILTER (terminal = 'done' AND NOT cached) AS fresh,
  count(*) FILTER (terminal = 'done' AND cached) AS stored, count(*) FILTER (terminal = 'done' AND NOT simulated) AS regular,
  CAST(sum(verified) FILTER (terminal = 'done' AND NOT simulated) AS BIGINT) AS verified, CAST(sum(likely) FILTER (terminal = 'done' AND NOT simulated) AS BIGINT) AS likely,
  CAST(sum(unconfirmed) FILTER (terminal = 'done' AND NOT simulated) AS BIGINT) AS unconfirmed,
  count(*) FILTER (terminal = 'done' AND NOT simulated AND verified = 0) AS without_verified,
  count(DISTINCT entity_id) FILTER (terminal = 'done' AND NOT simulated) AS entities, CAST(sum(photos) FILTER (terminal = 'done') AS BIGINT) AS checked_photos,
  count(*) FILTER (n_fails > 0) AS fails FROM runs""")
def run_summary(spark, sf_dir):
    return quality.run_summary(runs(spark, sf_dir))


@query("run_vision", RUN_CTES + """
SELECT coalesce(vision_status, 'no_data') AS vision_status, count(*) AS profiles FROM runs WHERE terminal = 'done' GROUP BY 1""")
def run_vision(spark, sf_dir):
    return quality.vision_histogram(runs(spark, sf_dir))


@query("run_figures", RUN_CTES + """
, f AS (
  SELECT 'resolved_ms' AS figure, resolved_ms AS value FROM runs WHERE terminal = 'done' AND NOT cached AND resolved_ms IS NOT NULL
  UNION ALL SELECT 'first_photos_ms', first_photos_ms FROM runs WHERE terminal = 'done' AND NOT cached
  UNION ALL SELECT 'done_ms', done_ms FROM runs WHERE terminal = 'done' AND NOT cached
  UNION ALL SELECT 'photos_per_profile', verified + likely + unconfirmed FROM runs WHERE terminal = 'done' AND NOT simulated)
SELECT figure, count(*) AS n, min(value) AS min, max(value) AS max, CAST(round(quantile_cont(value, 0.5) * 1000) AS BIGINT) AS median_milli
FROM f GROUP BY figure""")
def run_figures(spark, sf_dir):
    figures = quality.run_figures(runs(spark, sf_dir))
    return figures.select("figure", "n", "min", "max", F.round(F.col("median") * 1000).cast("bigint").alias("median_milli"))


def _milli(stats):
    return [F.round(F.col(c) * 1000).cast("bigint").alias(f"{c}_milli") for c in ("p50", "p90")]


@query("cold_latency", RUN_CTES + """
, t AS (SELECT CAST(round(o_totalprice) AS BIGINT) AS ms FROM orders JOIN runs ON run_id = o_orderkey WHERE terminal = 'done' AND NOT cached)
SELECT count(*) AS n, CAST(round(quantile_cont(ms, 0.5) * 1000) AS BIGINT) AS p50_milli, CAST(round(quantile_cont(ms, 0.9) * 1000) AS BIGINT) AS p90_milli FROM t""")
def cold_latency(spark, sf_dir):
    times = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.round("o_totalprice").cast("bigint").alias("ms"))
    fresh = runs(spark, sf_dir).filter("terminal = 'done' and not cached").join(times, "run_id")
    stats = quality.latency(fresh, [])
    return stats.select("n", *_milli(stats))


@query("batch_latency", """
WITH b AS (SELECT o_custkey % 3 AS model, CAST(round(o_totalprice) AS BIGINT) AS ms FROM orders)
SELECT model, count(*) AS n, CAST(round(quantile_cont(ms, 0.5) * 1000) AS BIGINT) AS p50_milli,
  CAST(round(quantile_cont(ms, 0.9) * 1000) AS BIGINT) AS p90_milli FROM b GROUP BY model""")
def batch_latency(spark, sf_dir):
    batches = read_table(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).alias("model"), F.round("o_totalprice").cast("bigint").alias("ms"))
    stats = quality.latency(batches, ["model"])
    return stats.select("model", "n", *_milli(stats))


@query("verdict", RUN_CTES + """
SELECT run_id, CASE WHEN terminal = 'error' AND error_code = 'rate_limited' THEN 'SKIP' WHEN terminal IS NULL OR terminal = 'error' OR n_fails > 0 THEN 'FAIL'
  WHEN n_warns > 0 OR CASE WHEN terminal = 'done' THEN 'profile' ELSE terminal END NOT IN (expect1, 'not_found') THEN 'WARN' ELSE 'PASS' END AS verdict FROM runs""")
def verdict(spark, sf_dir):
    return quality.verdict(runs(spark, sf_dir)).select("run_id", "verdict")


@query("degraded", """
WITH s AS (SELECT o_custkey AS entity_id, CASE o_orderkey % 5 WHEN 0 THEN 'commons' WHEN 1 THEN 'wikipedia' WHEN 2 THEN 'web_search' WHEN 3 THEN 'openverse' ELSE 'vision' END AS source,
    CASE o_orderkey % 9 WHEN 0 THEN 'timeout' WHEN 1 THEN 'error' WHEN 2 THEN 'simulated_down' WHEN 3 THEN 'partial' ELSE 'ok' END AS status FROM orders),
f AS (SELECT entity_id, CASE WHEN status IN ('timeout', 'error', 'simulated_down') AND source IN ('commons', 'wikipedia') THEN 'wikimedia_unavailable'
    WHEN status IN ('timeout', 'error', 'simulated_down') AND source = 'web_search' THEN 'web_search_unavailable'
    WHEN source = 'vision' AND status <> 'ok' THEN 'vision_unavailable' END AS flag FROM s)
SELECT entity_id, coalesce(string_agg(DISTINCT flag, ',' ORDER BY flag), '') AS degraded, count(flag) = 0 AS cacheable FROM f GROUP BY entity_id""")
def degraded(spark, sf_dir):
    k = F.col("o_orderkey")
    source = F.array(*[F.lit(x) for x in ("commons", "wikipedia", "web_search", "openverse", "vision")])
    status = F.array(*[F.lit(x) for x in ("timeout", "error", "simulated_down", "partial", "ok", "ok", "ok", "ok", "ok")])
    rows = read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity_id"), F.get(source, (k % 5).cast("int")).alias("source"),
        F.get(status, (k % 9).cast("int")).alias("status"))
    return quality.source_health(rows).select("entity_id", F.array_join("degraded", ",").alias("degraded"), "cacheable")


LABEL_CTES = SCORED_CTES + """,
lab AS (SELECT d.doc_id AS label_id, d.doc_id % 40 AS u, CASE WHEN l.quality = 1 THEN 'yes' WHEN l.toxic = 1 THEN 'unsure' ELSE 'no' END AS belongs,
    CASE WHEN d.doc_id % 3 = 0 THEN 'campus' ELSE 'library' END AS category FROM labels l JOIN documents d USING (doc_id)),
by_image AS (SELECT u, min(struct_pack(label_id, belongs, category)) AS l FROM lab WHERE label_id % 2 = 0 GROUP BY u),
by_page AS (SELECT label_id AS u, min(struct_pack(label_id, belongs, category)) AS l FROM lab GROUP BY label_id),
labeled AS (SELECT p.cand_id, p.tier, p.category, coalesce(i.l, g.l) AS lb FROM photos p LEFT JOIN by_image i ON i.u = p.seq % 97 LEFT JOIN by_page g ON g.u = p.seq % 1000
  WHERE coalesce(i.l, g.l) IS NOT NULL)
"""


def labeled(spark, sf_dir):
    rows = photos(spark, sf_dir).select(
        "cand_id", "tier", "category", (F.col("seq") % 97).cast("string").alias("image_url"),
        (F.col("seq") % 1000).cast("string").alias("source_page_url"))
    docs = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    labels = docs.select(
        F.col("doc_id").alias("label_id"),
        F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 40).cast("string")).alias("image_url"),
        F.col("doc_id").cast("string").alias("source_page_url"),
        F.when(F.col("quality") == 1, "yes").when(F.col("toxic") == 1, "unsure").otherwise("no").alias("belongs"),
        F.when(F.col("doc_id") % 3 == 0, "campus").otherwise("library").alias("category"))
    return quality.join_labels(rows, labels)


@query("tier_precision", LABEL_CTES + """
SELECT count(*) FILTER (lb.belongs <> 'unsure') AS n,
  round(count(*) FILTER (tier = 'verified' AND lb.belongs = 'yes') * 100.0 / nullif(count(*) FILTER (tier = 'verified' AND lb.belongs <> 'unsure'), 0), 3)::DOUBLE AS precision_verified,
  round(count(*) FILTER (tier IN ('verified', 'likely') AND lb.belongs = 'yes') * 100.0 / nullif(count(*) FILTER (tier IN ('verified', 'likely') AND lb.belongs <> 'unsure'), 0), 3)::DOUBLE AS precision_shown,
  round(count(*) FILTER (lb.belongs = 'yes' AND lb.category = labeled.category) * 100.0 / nullif(count(*) FILTER (lb.belongs = 'yes'), 0), 3)::DOUBLE AS category_accuracy
FROM labeled""")
def tier_precision(spark, sf_dir):
    return quality.tier_precision(labeled(spark, sf_dir))


@query("observation_eval", ctes("observations") + """
, r AS (SELECT *, 'm' || (seq % 3) AS model, CASE WHEN seq % 5 < 3 THEN 'yes' ELSE 'no' END AS belongs, CASE WHEN seq % 2 = 0 THEN 'campus' ELSE 'lab' END AS truth, seq % 50 AS tokens FROM observations)
SELECT model, count(*) AS n, round(count(*) FILTER (belongs = 'yes' AND primary_category = truth) * 100.0 / count(*) FILTER (belongs = 'yes'), 3)::DOUBLE AS category_accuracy,
  round(count(*) FILTER (belongs = 'no' AND (names_institution = 'other' OR image_type IN ('logo_or_emblem', 'map_or_plan', 'document_or_screenshot', 'collage'))) * 100.0 / count(*) FILTER (belongs = 'no'), 3)::DOUBLE AS trap_catch_rate,
  round(count(*) FILTER ((belongs = 'yes' AND names_institution = 'this') OR (belongs = 'no' AND names_institution = 'other')) * 100.0
    / count(*) FILTER (names_institution IN ('this', 'other')), 3)::DOUBLE AS name_correctness, CAST(sum(tokens) AS BIGINT) AS tokens
FROM r GROUP BY model""")
def observation_eval(spark, sf_dir):
    seq = F.col("seq")
    rows = adapter(spark, sf_dir, "observations").withColumns({
        "model": F.concat(F.lit("m"), seq % 3), "belongs": F.when(seq % 5 < 3, "yes").otherwise("no"),
        "true_category": F.when(seq % 2 == 0, "campus").otherwise("lab"), "tokens": seq % 50})
    return quality.observation_eval(rows)


@query("duplicate_leakage", SCORED_CTES + """
SELECT entity_id, count(*) - count(DISTINCT image_url) AS leaked FROM photos WHERE tier <> 'unconfirmed' GROUP BY entity_id""")
def duplicate_leakage(spark, sf_dir):
    shown = scored(spark, sf_dir).filter(F.col("tier").isin("verified", "likely"))
    # Count distinct per entity in two aggregations, so one hot entity is spread over its URLs.
    per_url = shown.groupBy("entity_id", "image_url").agg(F.count(F.lit(1)).alias("n"))
    return per_url.groupBy("entity_id").agg((F.sum("n") - F.count(F.lit(1))).alias("leaked"))


@query("embedding_pairs", """
WITH v AS (SELECT vec_id * 2 AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  UNION ALL SELECT vec_id * 2 + 1, label, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 3)) FROM embeddings WHERE vec_id % 2 = 0
  UNION ALL SELECT vec_id * 2 + 1000001, label, list_transform(embedding, lambda x: x::DOUBLE * 4) FROM embeddings WHERE vec_id % 6 = 0),
p AS (SELECT a.label, a.id AS id_a, b.id AS id_b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.label = b.label AND a.id < b.id),
followers AS (SELECT DISTINCT label, id_b AS id FROM p WHERE c > 0.999999999)
SELECT label, id_a, id_b FROM p WHERE c >= 0.9 AND NOT EXISTS (SELECT 1 FROM followers f WHERE f.label = p.label AND f.id = p.id_a)
  AND (c > 0.999999999 OR NOT EXISTS (SELECT 1 FROM followers f WHERE f.label = p.label AND f.id = p.id_b))""")
def embedding_pairs(spark, sf_dir):
    table = read_table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    copies = table.filter(v % 2 == 0).select(
        (v * 2 + 1).alias("id"), "label", F.transform("embedding", lambda x: x.cast("double") * (1 + v % 3)).alias("e"))
    more = table.filter(v % 6 == 0).select(
        (v * 2 + 1000001).alias("id"), "label", F.transform("embedding", lambda x: x.cast("double") * 4).alias("e"))
    rows = table.select((v * 2).alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return dedup.similar_embeddings(rows.unionByName(copies).unionByName(more), ["label"], 0.9)


