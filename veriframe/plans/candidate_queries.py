"""Queries over raw candidates: pre-rejects, unions, exact dedup, quotas, batches, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.functions.urls import (
    SIZE_PARAM, TRACKING_PARAM, canonical_url, official_hosts, stable_id, url_host,
)
from veriframe.operators import candidates as ops
from veriframe.plans.adapters import adapter, ctes
from veriframe.plans.registry import query
from veriframe.plans.scoring_queries import SCORED_CTES, scored
from veriframe.sources.tables import read_table

CANON = rf"""concat('https://', regexp_replace(lower(regexp_extract({{u}}, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', ''),
  regexp_replace(regexp_replace(
    CASE WHEN regexp_extract({{u}}, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/'
         ELSE regexp_extract({{u}}, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) END,
    '(?i)@[1-4]x(\.[a-z0-9]{{{{2,5}}}})$', '\1'),
    '(?i)[-_](?:\d{{{{2,5}}}}x\d{{{{2,5}}}}|thumbnail|thumb|small|medium|large|scaled|resized|preview)(\.[a-z0-9]{{{{2,5}}}})$', '\1'),
  CASE WHEN len(list_filter(string_split(regexp_extract({{u}}, '\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(?:{TRACKING_PARAM}|{SIZE_PARAM})(?:=|$)'))) > 0
    THEN '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract({{u}}, '\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(?:{TRACKING_PARAM}|{SIZE_PARAM})(?:=|$)'))), '&')
    ELSE '' END)"""


def canon_sql(column: str) -> str:
    return CANON.replace("{u}", column).replace("{{", "{").replace("}}", "}")


PRIOR = """(CASE source_type WHEN 'official' THEN 10 WHEN 'encyclopedic' THEN 8 WHEN 'news' THEN 5
    WHEN 'independent' THEN 3 WHEN 'social' THEN 1 ELSE 0 END
  + 50 * depicts::INT + 40 * commons_category::INT + 30 * used_on_wikipedia::INT + 30 * official_domain::INT
  + 10 * page_mentions_name::INT + 10 * (lat IS NOT NULL)::INT + 3 * (date_value IS NOT NULL)::INT
  + 2 * (license IS NOT NULL)::INT + 2 * (category_hint IS NOT NULL)::INT
  + CASE WHEN width * height >= 1000000 THEN 6 WHEN width * height >= 400000 THEN 3 ELSE 0 END)::BIGINT"""

PASS_CTES = ctes("candidates") + f""",
reasons AS (
  SELECT *, CASE WHEN source_domain = 'img.shutterstock.com' THEN 'stock_source'
    WHEN regexp_matches(image_url, '(?i)\\.(?:svg|gif|ico|bmp|tiff?)(?:$|[?#])') THEN 'not_a_photo' END AS reason
  FROM candidates),
passed AS (SELECT * FROM reasons WHERE reason IS NULL),
pri AS (SELECT *, {canon_sql('image_url')} AS canonical_url, {PRIOR} AS prior FROM passed),
steps AS (
  SELECT *, max(prior) OVER w AS best_before, row_number() OVER (PARTITION BY entity_id, canonical_url ORDER BY seq, cand_id) AS rn
  FROM pri WINDOW w AS (PARTITION BY entity_id, canonical_url ORDER BY seq, cand_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
led AS (SELECT *, best_before IS NULL OR prior > best_before AS leads FROM steps),
tagged AS (
  SELECT *, sum(leads::INT) OVER (PARTITION BY entity_id, canonical_url ORDER BY rn) AS era FROM led),
leaders AS (SELECT entity_id, canonical_url, era, source_page_url AS lead_page FROM tagged WHERE leads),
notes AS (
  SELECT t.entity_id, t.canonical_url, t.rn,
    CASE WHEN t.leads THEN b.lead_page ELSE t.source_page_url END AS page, l.lead_page
  FROM tagged t JOIN leaders l USING (entity_id, canonical_url, era)
  LEFT JOIN leaders b ON b.entity_id = t.entity_id AND b.canonical_url = t.canonical_url AND b.era = t.era - 1),
mentions AS (
  SELECT entity_id, canonical_url, page, min(rn) AS noted FROM notes WHERE page IS NOT NULL AND page <> lead_page GROUP BY ALL),
winners AS (
  SELECT * FROM (SELECT *, min(seq) OVER (PARTITION BY entity_id, canonical_url) AS first_seq,
      row_number() OVER (PARTITION BY entity_id, canonical_url ORDER BY prior DESC, seq, cand_id) AS w FROM pri) WHERE w = 1)
"""


def passed(spark, sf_dir):
    return ops.split_pre_rejects(adapter(spark, sf_dir, "candidates"))[0]


@query("pre_reject", PASS_CTES + "SELECT cand_id, reason FROM reasons WHERE reason IS NOT NULL")
def pre_reject(spark, sf_dir):
    return ops.split_pre_rejects(adapter(spark, sf_dir, "candidates"))[1].select("cand_id", "reason")


@query("low_quality", ctes("candidates") + """
SELECT cand_id, least(width, height) AS short_side FROM candidates
WHERE least(width, height) > 0 AND least(width, height) < 300
  AND NOT (depicts OR commons_category OR used_on_wikipedia OR official_domain)""")
def low_quality(spark, sf_dir):
    rows = adapter(spark, sf_dir, "candidates").filter(ops.is_low_quality())
    return rows.select("cand_id", F.least("width", "height").alias("short_side"))


@query("prior", ctes("candidates") + f"SELECT cand_id, {PRIOR} AS prior FROM candidates")
def prior(spark, sf_dir):
    return adapter(spark, sf_dir, "candidates").select("cand_id", ops.candidate_prior().alias("prior"))


@query("strength", ctes("candidates") + """
SELECT cand_id, CAST(round(1000000 * (50 * depicts::INT + 40 * commons_category::INT + 30 * used_on_wikipedia::INT
  + 30 * official_domain::INT + 10 * page_mentions_name::INT + 10 * (lat IS NOT NULL)::INT
  + 3 * (date_value IS NOT NULL)::INT + 2 * (license IS NOT NULL)::INT + 5 * (NOT low_res)::INT
  + least(10.0, width * height / 1e6))) AS BIGINT) AS strength_millionths FROM candidates""")
def strength(spark, sf_dir):
    return adapter(spark, sf_dir, "candidates").select(
        "cand_id", F.round(ops.candidate_strength() * 1_000_000).cast("bigint").alias("strength_millionths")
    )


@query("union_first", ctes("candidates") + """
SELECT provider, entity_id, image_url, cand_id FROM (
  SELECT *, row_number() OVER (PARTITION BY provider, entity_id, image_url ORDER BY seq, cand_id) AS rn FROM candidates)
WHERE rn = 1""")
def union_first(spark, sf_dir):
    rows = adapter(spark, sf_dir, "candidates")
    providers = [rows.filter(F.col("provider") == p) for p in ("commons", "web_search", "openverse")]
    return ops.union_candidates(providers).select("provider", "entity_id", "image_url", "cand_id")


@query("merge_flags", ctes("candidates") + """
SELECT entity_id, source_page_url, arg_min(cand_id, struct_pack(a := seq, b := cand_id)) AS cand_id,
  arg_min(category_hint, struct_pack(a := seq, b := cand_id)) FILTER (category_hint IS NOT NULL) AS category_hint,
  bool_or(depicts) AS depicts, bool_or(commons_category) AS commons_category,
  bool_or(used_on_wikipedia) AS used_on_wikipedia, bool_or(page_mentions_name) AS page_mentions_name
FROM candidates GROUP BY ALL""")
def merge_flags(spark, sf_dir):
    rows = adapter(spark, sf_dir, "candidates").select(
        "entity_id", "source_page_url", "seq", "cand_id", "category_hint", "depicts", "commons_category",
        "used_on_wikipedia", "page_mentions_name",
    )
    return ops.merge_flags(rows, ["entity_id", "source_page_url"]).drop("seq")


@query("dedup_url", PASS_CTES + """
SELECT w.entity_id, w.canonical_url, w.cand_id, w.prior, count(m.page) AS n_pages
FROM winners w LEFT JOIN mentions m USING (entity_id, canonical_url) GROUP BY ALL""")
def dedup_url(spark, sf_dir):
    winners, _ = ops.dedup_exact_url(passed(spark, sf_dir), keep=[])
    return winners.select("entity_id", "canonical_url", "cand_id", "prior", "n_pages")


@query("url_mentions", PASS_CTES + """
SELECT entity_id, canonical_url, page FROM mentions""")
def url_mentions(spark, sf_dir):
    _, mentions = ops.dedup_exact_url(passed(spark, sf_dir), keep=[])
    return mentions.select("entity_id", "canonical_url", "page")


QUOTA = """
, cut AS (
  SELECT *, coalesce(category_hint, 'unknown') AS bucket, row_number() OVER (
    PARTITION BY entity_id, coalesce(category_hint, 'unknown') ORDER BY prior DESC, first_seq, canonical_url) AS turn,
    row_number() OVER (PARTITION BY entity_id ORDER BY prior DESC, first_seq, canonical_url) AS overall
  FROM winners),
heads AS (SELECT *, min(overall) OVER (PARTITION BY entity_id, bucket) AS head FROM cut),
selected AS (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY turn, head) AS place FROM heads)
"""


@query("quota_select", PASS_CTES + QUOTA + """
SELECT entity_id, canonical_url, cand_id, bucket, turn, place FROM selected WHERE place <= 36""")
def quota_select(spark, sf_dir):
    ranked = ops.url_winners(ops.with_canonical(passed(spark, sf_dir)), keep=["category_hint"])
    return ops.select_with_quotas(ranked).select("entity_id", "canonical_url", "cand_id", "bucket", "turn", "place")


@query("interleave", """
WITH lists AS (
  SELECT o_custkey % 50 AS request, o_orderpriority AS list_name, CAST(substring(o_orderpriority, 1, 1) AS BIGINT) AS list_no,
    o_custkey * 7 % 400 AS item, row_number() OVER (PARTITION BY o_custkey % 50, o_orderpriority ORDER BY o_orderkey) AS pos
  FROM orders),
first AS (SELECT request, item, min(pos * 10 + list_no) AS turn FROM lists GROUP BY ALL)
SELECT request, item, row_number() OVER (PARTITION BY request ORDER BY turn, item) AS place FROM first""")
def interleave(spark, sf_dir):
    rows = read_table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("request"), "o_orderkey",
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("list_no"),
        (F.col("o_custkey") * 7 % 400).alias("item"),
    ).withColumn("block", F.floor(F.col("o_orderkey") / 65536).cast("bigint"))
    ranked = ops.positions(rows, ["request", "list_no"], ["block"], [F.col("o_orderkey")], "pos")
    return ops.interleave(ranked, ["request"]).select("request", "item", "place")


@query("pick_diverse", ctes("candidates") + """
, names AS (SELECT entity_id, source_page_url AS name, category_hint AS hint, min(seq) AS pos FROM candidates
  WHERE category_hint IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, hint ORDER BY pos, name) AS rn FROM names),
q AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY rn > 1, pos, hint, name) AS place FROM r)
SELECT entity_id, name, hint, place FROM q WHERE place <= 4""")
def pick_diverse(spark, sf_dir):
    names = (
        adapter(spark, sf_dir, "candidates").filter("category_hint is not null")
        .groupBy("entity_id", F.col("source_page_url").alias("name"), F.col("category_hint").alias("hint"))
        .agg(F.min("seq").alias("pos0"))
        .select("entity_id", "name", "hint", F.struct("pos0", "hint", "name").alias("pos"))
    )
    return ops.pick_diverse(names, ["entity_id"]).select("entity_id", "name", "hint", "place")


@query("batching", ctes("candidates", "observations") + """
, pending AS (SELECT *, coalesce(category_hint, 'unknown') AS hint FROM candidates c
  WHERE NOT EXISTS (SELECT 1 FROM observations o WHERE o.cand_id = c.cand_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seq, cand_id) AS rn FROM pending),
heads AS (SELECT *, min(rn) OVER (PARTITION BY entity_id, hint) AS head FROM ranked)
SELECT cand_id, entity_id, CAST(floor((row_number() OVER (PARTITION BY entity_id ORDER BY head, rn) - 1) / 12) AS BIGINT)
  AS batch_no FROM heads""")
def batching(spark, sf_dir):
    pending = adapter(spark, sf_dir, "candidates").join(
        adapter(spark, sf_dir, "observations").select("cand_id"), "cand_id", "left_anti"
    )
    return ops.batching(pending.select("cand_id", "entity_id", "seq", "category_hint")).select(
        "cand_id", "entity_id", "batch_no"
    )


@query("det_sample", """
SELECT doc_id, lang, n_chars FROM documents ORDER BY sha1(concat(CAST(doc_id AS STRING), '7')), doc_id LIMIT 40""")
def det_sample(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return ops.deterministic_sample(docs, "doc_id", 40, "7")


@query("label_sample", SCORED_CTES + """
, items AS (SELECT cand_id, entity_id, CASE WHEN tier = 'rejected' THEN 'rejected' ELSE 'shown' END AS outcome FROM scored)
SELECT cand_id, entity_id, outcome, pick, CASE WHEN substring(sha1(concat('split', CAST(entity_id AS STRING))), 1, 1) < '8'
  THEN 'tune' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, outcome ORDER BY sha1(concat(cand_id, '11')), cand_id) AS pick FROM items)
WHERE pick <= 12""")
def label_sample(spark, sf_dir):
    items = scored(spark, sf_dir).select(
        "cand_id", "entity_id", F.when(F.col("tier") == "rejected", "rejected").otherwise("shown").alias("outcome")
    )
    return ops.sample_for_labels(items, 24, "11")


@query("latest_value", """
SELECT c_custkey, arg_max(CAST(round(o_totalprice) AS BIGINT), struct_pack(a := o_orderdate, b := o_orderkey)) AS value
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL""")
def latest_value(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey",
        F.round("o_totalprice").cast("bigint").alias("value"),
    )
    latest = ops.latest_per_key(orders, ["c_custkey"], "value", ["o_orderdate", "o_orderkey"])
    return latest.join(read_table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "left_semi")


# --- URL columns over pages ---------------------------------------------------------


@query("canonical_url", f"""
SELECT page_id, {canon_sql('url')} AS canonical_url FROM pages""")
def canonical(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", canonical_url(F.col("url")).alias("canonical_url"))


@query("url_host", r"""
SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS host FROM pages""")
def host(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", url_host(F.col("url")).alias("host"))


@query("stable_id", f"""
SELECT page_id, substring(sha1({canon_sql('url')}), 1, 12) AS id FROM pages""")
def stable(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select(
        "page_id", stable_id(canonical_url(F.col("url"))).alias("id")
    )


@query("official_hosts", ctes("entities") + """
SELECT entity_id, unnest([domain, replace(domain, '.kz', '.edu.kz'), replace(domain, '.kz', '.ac.kz')]) AS host
FROM entities WHERE domain IS NOT NULL""")
def owned_hosts(spark, sf_dir):
    return adapter(spark, sf_dir, "entities").filter("domain is not null").select(
        "entity_id", F.explode(official_hosts(F.col("domain"))).alias("host")
    )
