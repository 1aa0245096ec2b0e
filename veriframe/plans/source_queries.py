"""Queries over landed provider rows, knowledge-base rows and stored profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe import config
from veriframe.plans.adapters import ADAPTERS, adapter, ctes
from veriframe.plans.registry import query
from veriframe.sources import knowledge, providers
from veriframe.sources.tables import read_table

_J = "json_extract_string(body, '$.{}.value')"


def _jv(field: str) -> str:
    return f"nullif({_J.format(field)}, '')"


IX_CTES = ctes("bindings") + rf""",
ix AS (
  SELECT p_partkey, regional, regexp_extract({_jv('item')}, '([^/]+)$', 1) AS qid, {_jv('nameEn')} AS name_en, {_jv('nameRu')} AS name_ru,
    list_sort(list_filter(list_distinct(list_concat(string_split(coalesce({_jv('altsEn')}, ''), '||'), [coalesce({_jv('shortName')}, '')])),
      lambda a: a <> '' AND a <> coalesce({_jv('nameEn')}, '') AND a <> coalesce({_jv('nameRu')}, ''))) AS aliases,
    {_jv('countryLabel')} AS country, {_jv('countryCode')} AS country_code,
    try_cast(nullif(regexp_extract({_jv('coord')}, '^Point\(([-\d.]+) ([-\d.]+)\)', 2), '') AS DOUBLE) AS lat,
    try_cast(nullif(regexp_extract({_jv('coord')}, '^Point\(([-\d.]+) ([-\d.]+)\)', 1), '') AS DOUBLE) AS lon,
    regexp_replace(lower(nullif(regexp_extract({_jv('website')}, '//([^/]+)', 1), '')), '^www\.', '') AS domain,
    left({_jv('inception')}, 4) AS inception, CAST(trunc(try_cast({_jv('students')} AS DOUBLE)) AS BIGINT) AS students,
    coalesce(try_cast({_jv('sitelinks')} AS BIGINT), 0) AS sitelinks,
    CASE WHEN {_jv('wpEn')} IS NOT NULL THEN 'en:' || {_jv('wpEn')} || ',ru:' || {_jv('wpRu')} ELSE '' END AS articles
  FROM bindings)
"""


@query("ix_parse", IX_CTES + """
SELECT qid, name_en, name_ru, array_to_string(aliases, '|') AS aliases, country, country_code, lat, lon, domain, inception,
  students, sitelinks, articles FROM ix""")
def ix_parse(spark, sf_dir):
    index = knowledge.read_index_bindings(adapter(spark, sf_dir, "bindings"))
    return index.select(
        "qid", "name_en", "name_ru", F.array_join("aliases", "|").alias("aliases"), "country", "country_code", "lat", "lon",
        F.get("domains", F.lit(0)).alias("domain"), "inception", "students", "sitelinks",
        F.array_join(F.transform("wikipedia", lambda a: F.concat(a["lang"], F.lit(":"), a["title"])), ",").alias("articles"),
    )


DOMAIN_CTES = f"""domain_rows AS ({ADAPTERS['domain_rows']}),
dl AS (
  SELECT regexp_replace(lower(json_extract_string(body, '$.name')), '[^a-z0-9]+', '', 'g') AS name_key,
    lower(trim(json_extract_string(body, '$.country'))) AS country_key,
    arg_max(CAST(json_extract(body, '$.domains') AS VARCHAR[]), ordinal) AS domains
  FROM domain_rows GROUP BY ALL)
"""


@query("ix_domains", "WITH " + DOMAIN_CTES + "SELECT name_key, country_key, array_to_string(domains, ',') AS domains FROM dl")
def ix_domains(spark, sf_dir):
    return knowledge.read_domain_list(adapter(spark, sf_dir, "domain_rows")).withColumn("domains", F.array_join("domains", ","))


@query("ix_enrich", IX_CTES + ", " + DOMAIN_CTES + """
SELECT qid, array_to_string(list_sort(list_distinct(list_concat(
    CASE WHEN domain IS NULL THEN []::VARCHAR[] ELSE [domain] END, coalesce(d.domains, []::VARCHAR[])))), ',') AS domains
FROM ix LEFT JOIN dl d ON d.name_key = regexp_replace(lower(coalesce(name_en, '')), '[^a-z0-9]+', '', 'g') AND d.country_key = lower(trim(country))""")
def ix_enrich(spark, sf_dir):
    index = knowledge.read_index_bindings(adapter(spark, sf_dir, "bindings"))
    domains = knowledge.read_domain_list(adapter(spark, sf_dir, "domain_rows"))
    return knowledge.enrich_domains(index, domains).select("qid", F.array_join("domains", ",").alias("domains"))


UNION_CTES = IX_CTES + """,
joined AS (
  SELECT * FROM ix WHERE regional AND (name_en IS NOT NULL OR name_ru IS NOT NULL)
  UNION ALL SELECT * FROM ix w WHERE p_partkey % 10 >= 2 AND sitelinks >= 30 AND (name_en IS NOT NULL OR name_ru IS NOT NULL)
    AND NOT EXISTS (SELECT 1 FROM ix r WHERE r.regional AND r.qid = w.qid))
"""


def united(spark, sf_dir):
    index = knowledge.read_index_bindings(adapter(spark, sf_dir, "bindings"))
    regional = index.filter("regional")
    return knowledge.index_union(regional, index.filter("p_partkey % 10 >= 2"))


@query("ix_union", UNION_CTES + "SELECT qid, sitelinks, regional FROM joined")
def ix_union(spark, sf_dir):
    return united(spark, sf_dir).select("qid", "sitelinks", "regional")


@query("ix_by_country", UNION_CTES + "SELECT country_code, count(*) AS n FROM joined GROUP BY ALL ORDER BY n DESC, country_code LIMIT 15")
def ix_by_country(spark, sf_dir):
    return knowledge.counts_by_country(united(spark, sf_dir))


@query("spot_check", IX_CTES + r"""
, expected AS (SELECT DISTINCT p_type || ' ' || p_brand AS name FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT p_brand || '!' FROM part),
keys AS (
  SELECT regexp_replace(lower(unnest(list_filter([name_en, name_ru], lambda x: x IS NOT NULL))), '[^a-z0-9]+', '', 'g') AS key, 0 AS src, -p_partkey AS o, qid FROM ix
  UNION ALL SELECT regexp_replace(lower(unnest(aliases)), '[^a-z0-9]+', '', 'g'), 1, p_partkey, qid FROM ix),
best AS (SELECT key, arg_min(qid, struct_pack(src, o)) AS qid FROM keys GROUP BY key)
SELECT name, qid FROM expected LEFT JOIN best ON key = regexp_replace(lower(name), '[^a-z0-9]+', '', 'g')""")
def spot_check(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    expected = part.select(F.explode(F.array(
        F.concat("p_type", F.lit(" "), "p_brand"), F.col("p_name"), F.concat("p_brand", F.lit("!")))).alias("name")).distinct()
    index = knowledge.read_index_bindings(adapter(spark, sf_dir, "bindings")).withColumn("ordinal", F.col("p_partkey"))
    return knowledge.spot_check(expected, index)


@query("hierarchy_walk", ctes("places") + """
, w1 AS (SELECT place_id, coalesce(name_ru, name_en) AS name, lat, lon, commons_category AS cat,
    CASE WHEN lat IS NULL OR commons_category IS NULL THEN parent_id END AS look FROM places WHERE starts_with(place_id, 'c')),
w2 AS (SELECT w.place_id, coalesce(w.name, p.name_ru, p.name_en) AS name, coalesce(w.lat, p.lat) AS lat, coalesce(w.lon, p.lon) AS lon,
    coalesce(w.cat, p.commons_category) AS cat, CASE WHEN coalesce(w.lat, p.lat) IS NULL OR coalesce(w.cat, p.commons_category) IS NULL THEN p.parent_id END AS look
  FROM w1 w LEFT JOIN places p ON p.place_id = w.look),
w3 AS (SELECT w.place_id, coalesce(w.name, p.name_ru, p.name_en) AS name, coalesce(w.lat, p.lat) AS lat, coalesce(w.lon, p.lon) AS lon,
    coalesce(w.cat, p.commons_category) AS cat FROM w2 w LEFT JOIN places p ON p.place_id = w.look)
SELECT place_id, name, lat, lon, cat AS commons_category FROM w3""")
def hierarchy_walk(spark, sf_dir):
    places = adapter(spark, sf_dir, "places")
    return knowledge.walk_up_hierarchy(places.filter(F.col("place_id").startswith("c")), places)


CLAIM_CTES = ctes("raw_entities") + """,
claims AS (
  SELECT qid, ord, c.property AS property, c.rank AS rank, c.snaktype AS snaktype, c.value AS value, c.point_in_time AS pit
  FROM (SELECT qid, unnest(j) AS c, generate_subscripts(j, 1) AS ord FROM (
    SELECT qid, from_json(claims_json, '[{"property":"VARCHAR","rank":"VARCHAR","snaktype":"VARCHAR","value":"JSON","point_in_time":"VARCHAR"}]') AS j FROM raw_entities))),
best AS (
  SELECT * FROM (SELECT *, max(rank = 'preferred') OVER (PARTITION BY qid, property) AS has_pref FROM claims WHERE rank <> 'deprecated')
  WHERE snaktype = 'value' AND (NOT has_pref OR rank = 'preferred')),
firsts AS (
  SELECT qid, arg_min(json_extract_string(value, '$.id'), ord) FILTER (property = 'P159') AS p159,
    arg_min(json_extract_string(value, '$.id'), ord) FILTER (property = 'P131') AS p131,
    arg_min(json_extract_string(value, '$.id'), ord) FILTER (property = 'P17') AS p17,
    arg_min(regexp_replace(regexp_extract(json_extract_string(value, '$.time'), '^\\+?(-?\\d{1,4})-', 1), '^0+(\\d)', '\\1'), ord) FILTER (property = 'P571') AS founded,
    arg_max(CAST(CAST(json_extract_string(value, '$.amount') AS DOUBLE) AS BIGINT), struct_pack(a := pit, b := -ord)) FILTER (property = 'P2196') AS students,
    arg_max(regexp_extract(pit, '^\\+?(\\d{4})-', 1), struct_pack(a := pit, b := -ord)) FILTER (property = 'P2196') AS students_year,
    arg_min(CAST(json_extract_string(value, '$.latitude') AS DOUBLE), ord) FILTER (property = 'P625') AS lat,
    arg_min(CAST(json_extract_string(value, '$.longitude') AS DOUBLE), ord) FILTER (property = 'P625') AS lon,
    arg_min(json_extract_string(value, '$'), ord) FILTER (property = 'P373') AS cat,
    arg_min(json_extract_string(value, '$'), ord) FILTER (property = 'P856') AS website,
    array_to_string(list(regexp_replace(lower(regexp_extract(json_extract_string(value, '$'), '//([^/]+)', 1)), '^www\\.', '') ORDER BY ord) FILTER (property = 'P856'), ',') AS domains
  FROM best GROUP BY qid),
classes AS (SELECT qid, list(json_extract_string(value, '$.id')) AS ids FROM claims WHERE property = 'P31' GROUP BY qid),
member AS (
  SELECT r.qid, CASE WHEN list_contains(ids, 'Q3918') THEN true WHEN len(ids) > 0 AND NOT list_contains(ids, 'Q5341295') THEN false
    ELSE regexp_matches(concat_ws('|', label_en, label_ru, description), '""" + config.HIGHER_EDUCATION_TEXT.replace("(?iu)", "(?i)") + """') END AS qualifies
  FROM raw_entities r LEFT JOIN classes USING (qid))
"""


def raw(spark, sf_dir):
    return adapter(spark, sf_dir, "raw_entities")


@query("claims_best", CLAIM_CTES + """
SELECT r.qid, coalesce(p159, p131) AS city_id, p17 AS country_id, founded, students, students_year, f.lat, f.lon
FROM raw_entities r LEFT JOIN firsts f USING (qid)""")
def claims_best(spark, sf_dir):
    claims = F.col("claims")
    return raw(spark, sf_dir).withColumn("claims", knowledge.parse_claims()).select(
        "qid", F.coalesce(*[F.get(knowledge.item_ids(claims, p), F.lit(0)) for p in ("P159", "P131")]).alias("city_id"),
        F.get(knowledge.item_ids(claims, "P17"), F.lit(0)).alias("country_id"),
        knowledge.first_year(claims, "P571").alias("founded"),
        knowledge.latest_quantity(claims, "P2196").alias("q"), knowledge.first_point(claims).alias("p"),
    ).select("qid", "city_id", "country_id", "founded", F.col("q.amount").alias("students"),
             F.col("q.year").alias("students_year"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


@query("in_class", CLAIM_CTES + "SELECT qid, qualifies FROM member")
def in_class(spark, sf_dir):
    return raw(spark, sf_dir).select("qid", knowledge.is_in_class(
        knowledge.parse_claims(), F.array("label_en", "label_ru", "description")).alias("qualifies"))


@query("guard_members", CLAIM_CTES + """
, ids AS (SELECT 'Q' || o_orderkey AS qid FROM orders), listed AS (SELECT DISTINCT 'Q' || (p_partkey * 3) AS qid FROM part)
SELECT i.qid, CASE WHEN m.qid IS NULL THEN 'not_found' WHEN m.qualifies OR l.qid IS NOT NULL THEN 'ok' ELSE 'not_a_university' END AS verdict
FROM ids i LEFT JOIN member m USING (qid) LEFT JOIN listed l USING (qid)""")
def guard_members(spark, sf_dir):
    ids = read_table(spark, sf_dir, "orders").select(F.concat(F.lit("Q"), "o_orderkey").alias("qid"))
    listed = read_table(spark, sf_dir, "part").select(F.concat(F.lit("Q"), F.col("p_partkey") * 3).alias("qid"))
    return knowledge.guard_members(ids, listed, raw(spark, sf_dir))


@query("build_entities", CLAIM_CTES + f""", places AS ({ADAPTERS['places']})
SELECT r.qid, coalesce(label_ru, label_en, r.qid) AS name, f.founded AS inception,
  CASE WHEN coalesce(p.name_ru, p.name_en) IS NOT NULL THEN coalesce(p159, p131) END AS city_id, coalesce(p.name_ru, p.name_en) AS city_name,
  CASE WHEN coalesce(p.name_ru, p.name_en) IS NOT NULL THEN p.lat END AS city_lat,
  coalesce(n.n_name, '') AS country, f.website, f.domains,
  coalesce(f.cat, CASE WHEN starts_with(commons_sitelink, 'Category:') THEN substring(commons_sitelink, 10) END) AS commons_category,
  coalesce(f.lat, article_lat) AS lat, coalesce(f.lon, article_lon) AS lon
FROM raw_entities r LEFT JOIN firsts f USING (qid) LEFT JOIN places p ON p.place_id = coalesce(p159, p131)
LEFT JOIN nation n ON 'n' || n.n_nationkey = p17""")
def build_entities(spark, sf_dir):
    countries = read_table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("country_id"), F.col("n_name").alias("country_name"),
        F.concat(F.lit("C"), "n_nationkey").alias("country_code"))
    built = knowledge.build_entities(raw(spark, sf_dir), adapter(spark, sf_dir, "places"), countries)
    return built.select("qid", "name", "inception", "city_id", "city_name", "city_lat", "country", "website",
                        F.array_join("domains", ",").alias("domains"), "commons_category", "lat", "lon")


@query("entity_view", ctes("index_entries") + """
SELECT qid, coalesce(name_ru, name_en, name_kk, qid) AS name, array_to_string(list_filter([
  'https://ru.wikipedia.org/wiki/' || url_encode(replace(name_ru, ' ', '_')), 'https://en.wikipedia.org/wiki/' || url_encode(replace(name_en, ' ', '_')),
  'https://kk.wikipedia.org/wiki/' || url_encode(replace(name_kk, ' ', '_'))], lambda x: x IS NOT NULL), ' ') AS urls,
  'https://commons.wikimedia.org/wiki/Special:FilePath/' || url_encode(replace(short_name || ' logo.png', ' ', '_')) || '?width=256' AS logo_url
FROM index_entries""")
def entity_view(spark, sf_dir):
    article = lambda lang, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(lang).alias("lang"), F.col(c).alias("title")))
    index = adapter(spark, sf_dir, "index_entries").withColumns({
        "wikipedia": F.array_compact(F.array(article("kk", "name_kk"), article("en", "name_en"), article("ru", "name_ru"))),
        "logo": F.concat("short_name", F.lit(" logo.png")),
    })
    return knowledge.entity_view(index).select("qid", "name", F.array_join("articles.url", " ").alias("urls"), "logo_url")


# --- provider rows ----------------------------------------------------------------------


@query("cand_web", ctes("web_rows") + r"""
, r AS (SELECT o_orderkey, category_hint, nullif(trim(json_extract_string(body, '$.imageUrl')), '') AS image_url,
    nullif(trim(json_extract_string(body, '$.link')), '') AS source_page_url, nullif(trim(json_extract_string(body, '$.domain')), '') AS domain,
    nullif(trim(json_extract_string(body, '$.title')), '') AS title, 
    CASE WHEN json_type(body, '$.imageWidth') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract(body, '$.imageWidth') AS DOUBLE) END AS w FROM web_rows)
SELECT o_orderkey, category_hint, image_url, source_page_url, title, CASE WHEN w > 0 THEN CAST(w AS BIGINT) END AS width,
  coalesce(nullif(regexp_replace(lower(regexp_extract(source_page_url, '^[a-z]+://([^/]+)', 1)), '^www\.', ''), ''), domain) AS source_domain
FROM r WHERE image_url IS NOT NULL AND source_page_url IS NOT NULL
  AND coalesce(nullif(regexp_extract(source_page_url, '^[a-z]+://([^/]+)', 1), ''), domain) IS NOT NULL""")
def cand_web(spark, sf_dir):
    return providers.normalize_web_rows(adapter(spark, sf_dir, "web_rows")).select(
        "o_orderkey", "category_hint", "image_url", "source_page_url", "title", "width", "source_domain")


@query("cand_open", ctes("open_rows") + """
, r AS (SELECT p_partkey, entity_id, json_extract_string(body, '$.title') AS title, json_extract_string(body, '$.tags[1].name') AS tag,
    CAST(json_extract_string(body, '$.width') AS BIGINT) AS width, CAST(json_extract_string(body, '$.height') AS BIGINT) AS height,
    regexp_extract(json_extract_string(body, '$.foreign_landing_url'), '//(?:www[.])?([^/]+)', 1) AS host,
    CASE WHEN json_extract_string(body, '$.license') <> '' THEN
      'CC ' || upper(json_extract_string(body, '$.license')) || coalesce(' ' || json_extract_string(body, '$.license_version'), '') END AS license,
    json_extract_string(body, '$.license_url') AS license_url, trim(json_extract_string(body, '$.creator')) AS author,
    json_extract_string(body, '$.mature') AS mature, lower(json_extract_string(body, '$.filetype')) AS ft FROM open_rows)
SELECT p_partkey, entity_id, license, CASE WHEN license IS NOT NULL THEN license_url END AS license_url,
  CASE WHEN license IS NOT NULL THEN author END AS author, host AS source_domain, width,
  CASE WHEN host = 'u' || entity_id || '.kz' AND entity_id % 9 <> 0 THEN 'official' ELSE 'independent' END AS source_type
FROM r WHERE mature = 'false' AND ft = 'jpg' AND least(width, height) >= 300 AND host NOT IN ('alamy.com', 'pinterest.com')
  AND (title LIKE 'View of Supplier%' OR tag LIKE 'supplier-%')""")
def cand_open(spark, sf_dir):
    rows = providers.normalize_open_rows(adapter(spark, sf_dir, "open_rows"), adapter(spark, sf_dir, "entities"))
    return rows.select("p_partkey", "entity_id", "license", "license_url", "author", "source_domain", "width", "source_type")


@query("cand_commons", ctes("media_rows") + rf"""
, r AS (SELECT *, regexp_replace(regexp_replace(title, '^File:', ''), '\.[A-Za-z0-9]+$', '') AS name,
    'View & ' || CASE WHEN c_custkey % 6 = 0 THEN 'dormitory' ELSE 'place' END AS caption FROM media_rows),
k AS (SELECT *, lower(concat_ws(' ', name, replace(replace(categories, '| ', ' '), '|', ' '), caption)) AS t,
    CASE WHEN c_custkey % 11 = 0 THEN 'Court of Supplier 00000000' || entity_id ELSE name END AS shown FROM r
  WHERE mime = 'image/jpeg' AND c_custkey % 15 <> 0 AND least(width, height) >= 300 AND c_custkey % 9 <> 0 AND c_custkey % 8 <> 0)
SELECT entity_id, title AS file_title, shown AS title, CASE WHEN width > 960 AND thumb_url IS NOT NULL THEN thumb_url ELSE replace(url, '?utm_source=z', '') END AS image_url,
  CASE WHEN origin = 'city' THEN 'city' WHEN c_custkey % 7 = 3 AND entity_id % 3 = 1 THEN 'sports' WHEN c_custkey % 7 = 3 AND entity_id % 3 = 2 THEN 'dormitory'
    WHEN contains(t, 'dormitor') OR contains(t, 'hostel') THEN 'dormitory' WHEN contains(t, 'librar') THEN 'library' WHEN contains(t, 'sport') THEN 'sports'
    WHEN contains(t, 'student') THEN 'student_life' ELSE 'campus' END AS category_hint,
  origin = 'category' AS commons_category, origin = 'depicts' AS depicts, origin = 'article' OR c_custkey % 7 = 0 AS used_on_wikipedia,
  origin <> 'city' AND (' ' || lower(name) || ' ' || lower(shown) || ' ') LIKE '% supplier 00000000' || entity_id || ' %' AS page_mentions_name,
  CASE WHEN lat IS NOT NULL THEN lat WHEN c_custkey % 4 = 1 THEN 12.5 END::DOUBLE AS lat,
  CASE WHEN c_custkey % 3 = 0 THEN '2014-06-09' WHEN c_custkey % 4 = 1 THEN '2017-03-01' ELSE '2019-11-02' END AS date_value,
  CASE WHEN c_custkey % 3 = 0 THEN 'taken' ELSE 'uploaded' END AS date_kind, license_name,
  CASE WHEN license_name IS NOT NULL THEN license_url END AS license_url, CASE WHEN license_name IS NOT NULL THEN 'Someone' END AS author
FROM k""")
def cand_commons(spark, sf_dir):
    files, entities = adapter(spark, sf_dir, "media_rows"), adapter(spark, sf_dir, "entities")
    article = files.filter("c_custkey % 7 = 0").select("entity_id", F.upper(F.replace("title", F.lit(" "), F.lit("_"))).alias("title"))
    # Two thirds of the entities have a chosen subcategory that names a section, all have one that names none.
    named = F.when(F.col("entity_id") % 3 == 1, "Sports clubs").when(F.col("entity_id") % 3 == 2, "Old hostels")
    relevant = files.select("entity_id").distinct().select("entity_id", F.explode(F.array_compact(F.array(named, F.lit("Places")))).alias("category"))
    rows = providers.normalize_media_rows(files, entities, article, relevant)
    return rows.select("entity_id", "file_title", "title", "image_url", "category_hint", "commons_category", "depicts", "used_on_wikipedia",
                       "page_mentions_name", "lat", "date_value", "date_kind", "license_name", "license_url", "author")


@query("obs_parse", ctes("observation_bodies") + r"""
, ok AS (SELECT body_id FROM observation_bodies WHERE body_id % 17 <> 0 AND body_id % 23 <> 0)
SELECT body_id, 'a' || body_id AS id, CASE body_id % 4 WHEN 0 THEN 'photo' WHEN 1 THEN 'collage' ELSE 'other' END AS image_type,
  body_id % 5 = 0 AS stock_like, CASE WHEN body_id % 2 = 0 THEN 'mark' END AS watermark_text,
  CASE WHEN body_id % 6 = 0 THEN 'other' ELSE 'library' END AS primary_category, 'campus,lab' AS secondary, 'Uni ' || body_id AS visible_text,
  CASE WHEN body_id % 7 = 0 THEN 'unclear' ELSE 'this' END AS names_institution, 'consistent' AS scene, body_id % 8 = 0 AS close_up_portrait,
  CASE body_id % 5 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN 1 ELSE 3 END::BIGINT AS quality FROM ok
UNION ALL SELECT body_id, 'b' || body_id, 'other', false, NULL, 'other', '', '', 'unclear', 'unclear', false, 3 FROM ok""")
def obs_parse(spark, sf_dir):
    observations, _ = providers.parse_observations(adapter(spark, sf_dir, "observation_bodies"))
    return observations.select("body_id", "id", "image_type", "stock_like", "watermark_text", "primary_category",
                               F.array_join("secondary_categories", ",").alias("secondary"), "visible_text", "names_institution",
                               "scene", "close_up_portrait", "quality")


@query("obs_quarantine", ctes("observation_bodies") + """
SELECT body_id FROM observation_bodies WHERE body_id % 17 = 0 OR body_id % 23 = 0""")
def obs_quarantine(spark, sf_dir):
    return providers.parse_observations(adapter(spark, sf_dir, "observation_bodies"))[1].select("body_id")


@query("event_log", """
SELECT event_id, b AS block_no, CASE b WHEN 0 THEN event_type ELSE 'message' END AS type, b = 0 AND event_id % 9 = 0 AS parse_error
FROM events, (SELECT unnest([0, 2]::BIGINT[]) AS b)""")
def event_log(spark, sf_dir):
    parsed = providers.parse_event_log(adapter(spark, sf_dir, "event_text"))
    return parsed.select("event_id", "block_no", "type", "parse_error")


@query("profile_ttl", """
WITH stored AS (SELECT user_id % 40 AS qid, event_id, ts AS saved_at, CASE WHEN event_id % 5 = 0 THEN 'v1' ELSE 'v2' END AS pipeline_version,
    event_id % 3 = 0 AS bad FROM events)
SELECT qid, max(saved_at)::VARCHAR AS saved_at FROM stored WHERE NOT bad AND pipeline_version = 'v2' AND saved_at <= TIMESTAMP '2024-01-20 00:00:00'
  AND saved_at > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 14 DAY GROUP BY qid""")
def profile_ttl(spark, sf_dir):
    stored = read_table(spark, sf_dir, "events").select(
        (F.col("user_id") % 40).alias("qid"), F.col("ts").alias("saved_at"),
        F.when(F.col("event_id") % 5 == 0, "v1").otherwise("v2").alias("pipeline_version"),
        F.when(F.col("event_id") % 3 == 0, F.array(F.lit("vision_unavailable"))).otherwise(F.array().cast("array<string>")).alias("degraded"),
    )
    fresh = providers.fresh_profiles(providers.cacheable(stored), "v2", F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"))
    return fresh.select("qid", F.col("saved_at").cast("string").alias("saved_at"))


