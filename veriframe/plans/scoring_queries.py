"""Queries over scored candidates: tiers, coverage, facets, display order, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe import config
from veriframe.operators import profile, quality, scoring
from veriframe.plans.adapters import adapter, ctes
from veriframe.plans.registry import query
from veriframe.session import stored
from veriframe.sources.tables import read_table

AS_OF_YEAR = 2008


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    observations = adapter(spark, sf_dir, "observations").withColumn(
        "secondary_categories", F.split("secondary_list", ",")
    )
    return adapter(spark, sf_dir, "candidates"), adapter(spark, sf_dir, "entities"), observations


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, entities, observations = inputs(spark, sf_dir)
    return scoring.score_photos(candidates, entities, observations, AS_OF_YEAR)


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.split_photos(scored(spark, sf_dir))[0]


def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.split_photos(scored(spark, sf_dir))[1]


def sql_list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_CATS = sql_list(config.CATEGORIES)


def scored_sql(source: str, other_sources: str) -> str:
    """Common table expressions from ``source`` candidates to scored, photos and rejects."""
    return f"""located AS (
  SELECT c.*, e.lat AS elat, e.lon AS elon, coalesce(e.lat, e.city_lat) AS rlat, coalesce(e.lon, e.city_lon) AS rlon
  FROM {source} c LEFT JOIN entities e USING (entity_id)),
dist AS (
  SELECT *, elat IS NOT NULL AS has_entity_point, 2 * 6371000 * asin(sqrt(
    power(sin(radians(rlat - lat) / 2), 2)
    + cos(radians(lat)) * cos(radians(rlat)) * power(sin(radians(rlon - lon) / 2), 2))) AS distance_m
  FROM located),
joined AS (
  SELECT d.*, o.cand_id IS NOT NULL AS observed, o.image_type, o.stock_like, o.primary_category, o.secondary_list,
    o.names_institution, o.scene, o.close_up_portrait,
    CASE WHEN o.primary_category IN ({_CATS}) THEN o.primary_category
         ELSE coalesce(d.category_hint, 'campus') END AS category
  FROM dist d LEFT JOIN observations o USING (cand_id)),
flags AS (
  SELECT *,
    list_distinct(list_filter(string_split(coalesce(secondary_list, ''), ','),
      lambda x: x IN ({_CATS}) AND x <> category)) AS secondary,
    CASE WHEN has_entity_point AND distance_m <= 1500 THEN 'geo_near_campus'
         WHEN distance_m <= 30000 THEN CASE WHEN category = 'city' THEN 'geo_in_city' ELSE 'geo_same_city' END
         WHEN distance_m > 50000 AND category <> 'city' THEN 'far' END AS geo,
    coalesce(stock_like, false) OR coalesce(image_type, '') = 'render_or_illustration' AS weak,
    source_type = 'news' OR source_domain = 'tengrinews.kz' AS newsy
  FROM joined),
ev AS (
  SELECT *, list_filter([
    CASE WHEN depicts THEN 'commons_depicts:provenance:45' END,
    CASE WHEN commons_category THEN 'commons_category:provenance:40' END,
    CASE WHEN used_on_wikipedia THEN 'wikipedia_use:provenance:30' END,
    CASE WHEN official_domain AND weak THEN 'official_domain_weak:provenance:10' END,
    CASE WHEN official_domain AND NOT weak THEN 'official_domain:provenance:30' END,
    CASE WHEN page_mentions_name THEN 'page_mentions_name:text:15' END,
    CASE WHEN page_mentions_name AND newsy THEN 'news_mentions_name:provenance:10' END,
    CASE WHEN {other_sources} > 0 THEN 'cross_source_match:cross_source:15' END,
    CASE WHEN geo = 'geo_near_campus' THEN 'geo_near_campus:geo:35' END,
    CASE WHEN geo = 'geo_in_city' THEN 'geo_in_city:geo:35' END,
    CASE WHEN geo = 'geo_same_city' THEN 'geo_same_city:geo:10' END,
    CASE WHEN image_type = 'render_or_illustration' THEN 'render:visual:-40' END,
    CASE WHEN names_institution = 'this' THEN 'visible_text_this:text:30' END,
    CASE WHEN scene = 'consistent' THEN 'visual_consistent:visual:10' END,
    CASE WHEN scene = 'inconsistent' THEN 'visual_inconsistent:visual:-25' END,
    CASE WHEN low_res THEN 'low_res:quality:-10' END], lambda x: x IS NOT NULL) AS evidence
  FROM flags),
pts AS (
  SELECT *, CAST(list_sum(list_transform(evidence, lambda x: CAST(split_part(x, ':', 3) AS BIGINT))) AS BIGINT) AS sum_points,
    depicts OR commons_category OR used_on_wikipedia OR (official_domain AND NOT weak)
      OR coalesce(geo IN ('geo_near_campus', 'geo_in_city'), false) OR coalesce(names_institution = 'this', false) AS strong,
    coalesce(image_type = 'render_or_illustration', false) OR coalesce(scene = 'inconsistent', false) AS negative,
    list_filter([CASE WHEN image_type = 'render_or_illustration' THEN 'render' END,
      CASE WHEN NOT observed THEN 'visual_check_unavailable' END,
      CASE WHEN low_res THEN 'low_res_verification' END,
      CASE WHEN date_kind <> 'retrieved' AND CAST(substring(date_value, 1, 4) AS BIGINT) > 1800
        AND {AS_OF_YEAR} - CAST(substring(date_value, 1, 4) AS BIGINT) >= 10 THEN 'possibly_outdated' END],
      lambda x: x IS NOT NULL) AS labels,
    CASE WHEN geo = 'far' THEN 'far_geotag' WHEN close_up_portrait THEN 'portrait'
      WHEN names_institution = 'other' THEN 'other_institution'
      WHEN image_type IN ('logo_or_emblem', 'map_or_plan', 'document_or_screenshot', 'collage') THEN 'not_a_photo'
      END AS hard_reject
  FROM ev),
pts2 AS (SELECT *, coalesce(sum_points, 0) AS points FROM pts),
scored AS (
  SELECT *, coalesce(hard_reject, CASE WHEN points < 10 THEN 'low_score' END) AS reject_reason,
    CASE WHEN hard_reject IS NOT NULL THEN 'rejected'
      WHEN points >= 60 AND strong AND NOT negative THEN 'verified'
      WHEN points >= 35 THEN CASE WHEN observed OR strong THEN 'likely' ELSE 'unconfirmed' END
      WHEN points >= 10 THEN 'unconfirmed' ELSE 'rejected' END AS tier
  FROM pts2),
photos AS (SELECT * FROM scored WHERE tier <> 'rejected'),
rejects AS (SELECT * FROM scored WHERE tier = 'rejected')
"""


SCORED_CTES = ctes("entities", "candidates", "observations") + ",\n" + scored_sql("candidates", "0")


@query("score", SCORED_CTES + """
SELECT cand_id, entity_id, category, points, tier, reject_reason,
  array_to_string(list_transform(evidence, lambda x: split_part(x, ':', 1)), ',') AS signals,
  array_to_string(labels, ',') AS labels
FROM scored""")
def score(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "cand_id", "entity_id", "category", "points", "tier", "reject_reason",
        F.array_join(F.col("evidence.signal"), ",").alias("signals"), F.array_join("labels", ",").alias("labels"),
    )


@query("category_resolve", SCORED_CTES + """
SELECT cand_id, category, array_to_string(list_sort(secondary), ',') AS secondary FROM flags""")
def category_resolve(spark, sf_dir):
    candidates, _, observations = inputs(spark, sf_dir)
    joined = scoring.join_observations(candidates, observations)
    category, secondary = scoring.resolve_category(
        F.col("primary_category"), F.col("category_hint"), F.col("secondary_categories")
    )
    return joined.select("cand_id", category.alias("category"),
                         F.array_join(F.array_sort(secondary), ",").alias("secondary"))


@query("signals", SCORED_CTES + """
SELECT cand_id, split_part(x, ':', 1) AS signal, split_part(x, ':', 2) AS kind,
  CAST(split_part(x, ':', 3) AS BIGINT) AS points
FROM (SELECT cand_id, unnest(evidence) AS x FROM ev)""")
def signals(spark, sf_dir):
    return scored(spark, sf_dir).select("cand_id", F.inline("evidence"))


@query("geo_signal", SCORED_CTES + "SELECT cand_id, geo AS geo_signal FROM flags WHERE geo IS NOT NULL")
def geo_signal(spark, sf_dir):
    return scored(spark, sf_dir).filter("geo_signal is not null").select("cand_id", "geo_signal")


@query("geo_distance", SCORED_CTES + """
SELECT cand_id, CAST(floor(distance_m + 0.5) AS BIGINT) AS distance_m FROM dist WHERE distance_m IS NOT NULL""")
def geo_distance(spark, sf_dir):
    candidates, entities, _ = inputs(spark, sf_dir)
    located = scoring.geo_attach(candidates, entities).filter(F.col("distance_m").isNotNull())
    return located.select("cand_id", scoring.meters(F.col("distance_m")).alias("distance_m"))


@query("reject_reason", SCORED_CTES + """
SELECT entity_id, reject_reason, count(*) AS n FROM scored WHERE reject_reason IS NOT NULL GROUP BY ALL""")
def reject_reason(spark, sf_dir):
    return scored(spark, sf_dir).filter("reject_reason is not null").groupBy("entity_id", "reject_reason").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("tier", SCORED_CTES + "SELECT entity_id, tier, count(*) AS n, CAST(sum(points) AS BIGINT) AS points FROM scored GROUP BY ALL")
def tier(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("entity_id", "tier").agg(
        F.count(F.lit(1)).alias("n"), F.sum("points").alias("points")
    )


@query("photos_out", SCORED_CTES + """
SELECT cand_id, entity_id, tier, points, image_url,
  CASE WHEN has_entity_point THEN CAST(floor(distance_m + 0.5) AS BIGINT) END AS distance_to_campus_m FROM photos""")
def photos_out(spark, sf_dir):
    return photos(spark, sf_dir).select(
        "cand_id", "entity_id", "tier", "points", "image_url", "distance_to_campus_m"
    )


@query("rejects_out", SCORED_CTES + """
SELECT cand_id, entity_id, reject_reason AS reason, points, source_page_url,
  CASE WHEN reject_reason <> 'portrait' THEN image_url END AS thumb_url FROM rejects""")
def rejects_out(spark, sf_dir):
    return rejected(spark, sf_dir).select("cand_id", "entity_id", "reason", "points", "source_page_url", "thumb_url")


@query("center_distance", ctes("entities") + """
SELECT entity_id, CAST(floor(2 * 6371000 * asin(sqrt(power(sin(radians(city_lat - lat) / 2), 2)
  + cos(radians(lat)) * cos(radians(city_lat)) * power(sin(radians(city_lon - lon) / 2), 2))) + 0.5) AS BIGINT)
  AS distance_to_center_m FROM entities""")
def center_distance(spark, sf_dir):
    return scoring.center_distance(adapter(spark, sf_dir, "entities"))


@query("obs_join", ctes("candidates", "observations") + """
SELECT c.cand_id, o.cand_id IS NOT NULL AS observed, o.image_type, o.scene
FROM candidates c LEFT JOIN observations o USING (cand_id)""")
def obs_join(spark, sf_dir):
    candidates, _, observations = inputs(spark, sf_dir)
    return scoring.join_observations(candidates, observations).select("cand_id", "observed", "image_type", "scene")


@query("obs_pending", ctes("candidates", "observations") + """
SELECT entity_id, count(*) AS n FROM candidates c
WHERE NOT EXISTS (SELECT 1 FROM observations o WHERE o.cand_id = c.cand_id) GROUP BY ALL""")
def obs_pending(spark, sf_dir):
    candidates, _, observations = inputs(spark, sf_dir)
    pending = scoring.pending_observations(candidates, observations)
    return pending.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


# --- profile aggregates -------------------------------------------------------

_CAT_ROWS = ", ".join(f"('{c}', {i})" for i, c in enumerate(config.CATEGORIES))
COVERAGE_CTES = SCORED_CTES + f""",
cats(category, ord) AS (VALUES {_CAT_ROWS}),
coverage AS (
  SELECT e.entity_id, k.category,
    count(*) FILTER (tier = 'verified') AS verified, count(*) FILTER (tier = 'likely') AS likely,
    count(*) FILTER (tier = 'unconfirmed') AS unconfirmed,
    CASE WHEN count(*) FILTER (tier IN ('verified', 'likely')) >= 3 THEN 'good'
         WHEN count(*) FILTER (tier IN ('verified', 'likely')) >= 1 THEN 'thin' ELSE 'none' END AS status
  FROM entities e CROSS JOIN cats k
  LEFT JOIN photos p ON p.entity_id = e.entity_id AND p.category = k.category
  GROUP BY ALL)
"""


@query("coverage", COVERAGE_CTES + "SELECT * FROM coverage")
def coverage(spark, sf_dir):
    return profile.coverage(photos(spark, sf_dir), adapter(spark, sf_dir, "entities"))


@query("tier_share", SCORED_CTES + """
SELECT tier, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS share
FROM photos GROUP BY tier""")
def tier_share(spark, sf_dir):
    return profile.shares(photos(spark, sf_dir), "tier")


@query("signal_counts", SCORED_CTES + """
SELECT split_part(x, ':', 1) AS signal, count(*) AS n FROM (SELECT unnest(evidence) AS x FROM photos) GROUP BY ALL""")
def signal_counts(spark, sf_dir):
    return profile.signal_counts(photos(spark, sf_dir))


@query("facets", SCORED_CTES + """
SELECT entity_id, category, count(*) AS n FROM photos
WHERE tier <> 'unconfirmed' AND source_type IN ('encyclopedic', 'news', 'independent', 'social') GROUP BY ALL""")
def facets(spark, sf_dir):
    return profile.facet_counts(photos(spark, sf_dir), categories=["campus"],
                                source_types=config.SOURCE_LENSES["independent"])


@query("photo_filter", SCORED_CTES + """
SELECT cand_id, tier, category, source_type FROM photos
WHERE tier <> 'unconfirmed' AND category IN ('campus', 'library') AND source_type IN ('official')""")
def photo_filter(spark, sf_dir):
    shown = profile.apply_filters(photos(spark, sf_dir), categories=["campus", "library"], lens="official")
    return shown.select("cand_id", "tier", "category", "source_type")


@query("rejected_groups", SCORED_CTES + f"""
SELECT entity_id, reject_reason AS reason, count(*) AS n,
  coalesce(list_position([{sql_list(config.REJECT_REASONS)}], reject_reason), 14)::BIGINT AS tray_order
FROM rejects GROUP BY ALL""")
def rejected_groups(spark, sf_dir):
    return profile.group_rejected(rejected(spark, sf_dir))


@query("rejected_items", SCORED_CTES + f"""
SELECT cand_id, entity_id, reject_reason AS reason, row_number() OVER (PARTITION BY entity_id, reject_reason ORDER BY seq, cand_id) AS place,
  CASE WHEN reject_reason <> 'portrait' THEN image_url END AS thumb_url,
  coalesce(list_position([{sql_list(config.REJECT_REASONS)}], reject_reason), 14)::BIGINT AS tray_order FROM rejects""")
def rejected_items(spark, sf_dir):
    rows = rejected(spark, sf_dir).select("cand_id", "entity_id", "reason", "seq", "thumb_url")
    return profile.rejected_items(rows).select("cand_id", "entity_id", "reason", "place", "thumb_url", "tray_order")


TOP_REJECT_CTES = SCORED_CTES + """,
reason_counts AS (
  SELECT entity_id, reject_reason AS reason, count(*) AS n, min(seq) AS first_seq FROM rejects GROUP BY ALL),
top_rejects AS (
  SELECT entity_id, CAST(sum(total) AS BIGINT) AS total, string_agg(reason || ' (' || n || ')', ', ' ORDER BY rn) AS reasons
  FROM (SELECT entity_id, reason, n, row_number() OVER w AS rn,
          CASE WHEN row_number() OVER w = 1 THEN sum(n) OVER (PARTITION BY entity_id) ELSE 0 END AS total
        FROM reason_counts WINDOW w AS (PARTITION BY entity_id ORDER BY n DESC, first_seq, reason))
  WHERE rn <= 3 GROUP BY entity_id)
"""


@query("top_rejects", TOP_REJECT_CTES + "SELECT * FROM top_rejects")
def top_rejects(spark, sf_dir):
    return profile.top_reject_reasons(rejected(spark, sf_dir))


@query("official_only", SCORED_CTES + """
SELECT entity_id * 100 + seq % 100 AS entity_id, category, count(*) AS n FROM photos
GROUP BY entity_id * 100 + seq % 100, category HAVING bool_and(source_type = 'official')""")
def official_only(spark, sf_dir):
    # The driver's entities have too many photos per section to be official only: use finer ones.
    finer = photos(spark, sf_dir).withColumn("entity_id", F.col("entity_id") * 100 + F.col("seq") % 100)
    return profile.official_only_sections(finer)


@query("evidence_kinds", SCORED_CTES + f"""
SELECT entity_id, kind, count(*) AS n, CAST(sum(points) AS BIGINT) AS points,
  coalesce(list_position([{sql_list(config.EVIDENCE_KINDS)}], kind), 8)::BIGINT AS kind_order
FROM (SELECT entity_id, split_part(x, ':', 2) AS kind, CAST(split_part(x, ':', 3) AS BIGINT) AS points
      FROM (SELECT entity_id, unnest(evidence) AS x FROM photos)) GROUP BY ALL""")
def evidence_kinds(spark, sf_dir):
    return profile.evidence_by_kind(photos(spark, sf_dir))


_DISPLAY = """row_number() OVER (PARTITION BY entity_id ORDER BY
  CASE tier WHEN 'verified' THEN 0 WHEN 'likely' THEN 1 ELSE 2 END, points DESC, seq, cand_id)"""


@query("display_order", SCORED_CTES + f"""
SELECT cand_id, entity_id, {_DISPLAY} AS position FROM photos""")
def display_order(spark, sf_dir):
    rows = photos(spark, sf_dir).select("cand_id", "entity_id", "tier", "points", "seq")
    return profile.display_order(rows).select("cand_id", "entity_id", "position")


@query("top_per_category", SCORED_CTES + f"""
, shown AS (
  SELECT entity_id, category, cand_id, count(*) OVER (PARTITION BY entity_id, category) AS shown_total,
    row_number() OVER (PARTITION BY entity_id, category ORDER BY
      CASE tier WHEN 'verified' THEN 0 ELSE 1 END, points DESC, seq, cand_id) AS rank
  FROM photos WHERE tier <> 'unconfirmed' AND category IN ({sql_list(config.REQUIRED_AREAS)}))
SELECT entity_id, category, cand_id, rank, shown_total FROM shown WHERE rank <= 3""")
def top_per_category(spark, sf_dir):
    rows = photos(spark, sf_dir).select("cand_id", "entity_id", "category", "tier", "points", "seq")
    return profile.compare_areas(rows).select(
        "entity_id", "category", "cand_id", "rank", "shown_total"
    )


@query("section_photos", SCORED_CTES + """
SELECT * FROM (SELECT entity_id, category, cand_id, row_number() OVER (PARTITION BY entity_id, category ORDER BY
      CASE tier WHEN 'verified' THEN 0 WHEN 'likely' THEN 1 ELSE 2 END, points DESC, seq, cand_id) AS rank
  FROM photos) WHERE rank <= 12""")
def section_photos(spark, sf_dir):
    return profile.section_photos(photos(spark, sf_dir)).select("entity_id", "category", "cand_id", "rank")


@query("compare_two", COVERAGE_CTES + f"""
, pairs AS (
  SELECT a.entity_id AS entity_a, b.entity_id AS entity_b FROM entities a JOIN entities b ON b.entity_id = a.entity_id + 1)
SELECT p.entity_a, p.entity_b, x.category, x.status AS status_a, y.status AS status_b,
  x.verified + x.likely AS shown_a, y.verified + y.likely AS shown_b
FROM pairs p JOIN coverage x ON x.entity_id = p.entity_a
JOIN coverage y ON y.entity_id = p.entity_b AND y.category = x.category""")
def compare_two(spark, sf_dir):
    entities = adapter(spark, sf_dir, "entities")
    cover = profile.coverage(photos(spark, sf_dir), entities)
    pairs = entities.select(F.col("entity_id").alias("entity_a"), (F.col("entity_id") + 1).alias("entity_b"))
    return profile.compare_entities(pairs, cover)


@query("map_points", SCORED_CTES + """
, pts_all AS (
  SELECT entity_id, lat, lon, 'pin' AS what FROM photos WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180
  UNION ALL SELECT entity_id, lat, lon, 'campus' FROM entities WHERE lat IS NOT NULL
  UNION ALL SELECT entity_id, city_lat, city_lon, 'city' FROM entities WHERE city_lat IS NOT NULL)
SELECT entity_id, count(*) FILTER (what = 'pin') AS pins, CAST(round(min(lat) * 1000000) AS BIGINT) AS south,
  CAST(round(max(lat) * 1000000) AS BIGINT) AS north, CAST(round(min(lon) * 1000000) AS BIGINT) AS west,
  CAST(round(max(lon) * 1000000) AS BIGINT) AS east
FROM pts_all GROUP BY entity_id""")
def map_points(spark, sf_dir):
    bounds = profile.geo_bounds(adapter(spark, sf_dir, "entities"), photos(spark, sf_dir))
    micro = lambda c: F.round(F.col(c) * 1000000).cast("bigint").alias(c)
    return bounds.select("entity_id", "pins", micro("south"), micro("north"), micro("west"), micro("east"))


_FACT_CTES = TOP_REJECT_CTES.replace("WITH ", "WITH ", 1) + f""",
cats(category, ord) AS (VALUES {_CAT_ROWS}),
coverage AS (
  SELECT e.entity_id, k.category, k.ord, count(*) FILTER (tier IN ('verified', 'likely')) AS shown,
    count(p.cand_id) AS total, bool_and(source_type = 'official') AS official
  FROM entities e CROSS JOIN cats k LEFT JOIN photos p ON p.entity_id = e.entity_id AND p.category = k.category
  GROUP BY ALL),
center AS (
  SELECT entity_id, floor(2 * 6371000 * asin(sqrt(power(sin(radians(city_lat - lat) / 2), 2)
  + cos(radians(lat)) * cos(radians(city_lat)) * power(sin(radians(city_lon - lon) / 2), 2))) + 0.5) AS m FROM entities),
linked AS (SELECT *, '{profile.KNOWLEDGE_PAGE}' || entity_id || '#' AS kb FROM entities),
facts AS (
  SELECT entity_id, 1 AS branch, 1 AS item, 'founded' AS fact, inception AS value, kb || 'P571' AS source FROM linked WHERE inception IS NOT NULL
  UNION ALL SELECT entity_id, 1, 2, 'students', students || coalesce(' (' || students_year || ')', ''), kb || 'P2196' FROM linked WHERE students IS NOT NULL
  UNION ALL SELECT entity_id, 1, 3, 'city', city_name, kb || city_property FROM linked WHERE city_name IS NOT NULL AND city_property IS NOT NULL
  UNION ALL SELECT entity_id, 1, 4, 'country', country, kb || 'P17' FROM linked WHERE country IS NOT NULL
  UNION ALL SELECT entity_id, 1, 5, 'website', 'https://' || domain, kb || 'P856' FROM linked WHERE domain IS NOT NULL
  UNION ALL SELECT entity_id, 2, 1, 'empty_sections', string_agg(category, ', ' ORDER BY ord), 'pipeline' FROM coverage WHERE shown = 0 GROUP BY entity_id
  UNION ALL SELECT entity_id, 3, 1, 'official_only', string_agg(category, ', ' ORDER BY ord), 'pipeline' FROM coverage WHERE total > 0 AND official GROUP BY entity_id
  UNION ALL SELECT entity_id, 4, 1, 'center_distance_m', CAST(CAST(m AS BIGINT) AS STRING), 'coordinates' FROM center WHERE m IS NOT NULL
  UNION ALL SELECT entity_id, 5, 1, 'rejected', CAST(total AS STRING) || ': ' || reasons, 'pipeline' FROM top_rejects)
"""


@query("facts", _FACT_CTES + """
SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY branch, item) AS ord, fact, value, source FROM facts""")
def facts(spark, sf_dir):
    everything = scored(spark, sf_dir)
    shown, dropped = scoring.split_photos(everything)
    entities = adapter(spark, sf_dir, "entities")
    return profile.collect_facts(entities, shown, dropped)


@query("entity_facts", _FACT_CTES + "SELECT entity_id, CAST(item AS BIGINT) AS ord, fact, value, source FROM facts WHERE branch = 1")
def entity_facts(spark, sf_dir):
    return profile.fact_rows(adapter(spark, sf_dir, "entities"))


# --- audits ---------------------------------------------------------------------

# Stored copies of photos with planted defects, so that every rule has something to find.
DEFECT_CTES = SCORED_CTES + """,
stored AS (
  SELECT cand_id, entity_id, seq, source_domain,
    CASE WHEN seq % 97 = 0 THEN points + 5 WHEN seq % 89 = 0 THEN 4 ELSE points END AS points,
    CASE WHEN seq % 83 = 0 THEN 'verified' WHEN seq % 79 = 0 THEN 'unconfirmed' WHEN seq % 73 = 0 THEN 'likely'
         WHEN seq % 71 = 0 THEN 'gold' ELSE tier END AS tier,
    CASE WHEN seq % 67 = 0 THEN 'ftp://x' ELSE source_page_url END AS source_page_url,
    CASE WHEN seq % 61 = 0 THEN CAST(NULL AS STRING) ELSE '2026-01-01' END AS retrieved_at,
    CASE WHEN seq % 59 = 0 THEN CAST(NULL AS STRING) ELSE category END AS category,
    sum_points, strong, negative, evidence
  FROM photos)
"""


def stored_photos(spark, sf_dir):
    seq = F.col("seq")
    null = F.lit(None).cast("string")
    return photos(spark, sf_dir).select(
        "cand_id", "entity_id", "seq", "source_domain",
        F.when(seq % 97 == 0, F.col("points") + 5).when(seq % 89 == 0, 4).otherwise(F.col("points")).alias("points"),
        F.when(seq % 83 == 0, "verified").when(seq % 79 == 0, "unconfirmed").when(seq % 73 == 0, "likely")
        .when(seq % 71 == 0, "gold").otherwise(F.col("tier")).alias("tier"),
        F.when(seq % 67 == 0, "ftp://x").otherwise(F.col("source_page_url")).alias("source_page_url"),
        F.when(seq % 61 == 0, null).otherwise("2026-01-01").alias("retrieved_at"),
        F.when(seq % 59 == 0, null).otherwise(F.col("category")).alias("category"),
        "evidence",
    )


@query("audit_integrity", DEFECT_CTES + """
, checks AS (
  SELECT *, points >= 60 AND strong AND NOT negative AS can FROM stored)
SELECT cand_id, violation FROM (
  SELECT cand_id, CASE WHEN tier NOT IN ('verified', 'likely', 'unconfirmed') THEN 'unknown_tier' END AS violation FROM checks
  UNION ALL SELECT cand_id, CASE WHEN points <> sum_points THEN 'points_sum' END FROM checks
  UNION ALL SELECT cand_id, CASE WHEN points < 10 THEN 'shown_below_threshold' WHEN can AND tier <> 'verified' THEN 'should_be_verified'
    WHEN tier = 'verified' AND NOT can THEN 'must_not_be_verified' WHEN tier = 'likely' AND points < 35 THEN 'likely_below_threshold'
    WHEN tier = 'unconfirmed' AND points >= 35 AND strong THEN 'unconfirmed_though_strong' END FROM checks
  UNION ALL SELECT cand_id, CASE WHEN NOT regexp_matches(source_page_url, '^https?://') THEN 'bad_source_url' END FROM checks
  UNION ALL SELECT cand_id, CASE WHEN retrieved_at IS NULL THEN 'no_retrieved_at' END FROM checks
  UNION ALL SELECT cand_id, CASE WHEN category IS NULL THEN 'no_category' END FROM checks)
WHERE violation IS NOT NULL""")
def audit_integrity(spark, sf_dir):
    return quality.audit_integrity(stored_photos(spark, sf_dir)).select("cand_id", "violation")


@query("audit_official", SCORED_CTES + """
, claims AS (
  SELECT p.cand_id, regexp_replace(p.source_domain, '^www\\.', '') AS host, e.domain
  FROM photos p LEFT JOIN entities e USING (entity_id)
  WHERE list_contains(list_transform(p.evidence, lambda x: split_part(x, ':', 1)), 'official_domain')
     OR list_contains(list_transform(p.evidence, lambda x: split_part(x, ':', 1)), 'official_domain_weak'))
SELECT cand_id, CASE WHEN host = domain OR ends_with(host, '.' || domain) THEN 'exact'
  WHEN host = replace(domain, '.kz', '.edu.kz') OR ends_with(host, '.' || replace(domain, '.kz', '.edu.kz'))
    OR host = replace(domain, '.kz', '.ac.kz') OR ends_with(host, '.' || replace(domain, '.kz', '.ac.kz')) THEN 'academic_twin'
  ELSE 'mismatch' END AS verdict FROM claims""")
def audit_official(spark, sf_dir):
    domains = adapter(spark, sf_dir, "entities").filter("domain is not null").select("entity_id", "domain")
    return quality.audit_official(photos(spark, sf_dir), domains)


@query("audit_membership", SCORED_CTES + """
, claims AS (
  SELECT cand_id, 'cat' || (entity_id % 20) AS category, 'cat' || (seq % 60) AS filed
  FROM photos WHERE list_contains(list_transform(evidence, lambda x: split_part(x, ':', 1)), 'commons_category')),
edges AS (
  SELECT DISTINCT 'cat' || (c_custkey % 60) AS child, 'cat' || ((c_custkey * 7) % 20) AS parent FROM customer)
SELECT cand_id, CASE WHEN filed = category THEN 'direct'
  WHEN EXISTS (SELECT 1 FROM edges WHERE child = filed AND parent = category) THEN 'one_level_up'
  ELSE 'unconfirmed' END AS verdict FROM claims""")
def audit_membership(spark, sf_dir):
    claimed = F.exists("evidence", lambda e: e["signal"] == "commons_category").alias("claimed")
    rows = stored(photos(spark, sf_dir).select("cand_id", "entity_id", "seq", claimed), "photos")
    claims = rows.filter("claimed").select("cand_id", F.concat(F.lit("cat"), F.col("entity_id") % 20).alias("category"))
    filed = rows.select("cand_id", F.concat(F.lit("cat"), F.col("seq") % 60).alias("filed"))
    customers = read_table(spark, sf_dir, "customer")
    edges = customers.select(
        F.concat(F.lit("cat"), F.col("c_custkey") % 60).alias("child"),
        F.concat(F.lit("cat"), (F.col("c_custkey") * 7) % 20).alias("parent"),
    )
    return quality.audit_membership(claims, filed, edges)


@query("coverage_consistency", COVERAGE_CTES + """
, stored_coverage AS (
  SELECT entity_id, category, verified, CASE WHEN entity_id % 10 = 0 THEN likely + 1 ELSE likely END AS likely, unconfirmed,
    CASE WHEN entity_id % 15 = 0 THEN 'none' ELSE status END AS status
  FROM coverage WHERE NOT (entity_id % 25 = 1 AND category = 'lab'))
SELECT 'missing_or_changed' AS side, * FROM (SELECT * FROM coverage EXCEPT ALL SELECT * FROM stored_coverage)
UNION ALL SELECT 'unexpected', * FROM (SELECT * FROM stored_coverage EXCEPT ALL SELECT * FROM coverage)""")
def coverage_consistency(spark, sf_dir):
    entities = adapter(spark, sf_dir, "entities")
    shown = photos(spark, sf_dir)
    cover = profile.coverage(shown, entities)
    eid = F.col("entity_id")
    stored = cover.filter(~((eid % 25 == 1) & (F.col("category") == "lab"))).withColumns({
        "likely": F.when(eid % 10 == 0, F.col("likely") + 1).otherwise(F.col("likely")),
        "status": F.when(eid % 15 == 0, "none").otherwise(F.col("status")),
    })
    return quality.coverage_consistency(shown, entities, stored)
