"""How the driver tables stand in for the engine's inputs.

Each adapter is one SELECT written in the SQL both engines share, so the same text feeds the Spark query
(``spark.sql`` over the parquet tables) and the checking SQL (a common table expression). Every adapter is
a narrow projection or a key join of whole tables: its rows grow with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from veriframe.sources.tables import TABLE_SCHEMAS, read_table

TABLES = list(TABLE_SCHEMAS)

_CAND_ID = """concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),
    CAST(l_suppkey AS STRING), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING),
    substring(CAST(l_shipdate AS STRING), 1, 10))"""

_DOMAIN = """CASE l_partkey % 10 WHEN 0 THEN concat('u', CAST(l_suppkey AS STRING), '.kz')
      WHEN 1 THEN 'commons.wikimedia.org' WHEN 2 THEN 'tengrinews.kz' WHEN 3 THEN 'img.shutterstock.com'
      WHEN 4 THEN 'vk.com' WHEN 5 THEN 'ru.pinterest.com'
      WHEN 6 THEN concat('www.u', CAST(l_suppkey AS STRING), '.edu.kz')
      ELSE concat('site', CAST(l_partkey % 50 AS STRING), '.example.org') END"""

_CATEGORY = "CASE {x} WHEN 0 THEN 'campus' WHEN 1 THEN 'dormitory' WHEN 2 THEN 'classroom' WHEN 3 THEN 'library' " \
            "WHEN 4 THEN 'city' WHEN 5 THEN 'sports' WHEN 6 THEN 'lab' WHEN 7 THEN 'student_life' {rest} END"

ADAPTERS: dict[str, str] = {}

ADAPTERS["entities"] = """
  SELECT s_suppkey AS entity_id, s_name AS name, n_name AS country,
    CASE WHEN s_suppkey % 8 <> 5 THEN s_name END AS name_en,
    CASE WHEN s_suppkey % 3 = 0 THEN concat('Вуз «Звезда ', CAST(s_suppkey AS STRING), '»') END AS name_ru,
    CASE WHEN s_suppkey % 5 = 0 THEN concat('Жұлдыз ', CAST(s_suppkey AS STRING)) END AS name_kk,
    concat('S', CAST(s_suppkey AS STRING)) AS alias,
    split(concat_ws(';', concat('S', CAST(s_suppkey AS STRING)), CASE WHEN s_suppkey % 6 = 0 THEN concat('Alma ', CAST(s_suppkey AS STRING)) END,
      CASE WHEN s_suppkey % 10 = 1 THEN concat('Shipped by ', CAST(s_suppkey AS STRING)) END), ';') AS aliases,
    CASE WHEN n_nationkey % 5 = 0 THEN 'KZ' WHEN n_nationkey % 5 = 1 THEN 'US' WHEN n_nationkey % 5 = 2 THEN 'DE'
         WHEN n_nationkey % 5 = 3 THEN 'ru' ELSE 'FR' END AS country_code,
    CASE WHEN s_suppkey % 7 <> 0 THEN 40 + (s_suppkey % 200) / 2e1 END AS lat,
    CASE WHEN s_suppkey % 7 <> 0 THEN 60 + (s_suppkey % 180) / 2e1 END AS lon,
    CASE WHEN s_suppkey % 11 <> 0 THEN 40 + (s_suppkey % 200) / 2e1 + 1 / 5e1 END AS city_lat,
    CASE WHEN s_suppkey % 11 <> 0 THEN 60 + (s_suppkey % 180) / 2e1 + 1 / 5e1 END AS city_lon,
    CASE WHEN s_suppkey % 13 <> 0 THEN concat('City ', CAST(n_nationkey AS STRING)) END AS city_name,
    CASE WHEN s_suppkey % 9 <> 0 THEN concat('u', CAST(s_suppkey AS STRING), '.kz') END AS domain,
    split(concat_ws(';', CASE WHEN s_suppkey % 9 <> 0 THEN concat('u', CAST(s_suppkey AS STRING), '.kz') END,
      CASE WHEN s_suppkey % 4 = 1 THEN concat('site', CAST(s_suppkey % 50 AS STRING), '.example.org') END,
      CASE WHEN s_suppkey % 25 = 5 THEN 'www.tengrinews.kz' END), ';') AS domains,
    CASE WHEN s_suppkey % 6 <> 0 THEN CAST(1900 + s_suppkey % 120 AS STRING) END AS inception,
    CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey * 37 % 30000 END AS students,
    CASE WHEN s_suppkey % 5 <> 2 THEN CAST(2000 + s_suppkey % 24 AS STRING) END AS students_year,
    CASE s_suppkey % 4 WHEN 0 THEN 'P159' WHEN 1 THEN 'P131' WHEN 2 THEN 'P276' END AS city_property,
    s_suppkey * 7 % 160 AS sitelinks
  FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

ADAPTERS["candidates"] = f"""
  SELECT {_CAND_ID} AS cand_id, l_orderkey * 8 + l_linenumber AS seq, l_suppkey AS entity_id,
    CASE l_linenumber % 3 WHEN 0 THEN 'commons' WHEN 1 THEN 'web_search' ELSE 'openverse' END AS provider,
    {_DOMAIN} AS source_domain,
    concat('https://', {_DOMAIN}, '/p/', CAST(l_partkey % 300 AS STRING), '/', CAST(l_orderkey % 7 AS STRING))
      AS source_page_url,
    concat(CASE WHEN l_linenumber % 2 = 0 THEN 'http://www.' ELSE 'https://' END, {_DOMAIN}, '/i/',
      CAST(l_orderkey % 40 AS STRING),
      CASE l_linenumber % 4 WHEN 0 THEN '-1024x768' WHEN 1 THEN '_thumb' WHEN 2 THEN '@2x' ELSE '' END,
      CASE WHEN l_partkey % 31 = 0 THEN '.svg' ELSE '.jpg' END,
      CASE l_linenumber % 3 WHEN 0 THEN '?utm_source=x&w=640' WHEN 1 THEN '?id=7&a=2' ELSE '' END) AS image_url,
    {_CATEGORY.format(x='l_partkey % 9', rest='')} AS category_hint,
    l_partkey % 17 = 0 AS depicts, l_partkey % 5 = 0 AS commons_category, l_orderkey % 13 = 0 AS used_on_wikipedia,
    l_partkey % 10 = 0 OR l_partkey % 10 = 6 AS official_domain, l_orderkey % 3 = 0 AS page_mentions_name,
    CASE l_partkey % 10 WHEN 0 THEN 'official' WHEN 6 THEN 'official' WHEN 1 THEN 'encyclopedic' WHEN 2 THEN 'news'
      WHEN 4 THEN 'social' WHEN 3 THEN 'unknown' WHEN 5 THEN 'unknown' ELSE 'independent' END AS source_type,
    CASE WHEN l_linenumber % 2 = 0 THEN 40 + (l_suppkey % 200) / 2e1 + ((l_partkey % 12) * (l_partkey % 12)) / 2e2
      END AS lat,
    CASE WHEN l_linenumber % 2 = 0 THEN 60 + (l_suppkey % 180) / 2e1 + (l_partkey % 3) / 1e3 END AS lon,
    CASE WHEN l_linenumber % 5 <> 0 THEN substring(CAST(l_shipdate AS STRING), 1,
      CAST(CASE l_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 10 END AS INT)) END AS date_value,
    CASE WHEN l_linenumber % 5 <> 0 THEN CASE l_linenumber % 4 WHEN 0 THEN 'taken' WHEN 1 THEN 'uploaded'
      WHEN 2 THEN 'published' ELSE 'retrieved' END END AS date_kind,
    CASE WHEN l_returnflag <> 'N' THEN concat('CC BY ', l_returnflag) END AS license,
    CAST(l_quantity * 40 AS BIGINT) AS width, CAST(l_quantity * 30 AS BIGINT) AS height,
    CAST(round(l_discount * 100) AS BIGINT) >= 8 AS low_res,
    CASE WHEN l_partkey % 3 <> 0 THEN concat('Part ', CAST(l_partkey AS STRING)) END AS title,
    CASE WHEN l_partkey % 4 = 1 THEN concat('Shipped by ', CAST(l_suppkey AS STRING)) END AS caption
  FROM lineitem"""

# Fingerprints of the candidates' pictures: twelve motifs per entity, the low seven bits differ between shots; some are missing.
ADAPTERS["prints"] = f"""
  SELECT {_CAND_ID} AS cand_id, CASE WHEN l_partkey % 21 <> 0 THEN
    ((l_suppkey * 12 + l_orderkey % 12 + 1) * 48271 % 2147483647 * 69621 % 2147483647 * 16777216
      + (l_suppkey * 12 + l_orderkey % 12 + 1) * 39373 % 2147483647 * 48271 % 16777216) * 128
    + CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 7 WHEN 4 THEN 15 WHEN 5 THEN 31 WHEN 6 THEN 63 ELSE 127 END
    END AS hash
  FROM lineitem"""

ADAPTERS["observations"] = f"""
  SELECT {_CAND_ID} AS cand_id, l_orderkey * 8 + l_linenumber AS seq, l_suppkey AS entity_id,
    CASE l_partkey % 23 WHEN 0 THEN 'logo_or_emblem' WHEN 1 THEN 'map_or_plan' WHEN 2 THEN 'document_or_screenshot'
      WHEN 3 THEN 'collage' WHEN 4 THEN 'render_or_illustration' WHEN 5 THEN 'render_or_illustration'
      WHEN 6 THEN 'other' ELSE 'photo' END AS image_type,
    l_partkey % 19 = 0 AS stock_like,
    {_CATEGORY.format(x='l_orderkey % 11', rest="WHEN 8 THEN 'other' WHEN 9 THEN 'garden' ELSE 'campus'")}
      AS primary_category,
    concat({_CATEGORY.format(x='l_partkey % 8', rest='')}, ',',
           {_CATEGORY.format(x='l_orderkey % 8', rest='')}, ',zzz') AS secondary_list,
    CASE WHEN l_partkey % 13 = 0 THEN concat('Uni ', CAST(l_suppkey AS STRING)) ELSE '' END AS visible_text,
    CASE l_orderkey % 9 WHEN 0 THEN 'other' WHEN 1 THEN 'this' WHEN 2 THEN 'this' WHEN 3 THEN 'none'
      ELSE 'unclear' END AS names_institution,
    CASE WHEN l_partkey % 2 = 0 THEN concat('Inst ', CAST(l_partkey % 10 AS STRING)) END AS other_institution_name,
    CASE l_linenumber % 4 WHEN 0 THEN 'inconsistent' WHEN 1 THEN 'consistent' WHEN 2 THEN 'consistent'
      ELSE 'unclear' END AS scene,
    l_partkey % 29 = 0 AS close_up_portrait,
    1 + l_partkey % 5 AS quality
  FROM lineitem WHERE l_orderkey % 5 <> 0"""

# Index entries: Latin and Cyrillic names, aliases, popularity.
ADAPTERS["index_entries"] = """
  SELECT concat('Q', CAST(p_partkey AS STRING)) AS qid,
    CASE WHEN p_partkey % 12 <> 11 THEN concat(p_name, ' ', lower(p_type), ' university') END AS name_en,
    CASE WHEN p_partkey % 5 = 0 THEN concat('Каз', translate(p_name, 'abdegilmnoprstuzwhc', 'абдегилмнопрстузвхк'),
      ' национальный институт имени ', CAST(p_size AS STRING)) END AS name_ru,
    CASE WHEN p_partkey % 10 = 0 THEN concat(translate(p_name, 'abdegilmnoprstuzwhc', 'әбдегілмңөпрстұзуһк'),
      ' университеті') END AS name_kk,
    split(concat_ws(';', CASE WHEN p_partkey % 3 = 0 THEN concat(p_brand, ' ', p_name) END,
      CASE WHEN p_partkey % 4 = 0 THEN p_brand END,
      CASE WHEN p_partkey % 20 = 0 THEN concat('P', CAST(p_partkey AS STRING)) END,
      CASE WHEN p_partkey % 20 = 0 THEN concat(p_brand, ' academy') END,
      CASE WHEN p_partkey % 20 = 0 THEN concat(p_type, ' college') END), ';') AS aliases,
    CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS short_name,
    CASE WHEN p_partkey % 7 <> 3 THEN p_partkey * 11 % 160 END AS sitelinks,
    CASE WHEN p_partkey % 3 = 1 THEN concat('Cat ', p_name) END AS commons_category,
    CASE WHEN p_partkey % 5 = 1 THEN concat('Category:', p_name) END AS media_sitelink,
    CASE WHEN p_partkey % 4 = 2 THEN 1e0 * p_size END AS lat, CASE WHEN p_partkey % 4 = 2 THEN 2e0 * p_size END AS lon,
    concat('NATION_', CAST(p_size % 25 AS STRING)) AS country,
    concat('C', CAST(p_size % 25 AS STRING)) AS country_code,
    concat('City ', CAST(p_size AS STRING)) AS city_name,
    CASE WHEN p_partkey % 6 <> 0 THEN CAST(1850 + p_size AS STRING) END AS inception,
    CASE WHEN p_partkey % 8 <> 0 THEN concat('https://www.P', CAST(p_partkey AS STRING), '.edu/start') END AS website
  FROM part"""

# Free-text name queries: exact, reordered, shortened, prefixed, misspelled, unknown.
ADAPTERS["name_queries"] = """
  SELECT p_partkey AS query_id,
    CASE p_partkey % 9
      WHEN 0 THEN concat(upper(p_name), '  ', p_type, ' University!')
      WHEN 1 THEN concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1))
      WHEN 2 THEN split_part(p_name, ' ', 2)
      WHEN 3 THEN p_brand
      WHEN 4 THEN concat('univer ', p_name)
      WHEN 5 THEN concat(substring(p_name, 1, 3), ' ', lower(p_type))
      WHEN 6 THEN concat('Каз', translate(p_name, 'abdegilmnoprstuzwhc', 'абдегилмнопрстузвхк'))
      WHEN 7 THEN concat(translate(split_part(p_name, ' ', 2), 'aeio', 'eaoi'), ' ', lower(p_type), ' extra')
      ELSE concat('zz', CAST(p_size AS STRING)) END AS query
  FROM part"""

# Places: customers below nations below regions, with gaps to fill from the parents.
ADAPTERS["places"] = """
  SELECT concat('c', CAST(c_custkey AS STRING)) AS place_id,
    CASE WHEN c_custkey % 3 = 0 THEN concat('Place ', CAST(c_custkey AS STRING)) END AS name_en,
    CASE WHEN c_custkey % 5 = 0 THEN concat('Место ', CAST(c_custkey AS STRING)) END AS name_ru,
    CASE WHEN c_custkey % 4 = 0 THEN 30 + (c_custkey % 100) / 1e1 END AS lat,
    CASE WHEN c_custkey % 4 = 0 THEN 50 + (c_custkey % 100) / 1e1 END AS lon,
    CASE WHEN c_custkey % 6 = 0 THEN c_name END AS commons_category,
    concat('n', CAST(c_nationkey AS STRING)) AS parent_id
  FROM customer
  UNION ALL
  SELECT concat('n', CAST(n_nationkey AS STRING)), n_name, CAST(NULL AS STRING),
    CASE WHEN n_nationkey % 2 = 0 THEN 20 + n_nationkey / 1e1 END,
    CASE WHEN n_nationkey % 2 = 0 THEN 70 + n_nationkey / 1e1 END,
    CASE WHEN n_nationkey % 3 = 0 THEN concat('Nation cat ', CAST(n_nationkey AS STRING)) END,
    concat('r', CAST(n_regionkey AS STRING))
  FROM nation
  UNION ALL
  SELECT concat('r', CAST(r_regionkey AS STRING)), r_name, concat('Р ', r_name), 10 + r_regionkey / 1e0,
    80 + r_regionkey / 1e0, concat('Region cat ', r_name), CAST(NULL AS STRING)
  FROM region"""

# Request event log: the five driver event types stand for stream event types.
ADAPTERS["stream_events"] = """
  SELECT concat('r', CAST(user_id AS STRING), '-', substring(CAST(ts AS STRING), 1, 10)) AS request_id, event_id, ts,
    CASE WHEN event_id % 41 = 0 THEN 'done' WHEN event_id % 43 = 0 THEN 'error' WHEN event_id % 47 = 0 THEN 'not_found'
      WHEN event_type = 'view' THEN 'photos' WHEN event_type = 'click' THEN 'source' WHEN event_type = 'signup' THEN 'resolved'
      WHEN event_type = 'purchase' THEN 'stage' ELSE 'rejected' END AS type,
    CAST(event_id * 7 % 13 AS BIGINT) AS item_no,
    CAST(round(value * 100) AS BIGINT) AS amount
  FROM events"""

# Knowledge-base result rows as JSON, one text per part.
ADAPTERS["bindings"] = """
  SELECT p_partkey, concat('{"item":{"value":"http://kb.example.org/entity/Q', CAST(p_partkey AS STRING), '"}',
    CASE WHEN p_partkey % 12 <> 11 THEN concat(',"nameEn":{"value":"', p_name, '"}') ELSE '' END,
    CASE WHEN p_partkey % 5 = 0 THEN concat(',"nameRu":{"value":"Вуз ', CAST(p_size AS STRING), '"}') ELSE '' END,
    CASE WHEN p_partkey % 3 = 0 THEN concat(',"altsEn":{"value":"', p_name, '||', p_brand, '||', p_type, '"}') ELSE '' END,
    CASE WHEN p_partkey % 4 = 0 THEN concat(',"shortName":{"value":"', p_brand, '"}') ELSE '' END,
    ',"countryLabel":{"value":"Nation_', CAST(p_size % 25 AS STRING), '"},"countryCode":{"value":"C', CAST(p_size % 25 AS STRING), '"}',
    CASE WHEN p_partkey % 6 <> 0 THEN concat(',"coord":{"value":"Point(', CAST(p_partkey % 180 AS STRING), '.25 -', CAST(p_size AS STRING), '.5)"}') ELSE '' END,
    CASE WHEN p_partkey % 7 <> 0 THEN concat(',"website":{"value":"https://www.P', CAST(p_partkey AS STRING), '.Edu/x"}') ELSE '' END,
    CASE WHEN p_partkey % 8 <> 0 THEN concat(',"inception":{"value":"19', CAST(10 + p_size AS STRING), '-01-01T00:00:00Z"}') ELSE '' END,
    CASE p_partkey % 3 WHEN 0 THEN ',"students":{"value":"many"}' WHEN 1 THEN concat(',"students":{"value":"', CAST(p_size * 100 AS STRING), '.7"}') ELSE '' END,
    CASE WHEN p_partkey % 9 <> 0 THEN concat(',"sitelinks":{"value":"', CAST(p_partkey * 11 % 160 AS STRING), '"}') ELSE '' END,
    CASE WHEN p_partkey % 2 = 0 THEN concat(',"wpRu":{"value":"Статья ', CAST(p_partkey AS STRING), '"},"wpEn":{"value":"Page ', CAST(p_partkey AS STRING), '"}') ELSE '' END,
    '}') AS body,
    p_partkey % 10 < 4 AS regional
  FROM part"""

# Open domain list rows: names repeat, so the last row of a key must win.
ADAPTERS["domain_rows"] = """
  SELECT p_partkey AS ordinal, concat('{"name":"', upper(p_name), CASE WHEN p_partkey % 2 = 0 THEN '!' ELSE '' END,
    '","country":" NATION_', CAST(p_size % 25 AS STRING), ' ","domains":["d', CAST(p_partkey AS STRING), '.edu","', 'e', CAST(p_size AS STRING), '.org"]}') AS body
  FROM part"""

# Raw knowledge-base items: labels and a JSON list of claims.
ADAPTERS["raw_entities"] = """
  SELECT concat('Q', CAST(c_custkey AS STRING)) AS qid, c_custkey AS k,
    CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS label_en,
    CASE WHEN c_custkey % 4 = 1 THEN concat('Университет ', CAST(c_custkey AS STRING)) END AS label_ru,
    CASE WHEN c_custkey % 5 = 2 THEN 'private higher education' ELSE 'a thing' END AS description,
    CASE WHEN c_custkey % 8 = 0 THEN concat('Category:Cat ', CAST(c_custkey AS STRING)) WHEN c_custkey % 8 = 1 THEN 'Gallery' END AS commons_sitelink,
    CASE WHEN c_custkey % 3 = 1 THEN 10 + (c_custkey % 50) / 1e1 END AS article_lat,
    CASE WHEN c_custkey % 3 = 1 THEN 20 + (c_custkey % 50) / 1e1 END AS article_lon,
    concat('[',
      CASE c_custkey % 4 WHEN 0 THEN '{"property":"P31","rank":"normal","snaktype":"value","value":{"id":"Q3918"}},'
        WHEN 1 THEN '{"property":"P31","rank":"normal","snaktype":"value","value":{"id":"Q5341295"}},'
        WHEN 2 THEN '{"property":"P31","rank":"deprecated","snaktype":"value","value":{"id":"Q515"}},' ELSE '' END,
      '{"property":"P571","rank":"', CASE WHEN c_custkey % 7 = 0 THEN 'deprecated' ELSE 'normal' END, '","snaktype":"value","value":{"time":"+',
        CASE WHEN c_custkey % 6 = 0 THEN '0' ELSE '1' END, CAST(800 + c_custkey % 199 AS STRING), '-06-28T00:00:00Z"}},',
      CASE WHEN c_custkey % 5 = 0 THEN concat('{"property":"P571","rank":"preferred","snaktype":"', CASE WHEN c_custkey % 10 = 0 THEN 'novalue' ELSE 'value' END,
        '","value":{"time":"+1', CAST(700 + c_custkey % 99 AS STRING), '-00-00T00:00:00Z"}},') ELSE '' END,
      '{"property":"P2196","rank":"normal","snaktype":"value","value":{"amount":"+', CAST(c_custkey * 3 AS STRING), '"},"point_in_time":"+2015-01-01T00:00:00Z"},',
      CASE WHEN c_custkey % 2 = 0 THEN concat('{"property":"P2196","rank":"normal","snaktype":"value","value":{"amount":"+', CAST(c_custkey * 5 AS STRING), '"},"point_in_time":"+20',
        CAST(10 + c_custkey % 13 AS STRING), '-01-01T00:00:00Z"},') ELSE '' END,
      CASE WHEN c_custkey % 3 = 0 THEN concat('{"property":"P625","rank":"normal","snaktype":"value","value":{"latitude":', CAST(c_custkey % 90 AS STRING), '.5,"longitude":',
        CAST(c_custkey % 170 AS STRING), '.25}},') ELSE '' END,
      CASE WHEN c_custkey % 2 = 0 THEN concat('{"property":"P159","rank":"normal","snaktype":"value","value":{"id":"n', CAST(c_nationkey AS STRING), '"}},') ELSE '' END,
      '{"property":"P131","rank":"normal","snaktype":"value","value":{"id":"', CASE WHEN c_custkey % 13 = 0 THEN 'nowhere' ELSE concat('r', CAST(c_nationkey % 5 AS STRING)) END, '"}},',
      '{"property":"P17","rank":"normal","snaktype":"value","value":{"id":"n', CAST(c_nationkey AS STRING), '"}},',
      CASE WHEN c_custkey % 6 = 0 THEN concat('{"property":"P373","rank":"normal","snaktype":"value","value":"Cat of ', c_name, '"},') ELSE '' END,
      '{"property":"P856","rank":"normal","snaktype":"value","value":"https://www.Site', CAST(c_custkey AS STRING), '.edu/a"},',
      '{"property":"P856","rank":"normal","snaktype":"value","value":"http://site', CAST(c_custkey % 50 AS STRING), '.org"}]') AS claims_json
  FROM customer"""

# Provider answers: web image rows, open-license rows, media file rows.
ADAPTERS["web_rows"] = """
  SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN CAST(NULL AS STRING) ELSE 'library' END AS category_hint,
    concat('{"title":"  Order ', CAST(o_orderkey AS STRING), ' ","imageUrl":"', CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE concat('https://img', CAST(o_orderkey % 7 AS STRING), '.example.com/', CAST(o_orderkey AS STRING), '.jpg') END,
      '","link":', CASE WHEN o_orderkey % 13 = 0 THEN 'null' WHEN o_orderkey % 17 = 0 THEN '"not a url"' ELSE concat('"https://www.Host', CAST(o_orderkey % 20 AS STRING), '.com/p"') END,
      ',"domain":', CASE WHEN o_orderkey % 2 = 0 THEN '" shop.example.net "' ELSE '""' END,
      ',"imageWidth":', CASE o_orderkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '-5' WHEN 2 THEN '800' ELSE CASE WHEN o_orderkey % 8 = 3 THEN '"700"' ELSE '"wide"' END END, ',"imageHeight":600}') AS body
  FROM orders"""

ADAPTERS["open_rows"] = """
  SELECT p_partkey, p_partkey % 10 AS entity_id, concat('{"title":"', CASE p_partkey % 4 WHEN 0 THEN concat('View of Supplier 00000000', CAST(p_partkey % 10 AS STRING)) ELSE p_name END,
      '","url":"https://live.example.org/', CAST(p_partkey AS STRING), '.jpg","foreign_landing_url":"https://', CASE p_partkey % 5 WHEN 0 THEN 'www.alamy.com' WHEN 1 THEN 'pinterest.com' WHEN 2 THEN concat('u', CAST(p_partkey % 10 AS STRING), '.kz') ELSE 'photos.example.org' END,
      '/x","license":"', CASE WHEN p_partkey % 3 = 0 THEN 'by-sa' WHEN p_partkey % 23 = 1 THEN '' ELSE 'cc0' END, '"', CASE WHEN p_partkey % 2 = 1 THEN ',"license_url":"https://licenses.example.org/x","creator":" Ann "' ELSE '' END, CASE WHEN p_partkey % 2 = 0 THEN ',"license_version":"4.0"' ELSE '' END,
      ',"filetype":"', CASE WHEN p_partkey % 7 = 0 THEN 'SVG' ELSE 'JPG' END, '","width":', CAST(p_size * 40 AS STRING), ',"height":', CAST(p_size * 30 AS STRING),
      ',"mature":', CASE WHEN p_partkey % 19 = 0 THEN 'true' ELSE 'false' END, ',"tags":[{"name":"campus"},{"name":"', CASE WHEN p_partkey % 3 = 1 THEN concat('supplier-00000000', CAST(p_partkey % 10 AS STRING)) ELSE 'x' END, '"}]}') AS body
  FROM part"""

ADAPTERS["media_rows"] = """
  SELECT c_custkey, c_custkey % 10 AS entity_id, CASE c_custkey % 5 WHEN 0 THEN 'category' WHEN 1 THEN 'depicts' WHEN 2 THEN 'geosearch' WHEN 3 THEN 'city' ELSE 'article' END AS origin,
    concat('File:', CASE c_custkey % 9 WHEN 0 THEN 'Logo of ' WHEN 1 THEN 'Library of ' WHEN 2 THEN 'Student club ' ELSE 'Main building ' END, 'Supplier 00000000', CAST(c_custkey % 10 AS STRING), ' no ', CAST(c_custkey AS STRING), '.JPG') AS title,
    CASE WHEN c_custkey % 14 = 0 THEN 'image/svg+xml' ELSE 'image/jpeg' END AS mime,
    concat('https://upload.example.org/a/', CAST(c_custkey AS STRING), '.jpg?utm_source=z') AS url,
    CASE WHEN c_custkey % 3 = 0 THEN concat('https://upload.example.org/thumb/', CAST(c_custkey AS STRING), '.jpg/960px-x.jpg') END AS thumb_url,
    concat('https://', CASE WHEN c_custkey % 15 = 0 THEN 'en.wikipedia.org' ELSE 'commons.wikimedia.org' END, '/wiki/File:', CAST(c_custkey AS STRING)) AS description_url,
    c_custkey % 40 * 50 AS width, c_custkey % 37 * 50 AS height,
    concat('<b>View</b> &amp; ', CASE WHEN c_custkey % 6 = 0 THEN 'dormitory' ELSE 'place' END) AS description_html,
    CASE WHEN c_custkey % 8 = 0 THEN 'Maps of cities|Other' WHEN c_custkey % 7 = 3 THEN 'Buildings| Sports clubs|Old hostels' ELSE 'Buildings|Places' END AS categories,
    CASE c_custkey % 11 WHEN 0 THEN concat('<i>Court</i> of Supplier 00000000', CAST(c_custkey % 10 AS STRING)) WHEN 1 THEN ' ' END AS object_name,
    CASE c_custkey % 4 WHEN 1 THEN '2017-03-01 10:00:00' WHEN 2 THEN '2016:05:04' END AS date_time,
    concat('https://licenses.example.org/', CAST(c_custkey % 3 AS STRING)) AS license_url,
    CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 80 + 1 / 2e0 END AS lat, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 170 + 1 / 4e0 END AS lon,
    CASE c_custkey % 4 WHEN 1 THEN '12.5' WHEN 2 THEN '0' ELSE 'x' END AS gps_lat, CASE c_custkey % 4 WHEN 1 THEN '70.25' WHEN 2 THEN '0' ELSE 'y' END AS gps_lon,
    CASE WHEN c_custkey % 3 = 0 THEN '2014-06-09 09:59' END AS date_original, '2019-11-02T10:00:00Z' AS uploaded_at,
    CASE WHEN c_custkey % 2 = 0 THEN 'CC BY-SA 4.0' END AS license_name, '<a href="x">Someone</a>' AS artist
  FROM customer"""

# Observation bodies: wrapped, bare or fenced JSON; some with a missing id or unusable text.
ADAPTERS["observation_bodies"] = """
  SELECT o_orderkey AS body_id, concat(CASE o_orderkey % 3 WHEN 0 THEN '{"images":' WHEN 1 THEN '' ELSE '```json ' END, '[',
      '{"id":', CASE WHEN o_orderkey % 17 = 0 THEN 'null' ELSE concat('"a', CAST(o_orderkey AS STRING), '"') END,
      ',"image_type":"', CASE o_orderkey % 4 WHEN 0 THEN 'photo' WHEN 1 THEN 'collage' WHEN 2 THEN 'painting' ELSE 'other' END,
      '","stock_like":', CASE o_orderkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN '"yes"' ELSE 'false' END,
      ',"watermark_text":"', CASE WHEN o_orderkey % 2 = 0 THEN '  mark ' ELSE ' ' END, '","primary_category":"', CASE WHEN o_orderkey % 6 = 0 THEN 'garden' ELSE 'library' END,
      '","secondary_categories":["campus","zzz","lab"],"visible_text":" Uni ', CAST(o_orderkey AS STRING), ' ","names_institution":"', CASE WHEN o_orderkey % 7 = 0 THEN 'maybe' ELSE 'this' END,
      '","scene_consistent_with_context":"consistent","close_up_portrait":', CASE WHEN o_orderkey % 8 = 0 THEN 'true' ELSE 'null' END,
      ',"quality":', CASE o_orderkey % 5 WHEN 0 THEN '9' WHEN 1 THEN '3.5' WHEN 2 THEN '"4"' WHEN 3 THEN '-1' ELSE '"bad"' END, ',"reason":"r"}',
      ',{"id":"b', CAST(o_orderkey AS STRING), '"}]', CASE o_orderkey % 3 WHEN 0 THEN '}' WHEN 1 THEN '' ELSE ' ```' END,
      CASE WHEN o_orderkey % 23 = 0 THEN '{{{' ELSE '' END) AS body
  FROM orders"""

# Server-sent event text, one per event: comments, CRLF, split data lines, bad JSON.
ADAPTERS["event_text"] = """
  SELECT event_id, concat('event: ', event_type, chr(10), 'data: ', CASE WHEN event_id % 9 = 0 THEN '{"a":' ELSE props END, CASE WHEN event_id % 4 = 0 THEN chr(13) ELSE '' END, chr(10), chr(10),
    ': heartbeat', chr(10), chr(10), 'data:{"b":', chr(10), 'data: 1}', chr(10), chr(10), CASE WHEN event_id % 3 = 0 THEN concat('event: tail', chr(10), 'data: {}') ELSE '' END) AS text
  FROM events"""

ADAPTERS["reviews"] = """
  SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS review_id, conv_id AS entity_id,
    CASE role WHEN 'user' THEN 'study' WHEN 'assistant' THEN 'dorm' ELSE 'weather' END AS aspect,
    turn % 7 AS rating, text, concat('10.0.', CAST(conv_id AS STRING), '.', CAST(turn AS STRING), ', proxy') AS forwarded,
    CASE (conv_id * 5 + turn) % 6 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'spam' WHEN 2 THEN 'insult' ELSE 'ok' END AS label,
    (conv_id + turn) % 5 AS report_count
  FROM conversations"""


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One engine input as a DataFrame."""
    # The stand-in expressions are long. Above 8000 bytes of bytecode HotSpot stops compiling a method, and such a
    # stage would run interpreted; with this limit Spark splits it instead.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    sources = {t: read_table(spark, sf_dir, t) for t in TABLES if _mentions(ADAPTERS[name], t)}
    text = ADAPTERS[name].replace("{", "{{").replace("}", "}}")
    for table in sources:
        text = _replace_word(text, table)
    return spark.sql(text, **sources)


def _mentions(text: str, table: str) -> bool:
    return re.search(rf"\b(?:FROM|JOIN)\s+{table}\b", text) is not None


def _replace_word(text: str, table: str) -> str:
    return re.sub(rf"\b(FROM|JOIN)\s+{table}\b", rf"\1 {{{table}}}", text)


def ctes(*names: str) -> str:
    """The adapters as common table expressions for the checking SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({ADAPTERS[n]})" for n in names)
