"""Queries over text, names, domains and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe import config
from veriframe.functions import text as tx
from veriframe.operators import geo_join, grounding, mentions
from veriframe.plans.adapters import adapter, ctes
from veriframe.plans.registry import query
from veriframe.sources.tables import read_table


def fold_sql(x: str) -> str:
    return (
        f"trim(regexp_replace(strip_accents(translate(lower(nfc_normalize({x})), '{tx.KAZAKH_FROM}', '{tx.KAZAKH_TO}')), "
        r"'[^\p{L}\p{N}]+', ' ', 'g'))"
    )


_FILL = ", ".join(f"'{w}'" for w in tx.FILLER_WORDS)


def drop_filler_sql(folded: str) -> str:
    words = f"list_filter(string_split({folded}, ' '), lambda w: w <> '')"
    kept = f"list_filter({words}, lambda w: w NOT IN ({_FILL}))"
    return f"array_to_string(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {words} END, ' ')"


def cyr_to_lat_sql(x: str) -> str:
    out = f"translate({x}, '{tx.CYRILLIC_SINGLE_FROM}{tx.CYRILLIC_SILENT}', '{tx.CYRILLIC_SINGLE_TO}')"
    for letter, latin in tx.CYRILLIC_MULTI.items():
        out = f"replace({out}, '{letter}', '{latin}')"
    return out


def lat_to_cyr_sql(x: str) -> str:
    out = x
    for latin, letter in [d for d in tx.LATIN_DIGRAPHS if "y" in d[0]]:
        out = f"replace({out}, '{latin}', '{letter}')"
    out = f"regexp_replace({out}, '([aeiouюяе])y', '\\1й', 'g')"
    for latin, letter in [d for d in tx.LATIN_DIGRAPHS if "y" not in d[0]]:
        out = f"replace({out}, '{latin}', '{letter}')"
    for latin, letters in tx.LATIN_MULTI.items():
        out = f"replace({out}, '{latin}', '{letters}')"
    return f"translate({out}, '{tx.LATIN_SINGLE_FROM}y', '{tx.LATIN_SINGLE_TO}ы')"


def translit_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '\\p{{Cyrillic}}') THEN {cyr_to_lat_sql(x)} ELSE {lat_to_cyr_sql(x)} END"


# Names of index entries in long form, folded and normalized.
NAMES_CTES = ctes("index_entries") + f""",
raw_names AS (
  SELECT qid, name_en AS text, 'label' AS kind FROM index_entries WHERE name_en IS NOT NULL
  UNION ALL SELECT qid, name_ru, 'label' FROM index_entries WHERE name_ru IS NOT NULL
  UNION ALL SELECT qid, name_kk, 'label' FROM index_entries WHERE name_kk IS NOT NULL
  UNION ALL SELECT qid, a, 'alias' FROM (SELECT qid, unnest(aliases) AS a FROM index_entries) WHERE a <> ''),
texts AS (SELECT DISTINCT text FROM raw_names),
folded AS (SELECT text, {fold_sql('text')} AS folded FROM texts),
normed AS (SELECT text, folded, {drop_filler_sql('folded')} AS norm FROM folded),
names AS (SELECT r.qid, r.text, r.kind, n.folded, n.norm FROM raw_names r JOIN normed n USING (text))
"""


@query("fold_text", f"""
SELECT doc_id, md5({fold_sql('text')}) AS digest, CAST(length({fold_sql('text')}) AS BIGINT) AS n FROM documents""")
def fold_text(spark, sf_dir):
    folded = read_table(spark, sf_dir, "documents").select("doc_id", tx.fold_text(F.col("text")).alias("f"))
    return folded.select("doc_id", F.md5("f").alias("digest"), F.length("f").cast("bigint").alias("n"))


@query("normalize_name", NAMES_CTES + "SELECT DISTINCT text, norm FROM names")
def normalize_name(spark, sf_dir):
    return raw_names(spark, sf_dir).select("text").distinct().select(
        "text", tx.normalize_name(F.col("text")).alias("norm")
    )


def raw_names(spark, sf_dir):
    from veriframe.operators.resolve import name_rows

    return name_rows(adapter(spark, sf_dir, "index_entries"))


@query("translit", NAMES_CTES + f"SELECT DISTINCT norm, {translit_sql('norm')} AS other FROM normed")
def translit(spark, sf_dir):
    norm = raw_names(spark, sf_dir).select(tx.normalize_name(F.col("text")).alias("norm")).distinct()
    return norm.select("norm", tx.transliterate(F.col("norm")).alias("other"))


@query("strip_html", r"""
WITH s AS (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM pages),
e AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    t, '&lt;', '<', 'gi'), '&gt;', '>', 'gi'), '&quot;', '"', 'gi'), '&apos;', '''', 'gi'), '&nbsp;', ' ', 'gi'), '&amp;', '&', 'gi') AS t FROM s),
c AS (SELECT page_id, trim(regexp_replace(t, '[\s\p{Z}\x{feff}]+', ' ', 'g')) AS t FROM e)
SELECT page_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS n FROM c""")
def strip_html(spark, sf_dir):
    plain = read_table(spark, sf_dir, "pages").select("page_id", tx.strip_html(F.col("html")).alias("t"))
    return plain.select("page_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n"))


_HINT_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(t, '(?i){config.CATEGORY_KEYWORDS[c]}') THEN '{c}'" for c in config.HINT_ORDER) + " END"
_HINT_TEXT = """concat(text, ' ', CASE doc_id % 9 WHEN 0 THEN 'Main Building' WHEN 1 THEN 'общежитие' WHEN 2 THEN 'Lecture'
  WHEN 3 THEN 'читальный зал' WHEN 4 THEN 'stadium' WHEN 5 THEN 'лаборатория' WHEN 6 THEN 'skyline' ELSE '' END)"""


@query("category_hint", f"WITH d AS (SELECT doc_id, {_HINT_TEXT} AS t FROM documents) SELECT doc_id, {_HINT_SQL} AS hint FROM d")
def category_hint(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.expr(_HINT_TEXT).alias("t"))
    return docs.select("doc_id", tx.category_hint(F.col("t"), config.CATEGORY_KEYWORDS, config.HINT_ORDER).alias("hint"))


_DATE_TEXT = """CASE o_orderkey % 5 WHEN 0 THEN concat('taken ', substring(CAST(o_orderdate AS STRING), 1, 10), ' 09:59')
  WHEN 1 THEN concat(substring(CAST(o_orderdate AS STRING), 1, 7), '-99 ?') WHEN 2 THEN substring(CAST(o_orderdate AS STRING), 1, 4)
  WHEN 3 THEN concat('1799-01-01 or ', substring(CAST(o_orderdate AS STRING), 1, 7)) ELSE 'no date' END"""


@query("iso_date", rf"""
SELECT o_orderkey, nullif(regexp_extract({_DATE_TEXT},
  '\b(1[89]\d{{2}}|20\d{{2}})-(0[1-9]|1[0-2])(?:-(0[1-9]|[12]\d|3[01]))?', 0), '') AS value FROM orders""")
def iso_date(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey", tx.iso_date(F.expr(_DATE_TEXT)).alias("value")
    )


@query("clip_extract", r"""
WITH a AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\(\s*[,;]?\s*\)', '', 'g'), '\s+', ' ', 'g'),
    '\s+([,.;:])', '\1', 'g')) AS t FROM documents),
b AS (SELECT *, substring(t, 1, 1500) AS cut, regexp_extract(substring(t, 1, 1500), '(?s)^(.*[.!?]) ', 1) AS head FROM a)
SELECT doc_id, md5(CASE WHEN length(t) <= 1500 THEN t WHEN length(head) - 1 > 500 THEN head ELSE rtrim(cut) || '…' END) AS digest
FROM b""")
def clip_extract(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(tx.clip_extract(F.col("text"))).alias("digest")
    )


def _keep_abbreviations(x: str) -> str:
    """Marks the end signs after initials and abbreviations with chr(1)."""
    return (rf"""regexp_replace({x}, '((?:^|[\s(])(?:\p{{Lu}}|{tx.ABBREVIATIONS}))([.!?…]+)(\s+[\p{{Lu}}\d«"(])', '\1\2' || chr(1) || '\3', 'g')""")


def quote_ctes(source: str, key: str) -> str:
    """Sentences and quote of ``source`` (key, text). Neighbouring initials overlap, so they are marked in two passes."""
    return rf"""
marked AS (SELECT {key}, regexp_replace({_keep_abbreviations(_keep_abbreviations('text'))}, '([.!?…]+)(\s+)([\p{{Lu}}\d«"(])', '\1' || chr(2) || '\2\3', 'g') AS t FROM {source}),
cut AS (SELECT {key}, list_filter(list_transform(string_split(replace(t, chr(1), ''), chr(2)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')),
    lambda s: s <> '') AS s FROM marked),
quoted AS (SELECT {key}, CASE WHEN len(s) > 2 AND length(array_to_string(s[1:2], ' ')) < 220 THEN array_to_string(s[1:3], ' ')
    ELSE array_to_string(s[1:2], ' ') END AS quote FROM cut)
"""


@query("quote_choice", rf"""WITH chosen AS (
  SELECT CAST(floor(doc_id / 3) AS BIGINT) AS entity_id, arg_min(struct_pack(l := lang, x := text), struct_pack(a := lang <> 'en', b := doc_id)) AS c
  FROM documents WHERE lang IS NOT NULL AND NOT regexp_full_match(coalesce(text, ''), '\s*') GROUP BY 1),
flat AS (SELECT entity_id, c.l AS lang, c.x AS text FROM chosen), {quote_ctes('flat', 'entity_id')}
SELECT entity_id, lang, quote FROM quoted JOIN flat USING (entity_id)""")
def quote_choice(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").filter("lang is not null").select(
        F.floor(F.col("doc_id") / 3).alias("entity_id"), "lang", F.col("doc_id").alias("ord"), F.col("text").alias("extract"))
    return grounding.quote_summaries(docs, "en")


@query("lead_quote", f"WITH {quote_ctes('documents', 'doc_id')} SELECT doc_id, quote FROM quoted")
def lead_quote(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", tx.lead_quote(F.col("text")).alias("quote"))


@query("mask_pii", rf"""
WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{tx.EMAIL}', '[удалено]', 'g'),
    '{tx.PHONE}', '[удалено]', 'g'), '(^|[\s(])@[\w.]{{2,}}', '\1[удалено]', 'g') AS t FROM documents)
SELECT doc_id, md5(t) AS digest, CAST((length(t) - length(replace(t, '[удалено]', ''))) // 9 AS BIGINT) AS masked FROM m""")
def mask_pii(spark, sf_dir):
    masked = read_table(spark, sf_dir, "documents").select(
        "doc_id", tx.mask_personal_data(F.col("text"), config.MASK_TOKEN).alias("t")
    )
    n = (F.length("t") - F.length(F.replace("t", F.lit(config.MASK_TOKEN), F.lit("")))) / len(config.MASK_TOKEN)
    return masked.select("doc_id", F.md5("t").alias("digest"), n.cast("bigint").alias("masked"))


@query("pseudonymize", ctes("reviews") + """
SELECT review_id, substring(sha256(trim(split_part(forwarded, ',', 1))), 1, 32) AS author_key FROM reviews""")
def pseudonymize(spark, sf_dir):
    from veriframe.operators.community import pseudonymize as hide

    return hide(adapter(spark, sf_dir, "reviews"), "forwarded").select("review_id", "author_key")


# In January 2024 the team zone is six hours ahead of UTC.
@query("local_date", """
SELECT strftime(ts + INTERVAL 6 HOUR, '%Y-%m-%d') AS local_date, count(*) AS n FROM events GROUP BY ALL""")
def local_date(spark, sf_dir):
    from veriframe.operators.community import local_date as day

    events = read_table(spark, sf_dir, "events").select(day(F.col("ts"), "Asia/Almaty").alias("local_date"))
    return events.groupBy("local_date").agg(F.count(F.lit(1)).alias("n"))


# --- mentions ---------------------------------------------------------------------------

_MENTION_TEXT = """concat(coalesce(c.title, ''), ' ', CASE c.seq % 7 WHEN 0 THEN e.name WHEN 1 THEN concat('the ', upper(e.name_ru), '!')
  WHEN 2 THEN concat('x', e.name, 'y') WHEN 3 THEN concat('(', e.alias, ')') WHEN 4 THEN concat(e.alias, 'x')
  WHEN 5 THEN concat('Жулдыз-', CAST(e.entity_id AS STRING)) ELSE '' END)"""


@query("mentions", ctes("candidates", "entities") + f"""
, t AS (SELECT c.cand_id, c.entity_id, ' ' || {fold_sql("coalesce(" + _MENTION_TEXT + ", '')")} || ' ' AS hay
  FROM candidates c JOIN entities e USING (entity_id)),
n AS (SELECT entity_id, list_filter([{fold_sql('name_en')}, {fold_sql('name_ru')}, {fold_sql('name_kk')}, {fold_sql('name')}],
    lambda x: length(x) >= 5) AS names, list_filter(list_transform(aliases, lambda a: {fold_sql('a')}), lambda x: length(x) >= 3) AS aliases FROM entities)
SELECT cand_id,
  len(list_filter(names, lambda x: contains(hay, ' ' || x || ' '))) + len(list_filter(aliases, lambda x: contains(hay, ' ' || x || ' '))) > 0 AS whole,
  len(list_filter(names, lambda x: contains(hay, x))) + len(list_filter(aliases, lambda x: contains(hay, ' ' || x || ' '))) > 0 AS page
FROM t JOIN n USING (entity_id)""")
def mentions_query(spark, sf_dir):
    entities = adapter(spark, sf_dir, "entities")
    rows = adapter(spark, sf_dir, "candidates").alias("c").join(entities.alias("e"), "entity_id").select(
        "cand_id", "entity_id", F.coalesce(F.expr(_MENTION_TEXT), F.lit("")).alias("text")
    )
    joined = rows.join(mentions.entity_needles(entities), "entity_id")
    check = lambda page: mentions.mentions_entity(
        F.col("text"), F.col("needle_names"), F.col("needle_aliases"), page)
    return joined.select("cand_id", check(False).alias("whole"), check(True).alias("page"))


@query("mention_join", f"""
WITH t AS (SELECT doc_id AS text_id, ' ' || {fold_sql('text')} || ' ' AS hay FROM documents),
n AS (SELECT item_id AS entity_id, array_to_string(string_split({fold_sql('text')}, ' ')[2:4], ' ') AS needle FROM benchmark
  UNION ALL SELECT item_id + 1000, array_to_string(string_split({fold_sql('text')}, ' ')[1:1], ' ') FROM benchmark)
SELECT DISTINCT text_id, entity_id FROM t JOIN n ON needle <> '' AND contains(hay, ' ' || needle || ' ')""")
def mention_join(spark, sf_dir):
    texts = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    words = read_table(spark, sf_dir, "benchmark").select("item_id", F.split(tx.fold_text(F.col("text")), " ").alias("w"))
    needle_rows = words.select(F.col("item_id").alias("entity_id"), F.array_join(F.slice("w", 2, 3), " ").alias("needle"))
    one = words.select((F.col("item_id") + 1000).alias("entity_id"), F.array_join(F.slice("w", 1, 1), " ").alias("needle"))
    return mentions.mention_join(texts, needle_rows.unionByName(one))


_LISTS = [("spam-farm.example.org", "stock"), ("cheap-pills.example.com", "stock"), ("example.org", "news"),
          ("theron.example.com", "social"), ("ththst.example.net", "encyclopedic")]
_LIST_ROWS = ", ".join(f"('{d}', '{n}')" for d, n in _LISTS)


@query("domain_join", rf"""
WITH lists(domain, list) AS (VALUES {_LIST_ROWS}),
h AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') AS host FROM pages)
SELECT DISTINCT host, list FROM h JOIN lists ON host = domain OR ends_with(host, '.' || domain)""")
def domain_join(spark, sf_dir):
    hosts = read_table(spark, sf_dir, "pages").select(mentions.host_of(F.col("url")).alias("host"))
    return mentions.domain_join(hosts, spark.createDataFrame(_LISTS, "domain string, list string"))


_CLASS_SQL = r"""CASE WHEN len(list_filter(list_transform(domains, lambda d: regexp_replace(d, '^www\.', '')), lambda d: d <> '' AND (host = d
    OR ends_with(host, '.' || d) OR host = replace(d, '.kz', '.edu.kz') OR ends_with(host, '.' || replace(d, '.kz', '.edu.kz'))))) > 0 THEN 'official'
  WHEN host = 'commons.wikimedia.org' THEN 'encyclopedic' WHEN host = 'tengrinews.kz' THEN 'news' WHEN host = 'vk.com' THEN 'social'
  WHEN host IN ('img.shutterstock.com', 'ru.pinterest.com') THEN 'unknown' ELSE 'independent' END"""


@query("classify_domain", ctes("candidates", "entities") + rf"""
, p AS (SELECT DISTINCT entity_id, regexp_replace(source_domain, '^www\.', '') AS host FROM candidates)
SELECT p.entity_id, host, {_CLASS_SQL} AS source_type, host = 'img.shutterstock.com' AS is_stock,
  host = 'ru.pinterest.com' AS is_aggregator FROM p JOIN entities e USING (entity_id)""")
def classify_domain(spark, sf_dir):
    pairs = adapter(spark, sf_dir, "candidates").select("entity_id", F.col("source_domain").alias("host"))
    return mentions.classify_domains(pairs, adapter(spark, sf_dir, "entities"))


@query("provenance", ctes("candidates", "entities") + rf"""
, t AS (SELECT c.cand_id, e.*, regexp_replace(source_domain, '^www\.', '') AS host, c.seq % 4 = 0 AS site_query,
    ' ' || {fold_sql("concat_ws(' ', coalesce(title, ''), coalesce(CASE WHEN c.seq % 9 = 0 THEN name ELSE caption END, ''), source_page_url)")} || ' ' AS hay
  FROM candidates c JOIN entities e USING (entity_id)),
k AS (SELECT *, {_CLASS_SQL} AS cls FROM t)
SELECT cand_id, cls AS source_type, cls = 'official' AS official_domain,
  contains(hay, {fold_sql('name')}) OR coalesce(length({fold_sql('name_ru')}) >= 5 AND contains(hay, {fold_sql('name_ru')}), false)
  OR coalesce(length({fold_sql('name_kk')}) >= 5 AND contains(hay, {fold_sql('name_kk')}), false)
  OR len(list_filter(list_transform(aliases, lambda a: {fold_sql('a')}), lambda x: length(x) >= 3 AND contains(hay, ' ' || x || ' '))) > 0 OR (cls = 'official' AND site_query) AS page_mentions_name
FROM k""")
def provenance(spark, sf_dir):
    entities = adapter(spark, sf_dir, "entities")
    rows = adapter(spark, sf_dir, "candidates").join(entities.select("entity_id", "name"), "entity_id").select(
        "cand_id", "entity_id", "source_domain", "source_page_url", "title",
        F.when(F.col("seq") % 9 == 0, F.col("name")).otherwise(F.col("caption")).alias("caption"),
        F.when(F.col("seq") % 4 == 0, F.concat(F.lit("site:x "), "name")).otherwise(F.col("name")).alias("query"),
    )
    return mentions.apply_provenance(rows, entities).select(
        "cand_id", "source_type", "official_domain", "page_mentions_name"
    )


def _templates(lang: str, name: str) -> list[str]:
    return [f"replace('{config.QUERY_TEMPLATES[lang][a]}', '{{name}}', {name})" for a in config.THIN_AREAS]


_RU = f"upper(country_code) IN ({', '.join(repr(c) for c in config.RU_FIRST_COUNTRIES)})"
_RUN, _ENN = "coalesce(name_ru, name_en)", "coalesce(name_en, name_ru)"
_PLAN = ["SELECT entity_id, country_code, %d AS pos, CASE WHEN %s THEN %s ELSE %s END AS q, CASE WHEN %s THEN 'ru' ELSE 'en' END AS lang, '%s' AS category_hint FROM entities"
         % (i, _RU, r, e, _RU, config.THIN_AREAS[i]) for i, (r, e) in enumerate(zip(_templates("ru", _RUN), _templates("en", _ENN)))]
_PLAN += [f"SELECT entity_id, country_code, 4, 'site:' || domain || ' ' || trim(regexp_replace(CASE WHEN {_RU} THEN {_RUN} ELSE {_ENN} END, '[\"«»]', '', 'g')),"
          f" CASE WHEN {_RU} THEN 'ru' ELSE 'en' END, 'campus' FROM entities"]
_PLAN += ["SELECT entity_id, country_code, %d, CASE WHEN %s THEN %s ELSE %s END, CASE WHEN %s THEN 'en' ELSE 'ru' END, '%s' FROM entities"
          % (5 + i, _RU, e, r, _RU, config.THIN_AREAS[i]) for i, (r, e) in enumerate(zip(_templates("ru", _RUN), _templates("en", _ENN)))]


@query("plan_queries", ctes("entities") + f""", plan AS ({' UNION ALL '.join(_PLAN)}),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, q ORDER BY pos) AS rn FROM plan WHERE q IS NOT NULL) WHERE rn = 1)
SELECT entity_id, place, q, lang, category_hint, lower(country_code) AS country_code FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY pos) AS place FROM firsts) WHERE place <= 6""")
def plan_queries(spark, sf_dir):
    return mentions.plan_queries(adapter(spark, sf_dir, "entities"))


@query("item_meta", ctes("candidates") + """
SELECT cand_id, concat_ws(' | ', source_domain, title, caption, 'hint: ' || category_hint) AS meta FROM candidates""")
def item_meta(spark, sf_dir):
    return adapter(spark, sf_dir, "candidates").select("cand_id", mentions.item_meta().alias("meta"))


@query("geo_within", ctes("candidates", "entities") + """
SELECT cand_id AS point_id, center_id, distance_m FROM (
  SELECT c.cand_id, e.entity_id AS center_id, CAST(floor(2 * 6371000 * asin(sqrt(power(sin(radians(c.lat - e.lat) / 2), 2)
  + cos(radians(e.lat)) * cos(radians(c.lat)) * power(sin(radians(c.lon - e.lon) / 2), 2))) + 0.5) AS BIGINT) AS distance_m,
    2 * 6371000 * asin(sqrt(power(sin(radians(c.lat - e.lat) / 2), 2)
  + cos(radians(e.lat)) * cos(radians(c.lat)) * power(sin(radians(c.lon - e.lon) / 2), 2))) AS exact
  FROM candidates c JOIN entities e ON abs(c.lat - e.lat) < 0.1)
WHERE exact <= 2000""")
def geo_within(spark, sf_dir):
    points = adapter(spark, sf_dir, "candidates").select(F.col("cand_id").alias("point_id"), "lat", "lon")
    centers = adapter(spark, sf_dir, "entities").select(F.col("entity_id").alias("center_id"), "lat", "lon")
    found = geo_join.within_radius(points, centers, config.CITY_RADIUS_M)
    return found.withColumn("distance_m", F.floor(F.col("distance_m") + 0.5).cast("bigint"))
