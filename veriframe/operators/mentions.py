"""Which texts name which entities, and what a source host means for an entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe import config
from veriframe.functions.text import fold_text
from veriframe.functions.urls import host_in_list, host_suffixes, official_hosts, source_type, strip_www, url_host

MIN_NAME, MIN_ALIAS = 5, 3


def needles(names: Column, aliases: Column) -> tuple[Column, Column]:
    """Folded names and aliases long enough to be distinctive."""
    fold = lambda xs, n: F.filter(F.transform(F.array_compact(xs), fold_text), lambda x: F.length(x) >= n)
    return fold(names, MIN_NAME), fold(aliases, MIN_ALIAS)


def mentions_entity(text: Column, names: Column, aliases: Column, page: bool = False) -> Column:
    """Whole-word mention; on web pages a long name may also be part of a longer word."""
    hay = F.concat(F.lit(" "), fold_text(text), F.lit(" "))
    word = lambda n: hay.contains(F.concat(F.lit(" "), n, F.lit(" ")))
    by_name = F.exists(names, (lambda n: hay.contains(n)) if page else word)
    return F.coalesce(by_name, F.lit(False)) | F.coalesce(F.exists(aliases, word), F.lit(False))


def listed(df: DataFrame, many: str, one: str) -> Column:
    """The array column ``many`` where the table has it, else the column ``one`` as an array."""
    return F.col(many) if many in df.columns else F.array(one)


def entity_needles(entities: DataFrame) -> DataFrame:
    """All names and aliases, folded once per entity, not once per candidate."""
    names, aliases = needles(F.array("name_en", "name_ru", "name_kk", "name"), listed(entities, "aliases", "alias"))
    return entities.select("entity_id", names.alias("needle_names"), aliases.alias("needle_aliases"))


def mention_join(texts: DataFrame, needle_rows: DataFrame) -> DataFrame:
    """(text_id, entity_id) for every needle that stands as whole words in a text.

    Needles are keyed by their longest word. Only texts that contain this word meet the needle, and the whole
    phrase is checked on the meeting rows. Texts (text_id, text); needles (entity_id, needle), folded.
    """
    words = F.split("needle", " ")
    anchor = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    anchors = needle_rows.filter("needle <> ''").select("needle", anchor.alias("token")).distinct()
    folded = texts.select("text_id", F.concat(F.lit(" "), fold_text(F.col("text")), F.lit(" ")).alias("hay"))
    tokens = folded.select("text_id", F.explode(F.array_distinct(F.split(F.trim("hay"), " "))).alias("token"))
    maybe = tokens.join(anchors, "token").select("text_id", "needle")
    hits = maybe.join(folded, "text_id").filter(
        F.col("hay").contains(F.concat(F.lit(" "), F.col("needle"), F.lit(" ")))
    ).select("text_id", "needle")
    return hits.join(needle_rows, "needle").select("text_id", "entity_id").distinct()


def domain_join(hosts: DataFrame, domain_lists: DataFrame) -> DataFrame:
    """Each distinct host with the lists that contain it or one of its parents (host, list)."""
    distinct = hosts.select(strip_www(F.col("host")).alias("host")).distinct()
    parts = distinct.select("host", F.explode(host_suffixes(F.col("host"))).alias("domain"))
    return parts.join(domain_lists, "domain").select("host", "list").distinct()


def classify_domains(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, host) -> source type and stock/aggregator flags; own domains are looked up, not listed."""
    distinct = pairs.select("entity_id", strip_www(F.col("host")).alias("host")).distinct()
    domains = entities.select("entity_id", F.explode(listed(entities, "domains", "domain")).alias("domain"))
    owned = domains.filter("domain <> ''").select("entity_id", F.explode(official_hosts(F.col("domain"))).alias("own"))
    own = distinct.select("entity_id", "host", F.explode(host_suffixes(F.col("host"))).alias("own")).join(
        owned, ["entity_id", "own"]
    ).select("entity_id", "host").distinct().withColumn("_own", F.lit(True))
    host = F.col("host")
    return distinct.join(own, ["entity_id", "host"], "left").select(
        "entity_id", "host", source_type(host, F.coalesce("_own", F.lit(False))).alias("source_type"),
        host_in_list(host, config.STOCK_DOMAINS).alias("is_stock"),
        host_in_list(host, config.AGGREGATOR_DOMAINS).alias("is_aggregator"),
    )


def apply_provenance(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Official flag and mention flag of web rows (title, caption, page URL, the query that found them).

    Every row stays: without a domain its source is unknown, without a known entity it names none.
    """
    rows = candidates.withColumn("_host", strip_www(F.col("source_domain")))
    classes = classify_domains(rows.select("entity_id", F.col("_host").alias("host")), entities)
    joined = rows.drop("source_type").join(
        classes.withColumnRenamed("host", "_host"), ["entity_id", "_host"], "left"
    ).join(entity_needles(entities), "entity_id", "left").withColumn("source_type", F.coalesce("source_type", F.lit("unknown")))
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("caption", F.lit("")), "source_page_url")
    official = F.col("source_type") == "official"
    named = F.coalesce(mentions_entity(text, F.col("needle_names"), F.col("needle_aliases"), page=True), F.lit(False))
    return joined.withColumns({
        "official_domain": official,
        "page_mentions_name": named | (official & F.coalesce(F.col("query").contains("site:"), F.lit(False))),
    }).drop("_host", "needle_names", "needle_aliases")


def plan_queries(entities: DataFrame, cap: int = config.QUERY_CAP) -> DataFrame:
    """Search queries per entity: thin areas in the primary language, the own site, then the other language."""
    ru_first = F.upper(F.col("country_code")).isin(config.RU_FIRST_COUNTRIES)
    ru_name, en_name = F.coalesce("name_ru", "name_en"), F.coalesce("name_en", "name_ru")
    primary = F.when(ru_first, "ru").otherwise("en")
    secondary = F.when(ru_first, "en").otherwise("ru")

    def rows(lang: Column, start: int) -> list[Column]:
        out = []
        for i, area in enumerate(config.THIN_AREAS):
            ru = F.replace(F.lit(config.QUERY_TEMPLATES["ru"][area]), F.lit("{name}"), ru_name)
            en = F.replace(F.lit(config.QUERY_TEMPLATES["en"][area]), F.lit("{name}"), en_name)
            text = F.when(lang == "ru", ru).otherwise(en)
            out.append(F.struct(F.lit(start + i).alias("pos"), F.trim(text).alias("q"), lang.alias("lang"),
                                F.lit(area).alias("category_hint")))
        return out

    own_name = F.when(ru_first, ru_name).otherwise(en_name)
    site = F.concat(F.lit("site:"), "domain", F.lit(" "), F.trim(F.regexp_replace(own_name, '["«»]', "")))
    plan = rows(primary, 0) + [F.struct(F.lit(4).alias("pos"), F.trim(site).alias("q"), primary.alias("lang"),
                                        F.lit("campus").alias("category_hint"))] + rows(secondary, 5)
    # Nine planned rows per entity at most, so the per-entity window is small.
    flat = entities.select("entity_id", F.lower("country_code").alias("country_code"), F.inline(F.array(*plan)))
    flat = flat.filter(F.coalesce(F.col("q"), F.lit("")) != "")
    first = flat.groupBy("entity_id", "q").agg(F.min(F.struct("pos", "lang", "category_hint", "country_code")).alias("r"))
    window = Window.partitionBy("entity_id").orderBy("r.pos")
    return first.withColumn("place", F.row_number().over(window).cast("bigint")).filter(F.col("place") <= cap).select(
        "entity_id", "place", "q", "r.lang", "r.category_hint", "r.country_code"
    )


def item_meta() -> Column:
    """One line of context for an observation provider; absent parts are skipped."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.concat_ws(" | ", blank("source_domain"), blank("title"), blank("caption"),
                       F.concat(F.lit("hint: "), F.col("category_hint")))


def host_of(col: Column) -> Column:
    return url_host(col)
