"""Readers of knowledge-base rows and claims, and the index built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe import config
from veriframe.functions.text import let, match_key
from veriframe.functions.urls import url_host

# --- fixed values: names of the result fields --------------------------------------
BINDING_FIELDS = [
    "item", "nameEn", "nameRu", "nameKk", "altsEn", "altsRu", "altsKk", "shortName", "countryLabel", "countryCode",
    "city", "coord", "website", "commons", "logo", "inception", "students", "sitelinks", "wpEn", "wpRu", "wpKk",
]


def read_index_bindings(rows: DataFrame, body: str = "body") -> DataFrame:
    """Result rows (JSON text) to typed index rows; bad values become null, never an error."""
    schema = "struct<" + ",".join(f"{f}:struct<value:string>" for f in BINDING_FIELDS) + ">"
    kept = [c for c in rows.columns if c != body]
    flat = rows.select(*kept, F.from_json(body, schema).alias("b")).select(
        *kept, *[F.nullif(F.col(f"b.{f}.value"), F.lit("")).alias(f) for f in BINDING_FIELDS]
    )
    multi = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), r"\|\|")
    aliases = F.concat(multi("altsEn"), multi("altsRu"), multi("altsKk"),
                       F.array(F.coalesce("shortName", F.lit(""))))
    names = F.array(F.lit(""), F.coalesce("nameEn", F.lit("")), F.coalesce("nameRu", F.lit("")),
                    F.coalesce("nameKk", F.lit("")))
    last = lambda c: F.element_at(F.split(F.col(c), "/"), -1)
    point = lambda g: F.regexp_extract("coord", r"^Point\(([-\d.]+) ([-\d.]+)\)", g).try_cast("double")
    article = lambda lang, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(lang).alias("lang"), F.col(c).alias("title")))
    return flat.select(
        *kept, last("item").alias("qid"), F.col("nameEn").alias("name_en"), F.col("nameRu").alias("name_ru"),
        F.col("nameKk").alias("name_kk"), F.array_sort(F.array_except(aliases, names)).alias("aliases"),
        F.coalesce("countryLabel", F.lit("")).alias("country"), F.coalesce("countryCode", F.lit("")).alias("country_code"),
        last("city").alias("city_qid"), point(2).alias("lat"), point(1).alias("lon"), "website",
        F.when(url_host(F.col("website")).isNotNull(), F.array(url_host(F.col("website"))))
        .otherwise(F.array().cast("array<string>")).alias("domains"),
        F.col("commons").alias("commons_category"), F.url_decode(last("logo")).alias("logo"),
        F.substring("inception", 1, 4).alias("inception"),
        F.col("students").try_cast("double").try_cast("bigint").alias("students"),
        F.coalesce(F.col("sitelinks").try_cast("bigint"), F.lit(0)).alias("sitelinks"),
        F.array_compact(F.array(article("en", "wpEn"), article("ru", "wpRu"), article("kk", "wpKk"))).alias("wikipedia"),
    )


def read_domain_list(rows: DataFrame, body: str = "body", ordinal: str = "ordinal") -> DataFrame:
    """(name_key, country_key, domains); the last row of a key wins."""
    parsed = rows.select(ordinal, F.from_json(body, "name string, country string, domains array<string>").alias("r"))
    keyed = parsed.select(
        ordinal, match_key(F.coalesce("r.name", F.lit(""))).alias("name_key"),
        F.lower(F.trim(F.coalesce("r.country", F.lit("")))).alias("country_key"),
        F.coalesce("r.domains", F.array().cast("array<string>")).alias("domains"),
    )
    return keyed.groupBy("name_key", "country_key").agg(F.max_by("domains", ordinal).alias("domains"))


def index_union(regional: DataFrame, worldwide: DataFrame, min_links: int = 30) -> DataFrame:
    """Regional rows first; worldwide rows only when well linked and unseen; unnamed rows dropped."""
    extra = worldwide.filter(F.col("sitelinks") >= min_links).join(regional.select("qid"), "qid", "left_anti")
    named = F.col("name_en").isNotNull() | F.col("name_ru").isNotNull() | F.col("name_kk").isNotNull()
    return regional.unionByName(extra).filter(F.col("qid").isNotNull() & named)


def enrich_domains(index: DataFrame, domain_list: DataFrame) -> DataFrame:
    """Left join by (normalized English name, country); both domain lists united and sorted."""
    keyed = index.withColumns({
        "name_key": match_key(F.coalesce("name_en", F.lit(""))),
        "country_key": F.lower(F.trim(F.coalesce("country", F.lit("")))),
    })
    extra = domain_list.withColumnRenamed("domains", "_extra")
    none = F.array().cast("array<string>")
    return keyed.join(extra, ["name_key", "country_key"], "left").withColumn(
        "domains", F.array_sort(F.array_union(F.coalesce("domains", none), F.coalesce("_extra", none)))
    ).drop("_extra", "name_key", "country_key")


def counts_by_country(index: DataFrame, n: int = 15) -> DataFrame:
    return index.groupBy("country_code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "country_code").limit(n)


def spot_check(expected: DataFrame, index: DataFrame) -> DataFrame:
    """Expected names with the id that carries them; a label beats an alias, a later row an earlier one."""
    def keyed(texts: Column, src: int) -> DataFrame:
        rows = index.select("ordinal", "qid", F.explode(texts).alias("text"))
        return rows.select(match_key(F.col("text")).alias("key"), F.lit(src).alias("src"), "ordinal", "qid")

    labels = keyed(F.array_compact(F.array("name_en", "name_ru", "name_kk")), 0)
    aliases = keyed(F.col("aliases"), 1)
    # Last label wins; among aliases the first one stays.
    order = F.when(F.col("src") == 0, -F.col("ordinal")).otherwise(F.col("ordinal"))
    best = labels.unionByName(aliases).groupBy("key").agg(F.min_by("qid", F.struct("src", order.alias("o"))).alias("qid"))
    return expected.withColumn("key", match_key(F.col("name"))).join(best, "key", "left").drop("key")


def walk_up_hierarchy(starts: DataFrame, places: DataFrame, max_hops: int = 3) -> DataFrame:
    """Name, point and category of each start place, missing ones filled from its parents.

    The number of hops is fixed, so the walk is that many joins. A place stops asking once it has a point and a
    category. Distinct starts only: places shared by many entities are walked once.
    """
    info = places.select(
        F.col("place_id").alias("look"), F.coalesce("name_ru", "name_en").alias("n"), F.col("lat").alias("p_lat"),
        F.col("lon").alias("p_lon"), F.col("commons_category").alias("p_cat"), F.col("parent_id").alias("parent"),
    )
    null = F.lit(None)
    state = starts.select("place_id").distinct().select(
        "place_id", F.col("place_id").alias("look"), null.cast("string").alias("name"), null.cast("double").alias("lat"),
        null.cast("double").alias("lon"), null.cast("string").alias("commons_category"),
    )
    for _ in range(max_hops):
        joined = state.join(info, "look", "left")
        lat = F.when(F.col("lat").isNotNull(), F.col("lat")).otherwise(F.col("p_lat"))
        lon = F.when(F.col("lat").isNotNull(), F.col("lon")).otherwise(F.col("p_lon"))
        state = joined.select(
            "place_id", F.coalesce("name", "n").alias("name"), lat.alias("lat"), lon.alias("lon"),
            F.coalesce("commons_category", "p_cat").alias("commons_category"), "parent",
        ).select(
            "place_id", F.when(F.col("lat").isNull() | F.col("commons_category").isNull(), F.col("parent")).alias("look"),
            "name", "lat", "lon", "commons_category",
        )
    return state.drop("look")


# --- claims -----------------------------------------------------------------------------

CLAIM_SCHEMA = "array<struct<property:string,rank:string,snaktype:string,value:string,point_in_time:string>>"


def parse_claims(column: str = "claims_json") -> Column:
    return F.from_json(column, CLAIM_SCHEMA)


def best_claims(claims: Column, prop: str) -> Column:
    """Preferred claims if any, else normal ones; deprecated ones never; only real values."""
    alive = F.filter(claims, lambda c: (c["property"] == prop) & (c["rank"] != "deprecated"))
    return let(alive, lambda all_: let(
        F.filter(all_, lambda c: c["rank"] == "preferred"),
        lambda top: F.filter(F.when(F.size(top) > 0, top).otherwise(all_), lambda c: c["snaktype"] == "value")))


def item_ids(claims: Column, prop: str) -> Column:
    return F.array_compact(F.transform(best_claims(claims, prop), lambda c: F.get_json_object(c["value"], "$.id")))


def strings(claims: Column, prop: str) -> Column:
    return F.filter(F.transform(best_claims(claims, prop), lambda c: c["value"]), lambda v: ~v.startswith("{"))


def instance_of(claims: Column) -> Column:
    """Class ids of every rank, for type checks."""
    mine = F.filter(claims, lambda c: c["property"] == "P31")
    return F.array_compact(F.transform(mine, lambda c: F.get_json_object(c["value"], "$.id")))


def first_point(claims: Column) -> Column:
    points = F.transform(best_claims(claims, "P625"), lambda c: F.struct(
        F.get_json_object(c["value"], "$.latitude").try_cast("double").alias("lat"),
        F.get_json_object(c["value"], "$.longitude").try_cast("double").alias("lon")))
    return F.get(F.filter(points, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull()), F.lit(0))


def first_year(claims: Column, prop: str) -> Column:
    years = F.transform(best_claims(claims, prop), lambda c: F.regexp_extract(
        F.get_json_object(c["value"], "$.time"), r"^\+?(-?\d{1,4})-", 1))
    return F.regexp_replace(F.get(F.filter(years, lambda y: y != ""), F.lit(0)), r"^0+(?=\d)", "")


def latest_quantity(claims: Column, prop: str) -> Column:
    """struct(amount, year) with the newest qualifier time; the first one among equals."""
    rows = F.transform(best_claims(claims, prop), lambda c, i: F.struct(
        F.coalesce(c["point_in_time"], F.lit("")).alias("time"), (-i).alias("neg"),
        F.get_json_object(c["value"], "$.amount").try_cast("double").alias("amount")))
    newest = F.array_max(F.filter(rows, lambda r: r["amount"].isNotNull()))
    return F.when(newest.isNotNull(), F.struct(
        newest["amount"].cast("bigint").alias("amount"),
        F.nullif(F.regexp_extract(newest["time"], r"^\+?(\d{4})-", 1), F.lit("")).alias("year")))


def is_in_class(claims: Column, texts: Column) -> Column:
    """Curated class: yes. Other classes and no generic one: no. Else the texts decide."""
    listed = F.array(*[F.lit(c) for c in config.HIGHER_EDUCATION_CLASSES])
    generic = F.array(*[F.lit(c) for c in config.GENERIC_EDUCATION_CLASSES])
    named = F.exists(F.array_compact(texts), lambda t: t.rlike(config.HIGHER_EDUCATION_TEXT))
    return let(instance_of(claims), lambda ids: F.when(F.arrays_overlap(ids, listed), True)
               .when((F.size(ids) > 0) & ~F.arrays_overlap(ids, generic), False).otherwise(named))


def build_entities(raw: DataFrame, places: DataFrame, countries: DataFrame) -> DataFrame:
    """Entities with city, country, hosts, category and point from claims and lookups."""
    claims = F.col("claims")
    df = raw.withColumn("claims", parse_claims()).select(
        "qid", F.coalesce("label_ru", "label_en", "qid").alias("name"),
        F.coalesce(*[F.get(item_ids(claims, p), F.lit(0)) for p in ("P159", "P131", "P276")]).alias("city_id"),
        F.get(item_ids(claims, "P17"), F.lit(0)).alias("country_id"),
        first_point(claims).alias("point"), first_year(claims, "P571").alias("inception"),
        strings(claims, "P856").alias("websites"),
        F.coalesce(F.get(strings(claims, "P373"), F.lit(0)), F.when(
            F.col("commons_sitelink").startswith("Category:"), F.substring("commons_sitelink", 10, 1000))).alias("commons_category"),
        "article_lat", "article_lon",
    )
    city = places.select(F.col("place_id").alias("city_id"), F.coalesce("name_ru", "name_en").alias("city_name"),
                         F.col("lat").alias("city_lat"), F.col("lon").alias("city_lon"))
    out = df.join(city, "city_id", "left").join(countries, "country_id", "left")
    has_city = F.col("city_name").isNotNull()
    return out.select(
        "qid", "name", "inception", F.when(has_city, F.col("city_id")).alias("city_id"), "city_name",
        F.when(has_city, F.col("city_lat")).alias("city_lat"), F.when(has_city, F.col("city_lon")).alias("city_lon"),
        F.coalesce("country_name", F.lit("")).alias("country"), F.coalesce("country_code", F.lit("")).alias("country_code"),
        F.get("websites", F.lit(0)).alias("website"),
        F.array_distinct(F.array_compact(F.transform("websites", url_host))).alias("domains"), "commons_category",
        F.coalesce("point.lat", "article_lat").alias("lat"), F.coalesce("point.lon", "article_lon").alias("lon"),
    )


def guard_members(ids: DataFrame, index: DataFrame, raw: DataFrame) -> DataFrame:
    """Why an id may or may not get a profile: ok, not_found or not_a_university."""
    known = raw.select("qid", is_in_class(parse_claims(), F.array("label_en", "label_ru", "description")).alias("qualifies"))
    listed = index.select("qid", F.lit(True).alias("listed")).distinct()
    joined = ids.join(known, "qid", "left").join(listed, "qid", "left")
    return joined.select("qid", F.when(F.col("qualifies").isNull(), "not_found")
                         .when(F.col("qualifies") | F.coalesce("listed", F.lit(False)), "ok")
                         .otherwise("not_a_university").alias("verdict"))


def entity_view(index: DataFrame) -> DataFrame:
    """Display name, articles in language order with their URLs, logo URL."""
    encode = lambda t: F.regexp_replace(F.replace(F.replace(F.replace(F.replace(F.replace(
        F.url_encode(F.replace(t, F.lit(" "), F.lit("_"))), F.lit("%21"), F.lit("!")), F.lit("%27"), F.lit("'")),
        F.lit("%28"), F.lit("(")), F.lit("%29"), F.lit(")")), F.lit("%7E"), F.lit("~")), r"\+", "%20")
    order = lambda a: F.coalesce(F.nullif(F.array_position(
        F.array(F.lit("ru"), F.lit("en"), F.lit("kk")), a["lang"]), F.lit(0)), F.lit(4))
    ranked = F.array_sort(F.transform("wikipedia", lambda a, i: F.struct(order(a).alias("r"), i.alias("i"), a.alias("a"))))
    articles = F.transform(ranked, lambda s: F.struct(
        s["a"]["lang"].alias("lang"), s["a"]["title"].alias("title"),
        F.concat(F.lit("https://"), s["a"]["lang"], F.lit(".wikipedia.org/wiki/"), encode(s["a"]["title"])).alias("url")))
    logo = F.when(F.col("logo").isNotNull(), F.concat(
        F.lit("https://commons.wikimedia.org/wiki/Special:FilePath/"), encode(F.col("logo")), F.lit("?width=256")))
    return index.select("qid", F.coalesce("name_ru", "name_en", "name_kk", "qid").alias("name"),
                        articles.alias("articles"), logo.alias("logo_url"))


