"""Reviews, uploads, matching of entities to wishes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe import config
from veriframe.functions.geo import haversine_m
from veriframe.functions.text import mask_personal_data


def pseudonymize(df: DataFrame, column: str) -> DataFrame:
    """Hash of the first forwarded address; the raw value is dropped."""
    first = F.trim(F.split(F.col(column), ",")[0])
    return df.withColumn("author_key", F.substring(F.sha2(F.coalesce(F.nullif(first, F.lit("")), F.lit("unknown")), 256), 1, 32)).drop(column)


def local_date(ts: Column, zone: str) -> Column:
    """Report day in the team's zone of a UTC timestamp without zone."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts), "yyyy-MM-dd")


def moderate(reviews: DataFrame) -> DataFrame:
    """Mask first, then validate, then publish only what the label allows and reports do not hold."""
    text = F.trim("text")
    problem = (
        F.when(~F.coalesce(F.col("aspect").isin(config.REVIEW_ASPECTS), F.lit(False)), "bad_aspect")
        .when(~F.coalesce(F.col("rating").between(1, 5), F.lit(False)), "bad_rating")
        .when(~F.length(text).between(config.REVIEW_MIN_CHARS, config.REVIEW_MAX_CHARS), "bad_text")
    )
    by_label = F.when(F.col("label") == "ok", "published").otherwise("held")
    status = F.when(F.col("report_count") >= config.REPORT_THRESHOLD, "held").otherwise(by_label)
    return reviews.withColumns({
        "masked": mask_personal_data(text, config.MASK_TOKEN),
        "status": F.coalesce(problem, status),
    })


def published_only(reviews: DataFrame) -> DataFrame:
    """Public projection: published rows without author and report columns."""
    return reviews.filter(F.col("status") == "published").drop("author_key", "forwarded", "report_count", "label", "text")


def geo_check(distance: Column) -> Column:
    return (
        F.when(distance.isNull(), "unknown").when(distance <= config.GEO_NEAR_M, "pass")
        .when(distance <= config.GEO_CITY_M, "unknown").otherwise("fail")
    )


def upload_checks(uploads: DataFrame, entities: DataFrame, duplicates: DataFrame, observations: DataFrame) -> DataFrame:
    """Long table (upload_id, check_id, result). A portrait ends the visual checks at once."""
    points = entities.select("entity_id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    df = (
        uploads.join(points, "entity_id", "left")
        .join(duplicates.select("upload_id", "match"), "upload_id", "left")
        .join(observations, "upload_id", "left")
    )
    distance = haversine_m(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
    seen = F.col("image_type").isNotNull()
    portrait = F.coalesce(F.col("close_up_portrait"), F.lit(False))
    visual = seen & ~portrait

    def check(name: str, when: Column, result: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("check_id"), result.alias("result")))

    bad_type = F.col("image_type").isin(config.NOT_A_PHOTO_TYPES + ["render_or_illustration"])
    other_category = (F.col("primary_category") != F.col("category")) & (F.col("primary_category") != "other")
    checks = F.array_compact(F.array(
        check("geo", F.lit(True), geo_check(distance)),
        check("duplicate", F.lit(True), F.when(F.coalesce(F.col("match"), F.lit("none")) == "none", "pass").otherwise("fail")),
        check("vision_unavailable", ~seen, F.lit("unknown")),
        check("vision_portrait", seen & portrait, F.lit("fail")),
        check("vision_type", visual, F.when(bad_type, "fail").otherwise("pass")),
        check("vision_stock", visual & F.col("stock_like"), F.lit("fail")),
        check("vision_institution", visual & (F.col("names_institution") == "other"), F.lit("fail")),
        check("vision_category", visual, F.when(other_category, "unknown").otherwise("pass")),
    ))
    return df.select("upload_id", F.inline(checks))


def upload_status(checks: DataFrame) -> DataFrame:
    """No visual check: pending; any failed check but geo: rejected; geo pass: on site; else plausible."""
    has = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    flags = checks.groupBy("upload_id").agg(
        has(F.col("check_id") == "vision_unavailable").alias("blind"),
        has((F.col("check_id") != "geo") & (F.col("result") == "fail")).alias("failed"),
        has((F.col("check_id") == "geo") & (F.col("result") == "pass")).alias("onsite"),
    )
    return flags.select(
        "upload_id",
        F.when(F.col("blind"), "pending_review").when(F.col("failed"), "rejected")
        .when(F.col("onsite"), "verified_onsite").otherwise("plausible").alias("status"),
    )


def match_pool(entities: DataFrame, country_code: str | None, n: int = config.MATCH_POOL) -> DataFrame:
    """The most linked entities after the country filter (a distributed top-n)."""
    pool = entities if country_code is None else entities.filter(F.col("country_code") == country_code)
    return pool.orderBy(F.desc("sitelinks"), "entity_id").limit(n)


def match_rank(entities: DataFrame, cover: DataFrame, country_code: str | None, city: str | None,
               categories: list[str], limit: int) -> DataFrame:
    """Score the pool by wishes: country, city, popularity, covered categories."""
    w = config.MATCH_WEIGHTS
    wanted = cover.filter(F.col("category").isin(categories)).groupBy("entity_id").agg(
        F.sum(F.when(F.col("status") == "good", w["good"]).when(F.col("status") == "thin", w["thin"]).otherwise(0)).alias("cat_points"),
        F.count(F.when(F.col("status") != "none", 1)).alias("covered"),
    )
    pool = match_pool(entities, country_code).join(wanted, "entity_id", "left")
    in_country = F.lit(country_code is not None) & F.coalesce(F.col("country_code") == F.lit(country_code), F.lit(False))
    in_city = F.lit(city is not None) & F.coalesce(
        F.lower(F.trim("city_name")) == F.lower(F.trim(F.lit(city))), F.lit(False))
    popularity = F.least(F.col("sitelinks"), F.lit(w["popularity_cap"])) / w["popularity_cap"] * w["popularity_max"]
    score = (
        F.when(in_country, w["country"]).otherwise(0) + F.when(in_city, w["city"]).otherwise(0)
        + popularity + F.coalesce("cat_points", F.lit(0))
    )
    reasons = F.concat_ws(",", F.when(in_country, "country"), F.when(in_city, "city"),
                          F.when(F.coalesce("covered", F.lit(0)) > 0, "covered_sections")
                          .when(F.lit(bool(categories)), "no_covered_sections"))
    ranked = pool.select(
        "entity_id", "name", (F.floor(score * 10 + 0.5) / 10).alias("score"), reasons.alias("reasons"), "sitelinks",
        F.col("covered").isNotNull().alias("has_profile"),
    )
    return ranked.orderBy(F.desc("score"), F.desc("sitelinks"), "entity_id").limit(limit)


