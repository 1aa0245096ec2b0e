"""Evidence points, trust tiers and reject reasons: one narrow projection after the observation join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe import config
from veriframe.functions.geo import haversine_m, meters
from veriframe.functions.urls import host_in_list
from veriframe.session import stored


def one_of(col: Column, values: list[str]) -> Column:
    return F.coalesce(col.isin(values), F.lit(False))


def flag(name: str) -> Column:
    """A boolean input column where null means "no"."""
    return F.coalesce(F.col(name), F.lit(False))


def geo_attach(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Add the entity's reference point and the distance to it (entity point, else city point).

    The points are stored first: where their size is known to be small, the candidates aren't shuffled to meet them.
    """
    points = stored(entities.select(
        "entity_id", F.col("lat").alias("entity_lat"), F.col("lon").alias("entity_lon"), "city_lat", "city_lon",
    ), "points")
    out = candidates.join(points, "entity_id", "left")
    ref_lat = F.coalesce("entity_lat", "city_lat")
    ref_lon = F.coalesce("entity_lon", "city_lon")
    return out.withColumn("has_entity_point", F.col("entity_lat").isNotNull()).withColumn(
        "distance_m", haversine_m(F.col("lat"), F.col("lon"), ref_lat, ref_lon)
    )


def resolve_category(primary: Column, hint: Column, secondary: Column) -> tuple[Column, Column]:
    """Observed category if valid, else the source's hint, else campus; distinct valid other categories."""
    category = F.coalesce(F.when(primary.isin(config.CATEGORIES), primary), hint, F.lit("campus"))
    others = F.array_distinct(F.filter(
        F.coalesce(secondary, F.array().cast("array<string>")),
        lambda c: c.isin(config.CATEGORIES) & (c != category),
    ))
    return category, others


def geo_signal() -> Column:
    """Name of the geo signal, 'far' for a reject, null for nothing."""
    d, city = F.col("distance_m"), F.col("category") == "city"
    return (
        F.when(F.col("has_entity_point") & (d <= config.GEO_NEAR_M), "geo_near_campus")
        .when(d <= config.GEO_CITY_M, F.when(city, "geo_in_city").otherwise("geo_same_city"))
        .when((d > config.GEO_FAR_M) & ~city, "far")
    )


def signal_rules() -> list[tuple[str, str, Column]]:
    """(signal, kind, condition) in the fixed display order."""
    weak = flag("stock_like") | (F.coalesce(F.col("image_type"), F.lit("")) == "render_or_illustration")
    seen = F.col("observed")
    geo = F.col("geo_signal")
    return [
        ("commons_depicts", "provenance", flag("depicts")),
        ("commons_category", "provenance", flag("commons_category")),
        ("wikipedia_use", "provenance", flag("used_on_wikipedia")),
        ("official_domain_weak", "provenance", flag("official_domain") & weak),
        ("official_domain", "provenance", flag("official_domain") & ~weak),
        ("page_mentions_name", "text", flag("page_mentions_name")),
        ("news_mentions_name", "provenance", flag("page_mentions_name") & F.col("_news")),
        ("cross_source_match", "cross_source", F.coalesce(F.col("other_sources"), F.lit(0)) > 0),
        ("geo_near_campus", "geo", geo == "geo_near_campus"),
        ("geo_in_city", "geo", geo == "geo_in_city"),
        ("geo_same_city", "geo", geo == "geo_same_city"),
        ("render", "visual", seen & (F.col("image_type") == "render_or_illustration")),
        ("visible_text_this", "text", seen & (F.col("names_institution") == "this")),
        ("visual_consistent", "visual", seen & (F.col("scene") == "consistent")),
        ("visual_inconsistent", "visual", seen & (F.col("scene") == "inconsistent")),
        ("low_res", "quality", flag("low_res")),
    ]


def first_reject() -> Column:
    """The first reason that applies wins."""
    seen = F.col("observed")
    return (
        F.when(F.col("geo_signal") == "far", "far_geotag")
        .when(seen & flag("close_up_portrait"), "portrait")
        .when(seen & (F.col("names_institution") == "other"), "other_institution")
        .when(seen & F.col("image_type").isin(config.NOT_A_PHOTO_TYPES), "not_a_photo")
    )


def is_outdated(value: Column, kind: Column, as_of_year: int) -> Column:
    year = F.substring(value, 1, 4).try_cast("int")
    return F.coalesce(
        (kind != "retrieved") & (year > 1800) & (F.lit(as_of_year) - year >= config.OUTDATED_YEARS), F.lit(False)
    )


def source_notes(candidates: DataFrame, as_of_year: int) -> DataFrame:
    """What the texts of the source and the date amount to: two flags, which cross the network in their place."""
    news = (F.col("source_type") == "news") | host_in_list(F.col("source_domain"), config.NEWS_DOMAINS)
    return candidates.withColumns({
        "_news": F.coalesce(news, F.lit(False)),
        "_outdated": is_outdated(F.col("date_value"), F.col("date_kind"), as_of_year),
    })


def photo_labels() -> Column:
    seen = F.col("observed")
    return F.array_compact(F.array(
        F.when(seen & (F.col("image_type") == "render_or_illustration"), "render"),
        F.when(~seen, "visual_check_unavailable"),
        F.when(flag("low_res"), "low_res_verification"),
        F.when(F.col("_outdated"), "possibly_outdated"),
    ))


def decide_tier(points: Column, strong: Column, negative: Column, looked: Column) -> Column:
    return (
        F.when((points >= config.TIER_VERIFIED) & strong & ~negative, "verified")
        .when(points >= config.TIER_LIKELY, F.when(looked | strong, "likely").otherwise("unconfirmed"))
        .when(points >= config.TIER_UNCONFIRMED, "unconfirmed")
        .otherwise("rejected")
    )


OBSERVATION_COLUMNS = [
    "image_type", "stock_like", "primary_category", "secondary_categories", "visible_text", "names_institution",
    "other_institution_name", "scene", "close_up_portrait",
]


def latest_observations(observations: DataFrame) -> DataFrame:
    """One observation per candidate: the one with the highest ``seq`` (if there is one), equal ones by their values."""
    order = [c for c in ("seq",) if c in observations.columns]
    best = F.max(F.struct(*order, *OBSERVATION_COLUMNS))  # max_by would carry the values twice
    return observations.groupBy("cand_id").agg(best.alias("o")).select("cand_id", *[F.col(f"o.{c}") for c in OBSERVATION_COLUMNS])


def join_observations(candidates: DataFrame, observations: DataFrame) -> DataFrame:
    """Left join by candidate id, one row each. Observations of ids that were never sent fall away by the join side."""
    seen = latest_observations(observations).withColumn("_seen", F.lit(True))
    return candidates.join(seen, "cand_id", "left").withColumn("observed", F.col("_seen").isNotNull()).drop("_seen")


def pending_observations(candidates: DataFrame, observations: DataFrame) -> DataFrame:
    return candidates.join(observations.select("cand_id"), "cand_id", "left_anti")


def score_joined(joined: DataFrame, as_of_year: int, vision_available: bool = True) -> DataFrame:
    """Score rows that already carry their distance and observation. No shuffle, no Python.

    ``other_sources`` comes from ``dedup.cross_sources``; rows without that column have none.
    """
    if "_news" not in joined.columns:
        joined = source_notes(joined, as_of_year)
    if "other_sources" not in joined.columns:
        joined = joined.withColumn("other_sources", F.lit(0))
    category, secondary = resolve_category(
        F.col("primary_category"), F.col("category_hint"), F.col("secondary_categories")
    )
    df = joined.withColumns({"category": category}).withColumns({
        "secondary": secondary, "geo_signal": geo_signal(),
    })
    rules = signal_rules()
    evidence = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(s).alias("signal"), F.lit(k).alias("kind"),
                              F.lit(config.POINTS[s]).cast("bigint").alias("points")))
        for s, k, cond in rules
    ]))
    points = sum((F.when(cond, config.POINTS[s]).otherwise(0) for s, _, cond in rules), F.lit(0))

    def any_of(names: list[str]) -> Column:
        out = F.lit(False)
        for s, _, cond in rules:
            if s in names:
                out = out | F.coalesce(cond, F.lit(False))
        return out

    df = df.withColumns({
        "evidence": evidence,
        "points": points.cast("bigint"),
        "strong": any_of(config.STRONG_SIGNALS),
        "negative": any_of(config.NEGATIVE_SIGNALS),
        "labels": photo_labels(),
        "hard_reject": first_reject(),
    })
    looked = F.col("observed") & F.lit(vision_available)
    tier = decide_tier(F.col("points"), F.col("strong"), F.col("negative"), looked)
    return df.withColumn("tier", F.when(F.col("hard_reject").isNotNull(), "rejected").otherwise(tier)).withColumn(
        "reject_reason",
        F.when(F.col("hard_reject").isNotNull(), F.col("hard_reject")).when(F.col("tier") == "rejected", "low_score"),
    ).drop("_news", "_outdated")


def score_photos(candidates: DataFrame, entities: DataFrame, observations: DataFrame, as_of_year: int,
                 vision_available: bool = True) -> DataFrame:
    """Candidates + entities + observations -> points, tier, category, evidence, labels, reject reason."""
    located = source_notes(geo_attach(candidates, entities), as_of_year)
    return score_joined(join_observations(located, observations), as_of_year, vision_available)


def score_observed(candidates: DataFrame, entities: DataFrame, newest: DataFrame, as_of_year: int) -> DataFrame:
    """Only the candidates in ``newest``, which has one observation each: they meet in one join."""
    located = source_notes(geo_attach(candidates, entities), as_of_year)
    return score_joined(located.join(newest.withColumn("observed", F.lit(True)), "cand_id"), as_of_year)


def split_photos(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(photos, rejected items). Portraits keep no thumbnail; photos get whole meters to the entity point."""
    photos = scored.filter(F.col("tier") != "rejected").withColumn(
        "distance_to_campus_m",
        F.when(F.col("has_entity_point"), meters(F.col("distance_m"))),
    )
    rejected = scored.filter(F.col("tier") == "rejected").select(
        "cand_id", "entity_id", "seq", "source_page_url",
        F.when(F.col("reject_reason") != "portrait", F.col("image_url")).alias("thumb_url"),
        F.col("reject_reason").alias("reason"), "points",
    )
    return photos, rejected


def center_distance(entities: DataFrame) -> DataFrame:
    d = haversine_m(F.col("lat"), F.col("lon"), F.col("city_lat"), F.col("city_lon"))
    return entities.select("entity_id", meters(d).alias("distance_to_center_m"))
