"""Provider answers to candidates, observation bodies to typed rows, event text to events, stored profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe import config
from veriframe.functions.geo import valid_gps
from veriframe.functions.text import category_hint, is_non_photo, iso_date, let, strip_html
from veriframe.functions.urls import host_in_list, url_host
from veriframe.operators.mentions import classify_domains, entity_needles, mentions_entity

# --- fixed values -----------------------------------------------------------------
PHOTO_FILETYPES = ["jpg", "jpeg", "png", "webp", "tiff"]
PHOTO_MIME = r"^image/(jpeg|png|tiff|webp)$"
MEDIA_HOST = "commons.wikimedia.org"
IMAGE_WIDTH, THUMB_WIDTH = 960, 500
TEXT_FIELDS = [
    "id", "image_type", "watermark_text", "primary_category", "visible_text", "names_institution",
    "other_institution_name", "scene_consistent_with_context", "near_duplicate_of", "reason",
]


def _text(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def normalize_web_rows(rows: DataFrame, body: str = "body") -> DataFrame:
    """Web image rows; a row without image, page or host is dropped; sizes only when positive numbers."""
    schema = "title string, imageUrl string, thumbnailUrl string, link string, domain string"
    kept = [c for c in rows.columns if c != body]

    def size(name: str) -> Column:
        value = F.try_variant_get(F.try_parse_json(body), f"$.{name}", "variant")
        number = F.when(F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value, "$", "double"))
        return F.when(number > 0, number.cast("bigint"))

    out = rows.select(*kept, size("imageWidth").alias("width"), size("imageHeight").alias("height"),
                      F.from_json(body, schema).alias("r"))
    page = _text(F.col("r.link"))
    out = out.select(
        *kept, _text(F.col("r.imageUrl")).alias("image_url"), _text(F.col("r.thumbnailUrl")).alias("thumb_url"),
        page.alias("source_page_url"), F.coalesce(url_host(page), _text(F.col("r.domain"))).alias("source_domain"),
        F.lit("web_search").alias("provider"), _text(F.col("r.title")).alias("title"), "width", "height",
    )
    return out.filter("image_url is not null and source_page_url is not null and source_domain is not null")


def normalize_open_rows(rows: DataFrame, entities: DataFrame, body: str = "body") -> DataFrame:
    """Open-license rows that are photos, large enough, name the entity and come from no stock or aggregator host."""
    schema = ("title string, url string, thumbnail string, foreign_landing_url string, creator string, license string, "
              "license_version string, license_url string, filetype string, width bigint, height bigint, mature boolean, "
              "tags array<struct<name:string>>")
    kept = [c for c in rows.columns if c != body]
    flat = rows.select(*kept, F.from_json(body, schema).alias("r"))
    side = F.least(F.coalesce("r.width", F.lit(0)), F.coalesce("r.height", F.lit(0)))
    usable = flat.filter(
        (F.coalesce(F.trim("r.url"), F.lit("")) != "") & (F.coalesce(F.trim("r.foreign_landing_url"), F.lit("")) != "")
        & ~F.coalesce("r.mature", F.lit(False))
        & F.coalesce(F.lower("r.filetype").isin(PHOTO_FILETYPES) | (F.col("r.filetype") == ""), F.lit(True))
        & ~((side > 0) & (side < config.MIN_SHORT_SIDE_PX))
    ).withColumn("host", url_host(F.col("r.foreign_landing_url"))).filter("host is not null")
    usable = usable.filter(~host_in_list(F.col("host"), config.STOCK_DOMAINS + config.AGGREGATOR_DOMAINS))
    text = F.concat_ws(" ", F.col("r.title"), F.concat_ws(" ", F.transform("r.tags", lambda t: t["name"])))
    named = usable.join(entity_needles(entities), "entity_id").filter(
        mentions_entity(text, F.col("needle_names"), F.col("needle_aliases"), page=True))
    classes = classify_domains(named.select("entity_id", "host"), entities).select("entity_id", "host", "source_type")
    license_name = F.when(F.coalesce("r.license", F.lit("")) != "", F.concat(
        F.lit("CC "), F.upper("r.license"), F.coalesce(F.concat(F.lit(" "), F.nullif("r.license_version", F.lit(""))), F.lit(""))))
    return named.join(classes, ["entity_id", "host"]).select(
        *kept, F.trim("r.url").alias("image_url"), F.col("r.thumbnail").alias("thumb_url"),
        F.trim("r.foreign_landing_url").alias("source_page_url"), F.col("host").alias("source_domain"),
        F.lit("openverse").alias("provider"), F.nullif("r.title", F.lit("")).alias("title"), "source_type",
        (F.col("source_type") == "official").alias("official_domain"), F.lit(True).alias("page_mentions_name"),
        license_name.alias("license"), F.when(license_name.isNotNull(), _text(F.col("r.license_url"))).alias("license_url"),
        F.when(license_name.isNotNull(), _text(F.col("r.creator"))).alias("author"),
        F.col("r.width").alias("width"), F.col("r.height").alias("height"),
    )


def file_key(title: Column) -> Column:
    """Name after the namespace, spaces for underscores, lower case."""
    return F.lower(F.replace(F.regexp_replace(title, "^[^:]+:", ""), F.lit("_"), F.lit(" ")))


def _without_tracking(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"(?<=[?&])utm_[^&#]*(?:&|(?=#|$))", ""), r"[?&](?=#|$)", "")


def normalize_media_rows(files: DataFrame, entities: DataFrame, article_files: DataFrame, relevant: DataFrame) -> DataFrame:
    """Encyclopedic media files: photos on the media host, large enough, not a logo, map or document.

    ``article_files`` (entity_id, title) are files used in the entity's article, whatever the origin of the row;
    ``relevant`` (entity_id, category) the few subcategories chosen for it: the first of a file's categories that is one
    of them and names a section gives the hint before the text does. The title is the object's name, else the file's.
    """
    host = url_host(F.col("description_url"))
    side = F.least(F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0)))
    rows = files.filter(F.col("mime").rlike(PHOTO_MIME) & (host == MEDIA_HOST) & (side >= config.MIN_SHORT_SIDE_PX)
                        & F.col("url").isNotNull())
    rows = rows.withColumns({
        "name": F.regexp_replace(F.regexp_replace("title", "^File:", ""), r"(?i)\.[a-z0-9]+$", ""),
        "caption": F.substring(strip_html(F.col("description_html")), 1, 300),
        "filed_in": F.transform(F.split(F.coalesce(strip_html(F.col("categories")), F.lit("")), r"\|"), lambda c: F.trim(c)),
    }).withColumn("filed", F.array_join("filed_in", " ")).filter(~is_non_photo(F.concat_ws(" ", "name", "filed")))
    used = article_files.select("entity_id", file_key(F.col("title")).alias("_key")).distinct().withColumn("_used", F.lit(True))
    rows = rows.withColumn("_key", file_key(F.col("title"))).join(used, ["entity_id", "_key"], "left")
    chosen = relevant.groupBy("entity_id").agg(F.collect_set("category").alias("_chosen"))
    rows = rows.join(entity_needles(entities), "entity_id").join(chosen, "entity_id", "left")
    hinted = lambda text: category_hint(text, config.CATEGORY_KEYWORDS, config.HINT_ORDER)
    from_category = F.get(F.filter(F.transform("filed_in", lambda c: F.when(
        F.coalesce(F.array_contains("_chosen", c), F.lit(False)), hinted(c))), lambda h: h.isNotNull()), F.lit(0))
    hint = F.coalesce(from_category, hinted(F.concat_ws(" ", "name", "filed", "caption")))
    original, thumb = _without_tracking(F.col("url")), _without_tracking(F.col("thumb_url"))
    large = (F.col("width") > IMAGE_WIDTH) & F.col("thumb_url").isNotNull()
    gps_lat, gps_lon = F.col("gps_lat").try_cast("double"), F.col("gps_lon").try_cast("double")
    gps = F.when(valid_gps(gps_lat, gps_lon), F.struct(gps_lat.alias("lat"), gps_lon.alias("lon")))
    point = F.when(F.col("lat").isNotNull(), F.struct("lat", "lon")).otherwise(gps)
    taken = iso_date(F.col("date_original"))
    uploaded = F.coalesce(iso_date(F.col("date_time")), iso_date(F.col("uploaded_at")))
    shown = F.coalesce(_text(strip_html(F.col("object_name"))), F.col("name"))
    named = mentions_entity(F.concat_ws(" ", shown, "name", "caption"), F.col("needle_names"), F.col("needle_aliases"))
    licensed = _text(strip_html(F.col("license_name")))
    return rows.select(
        "entity_id", F.col("title").alias("file_title"), shown.alias("title"), "origin",
        F.when(large, thumb).otherwise(original).alias("image_url"),
        F.when(large, F.replace(thumb, F.lit(f"/{IMAGE_WIDTH}px-"), F.lit(f"/{THUMB_WIDTH}px-"))).otherwise(original).alias("thumb_url"),
        F.col("description_url").alias("source_page_url"), F.lit(MEDIA_HOST).alias("source_domain"), "caption",
        F.when(F.col("origin") == "city", "city").otherwise(hint).alias("category_hint"),
        (F.col("origin") == "category").alias("commons_category"), (F.col("origin") == "depicts").alias("depicts"),
        ((F.col("origin") == "article") | F.coalesce("_used", F.lit(False))).alias("used_on_wikipedia"),
        ((F.col("origin") != "city") & named).alias("page_mentions_name"), F.lit("encyclopedic").alias("source_type"),
        point["lat"].alias("lat"), point["lon"].alias("lon"), F.coalesce(taken, uploaded).alias("date_value"),
        F.when(taken.isNotNull(), "taken").when(uploaded.isNotNull(), "uploaded").alias("date_kind"),
        licensed.alias("license_name"), F.when(licensed.isNotNull(), F.col("license_url")).alias("license_url"),
        F.when(licensed.isNotNull(), F.substring(strip_html(F.col("artist")), 1, 120)).alias("author"), "width", "height",
    )


# --- observation bodies ------------------------------------------------------------------


def strict_json(text: Column) -> Column:
    """Parsed JSON or null. Wrapping the text in a list makes the parser see trailing garbage, which it skips otherwise."""
    wrapped = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return let(wrapped, lambda items: F.when(F.size(items) == 1, F.get(items, F.lit(0))))


def parse_observations(bodies: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(observations, quarantined bodies). A missing id spoils its whole body; other odd values get a safe default."""
    kept = [c for c in bodies.columns if c != body]
    raw = F.trim(F.regexp_replace(body, r"^\s+|\s+$", ""))
    unfenced = lambda r: F.trim(F.regexp_replace(F.regexp_replace(r, r"(?i)^```[a-z]*\s*", ""), "```$", ""))
    text = let(raw, lambda r: F.when(r.startswith("```"), unfenced(r)).otherwise(r))
    fields = TEXT_FIELDS + ["stock_like", "close_up_portrait", "quality", "secondary_categories"]
    # One pass per body: every field stays a variant, so its JSON type is still known.
    shape = "array<struct<" + ",".join(f"{f}:variant" for f in fields) + ">>"
    parsed = bodies.withColumn("_list", let(strict_json(text), lambda j: F.coalesce(
        F.try_variant_get(j, "$.images", shape), F.try_variant_get(j, "$", shape))))
    is_text = lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))
    has_id = lambda o: is_text(o["id"]) & (F.try_variant_get(o["id"], "$", "string") != "")
    parsed = parsed.withColumn("_good", F.coalesce(F.forall("_list", has_id), F.lit(False)))
    rows = parsed.filter("_good").select(*kept, F.explode("_list").alias("o")).select(
        *kept, *[F.when(is_text(F.col(f"o.{f}")), F.try_variant_get(f"o.{f}", "$", "string")).alias(f) for f in TEXT_FIELDS],
        *[F.coalesce((F.schema_of_variant(f"o.{f}") == "BOOLEAN") & F.try_variant_get(f"o.{f}", "$", "boolean"), F.lit(False)).alias(f)
          for f in ("stock_like", "close_up_portrait")],
        F.when(F.schema_of_variant("o.quality") == "BOOLEAN", F.try_variant_get("o.quality", "$", "boolean").cast("int").cast("string"))
        .otherwise(F.try_variant_get("o.quality", "$", "string")).alias("quality"),
        (F.col("o.quality").isNotNull() & F.is_variant_null("o.quality")).alias("_no_quality"),
        let(F.try_variant_get("o.secondary_categories", "$", "array<variant>"),
            lambda xs: F.when(F.forall(xs, is_text), F.transform(xs, lambda x: F.try_variant_get(x, "$", "string")))).alias("secondary_categories"),
    )

    def enum(field: str, values: list[str], default: str) -> Column:
        return F.when(F.col(field).isin(values), F.col(field)).otherwise(default)

    cut = lambda field, n: F.substring(F.trim(field), 1, n)
    nullable = lambda field: F.nullif(cut(field, 120), F.lit("")).alias(field)
    # An empty or null answer counts as zero, so it is clamped to 1; only a missing or odd one takes the default.
    number = F.when(F.col("_no_quality") | (F.col("quality") == ""), 0.0).otherwise(F.col("quality").try_cast("double"))
    observations = rows.select(
        *kept, "id", enum("image_type", config.IMAGE_TYPES, "other").alias("image_type"), "stock_like",
        nullable("watermark_text"), enum("primary_category", config.CATEGORIES + ["other"], "other").alias("primary_category"),
        F.filter(F.coalesce("secondary_categories", F.array().cast("array<string>")),
                 lambda c: c.isin(config.CATEGORIES)).alias("secondary_categories"),
        F.coalesce(cut("visible_text", 120), F.lit("")).alias("visible_text"),
        enum("names_institution", config.NAMES_INSTITUTION, "unclear").alias("names_institution"),
        nullable("other_institution_name"),
        enum("scene_consistent_with_context", config.SCENE_VALUES, "unclear").alias("scene"),
        "close_up_portrait", nullable("near_duplicate_of"),
        F.when(number.isNull() | F.isnan(number), 3).otherwise(
            F.least(F.lit(5), F.greatest(F.lit(1), F.floor(number + 0.5)))).cast("bigint").alias("quality"),
        F.coalesce(cut("reason", 200), F.lit("")).alias("reason"),
    )
    return observations, parsed.filter("not _good").select(*kept, body)


# --- event text ----------------------------------------------------------------------------


def parse_event_log(rows: DataFrame, text: str = "text") -> DataFrame:
    """Complete blocks (ended by a blank line) to (block_no, type, payload, parse_error); comments are skipped."""
    kept = [c for c in rows.columns if c != text]
    blocks = F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), "\n\n")
    complete = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    flat = rows.select(*kept, F.posexplode(complete).alias("block_no", "block"))
    field = lambda line: F.when(line.contains(":"), F.substring_index(line, ":", 1)).otherwise(line)
    value = lambda line: F.when(line.contains(":"), F.regexp_replace(line, "^[^:]*: ?", "")).otherwise("")
    lines = F.filter(F.split("block", "\n"), lambda x: (x != "") & ~x.startswith(":"))
    of = lambda name: F.transform(F.filter(F.col("lines"), lambda x: field(x) == name), value)
    out = flat.withColumn("lines", lines).select(
        *kept, F.col("block_no").cast("bigint").alias("block_no"),
        F.coalesce(F.try_element_at(of("event"), F.lit(-1)), F.lit("message")).alias("type"), of("data").alias("data"),
    ).filter(F.size("data") > 0)
    body = F.array_join("data", "\n")
    bad = strict_json(body).isNull()
    return out.select(*kept, "block_no", "type", F.when(~bad, body).alias("payload"), bad.alias("parse_error"))


# --- stored profiles ---------------------------------------------------------------------------


def cacheable(profiles: DataFrame) -> DataFrame:
    """Only healthy profiles are stored."""
    return profiles.filter(F.coalesce(F.size("degraded"), F.lit(0)) <= 0)


def write_profiles(profiles: DataFrame, path: str) -> None:
    """Append healthy profiles, one folder per pipeline version."""
    cacheable(profiles).write.mode("append").partitionBy("pipeline_version").parquet(path)


def fresh_profiles(stored: DataFrame, version: str, as_of: Column, ttl_s: int = config.PROFILE_TTL_S) -> DataFrame:
    """Same version, inside the lifetime, newest copy of each id. The version filter prunes folders."""
    alive = stored.filter((F.col("pipeline_version") == version) & (F.col("saved_at") <= as_of)
                          & (F.col("saved_at") > as_of - F.expr(f"INTERVAL {ttl_s} SECONDS")))
    others = [c for c in stored.columns if c != "qid"]
    return alive.groupBy("qid").agg(F.max_by(F.struct(*others), "saved_at").alias("_row")).select("qid", "_row.*")


def read_profiles(spark: SparkSession, path: str, version: str, as_of: Column, ttl_s: int = config.PROFILE_TTL_S) -> DataFrame:
    return fresh_profiles(spark.read.parquet(path), version, as_of, ttl_s)


# --- picture files ---------------------------------------------------------------------------


def _resample(row: pd.Series) -> list[float]:
    """9 x 8 grayscale means of a decoded picture (bytes in blue-green-red order)."""
    grid = np.frombuffer(row["data"], dtype=np.uint8).reshape(row["height"], row["width"], row["nChannels"])
    if row["nChannels"] >= 3:
        gray = grid[:, :, :3].astype(float) @ np.array([0.114, 0.587, 0.299])
    else:
        gray = grid[:, :, 0].astype(float)
    rows = np.minimum(np.arange(8 + 1) * gray.shape[0] // 8, gray.shape[0])
    cols = np.minimum(np.arange(9 + 1) * gray.shape[1] // 9, gray.shape[1])
    cell = lambda a, n, i: slice(a[i], max(a[i + 1], a[i] + 1))
    return [float(gray[cell(rows, 8, r), cell(cols, 9, c)].mean()) for r in range(8) for c in range(9)]


def image_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(origin, width, height, hash) of picture files; decoding is Spark's, packing is a column expression."""
    from veriframe.functions.hashes import neighbour_bits

    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*").filter(
        (F.col("width") > 0) & (F.col("height") > 0))

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"origin": batch["origin"], "width": batch["width"], "height": batch["height"],
                                "gray": [_resample(r) for _, r in batch.iterrows()]})

    small = images.mapInPandas(shrink, "origin string, width int, height int, gray array<double>")
    return small.select("origin", "width", "height", neighbour_bits(F.col("gray")).alias("hash"))
