"""Profile tables: coverage, facets, display order, facts, map bounds, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe import config
from veriframe.functions.geo import valid_point
from veriframe.operators.ranking import positions, top_k
from veriframe.operators.scoring import center_distance
from veriframe.session import stored

# --- fixed values ---------------------------------------------------------------
KNOWLEDGE_PAGE = "https://www.wikidata.org/wiki/Q"


def list_rank(col: Column, values: list[str]) -> Column:
    """1-based place in a fixed list; unknown values go last."""
    place = F.array_position(F.array(*[F.lit(v) for v in values]), col)
    return F.when(place > 0, place).otherwise(len(values) + 1).cast("bigint")


def tier_rank(col: Column) -> Column:
    return list_rank(col, config.TIERS) - 1


def with_categories(entities: DataFrame) -> DataFrame:
    """Every entity with every category: an explode of a constant, not a cross join."""
    return entities.select("entity_id", F.explode(F.array(*[F.lit(c) for c in config.CATEGORIES])).alias("category"))


def coverage(photos: DataFrame, entities: DataFrame) -> DataFrame:
    """Counts per entity, category and tier; entities without photos get zero rows."""
    count_tier = lambda t: F.count(F.when(F.col("tier") == t, 1)).alias(t)
    counted = photos.groupBy("entity_id", "category").agg(*[count_tier(t) for t in config.TIERS])
    dense = with_categories(entities).join(counted, ["entity_id", "category"], "left").na.fill(0, config.TIERS)
    shown = F.col("verified") + F.col("likely")
    return dense.withColumn("status", F.when(shown >= 3, "good").when(shown >= 1, "thin").otherwise("none"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Counts and percentages. The window runs over the counts, one row per enum value, never over the rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.select(column, "n", F.round(100.0 * F.col("n") / total, 4).alias("share"))


def signal_counts(photos: DataFrame) -> DataFrame:
    return photos.select(F.explode("evidence.signal").alias("signal")).groupBy("signal").agg(
        F.count(F.lit(1)).alias("n")
    )


def apply_filters(photos: DataFrame, categories: list[str] | None = None, source_types: list[str] | None = None,
                  show_unconfirmed: bool = False, lens: str | None = None) -> DataFrame:
    """Empty lists mean "all"; a lens is a named list of source types."""
    if lens is not None:
        source_types = config.SOURCE_LENSES[lens]
    out = photos
    if not show_unconfirmed:
        out = out.filter(F.col("tier") != "unconfirmed")
    if categories:
        out = out.filter(F.col("category").isin(categories))
    if source_types:
        out = out.filter(F.col("source_type").isin(source_types))
    return out


def facet_counts(photos: DataFrame, categories: list[str] | None = None, **filters) -> DataFrame:
    """Count per category under the other filters; the category filter itself is ignored."""
    return apply_filters(photos, None, **filters).groupBy("entity_id", "category").agg(F.count(F.lit(1)).alias("n"))


def group_rejected(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("entity_id", "reason").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "tray_order", list_rank(F.col("reason"), config.REJECT_REASONS)
    )


def rejected_items(rejected: DataFrame) -> DataFrame:
    """Every rejected item at its place within its reason, with the place of the reason in the tray.

    The rows are stored, since they are counted first and then numbered.
    """
    placed = positions(stored(rejected, "rejected"), ["entity_id", "reason"], [], [F.col("seq"), F.col("cand_id")], "place", block=("seq", 1 << 16))
    return placed.withColumn("tray_order", list_rank(F.col("reason"), config.REJECT_REASONS))


def top_reject_reasons(rejected: DataFrame, k: int = 3) -> DataFrame:
    """Total and the k most frequent reasons as text; ties go to the reason seen first."""
    counts = rejected.groupBy("entity_id", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")
    )
    # At most one row per reason is left, so collecting them per entity is bounded by the enum.
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "first_seq", "reason")))
    top = F.slice(rows, 1, k)
    text = F.array_join(F.transform(top, lambda r: F.concat(
        r["reason"], F.lit(" ("), (-r["neg"]).cast("string"), F.lit(")"))), ", ")
    return counts.groupBy("entity_id").agg(F.sum("n").alias("total"), text.alias("reasons"))


def official_only_sections(photos: DataFrame) -> DataFrame:
    return (
        photos.groupBy("entity_id", "category")
        .agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("source_type") == "official").alias("_only"))
        .filter("_only").drop("_only")
    )


def evidence_by_kind(photos: DataFrame) -> DataFrame:
    rows = photos.select("entity_id", F.inline("evidence"))
    return rows.groupBy("entity_id", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("points").alias("points")
    ).withColumn("kind_order", list_rank(F.col("kind"), config.EVIDENCE_KINDS))


def display_order(photos: DataFrame) -> DataFrame:
    """Exact position of every photo inside its entity: tier, points, then pipeline order.

    The rows are stored, since they are counted first and then numbered.
    """
    keyed = stored(photos, "photos").withColumns({"_tier": tier_rank(F.col("tier")), "_neg": -F.col("points")})
    return positions(
        keyed, ["entity_id"], ["_tier", "_neg"], [F.col("seq"), F.col("cand_id")], block=("seq", 1 << 16)
    ).drop("_tier", "_neg")


def _best_first() -> list[Column]:
    return [tier_rank(F.col("tier")), F.desc("points"), F.col("seq"), F.col("cand_id")]


def section_photos(photos: DataFrame, n: int = config.DISPLAY_CAP) -> DataFrame:
    return top_k(photos, ["entity_id", "category"], _best_first(), n)


def compare_areas(photos: DataFrame, n: int = config.COMPARE_CAP) -> DataFrame:
    """Best shown photos of each required area plus how many the area has in total."""
    shown = stored(photos.filter((F.col("tier") != "unconfirmed") & F.col("category").isin(config.REQUIRED_AREAS)), "shown")
    totals = shown.groupBy("entity_id", "category").agg(F.count(F.lit(1)).alias("shown_total"))
    return section_photos(shown, n).join(totals, ["entity_id", "category"])


def compare_entities(pairs: DataFrame, cover: DataFrame) -> DataFrame:
    """Two coverages side by side over the fixed category axis."""
    def side(s: str) -> DataFrame:
        return cover.select(
            F.col("entity_id").alias(f"entity_{s}"), "category", F.col("status").alias(f"status_{s}"),
            (F.col("verified") + F.col("likely")).alias(f"shown_{s}"),
        )

    return pairs.join(side("a"), "entity_a").join(side("b"), ["entity_b", "category"]).select(
        "entity_a", "entity_b", "category", "status_a", "status_b", "shown_a", "shown_b"
    )


def geo_bounds(entities: DataFrame, photos: DataFrame) -> DataFrame:
    """Bounding box of entity point, city point and valid pins. Pins are reduced per entity first."""
    pins = photos.filter(valid_point(F.col("lat"), F.col("lon"))).select(
        "entity_id", "lat", "lon", F.lit(1).alias("pin")
    )
    fixed = entities.select("entity_id", F.inline(F.array(
        F.struct(F.col("lat").alias("lat"), F.col("lon").alias("lon")),
        F.struct(F.col("city_lat").alias("lat"), F.col("city_lon").alias("lon")),
    ))).filter(valid_point(F.col("lat"), F.col("lon"))).withColumn("pin", F.lit(0))
    return pins.unionByName(fixed).groupBy("entity_id").agg(
        F.sum("pin").cast("bigint").alias("pins"), F.min("lat").alias("south"), F.max("lat").alias("north"),
        F.min("lon").alias("west"), F.max("lon").alias("east"),
    )


def fact_rows(entities: DataFrame) -> DataFrame:
    """Facts that are present, in fixed order, each with a link to the property it comes from.

    Students carry the year of the count if it is known; the city is a fact only with the property that names it.
    """
    page = F.concat(F.lit(KNOWLEDGE_PAGE), F.col("entity_id").cast("string"), F.lit("#"))

    def row(ord_: int, fact: str, value: Column, source: Column) -> Column:
        return F.when(value.isNotNull() & source.isNotNull(), F.struct(
            F.lit(ord_).cast("bigint").alias("ord"), F.lit(fact).alias("fact"), value.alias("value"),
            F.concat(page, source).alias("source")))

    amount = F.col("students").cast("string")
    students = F.when(F.col("students_year").isNotNull(), F.concat(amount, F.lit(" ("), "students_year", F.lit(")"))).otherwise(amount)
    website = F.when(F.col("domain").isNotNull(), F.concat(F.lit("https://"), "domain"))
    return entities.select("entity_id", F.inline(F.array_compact(F.array(
        row(1, "founded", F.col("inception"), F.lit("P571")), row(2, "students", students, F.lit("P2196")),
        row(3, "city", F.col("city_name"), F.col("city_property")), row(4, "country", F.col("country"), F.lit("P17")),
        row(5, "website", website, F.lit("P856")),
    ))))


def collect_facts(entities: DataFrame, photos: DataFrame, rejected: DataFrame) -> DataFrame:
    """Numbered fact rows per entity from five branches, each with its source label."""
    cover = photos.groupBy("entity_id", "category").agg(
        F.count(F.when(F.col("tier") != "unconfirmed", 1)).alias("shown"),
        F.count(F.lit(1)).alias("total"), F.bool_and(F.col("source_type") == "official").alias("official"),
    )
    # Eight rows per entity at most: the lists below are bounded by the category list.
    dense = with_categories(entities).join(cover, ["entity_id", "category"], "left").na.fill(0, ["shown", "total"])
    ordered = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
        cond, F.struct(list_rank(F.col("category"), config.CATEGORIES).alias("r"), "category")))),
        lambda s: s["category"]), ", ")
    sections = dense.groupBy("entity_id").agg(
        ordered(F.col("shown") == 0).alias("empty"),
        ordered((F.col("total") > 0) & F.col("official")).alias("official_only"),
    )
    per_entity = (
        sections.join(center_distance(entities), "entity_id")
        .join(top_reject_reasons(rejected), "entity_id", "left")
    )

    def row(branch: int, fact: str, value: Column, present: Column, source: str) -> Column:
        return F.when(present, F.struct(
            F.lit(branch).alias("branch"), F.lit(1).cast("bigint").alias("item"), F.lit(fact).alias("fact"),
            value.alias("value"), F.lit(source).alias("source")))

    derived = per_entity.select("entity_id", F.inline(F.array_compact(F.array(
        row(2, "empty_sections", F.col("empty"), F.col("empty") != "", "pipeline"),
        row(3, "official_only", F.col("official_only"), F.col("official_only") != "", "pipeline"),
        row(4, "center_distance_m", F.col("distance_to_center_m").cast("string"),
            F.col("distance_to_center_m").isNotNull(), "coordinates"),
        row(5, "rejected", F.concat(F.col("total").cast("string"), F.lit(": "), F.col("reasons")),
            F.col("total").isNotNull(), "pipeline"),
    ))))
    known = fact_rows(entities).select(
        "entity_id", F.lit(1).alias("branch"), F.col("ord").alias("item"), "fact", "value", "source"
    )
    # At most nine facts per entity.
    window = Window.partitionBy("entity_id").orderBy("branch", "item")
    return known.unionByName(derived).select(
        "entity_id", F.row_number().over(window).cast("bigint").alias("ord"), "fact", "value", "source"
    )
