"""Audits, run summaries and label-based metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe import config
from veriframe.functions.urls import host_suffixes, official_hosts, strip_www
from veriframe.operators.profile import coverage
from veriframe.operators.ranking import histogram_percentiles


def _has_signal(names: list[str]) -> Column:
    return F.exists("evidence", lambda e: e["signal"].isin(names))


def audit_integrity(photos: DataFrame) -> DataFrame:
    """One row per broken rule of a stored photo."""
    total = F.aggregate("evidence", F.lit(0).cast("bigint"), lambda acc, e: acc + e["points"])
    points, tier = F.col("points"), F.col("tier")
    strong, negative = _has_signal(config.STRONG_SIGNALS), _has_signal(config.NEGATIVE_SIGNALS)
    can = (points >= config.TIER_VERIFIED) & strong & ~negative
    tier_rule = (
        F.when(points < config.TIER_UNCONFIRMED, "shown_below_threshold")
        .when(can & (tier != "verified"), "should_be_verified")
        .when((tier == "verified") & ~can, "must_not_be_verified")
        .when((tier == "likely") & (points < config.TIER_LIKELY), "likely_below_threshold")
        .when((tier == "unconfirmed") & (points >= config.TIER_LIKELY) & strong, "unconfirmed_though_strong")
    )
    return photos.select("*", F.explode(F.array_compact(F.array(
        F.when(~tier.isin(config.TIERS), "unknown_tier"),
        F.when(points != total, "points_sum"),
        tier_rule,
        F.when(~F.coalesce(F.col("source_page_url"), F.lit("")).rlike("^https?://"), "bad_source_url"),
        F.when(F.col("retrieved_at").isNull(), "no_retrieved_at"),
        F.when(F.col("category").isNull(), "no_category"),
    ))).alias("violation"))


def audit_official(photos: DataFrame, domains: DataFrame) -> DataFrame:
    """Each official claim: the entity's exact domain, its academic twin, or a mismatch."""
    claims = photos.filter(_has_signal(["official_domain", "official_domain_weak"])).select(
        "cand_id", "entity_id", strip_www(F.col("source_domain")).alias("host")
    )
    # Verdicts depend on (entity, host) only; the claims of a hot entity collapse before the join.
    hosts = claims.select("entity_id", "host").distinct()
    owned = domains.select("entity_id", strip_www(F.col("domain")).alias("domain"),
                           F.posexplode(official_hosts(F.col("domain"))).alias("place", "own"))
    hits = hosts.withColumn("own", F.explode(host_suffixes(F.col("host")))).join(owned, ["entity_id", "own"])
    best = hits.groupBy("entity_id", "host").agg(F.min(F.when(F.col("place") == 0, 0).otherwise(1)).alias("kind"))
    return claims.join(best, ["entity_id", "host"], "left").select(
        "cand_id",
        F.when(F.col("kind") == 0, "exact").when(F.col("kind") == 1, "academic_twin").otherwise("mismatch")
        .alias("verdict"),
    )


def audit_membership(claims: DataFrame, filed: DataFrame, edges: DataFrame) -> DataFrame:
    """Category claims: filed directly, one level up, or unconfirmed."""
    rows = claims.join(filed, "cand_id")
    pairs = edges.select(F.col("child").alias("filed"), F.col("parent").alias("category")).distinct()
    verdict = rows.join(pairs.withColumn("_up", F.lit(True)), ["filed", "category"], "left").select(
        "cand_id", F.when(F.col("filed") == F.col("category"), 2).when(F.col("_up"), 1).otherwise(0).alias("v")
    )
    # A file may sit in several categories: the best verdict counts.
    return verdict.groupBy("cand_id").agg(F.max("v").alias("v")).select(
        "cand_id",
        F.when(F.col("v") == 2, "direct").when(F.col("v") == 1, "one_level_up").otherwise("unconfirmed")
        .alias("verdict"),
    )


def coverage_consistency(photos: DataFrame, entities: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows in which the recomputed and the stored coverage differ, from both sides."""
    fresh = coverage(photos, entities)
    old = stored.select(*fresh.columns)
    return fresh.exceptAll(old).select(F.lit("missing_or_changed").alias("side"), "*").unionByName(
        old.exceptAll(fresh).select(F.lit("unexpected").alias("side"), "*")
    )


# --- runs, labels, sources ----------------------------------------------------------------


def source_health(statuses: DataFrame) -> DataFrame:
    """Degraded flags per entity and whether its profile may be stored."""
    down = F.col("status").isin("timeout", "error", "simulated_down")
    flag = (
        F.when(down & F.col("source").isin("commons", "wikipedia"), "wikimedia_unavailable")
        .when(down & (F.col("source") == "web_search"), "web_search_unavailable")
        .when((F.col("source") == "vision") & (F.col("status") != "ok"), "vision_unavailable")
    )
    # Three flags exist, so the set is bounded.
    flags = statuses.groupBy("entity_id").agg(F.array_sort(F.collect_set(flag)).alias("degraded"))
    return flags.withColumn("cacheable", F.size("degraded") == 0)


def verdict(runs: DataFrame) -> DataFrame:
    """FAIL / WARN / SKIP / PASS of each run (terminal, error_code, n_fails, n_warns, expected)."""
    limited = (F.col("terminal") == "error") & (F.coalesce("error_code", F.lit("")) == "rate_limited")
    outcome = F.when(F.col("terminal") == "done", "profile").otherwise(F.col("terminal"))
    unexpected = outcome.isNotNull() & (outcome != "error") & ~F.array_contains("expected", outcome)
    return runs.withColumn(
        "verdict",
        F.when(limited, "SKIP").when(F.col("terminal").isNull() | (F.col("terminal") == "error"), "FAIL")
        .when(F.col("n_fails") > 0, "FAIL").when((F.col("n_warns") > 0) | unexpected, "WARN").otherwise("PASS"),
    )


def run_summary(runs: DataFrame) -> DataFrame:
    """One row: outcomes, fresh and stored profiles, tiers of regular ones, profiles without a verified photo."""
    done = F.col("terminal") == "done"
    regular = done & ~F.col("simulated")
    fresh = done & ~F.coalesce("cached", F.lit(False))
    n = lambda cond: F.count(F.when(cond, 1))
    tier_sum = lambda c: F.coalesce(F.sum(F.when(regular, F.col(c))), F.lit(0)).cast("bigint")
    return runs.agg(
        n(done).alias("profiles"), n(done & F.col("simulated")).alias("simulated"), n(F.col("terminal") == "ambiguous").alias("ambiguous"),
        n(F.col("terminal") == "not_found").alias("not_found"), n(F.col("terminal") == "error").alias("errors"),
        n(fresh).alias("fresh"), (n(done) - n(fresh)).alias("stored"), n(regular).alias("regular"),
        tier_sum("verified").alias("verified"), tier_sum("likely").alias("likely"), tier_sum("unconfirmed").alias("unconfirmed"),
        n(regular & (F.col("verified") == 0)).alias("without_verified"),
        F.count_distinct(F.when(regular, F.col("entity_id"))).alias("entities"),
        F.coalesce(F.sum(F.when(done, F.col("photos"))), F.lit(0)).cast("bigint").alias("checked_photos"),
        n(F.coalesce("n_fails", F.lit(0)) > 0).alias("fails"),
    )


def vision_histogram(runs: DataFrame) -> DataFrame:
    """Profiles by the status of the visual check; a profile without one counts as ``no_data``."""
    done = runs.filter("terminal = 'done'")
    return done.groupBy(F.coalesce("vision_status", F.lit("no_data")).alias("vision_status")).agg(F.count(F.lit(1)).alias("profiles"))


def run_figures(runs: DataFrame) -> DataFrame:
    """Median, least, most and number of each figure: three timings of fresh profiles, photos of regular ones.

    Stored profiles answer at once and would flatter the timings; simulated outages would lower the photos.
    """
    fresh, regular = ~F.coalesce("cached", F.lit(False)), ~F.col("simulated")
    value = lambda name, cond, c: F.struct(F.lit(name).alias("figure"), F.when(cond, c).cast("bigint").alias("value"))
    photos = F.col("verified") + F.col("likely") + F.col("unconfirmed")
    rows = runs.filter("terminal = 'done'").select(F.explode(F.array(
        value("resolved_ms", fresh, F.col("resolved_ms")), value("first_photos_ms", fresh, F.col("first_photos_ms")),
        value("done_ms", fresh, F.col("done_ms")), value("photos_per_profile", regular, photos))).alias("f")).select("f.*")
    return histogram_percentiles(rows, ["figure"], "value", {"median": 0.5})


def latency(rows: DataFrame, keys: list[str], value: str = "ms") -> DataFrame:
    """Median and 90th percentile per key: of fresh runs (``keys`` empty) or of a model's batches."""
    everything = rows.withColumn("_all", F.lit(0))
    return histogram_percentiles(everything, [*keys, "_all"], value, {"p50": 0.5, "p90": 0.9}).drop("_all")


def join_labels(photos: DataFrame, labels: DataFrame) -> DataFrame:
    """Label of each photo: by picture URL, else by page URL."""
    by_image = labels.groupBy("image_url").agg(F.min(F.struct("label_id", "belongs", "category")).alias("li"))
    by_page = labels.groupBy("source_page_url").agg(F.min(F.struct("label_id", "belongs", "category")).alias("lp"))
    joined = photos.join(by_image, "image_url", "left").join(by_page, "source_page_url", "left")
    label = F.coalesce("li", "lp")
    return joined.filter(label.isNotNull()).withColumns({
        "belongs": label["belongs"], "true_category": label["category"]}).drop("li", "lp")


def tier_precision(labeled: DataFrame) -> DataFrame:
    """Precision of verified, and of verified + likely; category accuracy on photos that belong."""
    tier, yes = F.col("tier"), F.col("belongs") == "yes"
    known = F.col("belongs") != "unsure"
    ratio = lambda num, den: F.round(F.try_divide(F.count(F.when(num, 1)) * 100.0, F.count(F.when(den, 1))), 3)
    shown = tier.isin("verified", "likely")
    return labeled.agg(
        F.count(F.when(known, 1)).alias("n"),
        ratio(known & (tier == "verified") & yes, known & (tier == "verified")).alias("precision_verified"),
        ratio(known & shown & yes, known & shown).alias("precision_shown"),
        ratio(yes & (F.col("category") == F.col("true_category")), yes).alias("category_accuracy"),
    )


def observation_eval(rows: DataFrame) -> DataFrame:
    """Per model: category accuracy on belonging items, trap catch rate, name correctness."""
    yes, trap = F.col("belongs") == "yes", F.col("belongs") == "no"
    ratio = lambda num, den: F.round(F.try_divide(F.count(F.when(num, 1)) * 100.0, F.count(F.when(den, 1))), 3)
    caught = (F.col("names_institution") == "other") | F.col("image_type").isin(config.NOT_A_PHOTO_TYPES)
    named = F.col("names_institution").isin("this", "other")
    right = (yes & (F.col("names_institution") == "this")) | (trap & (F.col("names_institution") == "other"))
    return rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), ratio(yes & (F.col("primary_category") == F.col("true_category")), yes).alias("category_accuracy"),
        ratio(trap & caught, trap).alias("trap_catch_rate"), ratio(named & right, named).alias("name_correctness"),
        F.sum("tokens").cast("bigint").alias("tokens"),
    )
