"""Candidate handling before scoring: rejects, merges, exact dedup, priors, quotas, batches, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe import config
from veriframe.functions.urls import NON_PHOTO_EXTENSION, canonical_url, host_in_list, url_host
from veriframe.operators.ranking import positions, top_k
from veriframe.operators.scoring import flag
from veriframe.session import stored

ORDER = ["seq", "cand_id"]  # pipeline order; cand_id makes it total


def order_key() -> Column:
    return F.struct(*ORDER)


def pre_reject_reason() -> Column:
    stock = host_in_list(F.col("source_domain"), config.STOCK_DOMAINS) | F.coalesce(
        host_in_list(url_host(F.col("image_url")), config.STOCK_DOMAINS), F.lit(False)
    )
    return F.when(stock, "stock_source").when(F.col("image_url").rlike(NON_PHOTO_EXTENSION), "not_a_photo")


def split_pre_rejects(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passed, rejected): stock banks and non-photo file types stop here."""
    marked = candidates.withColumn("reason", pre_reject_reason())
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def strong_provenance() -> Column:
    return flag("depicts") | flag("commons_category") | flag("used_on_wikipedia") | flag("official_domain")


def is_low_quality() -> Column:
    side = F.least(F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0)))
    return (side > 0) & (side < config.MIN_SHORT_SIDE_PX) & ~strong_provenance()


def _present(name: str, points: int) -> Column:
    return F.when(F.col(name).isNotNull(), points).otherwise(0)


def _flag_points(name: str, points: int) -> Column:
    return F.when(flag(name), points).otherwise(0)


def _provenance_points() -> Column:
    return (
        _flag_points("depicts", 50) + _flag_points("commons_category", 40) + _flag_points("used_on_wikipedia", 30)
        + _flag_points("official_domain", 30) + _flag_points("page_mentions_name", 10)
        + F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), 10).otherwise(0)
        + _present("date_value", 3) + _present("license", 2)
    )


def candidate_prior() -> Column:
    """How promising a candidate is before any costly step."""
    base = F.lit(0)
    for name, points in config.SOURCE_TYPE_PRIOR.items():
        base = F.when(F.col("source_type") == name, points).otherwise(base)
    pixels = F.coalesce("width", F.lit(0)) * F.coalesce("height", F.lit(0))
    return (
        base + _provenance_points() + _present("category_hint", 2)
        + F.when(pixels >= 1_000_000, 6).when(pixels >= 400_000, 3).otherwise(0)
    ).cast("bigint")


def candidate_strength() -> Column:
    """Who represents a group of copies."""
    megapixels = F.col("width") * F.col("height") / 1_000_000
    return _provenance_points() + F.when(flag("low_res"), 0).otherwise(5) + F.least(F.lit(10.0), megapixels)


def first_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """First row of each key in pipeline order: a partial aggregation, no window over the group."""
    others = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*others), order_key()).alias("_row"))
    return picked.select(*keys, "_row.*")


def union_candidates(providers: list[DataFrame]) -> DataFrame:
    """Providers in order, one row per (provider, entity, image URL), first wins."""
    out = providers[0]
    for df in providers[1:]:
        out = out.unionByName(df)
    return first_per_key(out, ["provider", "entity_id", "image_url"])


def merge_flags(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Same file from several origins: first row's fields, first known hint, flags or-ed."""
    flags = ["depicts", "commons_category", "used_on_wikipedia", "page_mentions_name"]
    others = [c for c in rows.columns if c not in keys + flags + ["category_hint"]]
    out = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*others), order_key()).alias("_row"),
        F.min_by("category_hint", F.when(F.col("category_hint").isNotNull(), order_key())).alias("category_hint"),
        *[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags],
    )
    return out.select(*keys, "_row.*", "category_hint", *flags)


# --- exact dedup by canonical URL -------------------------------------------------

GROUP = ["entity_id", "canonical_url"]


def with_canonical(candidates: DataFrame) -> DataFrame:
    return candidates.withColumns({"canonical_url": canonical_url(F.col("image_url")), "prior": candidate_prior()})


def url_winners(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Best candidate of each canonical URL (highest prior, earliest among equals) and where the group began.

    ``keep`` names the payload columns to carry; the rest never enters the aggregation.
    """
    if keep is not None:
        rows = rows.select(*dict.fromkeys(GROUP + ORDER + ["prior"] + keep))
    others = [c for c in rows.columns if c not in GROUP]
    best = F.min_by(F.struct(*others), F.struct((-F.col("prior")).alias("p"), *ORDER))
    return rows.groupBy(*GROUP).agg(best.alias("_row"), F.min("seq").alias("first_seq")).select(
        *GROUP, "_row.*", "first_seq"
    )


def url_mentions(rows: DataFrame) -> DataFrame:
    """Other pages of each file, in the order a sequential reader would note them.

    Reading a group in order, the leader changes only at candidates with a strictly higher prior. There are
    at most as many leaders as prior values, so they fit in one small array per group. Each candidate then
    knows, by itself, which page it adds: its own (it lost to the leader) or the page of the leader it
    replaced. No group is ever sorted or collected whole, and a file seen once has no other page.
    """
    # Dealt by file once, for this step and the next: nearly all files are seen once, so counting first makes no shuffle smaller.
    firsts = rows.repartition(*GROUP).groupBy(*GROUP, "prior").agg(
        F.min_by(F.struct(*ORDER, "source_page_url", "source_domain"), order_key()).alias("f"), F.count(F.lit(1)).alias("n")
    )
    entry = F.struct(F.col("f.seq").alias("seq"), F.col("f.cand_id").alias("cand_id"), "prior",
                     F.col("f.source_page_url").alias("page"), F.col("f.source_domain").alias("domain"))
    ordered = F.array_sort(F.collect_list(entry))
    leaders = F.when(F.count(F.lit(1)) == 1, F.collect_list(entry)).otherwise(F.filter(ordered, lambda x: ~F.exists(ordered, lambda y: (
        (F.struct(y["seq"], y["cand_id"]) < F.struct(x["seq"], x["cand_id"])) & (y["prior"] >= x["prior"])))))
    per_group = firsts.groupBy(*GROUP).agg(leaders.alias("leaders"), F.sum("n").alias("n")).filter("n > 1").drop("n")

    joined = rows.select(*GROUP, *ORDER, "source_page_url", "source_domain").join(per_group, GROUP)
    place = F.size(F.filter("leaders", lambda x: F.struct(x["seq"], x["cand_id"]) <= F.struct(*[F.col(c) for c in ORDER])))
    joined = joined.withColumn("_place", place)
    now = F.try_element_at("leaders", F.col("_place"))
    before = F.get("leaders", F.col("_place") - 2)
    leads = now["cand_id"] == F.col("cand_id")
    page = F.when(leads, before["page"]).otherwise(F.col("source_page_url"))
    domain = F.when(leads, before["domain"]).otherwise(F.col("source_domain"))
    noted = joined.select(*GROUP, *ORDER, page.alias("page"), domain.alias("domain"), now["page"].alias("_lead"))
    noted = noted.filter(F.col("page").isNotNull() & (F.col("page") != F.col("_lead")))
    return noted.groupBy(*GROUP, "page").agg(
        F.min(order_key()).alias("noted_at"), F.min_by("domain", order_key()).alias("domain")
    )


def dedup_exact_url(candidates: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(winners with their count of other pages, the other pages in long form).

    The addresses are cleaned once: the steps below read them from a stored table, with ``keep`` a narrow one.
    """
    rows = with_canonical(candidates)
    if keep is not None:
        rows = rows.select(*dict.fromkeys([*GROUP, *ORDER, "prior", "source_page_url", "source_domain", *keep]))
    rows = stored(rows, "urls")
    mentions = url_mentions(rows)
    counts = mentions.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_pages"))
    winners = url_winners(rows, keep).join(counts, GROUP, "left").na.fill(0, ["n_pages"])
    return winners, mentions


def select_with_quotas(ranked: DataFrame, limit: int = config.SELECT_LIMIT) -> DataFrame:
    """Round robin over hint buckets (in order of their best row), each best-first, up to ``limit`` per entity.

    No bucket can give more than ``limit`` rows, so buckets are cut first (on the map side); what remains
    per entity is bounded by buckets x limit.
    """
    df = ranked.withColumn("bucket", F.coalesce("category_hint", F.lit("unknown")))
    best = [F.desc("prior"), F.col("first_seq"), F.col("canonical_url")]
    cut = top_k(df, ["entity_id", "bucket"], best, limit, "turn")
    key = F.struct((-F.col("prior")).alias("p"), "first_seq", "canonical_url")
    cut = cut.withColumn("_head", F.min(key).over(Window.partitionBy("entity_id", "bucket")))
    return top_k(cut, ["entity_id"], [F.col("turn"), F.col("_head")], limit, "place").drop("_head")


def interleave(lists: DataFrame, keys: list[str]) -> DataFrame:
    """Round-robin merge of ranked lists (list_no, pos, item); the first occurrence of an item counts."""
    first = lists.groupBy(*keys, "item").agg(F.min(F.struct("pos", "list_no")).alias("at"))
    return positions(first.select(*keys, "item", "at.*"), keys, ["pos"], [F.col("list_no"), F.col("item")], "place")


def pick_diverse(names: DataFrame, keys: list[str], k: int = 4) -> DataFrame:
    """One name per hint first, then the rest in order, up to k."""
    heads = top_k(names, keys + ["hint"], [F.col("pos")], k, "_rn")
    return top_k(heads, keys, [F.col("_rn") > 1, F.col("pos")], k, "place").drop("_rn")


def batching(items: DataFrame, size: int = config.BATCH_SIZE) -> DataFrame:
    """Group by hint (in order of first appearance), then cut into consecutive batches."""
    df = items.withColumn("hint", F.coalesce("category_hint", F.lit("unknown")))
    heads = df.groupBy("entity_id", "hint").agg(F.min(order_key()).alias("h"))
    heads = heads.select("entity_id", "hint", F.col("h.seq").alias("_h1"), F.col("h.cand_id").alias("_h2"))
    keyed = df.join(heads, ["entity_id", "hint"])
    numbered = positions(keyed, ["entity_id"], ["_h1", "_h2"], [F.col("seq"), F.col("cand_id")],
                         block=("seq", 1 << 16))
    return numbered.withColumn("batch_no", F.floor((F.col("position") - 1) / size).cast("bigint")).drop("_h1", "_h2")


def hash_order(id_col: Column, seed: str) -> Column:
    return F.sha1(F.concat(id_col.cast("string"), F.lit(seed)))


def deterministic_sample(df: DataFrame, id_col: str, n: int, seed: str) -> DataFrame:
    """Repeatable sample of n rows: order by a salted hash, take the head (a distributed top-n)."""
    return df.orderBy(hash_order(F.col(id_col), seed), id_col).limit(n)


def sample_for_labels(items: DataFrame, n: int, seed: str) -> DataFrame:
    """Per entity, shown and rejected items both included; entities split into tune and test by hash."""
    per_outcome = n // 2
    picked = top_k(items, ["entity_id", "outcome"], [hash_order(F.col("cand_id"), seed), F.col("cand_id")],
                   per_outcome, "pick")
    half = F.substring(F.sha1(F.concat(F.lit("split"), F.col("entity_id").cast("string"))), 1, 1)
    return picked.withColumn("split", F.when(half < "8", "tune").otherwise("test"))


def latest_per_key(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Newest value of each key; null order columns lose."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))
