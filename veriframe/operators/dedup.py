"""Near-duplicate search and dedup over 64-bit fingerprints.

Everything works on *distinct* fingerprints: equal copies collapse into one class before any join, so a
group of a billion copies costs one row. Classes meet on masked keys (see ``clean_band_masks``), and a bucket
that is still large is cut into blocks that are paired block by block, so no task owns a hot bucket.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe import config
from veriframe.functions.hashes import band_layout, clean_band_masks, hamming, masked_keys, probe_masks
from veriframe.functions.text import let
from veriframe.operators.components import components
from veriframe.operators.ranking import top_k
from veriframe.session import cut_lineage, stored

BLOCK = 2048  # members of one bucket that share a join key
MATRIX, MATRIX_ROWS = 8192, 512  # vectors of a block, and rows of it that are multiplied at once
ROUNDS = 6  # of the greedy dedup, before what is still open is settled by component
COMPONENT = 200_000  # rows (items and links) of a component that one task settles in order
SPARE_BANDS = 3  # untouched bands in a key: about 21 bits for distance 6
SPARE_BANDS_KEYED = 2  # beside a key such as the entity: 16 bits, and a third of the copies


def near_pairs(classes: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """All pairs (hash_a < hash_b) of distinct fingerprints at most ``distance`` bits apart, per key.

    ``classes`` holds distinct (keys, hash) rows. Exact: no bucket is capped or sampled. The layout is the same at every
    size; buckets that grow are cut in blocks.
    """
    masks = clean_band_masks(distance, distance + (SPARE_BANDS_KEYED if keys else SPARE_BANDS))
    slots = classes.select(*keys, "hash", F.explode(masked_keys(F.col("hash"), masks)).alias("k")).select(
        *keys, "hash", "k.slot", "k.bits"
    )
    bucket = keys + ["slot", "bits"]
    sizes = slots.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Merge joins: an explode isn't in Spark's size estimate, which would send the keys of all prints through the driver.
    members = slots.join(sizes.hint("merge"), bucket).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("hash"), F.col("blocks")).cast("int"))
    left = members.select(*bucket, F.col("hash").alias("hash_l"), F.col("block").alias("bl"),
                          F.explode(F.sequence("block", F.col("blocks") - 1)).alias("br"))
    right = members.select(*bucket, F.col("hash").alias("hash_r"), F.col("block").alias("br"),
                           F.explode(F.sequence(F.lit(0), "block")).alias("bl"))
    met = left.join(right.hint("merge"), bucket + ["bl", "br"]).filter(
        ((F.col("bl") != F.col("br")) | (F.col("hash_l") < F.col("hash_r")))
        & (hamming(F.col("hash_l"), F.col("hash_r")) <= distance)
    )
    return met.select(
        *keys, F.least("hash_l", "hash_r").alias("hash_a"), F.greatest("hash_l", "hash_r").alias("hash_b")
    ).distinct().withColumn("distance", hamming(F.col("hash_a"), F.col("hash_b")).cast("bigint"))


def both_ways(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs in both directions plus every class with itself is added by the caller."""
    return pairs.select(*keys, F.col("hash_a").alias("hash"), F.col("hash_b").alias("other")).unionByName(
        pairs.select(*keys, F.col("hash_b").alias("hash"), F.col("hash_a").alias("other"))
    )


def _priority(neg_strength: Column) -> Column:
    return F.struct(neg_strength.alias("neg_strength"), F.col("ord").alias("ord"), F.col("item_id").alias("item_id"))


def dedup_near(items: DataFrame, distance: int = config.NEAR_DUP_HAMMING) -> DataFrame:
    """Greedy dedup, strongest first, of (entity_id, item_id, ord, strength, hash, canonical_url).

    An item is dropped when a *kept* stronger item has the same canonical URL or a near fingerprint; its twin
    is the strongest such item. That is the lexicographically first maximal independent set, found by rounds:
    an undecided item is kept once nothing stronger and undecided is near it, and dropped once something
    kept and stronger is. Messages travel per class (min over class, then over near classes), never per item pair.
    Every round settles at least the strongest open item; rounds work on the items still open and those kept in the
    round before, whose message is then delivered. What a few rounds leave open (long chains) is cut in connected
    components: each of bounded size is settled in order by one task, and rounds go on for the others alone.
    """
    prio = _priority(-F.col("strength"))
    base = items.select("entity_id", "item_id", "hash", "canonical_url", prio.alias("prio"))
    classes = base.groupBy("entity_id", "hash").agg(F.count(F.lit(1)).alias("class_n"))
    pairs = cut_lineage(near_pairs(classes.select("entity_id", "hash"), ["entity_id"], distance))
    links = both_ways(pairs, ["entity_id"])
    linked = links.select("entity_id", "hash").distinct().withColumn("linked", F.lit(True))
    urls = base.groupBy("entity_id", "canonical_url").agg(F.count(F.lit(1)).alias("url_n"))
    state = (
        base.join(classes, ["entity_id", "hash"]).join(urls, ["entity_id", "canonical_url"])
        .join(linked, ["entity_id", "hash"], "left")
    )
    alone = (F.col("class_n") == 1) & (F.col("url_n") == 1) & F.col("linked").isNull()
    state = cut_lineage(state.select(
        "entity_id", "item_id", "hash", "canonical_url", "prio",
        F.when(alone, "keep").otherwise("open").alias("status"),
    ))
    settled, active = [state.filter("status = 'keep'")], state.filter("status = 'open'")
    rounds = 0
    while not active.filter("status = 'open'").isEmpty():
        rounds += 1
        if rounds == ROUNDS + 1:
            done, active = _by_component(active, links)
            settled.append(done)
            continue
        after = cut_lineage(_round(active, links))
        settled.append(after.filter("status in ('done', 'drop')"))
        active = after.filter("status in ('open', 'keep')")
        if len(settled) == 16:
            settled = [cut_lineage(reduce(DataFrame.unionByName, settled))]
    every = reduce(DataFrame.unionByName, [*settled, active])
    return settle_twins(every.withColumn("status", F.when(F.col("status") == "drop", "drop").otherwise("keep")), links)


def _round(active: DataFrame, links: DataFrame) -> DataFrame:
    """One round over open items and the items kept in the round before, which come out as done."""
    open_prio = F.min(F.when(F.col("status") == "open", F.col("prio")))
    kept_prio = F.min(F.when(F.col("status") == "keep", F.col("prio")))
    per_class = active.groupBy("entity_id", "hash").agg(open_prio.alias("o"), kept_prio.alias("k"))
    # What a class hears: its own best and the best of the near classes.
    heard = per_class.select("entity_id", "hash", "o", "k").unionByName(
        links.join(per_class.withColumnRenamed("hash", "other"), ["entity_id", "other"]).select(
            "entity_id", "hash", "o", "k")
    ).groupBy("entity_id", "hash").agg(F.min("o").alias("o_near"), F.min("k").alias("k_near"))
    per_url = active.groupBy("entity_id", "canonical_url").agg(open_prio.alias("o_url"), kept_prio.alias("k_url"))
    joined = active.join(heard, ["entity_id", "hash"]).join(per_url, ["entity_id", "canonical_url"])
    best_open = F.least("o_near", "o_url")  # least() skips nulls
    best_kept = F.least("k_near", "k_url")
    beaten = F.coalesce(best_kept < F.col("prio"), F.lit(False))
    is_open = F.col("status") == "open"
    return joined.select(
        "entity_id", "item_id", "hash", "canonical_url", "prio",
        F.when(~is_open, "done").when(beaten, "drop")
        .when(best_open == F.col("prio"), "keep").otherwise("open").alias("status"),
    )


def _by_component(active: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled rows, rows of components that are too large for one task) of items still open and those just kept."""
    node = lambda kind, c: F.xxhash64(F.lit(kind), "entity_id", c)
    classes = active.select("entity_id", "hash").distinct()
    near = links.join(classes, ["entity_id", "hash"], "left_semi").join(
        classes.withColumnRenamed("hash", "other"), ["entity_id", "other"], "left_semi")
    by_class, by_url = node("class", "hash"), node("url", "canonical_url")
    edges = near.select(by_class.alias("u"), node("class", "other").alias("v")).unionByName(
        active.select(by_class.alias("u"), by_url.alias("v")))
    found = cut_lineage(components(edges))
    place = lambda df: df.withColumn("node", by_class).join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node")).drop("node")
    members, ties = cut_lineage(place(active)), cut_lineage(place(near))
    sizes = members.select("component").unionByName(ties.select("component")).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.filter(F.col("n") <= COMPONENT).select("component")
    # Written, so that the two sides share no column by origin.
    rows = cut_lineage(members.join(small, "component", "left_semi").select(
        "component", "entity_id", "item_id", "hash", "canonical_url", "prio.neg_strength", "prio.ord", "status"))
    own = cut_lineage(ties.join(small, "component", "left_semi").select("component", "entity_id", "hash", "other"))
    kinds = dict(active.dtypes)
    verdicts = rows.groupBy("component").cogroup(own.groupBy("component")).applyInPandas(
        _settle, f"entity_id {kinds['entity_id']}, item_id {kinds['item_id']}, status string")
    done = members.drop("status", "component").join(cut_lineage(verdicts), ["entity_id", "item_id"])
    return done, members.join(small, "component", "left_anti").drop("component")


def _settle(items: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """One component in order: an item stays unless something kept before it is near or has its URL."""
    near: dict[tuple, list] = {}
    for entity, own, other in zip(links["entity_id"], links["hash"], links["other"]):
        near.setdefault((entity, own), []).append((entity, other))
    items = items.sort_values(["neg_strength", "ord", "item_id"])
    kept_classes, kept_urls, out = set(), set(), []
    for entity, own, url, status in zip(items["entity_id"], items["hash"], items["canonical_url"], items["status"]):
        cls = (entity, own)
        beaten = status == "open" and (
            (entity, url) in kept_urls or cls in kept_classes or any(c in kept_classes for c in near.get(cls, ())))
        out.append("drop" if beaten else "done")
        if not beaten:
            kept_classes.add(cls)
            kept_urls.add((entity, url))
    return pd.DataFrame({"entity_id": items["entity_id"], "item_id": items["item_id"], "status": out})


def settle_twins(state: DataFrame, links: DataFrame) -> DataFrame:
    """Verdicts with the strongest kept twin of every dropped item, read off the final kept set.

    A drop is decided as soon as one kept twin is known; a stronger one may settle in a later round.
    """
    kept = state.filter("status = 'keep'")
    by_hash = kept.groupBy("entity_id", "hash").agg(F.min("prio").alias("k"))
    by_url = kept.groupBy("entity_id", "canonical_url").agg(F.min("prio").alias("k_url"))
    near = by_hash.unionByName(
        links.join(by_hash.withColumnRenamed("hash", "other"), ["entity_id", "other"]).select("entity_id", "hash", "k")
    ).groupBy("entity_id", "hash").agg(F.min("k").alias("k_hash"))
    found = state.join(near, ["entity_id", "hash"], "left").join(by_url, ["entity_id", "canonical_url"], "left")
    twin = F.least("k_hash", "k_url")
    return found.select("entity_id", "item_id", F.col("status").alias("verdict"),
                        F.when(F.col("status") == "drop", twin["item_id"]).alias("twin_id"))


def attach_also_found(items: DataFrame, twins: DataFrame, own_pages: DataFrame,
                      cap: int = config.ALSO_FOUND_CAP) -> DataFrame:
    """Pages each kept item collects: its own list, then page and list of every duplicate, strongest first.

    Its own page and repeats are skipped. The own list stays whole; pages of duplicates are added while the list is
    shorter than ``cap``, and only the first ``cap`` of them per item survive the map side. ``items`` has page,
    strength, ord; ``own_pages`` has (entity_id, item_id, pos, page). With a ``domain`` in both, pages keep theirs.
    """
    extra = [c for c in ("domain",) if c in items.columns and c in own_pages.columns]
    info = items.select("entity_id", "item_id", "page", *extra, (-F.col("strength")).alias("neg"), "ord")
    lead = info.select("entity_id", F.col("item_id").alias("keeper"), F.col("page").alias("keeper_page"))
    keepers = info.join(twins.select("entity_id", "item_id"), ["entity_id", "item_id"], "left_anti")
    own = own_pages.join(keepers.select("entity_id", "item_id"), ["entity_id", "item_id"]).select(
        "entity_id", F.col("item_id").alias("keeper"), F.lit(0).alias("src"), F.lit(0.0).alias("neg"),
        F.lit(0).cast("bigint").alias("ord"), "pos", "page", *extra)
    losers = info.join(twins, ["entity_id", "item_id"])
    pages = losers.select("entity_id", F.col("twin_id").alias("keeper"), F.lit(1).alias("src"), "neg", "ord",
                          F.lit(0).cast("bigint").alias("pos"), "page", *extra)
    lists = own_pages.join(losers.drop("page", *extra), ["entity_id", "item_id"]).select(
        "entity_id", F.col("twin_id").alias("keeper"), F.lit(1).alias("src"), "neg", "ord",
        (F.col("pos") + 1).alias("pos"), "page", *extra)
    every = own.unionByName(pages).unionByName(lists).join(lead, ["entity_id", "keeper"])
    # The keeper's own list is taken as it is; for the rest its own page and repeats are skipped.
    every = every.filter((F.col("src") == 0) | (F.col("page") != F.col("keeper_page")))
    at = F.struct("src", "neg", "ord", "pos")
    first = every.groupBy("entity_id", "keeper", "page").agg(F.min(at).alias("at"), *[F.min_by(c, at).alias(c) for c in extra])
    added = top_k(first.filter("at.src = 1"), ["entity_id", "keeper"], [F.col("at"), F.col("page")], cap, "place").drop("place")
    order = Window.partitionBy("entity_id", "keeper").orderBy("at", "page")
    placed = first.filter("at.src = 0").unionByName(added).withColumn("place", F.row_number().over(order).cast("bigint"))
    return placed.filter((F.col("at.src") == 0) | (F.col("place") <= cap)).select(
        "entity_id", F.col("keeper").alias("item_id"), "page", *extra, "place"
    )


def cross_sources(items: DataFrame, also_found: DataFrame) -> DataFrame:
    """(entity_id, item_id, other_sources) of the kept items that other domains show too.

    Counts the pages of ``also_found`` (with ``domain``) whose domain isn't the item's own; the scorer's cross-source
    signal asks whether there is one. A missing domain is a domain of its own.
    """
    own = items.select("entity_id", "item_id", F.col("domain").alias("own_domain"))
    other = also_found.join(own, ["entity_id", "item_id"]).filter(~F.col("domain").eqNullSafe(F.col("own_domain")))
    return other.groupBy("entity_id", "item_id").agg(F.count("*").alias("other_sources"))


def resolve_pointers(items: DataFrame) -> DataFrame:
    """Observed duplicates: an item points to another one and is dropped only if that one is *shown*.

    Input (entity_id, item_id, ord, points_to, eligible). Only pointers to earlier items count. Whether an item
    is shown depends on its pointer alone, so each item is a function of its target ("not", "never", ...).
    Composing the functions doubles the distance per round: log2(longest chain) rounds instead of one per link.
    """
    target = items.select("entity_id", F.col("item_id").alias("points_to"), F.col("ord").alias("t_ord"))
    linked = items.join(target, ["entity_id", "points_to"], "left")
    valid = (F.col("points_to") != F.col("item_id")) & (F.col("t_ord") < F.col("ord"))
    # on_shown / on_hidden: is this item shown if its target is shown / hidden?
    state = linked.select(
        "entity_id", "item_id", "eligible", F.when(valid, F.col("points_to")).alias("target"),
    ).withColumn("first_target", F.col("target")).select(
        "*",
        F.when(F.col("target").isNull(), F.col("eligible")).otherwise(F.lit(False)).alias("on_shown"),
        F.col("eligible").alias("on_hidden"),
    )
    state = cut_lineage(state)
    while True:
        open_rows = state.filter("target is not null and on_shown <> on_hidden")
        if open_rows.isEmpty():
            break
        nxt = state.select(
            "entity_id", F.col("item_id").alias("target"), F.col("target").alias("n_target"),
            F.col("on_shown").alias("n_shown"), F.col("on_hidden").alias("n_hidden"),
        )
        apply = lambda c: F.when(F.col(c), F.col("on_shown")).otherwise(F.col("on_hidden"))
        stepped = open_rows.join(nxt, ["entity_id", "target"]).select(
            "entity_id", "item_id", "eligible", F.col("n_target").alias("target"), "first_target",
            apply("n_shown").alias("on_shown"), apply("n_hidden").alias("on_hidden"),
        )
        settled = state.filter("target is null or on_shown = on_hidden")
        state = cut_lineage(settled.unionByName(stepped))
    shown = state.select("entity_id", "item_id", "eligible", "first_target", F.col("on_hidden").alias("shown"))
    twin = shown.select("entity_id", F.col("item_id").alias("first_target"), F.col("shown").alias("twin_shown"))
    joined = shown.join(twin, ["entity_id", "first_target"], "left")
    duplicate = F.coalesce(F.col("twin_shown"), F.lit(False))
    return joined.select(
        "entity_id", "item_id",
        F.when(duplicate, "duplicate").when(F.col("shown"), "shown").otherwise("rejected").alias("verdict"),
        F.when(duplicate, F.col("first_target")).alias("duplicate_of"),
    )


# --- nearest known picture ----------------------------------------------------------

PROBE_BANDS = 4


def probe_pairs(queries: DataFrame, known: DataFrame, flips: int, distance: int) -> DataFrame:
    """(q_hash, k_hash, distance) for distinct fingerprints at most ``distance`` bits apart.

    The known side stores one row per band (16 bits); the asking side flips up to ``flips`` bits of each band. Nothing
    within PROBE_BANDS * (flips + 1) - 1 bits is missed: some band then has at most ``flips`` errors.
    """
    layout = [m - (1 << 64) if m >= 1 << 63 else m for m in band_layout(PROBE_BANDS)]
    stored = known.select("k_hash", F.explode(masked_keys(F.col("k_hash"), layout)).alias("k")).select(
        "k_hash", "k.slot", "k.bits"
    )
    probes = F.array(*[
        F.struct(F.lit(slot).alias("slot"), F.array(*[F.lit(m) for m in probe_masks(band, flips)]).alias("flips"))
        for slot, band in enumerate(band_layout(PROBE_BANDS))
    ])
    asked = queries.select("q_hash", F.explode(probes).alias("p")).select(
        "q_hash", F.col("p.slot").alias("slot"), F.explode("p.flips").alias("flip")
    )
    mask = F.element_at(F.array(*[F.lit(m) for m in layout]), F.col("slot") + 1)
    asked = asked.select("q_hash", "slot", F.col("q_hash").bitwiseAND(mask).bitwiseXOR(F.col("flip")).alias("bits"))
    near = hamming(F.col("q_hash"), F.col("k_hash"))
    # As in near_pairs: neither side's estimate counts its flips or bands.
    return asked.join(stored.hint("merge"), ["slot", "bits"]).filter(near <= distance).select(
        "q_hash", "k_hash", near.cast("bigint").alias("distance")
    ).distinct()


def nearest_pairs(queries: DataFrame, known: DataFrame, distance: int) -> DataFrame:
    """(q_hash, k_hash, distance): all known fingerprints at the least distance of each asking one, within ``distance``.

    The radius grows: equal ones by a plain join, then what whole bands find (three bits), then one and more flips a band.
    A stage asks only for those that found nothing so far, and finds everything within its radius, so its best is certain:
    an upload with an exact copy never pays for the wide search.
    """
    equal = queries.join(known, F.col("q_hash") == F.col("k_hash")).select("q_hash", "k_hash", F.lit(0).cast("bigint").alias("distance"))
    found, flips, reach = cut_lineage(equal), 0, 0
    every = Window.partitionBy("q_hash")
    while reach < distance:
        reach = min(PROBE_BANDS * (flips + 1) - 1, distance)
        pairs = probe_pairs(queries.join(found, "q_hash", "left_anti"), known, flips, reach)
        best = pairs.withColumn("least", F.min("distance").over(every)).filter("distance = least").drop("least")
        found = found.unionByName(cut_lineage(best))
        flips += 1
    return found


def known_pool(photos: DataFrame, uploads: DataFrame) -> DataFrame:
    """(entity_id, hash, ord): what is known of every entity, its profile photos and accepted uploads, each print once.

    Both sides have (entity_id, hash, ord); the first place counts. Rows without a fingerprint can't be found again.
    """
    columns = ["entity_id", "hash", "ord"]
    rows = photos.select(*columns).unionByName(uploads.select(*columns)).filter("hash is not null")
    return rows.groupBy("entity_id", "hash").agg(F.min("ord").alias("ord"))


def nearest_known(uploads: DataFrame, known: DataFrame, distance: int = config.UPLOAD_DUP_HAMMING) -> DataFrame:
    """Verdict of each upload (upload_id, entity_id, hash) against known (entity_id, hash, ord).

    The closest known picture decides; among equals the upload's own entity comes first in the pool, then pool
    order. Hits become ``own`` or ``other``; nothing within ``distance`` is ``none``.
    """
    by_entity = known.groupBy("hash", "entity_id").agg(F.min("ord").alias("ord"))
    by_hash = by_entity.groupBy("hash").agg(F.min(F.struct("ord", "entity_id")).alias("first"))
    pairs = nearest_pairs(
        uploads.select(F.col("hash").alias("q_hash")).filter("q_hash is not null").distinct(),
        by_hash.select(F.col("hash").alias("k_hash")), distance
    )
    ties = pairs.join(by_hash.select(F.col("hash").alias("k_hash"), "first"), "k_hash")
    # Per asking fingerprint: the first known one overall, and the entities that own one of the ties.
    overall = ties.groupBy("q_hash", "distance").agg(F.min("first").alias("first"))
    owners = ties.join(by_entity.select(F.col("hash").alias("k_hash"), "entity_id"), "k_hash").select(
        "q_hash", "entity_id"
    ).distinct().withColumn("own", F.lit(True))
    found = uploads.withColumnRenamed("hash", "q_hash").join(overall, "q_hash", "left").join(
        owners, ["q_hash", "entity_id"], "left"
    )
    return found.select(
        "upload_id", "entity_id", "distance",
        F.when(F.col("distance").isNull(), "none").when(F.col("own"), "own").otherwise("other").alias("match"),
        F.when(F.col("distance").isNotNull(), F.when(F.col("own"), F.col("entity_id"))
               .otherwise(F.col("first.entity_id"))).alias("matched_entity"),
    )


def reuse(items: DataFrame, distance: int = config.NEAR_DUP_HAMMING) -> DataFrame:
    """Copies across entities (item_id, entity_id, hash, is_stock): stock reuse, reuse by many, reuse by one.

    "At least two others" needs no more than the three smallest entity ids near a class, so per-class lists stay
    at three entries however many entities share a picture.
    """
    classes = items.groupBy("hash").agg(F.bool_or("is_stock").alias("stock"))
    pairs = near_pairs(classes.select("hash"), [], distance)
    self_links = classes.select("hash", F.col("hash").alias("other"))
    links = both_ways(pairs, []).unionByName(self_links)
    owners = top_k(items.select("hash", "entity_id").distinct(), ["hash"], [F.col("entity_id")], 3, "_r").drop("_r")
    near_owners = links.join(owners.withColumnRenamed("hash", "other"), "other").select("hash", "entity_id").distinct()
    few = top_k(near_owners, ["hash"], [F.col("entity_id")], 3, "_r").groupBy("hash").agg(
        F.collect_list("entity_id").alias("near_entities")
    )
    stock = links.join(classes.withColumnRenamed("hash", "other"), "other").groupBy("hash").agg(
        F.bool_or("stock").alias("near_stock")
    )
    joined = items.join(few, "hash").join(stock, "hash")
    others = F.size(F.filter("near_entities", lambda e: e != F.col("entity_id")))
    return joined.select(
        "item_id", "entity_id",
        F.when(F.col("near_stock"), "stock_reuse").when(others >= 2, "reused_across_universities")
        .when(others == 1, "reused_by_one").otherwise("unique").alias("verdict"),
    )


# --- embeddings and bytes -------------------------------------------------------------


def dedup_bytes(rows: DataFrame, content: str, order: list[str]) -> DataFrame:
    """First row of each identical content; copies are counted, never collected."""
    others = [c for c in rows.columns if c != content]
    return rows.withColumn("digest", F.sha2(F.col(content), 256)).groupBy("digest").agg(
        F.min_by(F.struct(*others), F.struct(*order)).alias("_row"), F.count(F.lit(1)).alias("copies")
    ).select("digest", "_row.*", "copies")


def normalized(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return let(norm, lambda n: F.transform(vector, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def similar_embeddings(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Similar vectors (keys, id_a, id_b), exact, without listing all pairs of a group of copies.

    Copies (equal after scaling) form a class led by their smallest id and are linked to it, one row each. Leaders
    with cosine at least ``threshold`` are paired. Such unit vectors differ by at most sqrt(2 - 2t) in every fixed
    projection; three projections are cut into cells of that width, so a pair is at most one cell apart in each. Cells
    are cut in blocks, and every two blocks of neighbouring cells meet once, as one matrix product in one task.
    """
    width = (2 - 2 * threshold) ** 0.5 + 1e-9
    form = rows.select(*keys, "id", F.transform(normalized(F.col("e")), lambda x: F.round(x, 9)).alias("form"))
    leaders = stored(form.groupBy(*keys, "form").agg(F.min("id").alias("lead")), "leaders")
    copies = form.join(leaders, keys + ["form"]).filter(F.col("id") != F.col("lead")).select(
        *keys, F.col("lead").alias("id_a"), F.col("id").alias("id_b"))

    def projection(part: int) -> Column:
        picked = F.filter("form", lambda x, i: i % 3 == part)
        total = F.aggregate(picked, F.lit(0.0), lambda acc, x: acc + x)
        return F.floor(total / F.sqrt(F.size(picked).cast("double")) / F.lit(width))

    axes, others = ["c0", "c1", "c2"], ["n0", "n1", "n2"]
    # Vectors of different sizes, or with a part missing, have no cosine.
    cells = leaders.filter(F.col("lead").isNotNull() & ~F.exists("form", lambda x: x.isNull())).select(
        *keys, F.size("form").alias("size"), "lead", "form", *[projection(p).alias(axes[p]) for p in range(3)])
    cell = [*keys, "size", *axes]
    sizes = cut_lineage(cells.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / MATRIX).cast("int").alias("blocks")))
    placed = cells.join(sizes, cell).withColumn("block", F.pmod(F.xxhash64("lead"), F.col("blocks")).cast("int")).drop("blocks")
    steps = [s for s in product((-1, 0, 1), repeat=3) if s >= (0, 0, 0)]
    beside = sizes.select(*cell, F.col("blocks").alias("left_blocks"), F.explode(F.array(*[F.struct(
        *[(F.col(a) + d).alias(n) for a, d, n in zip(axes, s, others)]) for s in steps])).alias("n")).select(*cell, "left_blocks", "n.*")
    beside = beside.join(sizes.toDF(*keys, "size", *others, "blocks"), [*keys, "size", *others])
    same = (F.col("c0") == F.col("n0")) & (F.col("c1") == F.col("n1")) & (F.col("c2") == F.col("n2"))
    meets = beside.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1))).withColumn(
        "other", F.explode(F.sequence(F.when(same, F.col("block")).otherwise(0), F.col("blocks") - 1)))
    meets = cut_lineage(meets.select(*cell, *others, "block", "other"))
    left = placed.join(meets.hint("merge"), [*cell, "block"])
    right = placed.toDF(*keys, "size", *others, "lead", "form", "other").join(meets.hint("merge"), [*keys, "size", *others, "other"])
    meeting, kinds = [*cell, *others, "block", "other"], dict(leaders.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"id_a {kinds['lead']}", f"id_b {kinds['lead']}"])

    def pairs_of(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        at = len(keys) + 1
        own = key[at:at + 3] == key[at + 3:at + 6] and key[-2] == key[-1]
        first, second = _close_rows(np.stack(a["form"]), np.stack(b["r_form"]), threshold - 1e-9) if len(a) and len(b) else ([], [])
        x, y = a["lead"].to_numpy()[first], b["r_lead"].to_numpy()[second]
        out = pd.DataFrame({"id_a": np.where(x < y, x, y), "id_b": np.where(x < y, y, x)})[(x < y) if own else (x != y)]
        for i, k in enumerate(keys):
            out.insert(i, k, [key[i]] * len(out))
        return out

    # Names of its own, so that the two sides share no column by origin.
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in meeting], F.col("lead").alias("r_lead"), F.col("form").alias("r_form"))
    pairs = left.groupBy(*meeting).cogroup(right.groupBy(*[f"r_{c}" for c in meeting])).applyInPandas(pairs_of, schema)
    return copies.unionByName(pairs)


def _close_rows(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (of a, of b) whose inner product is ``least`` or more, NaN included as SQL orders it.

    A matrix product may add in another order, so products at the bound are summed again, part by part as ``cosine`` does.
    """
    found = [(np.empty(0, int), np.empty(0, int))]
    for start in range(0, len(a), MATRIX_ROWS):
        products = a[start:start + MATRIX_ROWS] @ b.T
        i, j = np.nonzero(~(products < least - 1e-12))
        near = np.flatnonzero(np.abs(products[i, j] - least) <= 1e-12)
        keep = np.ones(len(i), bool)
        for part in np.array_split(near, len(near) // 65536 + 1):
            keep[part] = ~(np.add.accumulate(a[start + i[part]] * b[j[part]], axis=1)[:, -1] < least)
        found.append((start + i[keep], j[keep]))
    return tuple(np.concatenate(side) for side in zip(*found))
