"""Chains without a round cap, own pages kept whole, typed provider values."""

import json

from veriframe.operators import dedup, mentions
from veriframe.sources import providers


def test_drifting_chain_equals_sequential_loop(spark):
    # Frames of one slow pan: three more bits turn with each, so a round settles about one link.
    prints = [0]
    for i in range(149):
        prints.append(prints[-1] ^ sum(1 << (3 * i + k) % 64 for k in range(3)))
    rows = [(0, f"i{i}", i, 1.0, h - (1 << 64) if h >> 63 else h, f"u{i}") for i, h in enumerate(prints)]
    df = spark.createDataFrame(rows, "entity_id int, item_id string, ord long, strength double, hash long, canonical_url string")
    got = {r.item_id: (r.verdict, r.twin_id) for r in dedup.dedup_near(df).collect()}
    kept, want = [], {}
    for i, h in enumerate(prints):
        twin = next((k for k in kept if (prints[k] ^ h).bit_count() <= 6), None)
        want[f"i{i}"] = ("keep", None) if twin is None else ("drop", f"i{twin}")
        kept += [i] if twin is None else []
    assert got == want


def test_own_pages_are_not_cut(spark):
    items = spark.createDataFrame([(0, "a", "home", 2.0, 0), (0, "b", "away", 1.0, 1)], "entity_id int, item_id string, page string, strength double, ord long")
    twins = spark.createDataFrame([(0, "b", "a")], "entity_id int, item_id string, twin_id string")
    for n, expected in ((12, 12), (6, 7)):
        own = spark.createDataFrame([(0, "a", i, f"p{i}") for i in range(n)], "entity_id int, item_id string, pos long, page string")
        rows = dedup.attach_also_found(items, twins, own).collect()
        assert len(rows) == expected and sorted(r.place for r in rows) == list(range(1, expected + 1))


def test_sizes_are_numbers_only(spark):
    bodies = [json.dumps({"imageUrl": "https://a/b", "link": "https://c.org/d", "imageWidth": w}) for w in (800, "800", -1, 12.5, None, True)]
    rows = providers.normalize_web_rows(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "k int, body string"))
    assert [r.width for r in rows.orderBy("k").collect()] == [800, None, None, 12, None, None]


def test_observation_values_by_type(spark):
    values = [([1, "campus"], True), (["campus"], 4), ("campus", "2"), (["campus", "nonsense"], False)]
    bodies = [(i, json.dumps([{"id": "x", "secondary_categories": c, "quality": q}])) for i, (c, q) in enumerate(values)]
    rows, _ = providers.parse_observations(spark.createDataFrame(bodies, "k int, body string"))
    assert [(r.secondary_categories, r.quality) for r in rows.orderBy("k").collect()] == [([], 1), (["campus"], 4), ([], 2), (["campus"], 1)]


def test_one_observation_per_candidate(spark):
    from veriframe.operators import scoring
    columns = ", ".join(f"{c} array<string>" if c == "secondary_categories" else f"{c} boolean" if c in ("stock_like", "close_up_portrait")
                        else f"{c} string" for c in scoring.OBSERVATION_COLUMNS)
    def row(cand, seq, kind):
        return (cand, seq, *[{"image_type": kind, "secondary_categories": [], "stock_like": False, "close_up_portrait": False}.get(c)
                             for c in scoring.OBSERVATION_COLUMNS])
    seen = spark.createDataFrame([row("a", 1, "photo"), row("a", 2, "collage"), row("a", 2, "collage"), row("b", 1, "photo")], f"cand_id string, seq long, {columns}")
    sent = spark.createDataFrame([("a",), ("b",), ("c",)], "cand_id string")
    got = {r.cand_id: (r.image_type, r.observed) for r in scoring.join_observations(sent, seen).collect()}
    assert got == {"a": ("collage", True), "b": ("photo", True), "c": (None, False)}


def test_addresses_that_a_parser_refuses(spark):
    from veriframe.functions.urls import canonical_url, url_host
    urls = ["https://www.a.org/x y|{1}.jpg?utm_source=z&id=5", "http://a.org/100%.jpg?w=3", "https://a.org/b\\c.jpg", "https://a.org/ü.jpg?w=1", None]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(canonical_url("u").alias("c"), url_host("u").alias("h")).collect()
    assert [r.c for r in rows] == ["https://a.org/x%20y%7C%7B1%7D.jpg?id=5", "https://a.org/100%25.jpg", "https://a.org/b/c.jpg", "https://a.org/ü.jpg", None]
    assert [r.h for r in rows] == ["a.org"] * 4 + [None]


def test_percentiles_of_a_hot_key_come_from_many_cells(spark):
    import numpy as np
    from veriframe.operators.ranking import histogram_percentiles
    values = np.random.default_rng(3).normal(0, 40, 3000).round(3).tolist() + [5.0] * 500 + [None]
    df = spark.createDataFrame([(1, v) for v in values] + [(2, 7.0)], "k int, v double")
    got = {r.k: r for r in histogram_percentiles(df, ["k"], "v", {"p50": 0.5, "p90": 0.9}).collect()}
    known = [v for v in values if v is not None]
    assert got[1].n == 3500 and abs(got[1].p50 - np.quantile(known, 0.5)) < 1e-9 and abs(got[1].p90 - np.quantile(known, 0.9)) < 1e-9
    assert (got[2].n, got[2].p50, got[2].p90) == (1, 7.0, 7.0)


def test_provenance_keeps_rows_without_domain_or_entity(spark):
    entities = spark.createDataFrame(
        [(1, "Test University", ["tu"], ["t.edu"])], "entity_id long, name_en string, aliases array<string>, domains array<string>"
    ).selectExpr("*", "name_en AS name", "name_en AS name_ru", "name_en AS name_kk", "'tu' AS alias", "'t.edu' AS domain")
    rows = [(1, "www.t.edu", "At Test University"), (1, None, "At Test University"), (7, "x.org", "Elsewhere")]
    web = spark.createDataFrame(rows, "entity_id long, source_domain string, title string").selectExpr(
        "*", "'' AS caption", "'https://x/y' AS source_page_url", "'q' AS query", "'web' AS source_type")
    got = sorted((r.entity_id, r.source_domain or "", r.source_type, r.official_domain, r.page_mentions_name)
                 for r in mentions.apply_provenance(web, entities).collect())
    assert got == [(1, "", "unknown", False, True), (1, "www.t.edu", "official", True, True), (7, "x.org", "independent", False, False)]


def test_copies_never_pay_for_the_wide_search(spark, monkeypatch):
    asked = []
    probe = dedup.probe_pairs
    monkeypatch.setattr(dedup, "probe_pairs", lambda q, k, flips, d: asked.append((flips, q.count())) or probe(q, k, flips, d))
    prints = [(i * 0x9E3779B97F4A7C15 + 12345) % (1 << 63) for i in range(40)]
    known = spark.createDataFrame([(2, h, i) for i, h in enumerate(prints)], "entity_id int, hash long, ord long")
    uploads = [(str(i), 1, h) for i, h in enumerate(prints)] + [("two", 1, prints[3] ^ 0b11), ("six", 1, prints[4] ^ 0b111111 << 20)]
    found = dedup.nearest_known(spark.createDataFrame(uploads, "upload_id string, entity_id int, hash long"), known)
    assert {r.upload_id: r.distance for r in found.collect()} == {**{str(i): 0 for i in range(40)}, "two": 2, "six": 6}
    assert asked == [(0, 2), (1, 1), (2, 0)]
