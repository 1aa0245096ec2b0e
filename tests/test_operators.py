"""Operators against small loops that follow the rules literally."""

import random

from pyspark.sql import functions as F

from veriframe import config
from veriframe.functions.hashes import clean_band_masks, hash_to_hex, hex_to_hash, neighbour_bits
from veriframe.operators import candidates, dedup, geo_join, mentions, profile, ranking, resolve, scoring


def popcount(x):
    return bin(x & (1 << 64) - 1).count("1")


def test_band_masks_lose_no_pair():
    rng = random.Random(1)
    for distance, bands in ((6, 7), (6, 9), (10, 14)):
        masks = clean_band_masks(distance, bands)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for p in rng.sample(range(64), distance):
                b ^= 1 << p
            assert any((a & m) == (b & m) for m in masks)


def near_items(rng, n):
    rows, base = [], [rng.getrandbits(64) for _ in range(6)]
    for i in range(n):
        h = rng.choice(base)
        for p in rng.sample(range(64), rng.randint(0, 7)):
            h ^= 1 << p
        h = h - (1 << 64) if h >= 1 << 63 else h
        url = f"s{rng.randint(0, 3)}" if rng.random() < 0.1 else f"u{i}"
        rows.append((i % 2, f"i{i}", i, float(rng.randint(0, 9)), h, url))
    return rows


def test_greedy_dedup_equals_sequential_loop(spark):
    rng = random.Random(7)
    rows = near_items(rng, 240)
    df = spark.createDataFrame(rows, "entity_id int, item_id string, ord long, strength double, hash long, canonical_url string")
    got = {r.item_id: (r.verdict, r.twin_id) for r in dedup.dedup_near(df).collect()}
    want = {}
    for entity in (0, 1):
        kept = []
        for row in sorted((r for r in rows if r[0] == entity), key=lambda r: (-r[3], r[2])):
            twin = next((k for k in kept if k[5] == row[5] or popcount(k[4] ^ row[4]) <= 6), None)
            want[row[1]] = ("drop", twin[1]) if twin else ("keep", None)
            if not twin:
                kept.append(row)
    assert got == want


def drifting_chain(n, seed=2):
    """Each print a few bits from the one before: the greedy order can only be followed link by link."""
    rng, h, rows = random.Random(seed), 0, []
    for i in range(n):
        for bit in rng.sample(range(64), 4):
            h ^= 1 << bit
        rows.append((1, str(i), i, float(n - i), h - (1 << 64) if h >> 63 else h, f"u{i}"))
    return rows


def test_long_chains_take_no_more_rounds(spark, monkeypatch):
    rows = drifting_chain(3000) + [(2, "a", 0, 2.0, 5, "x"), (2, "b", 1, 1.0, -1, "x"), (2, "c", 2, 0.5, -2, "y")]
    kept, wanted = {}, {}
    for entity, item, ord_, strength, h, url in sorted(rows, key=lambda r: (r[0], -r[3], r[2])):
        twin = next((k for k in kept.get(entity, []) if k[1] == url or popcount(k[2] ^ h) <= 6), None)
        wanted[entity, item] = twin and twin[0]
        if not twin:
            kept.setdefault(entity, []).append((item, url, h))
    items = spark.createDataFrame(rows, "entity_id long, item_id string, ord long, strength double, hash long, canonical_url string")
    rounds = []
    whole = dedup._round
    monkeypatch.setattr(dedup, "_round", lambda *a: rounds.append(1) or whole(*a))
    for size, most in ((200_000, dedup.ROUNDS), (5, 10_000)):  # with small components, rounds have to settle the chain
        if size == 5:
            items = items.where("ord < 15")
        monkeypatch.setattr(dedup, "COMPONENT", size)
        rounds.clear()
        got = {(r.entity_id, r.item_id): r.twin_id for r in dedup.dedup_near(items).collect()}
        assert got == {k: v for k, v in wanted.items() if k in got} and len(rounds) <= most
        assert len(got) == items.count()


def test_components(spark):
    from veriframe.operators.components import components

    chain = [(i, i + 1) for i in range(10, 300)] + [(500, 400), (400, 450), (600, 600), (None, 3), (500, 400)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "u long, v long")).collect()))
    assert got == {**{i: 10 for i in range(11, 301)}, 450: 400, 500: 400}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_near_pairs_with_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 5)
    rng = random.Random(9)
    hashes = sorted({r[4] for r in near_items(rng, 150)})
    got = {(r.hash_a, r.hash_b) for r in dedup.near_pairs(
        spark.createDataFrame([(h,) for h in hashes], "hash long"), [], 6).collect()}
    assert got == {(a, b) for a in hashes for b in hashes if a < b and popcount(a ^ b) <= 6}


def test_pointer_chain(spark):
    # 1 shown, 2 -> 1 duplicate, 3 -> 2 shown (its target is hidden), 4 -> 3 duplicate, 5 -> 9 later: ignored, 6 rejected
    rows = [(0, 1, 1, None, True), (0, 2, 2, 1, True), (0, 3, 3, 2, True), (0, 4, 4, 3, True), (0, 5, 5, 9, True),
            (0, 6, 6, None, False), (0, 9, 9, 6, True)]
    df = spark.createDataFrame(rows, "entity_id int, item_id long, ord long, points_to long, eligible boolean")
    got = {r.item_id: (r.verdict, r.duplicate_of) for r in dedup.resolve_pointers(df).collect()}
    assert got == {1: ("shown", None), 2: ("duplicate", 1), 3: ("shown", None), 4: ("duplicate", 3), 5: ("shown", None),
                   6: ("rejected", None), 9: ("shown", None)}


def candidate_rows(rng, n):
    return [(i, f"c{i:04d}", rng.randint(0, 2), f"u{rng.randint(0, 5)}", rng.randint(0, 4), f"p{rng.randint(0, 6)}",
             rng.choice(["a", "b", "c", None])) for i in range(n)]


SCHEMA = "seq long, cand_id string, entity_id int, canonical_url string, prior long, source_page_url string, category_hint string"


def test_url_mentions_equal_sequential_fold(spark):
    rows = candidate_rows(random.Random(11), 300)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("source_domain", F.col("source_page_url"))
    got = {}
    for r in candidates.url_mentions(df).collect():
        got.setdefault((r.entity_id, r.canonical_url), []).append((tuple(r.noted_at), r.page))
    got = {k: [p for _, p in sorted(v)] for k, v in got.items()}
    groups = {}
    for seq, cid, ent, url, prior, page, _ in rows:
        g = groups.setdefault((ent, url), {"best": None, "prior": 0, "pages": []})
        if g["best"] is None:
            g.update(best=page, prior=prior)
            continue
        weaker = g["best"] if prior > g["prior"] else page
        if prior > g["prior"]:
            g.update(best=page, prior=prior)
        if weaker != g["best"] and weaker not in g["pages"]:
            g["pages"].append(weaker)
    assert got == {k: g["pages"] for k, g in groups.items() if g["pages"]}


def test_quota_select_equals_round_robin(spark):
    rows = candidate_rows(random.Random(13), 200)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("canonical_url", F.col("cand_id")).withColumn("first_seq", F.col("seq"))
    got = {}
    for r in candidates.select_with_quotas(df, 20).collect():
        got.setdefault(r.entity_id, []).append((r.place, r.cand_id))
    for entity, places in got.items():
        ranked = sorted((r for r in rows if r[2] == entity), key=lambda r: (-r[4], r[0]))
        buckets = {}
        for r in ranked:
            buckets.setdefault(r[6] or "unknown", []).append(r[1])
        want = []
        while len(want) < 20 and any(buckets.values()):
            for b in buckets.values():
                if b and len(want) < 20:
                    want.append(b.pop(0))
        assert [c for _, c in sorted(places)] == want


def test_positions_and_percentiles(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xy"), rng.choice([None, 1, 2]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, c int, i long")
    got = {r.i: r.position for r in ranking.positions(df, ["k"], ["c"], [F.col("i")], block=("i", 16)).collect()}
    for key in "xy":
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in ordered] == list(range(1, len(ordered) + 1))
    stats = ranking.histogram_percentiles(df, ["k"], "i", {"median": 0.5}).collect()
    import statistics
    assert {r.k: r["median"] for r in stats} == {k: statistics.median(r[2] for r in rows if r[0] == k) for k in "xy"}


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = ranking.top_k(df, ["k"], [F.col("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def scored_row(spark, candidate=None, observation=None, entity=None):
    base = {"cand_id": "a", "seq": 1, "entity_id": 1, "source_domain": "x.org", "source_type": "independent", "depicts": False,
            "commons_category": False, "used_on_wikipedia": False, "official_domain": False, "page_mentions_name": False,
            "other_sources": 0, "lat": None, "lon": None, "low_res": False, "date_value": None, "date_kind": None,
            "category_hint": None, "image_url": "u", "source_page_url": "p"} | (candidate or {})
    seen = {"cand_id": "a", "image_type": "photo", "stock_like": False, "primary_category": "campus",
            "secondary_categories": ["lab", "lab", "x", "campus"], "visible_text": "", "names_institution": "none",
            "other_institution_name": None, "scene": "unclear", "close_up_portrait": False}
    place = {"entity_id": 1, "lat": 43.0, "lon": 77.0, "city_lat": 43.1, "city_lon": 77.0} | (entity or {})
    cs = ("cand_id string, seq long, entity_id long, source_domain string, source_type string, depicts boolean, commons_category boolean, "
          "used_on_wikipedia boolean, official_domain boolean, page_mentions_name boolean, other_sources long, lat double, lon double, "
          "low_res boolean, date_value string, date_kind string, category_hint string, image_url string, source_page_url string")
    os_ = ("cand_id string, image_type string, stock_like boolean, primary_category string, secondary_categories array<string>, visible_text string, "
           "names_institution string, other_institution_name string, scene string, close_up_portrait boolean")
    obs = [] if observation is None else [tuple((seen | observation).values())]
    return scoring.score_photos(
        spark.createDataFrame([tuple(base.values())], cs),
        spark.createDataFrame([tuple(place.values())], "entity_id long, lat double, lon double, city_lat double, city_lon double"),
        spark.createDataFrame(obs, os_), 2026).collect()[0]


def test_scoring_rules(spark):
    strong = scored_row(spark, {"depicts": True, "commons_category": True}, {})
    assert (strong.points, strong.tier, strong.secondary) == (85, "verified", ["lab"])
    render = scored_row(spark, {"depicts": True, "commons_category": True, "used_on_wikipedia": True}, {"image_type": "render_or_illustration"})
    assert (render.points, render.tier) == (75, "likely")  # enough points, but a render is never verified
    web = {"page_mentions_name": True, "other_sources": 1, "source_type": "news"}
    assert scored_row(spark, web).tier == "unconfirmed"  # 40 points, not strong, never looked at
    assert scored_row(spark, web, {}).tier == "likely"
    weak = scored_row(spark, {"official_domain": True}, {"stock_like": True})
    assert (weak.points, weak.strong, weak.tier) == (10, False, "unconfirmed")
    far = scored_row(spark, {"depicts": True, "lat": 44.0, "lon": 77.0}, {"close_up_portrait": True})
    assert far.reject_reason == "far_geotag"  # the first reason wins
    near = scored_row(spark, {"lat": 43.001, "lon": 77.0}, {"primary_category": "city"})
    assert [e.signal for e in near.evidence] == ["geo_near_campus"]
    no_point = scored_row(spark, {"lat": 43.1, "lon": 77.0}, {"primary_category": "city"}, {"lat": None, "lon": None})
    assert [e.signal for e in no_point.evidence] == ["geo_in_city"]  # a city point never proves the campus
    assert scored_row(spark).reject_reason == "low_score"
    assert "possibly_outdated" in scored_row(spark, {"date_value": "2014-06", "date_kind": "taken"}).labels
    assert "possibly_outdated" not in scored_row(spark, {"date_value": "2014-06", "date_kind": "retrieved"}).labels


def test_scoring_is_one_narrow_stage(spark):
    from veriframe.plans.scoring_queries import scored
    plan = scored(spark, "/root/testdata/sf0.001").select("points", "tier")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Window" not in plan


def test_coverage_has_zero_rows(spark):
    photos = spark.createDataFrame([(1, "campus", "verified")] * 2 + [(1, "campus", "likely"), (1, "lab", "unconfirmed"), (1, "city", "likely")],
                                   "entity_id long, category string, tier string")
    rows = profile.coverage(photos, spark.createDataFrame([(1,), (2,)], "entity_id long")).collect()
    assert len(rows) == 16
    by = {(r.entity_id, r.category): r.status for r in rows}
    assert by[1, "campus"] == "good" and by[1, "city"] == "thin" and by[1, "lab"] == "none" and by[2, "campus"] == "none"


def test_hash_bits(spark):
    df = spark.createDataFrame([([float(c) for _ in range(8) for c in range(9)],)], "g array<double>")
    assert df.select(hash_to_hex(neighbour_bits(F.col("g")))).first()[0] == "f" * 16
    hexes = ["ffffffffffffffff", "8000000000000001", "0123456789abcdef"]
    back = spark.createDataFrame([(h,) for h in hexes], "h string").select(hash_to_hex(hex_to_hash(F.col("h")))).collect()
    assert [r[0] for r in back] == hexes


def test_nearest_known_within_ten_bits(spark):
    rng = random.Random(4)
    known = [rng.getrandbits(63) for _ in range(20)]
    uploads = []
    for i, h in enumerate(known):
        q = h
        for p in rng.sample(range(63), i % 13):
            q ^= 1 << p
        uploads.append((f"u{i}", 1, q))
    got = {r.upload_id: r.distance for r in dedup.nearest_known(
        spark.createDataFrame(uploads, "upload_id string, entity_id int, hash long"),
        spark.createDataFrame([(2, h, i) for i, h in enumerate(known)], "entity_id int, hash long, ord long")).collect()}
    for name, _, q in uploads:
        best = min(popcount(q ^ h) for h in known)
        assert got[name] == (best if best <= 10 else None)


def test_radius_wraps_at_the_date_line(spark):
    points = spark.createDataFrame([("p", 0.0, 179.999), ("q", 0.0, 179.0), ("n", 89.9999, 10.0)], "point_id string, lat double, lon double")
    centers = spark.createDataFrame([("c", 0.0, -179.999), ("pole", 89.9999, -170.0)], "center_id string, lat double, lon double")
    got = {(r.point_id, r.center_id) for r in geo_join.within_radius(points, centers, 1000).collect()}
    assert got == {("p", "c"), ("n", "pole")}


def test_mentions(spark):
    df = spark.createDataFrame([("nazarbayev-university campus",), ("NU today",), ("annual menu",), ("prenazarbayev universityx",)], "t string")
    names, aliases = F.array(F.lit("nazarbayev university")), F.array(F.lit("nu1"))
    rows = df.select(mentions.mentions_entity(F.col("t"), names, aliases), mentions.mentions_entity(F.col("t"), names, aliases, True)).collect()
    assert [tuple(r) for r in rows] == [(True, True), (False, False), (False, False), (False, True)]


INDEX = [
    ("Q1", "Kazakh-British Technical University", "Казахстанско-Британский технический университет", None, ["KBTU", "KBTU University", "Technical of Almaty", "BTU Kazakhstan", "kbtu.kz"], 20, "Cat"),
    ("Q2", "L. N. Gumilyov Eurasian National University", "Евразийский национальный университет имени Л. Н. Гумилёва", None, None, 40, "Cat"),
    ("Q3", "Harvard University", "Гарвардский университет", None, None, 150, "Cat"),
    ("Q4", "Harvard University", None, None, [], 0, None),
    ("Q5", "Kazakh National Medical University", "Казахский национальный медицинский университет", None, None, 10, "Cat"),
]


def test_resolve(spark):
    index = spark.createDataFrame(INDEX, "qid string, name_en string, name_ru string, name_kk string, aliases array<string>, sitelinks long, commons_category string")
    for column, kind in (("media_sitelink", "string"), ("lat", "double"), ("lon", "double")):
        index = index.withColumn(column, F.lit(None).cast(kind))
    assert [r.qid for r in index.filter(resolve.is_stub()).collect()] == ["Q4"]
    asked = ["Ka", "Kaz", "kaza", "BTU Kazakhstan", "KBTU", "ЕНУ", "harvard", "КазНМУ", "KazNMU", "gumilyov", "nothing like it", "Гарвард"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    ids, _, decided = resolve.resolve(queries, index)
    got = {asked[r.query_id]: (r.status, r.qid) for r in ids.join(decided, "norm").collect()}
    # Two or three letters only find whole words; four begin a word. The fourth alias counts like the first.
    assert got["Ka"] == got["Kaz"] == ("not_found", None) and got["kaza"][0] == "ambiguous"
    assert got["BTU Kazakhstan"] == ("resolved", "Q1")
    assert got["KBTU"] == ("resolved", "Q1")
    assert got["ЕНУ"] == ("resolved", "Q2")
    assert got["harvard"] == ("resolved", "Q3")
    assert got["КазНМУ"] == ("resolved", "Q5") and got["KazNMU"] == ("resolved", "Q5")
    assert got["gumilyov"] == ("resolved", "Q2")
    assert got["nothing like it"] == ("not_found", None)
    assert got["Гарвард"] == ("resolved", "Q3")


def test_embedding_copies_form_a_star(spark):
    rows = [(i, 0, [1.0 * (i + 1), 2.0 * (i + 1), 0.5 * (i + 1)]) for i in range(5)] + [(9, 0, [1.0, 2.05, 0.5]), (10, 0, [-1.0, 0.0, 3.0])]
    df = spark.createDataFrame(rows, "id long, g int, e array<double>")
    got = {(r.id_a, r.id_b) for r in dedup.similar_embeddings(df, ["g"], 0.95).collect()}
    assert got == {(0, 1), (0, 2), (0, 3), (0, 4), (0, 9)}


def test_constants_are_consistent():
    assert len(config.POINTS) == 16 and set(config.STRONG_SIGNALS) <= set(config.POINTS)
