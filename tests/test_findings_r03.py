"""What the third round's findings changed: joins off the driver, rows made and shuffled once, running counts, state calls."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veriframe.operators import candidates as candidate_steps
from veriframe.operators import chain, dedup, profile, ranking, resolve, retrieval, scoring
from veriframe.plans import candidate_queries
from veriframe.streaming import requests, stateful


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_prints_are_not_broadcast(spark):
    classes = spark.createDataFrame([(0, i * 0x9E3779B97F4A7C15 % (1 << 63)) for i in range(20)], "entity_id int, hash long")
    for keys in (["entity_id"], []):
        plan = plan_of(dedup.near_pairs(classes.select(*keys, "hash"), keys, 6))
        assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 3


def test_probes_of_prints_are_not_broadcast(spark):
    prints = spark.createDataFrame([(i * 0x9E3779B97F4A7C15 % (1 << 63),) for i in range(20)], "h long")
    plan = plan_of(dedup.probe_pairs(prints.selectExpr("h AS q_hash"), prints.selectExpr("h AS k_hash"), 1, 7))
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def score_inputs(spark, n=40):
    # A join whose size Spark takes for the product of its sides.
    names = spark.range(3000).selectExpr("id AS entity_id", "CAST(id AS STRING) AS name")
    entities = names.join(spark.range(3000).withColumnRenamed("id", "entity_id"), "entity_id").selectExpr(
        "entity_id", "CAST(entity_id % 90 AS DOUBLE) AS lat", "1D AS lon", "2D AS city_lat", "3D AS city_lon")
    candidates = spark.range(n).selectExpr(
        "CAST(id AS STRING) AS cand_id", "id AS entity_id", "id AS seq", "IF(id < 0, 'x', 'news') AS source_type", "'a.org' AS source_domain",
        "CAST(1990 + id % 2 AS STRING) AS date_value", "'taken' AS date_kind", "'city' AS category_hint", "1D AS lat", "1D AS lon", "'p' AS source_page_url",
        "'i' AS image_url", *[f"id % 2 = 0 AS {c}" for c in (
            "depicts", "commons_category", "used_on_wikipedia", "official_domain", "page_mentions_name", "low_res")])
    observations = candidates.selectExpr(
        "cand_id", "seq", "'photo' AS image_type", "false AS stock_like", "'lab' AS primary_category", "array('lab') AS secondary_categories",
        "'' AS visible_text", "'this' AS names_institution", "'' AS other_institution_name", "'consistent' AS scene", "false AS close_up_portrait")
    return candidates, entities, observations


def test_scoring_shuffles_candidates_once_and_without_source_texts(spark):
    scored = scoring.score_photos(*score_inputs(spark), 2026).select("cand_id", "points", "labels")
    plan = plan_of(scored)
    assert "hashpartitioning(entity_id" not in plan and "max_by" not in plan
    above = plan.split("SortMergeJoin [cand_id", 1)[1] if "SortMergeJoin [cand_id" in plan else plan
    assert "_outdated" in above and "_news" in above
    labels = {int(r.cand_id) % 2: r.labels for r in scored.collect()}
    assert labels == {0: ["low_res_verification", "possibly_outdated"], 1: ["possibly_outdated"]}


def test_positions_with_nulls_shuffle_rows_once(spark):
    data = [(k, None if i % 5 == 0 else i % 3, i) for k in (1, 2, None) for i in range(30)]
    df = spark.createDataFrame(data, "k int, c int, i int")
    out = ranking.positions(df, ["k"], ["c"], [F.col("i")], block=("i", 8))
    order = lambda r: (-1 if r[1] is None else r[1], r[2] // 8, r[2])
    want = {(k, *row[1:]): place for k in (1, 2, None) for place, row in enumerate(sorted((r for r in data if r[0] == k), key=order), 1)}
    assert {(r.k, r.c, r.i): r.position for r in out.collect()} == want
    assert "hashpartitioning(coalesce" not in plan_of(out)


def test_numbered_rows_are_made_once(spark):
    rejected = spark.range(20).selectExpr("CAST(id AS STRING) AS cand_id", "id % 2 AS entity_id", "'portrait' AS reason", "id AS seq", "xxhash64(id, 'made') AS made")
    assert "xxhash64" not in plan_of(profile.rejected_items(rejected))
    photos = spark.range(20).selectExpr("CAST(id AS STRING) AS cand_id", "id % 2 AS entity_id", "'likely' AS tier", "id AS points",
                                        "id AS seq", "'dormitory' AS category", "xxhash64(id, 'made') AS made")
    assert "xxhash64" not in plan_of(profile.display_order(photos)) and "xxhash64" not in plan_of(profile.compare_areas(photos))


def test_a_window_is_not_counted_anew_for_every_call(spark):
    calls = spark.createDataFrame([(i, f"2024-01-01 00:{i // 7 % 60:02d}:00", i % 2 or None) for i in range(300)] + [(999, None, 1)],
                                  "event_id long, t string, client int").select("event_id", F.to_timestamp_ntz("t").alias("ts"), "client")
    out = requests.sliding_limit(calls, 3, 600)
    assert "RangeFrame, -600" not in plan_of(out) and out.columns == [*calls.columns, "in_window", "allowed"]
    data = [r for r in calls.collect() if r.ts is not None]
    want = {r.event_id: sum(o.client == r.client and 0 <= (r.ts - o.ts).total_seconds() <= 600 for o in data) for r in data}
    assert {r.event_id: r.in_window for r in out.collect()} == want


class Cell:
    """A value state that counts its calls."""

    def __init__(self, calls):
        self.value, self.calls = None, calls

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.value = None


class Store:
    def __init__(self):
        self.calls, self.maps, self.timers = [], [], []

    def getValueState(self, *_):
        return Cell(self.calls)

    def getMapState(self, name, *_):
        self.maps.append(name)

    def registerTimer(self, at):
        self.timers.append(at)


def test_a_request_reads_and_writes_its_state_once_per_call():
    deadline = stateful.Deadline(60_000_000, 60_000_000)
    deadline.init(store := Store())
    frame = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=8, freq="20s"), "event_id": range(8),
                          "type": ["photos", "source"] * 4, "item_no": [0, 1, 0, 1, 0, 2, 0, 2]})
    out = pd.concat(deadline.handleInputRows(("r",), iter([frame]), None))
    assert store.calls == ["get", "update"] and len(store.timers) == 1 and not store.maps
    assert out["outcome"].tolist() == ["on_time"] * 2 + ["verification_timeout"] * 2
    closed = pd.concat(deadline.handleExpiredTimer(("r",), None, None))
    assert list(zip(closed["source"], closed["outcome"])) == [(1, "ok"), (2, "timeout")] and len(store.timers) == 2
    state = stateful.RequestState(1000)
    state.init(store := Store())
    assert store.maps == ["photos"]


def test_vectors_meet_as_blocks_of_neighbouring_cells(spark, monkeypatch):
    monkeypatch.setattr(dedup, "MATRIX", 3)
    monkeypatch.setattr(dedup, "MATRIX_ROWS", 2)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    data = [(i, None if i == 50 else i % 2, (centres[i % 6] + rng.normal(size=8) * rng.uniform(0.05, 0.6)).tolist()) for i in range(60)]
    data += [(100, 0, [2 * x for x in data[0][2]]), (101, 1, None), (102, 1, [None] + [1.0] * 7), (103, 0, [1.0] * 3), (104, 0, [float("nan")] * 8)]
    found = dedup.similar_embeddings(spark.createDataFrame(data, "id long, k int, e array<double>"), ["k"], 0.9)
    assert "FlatMapCoGroupsInPandas" in plan_of(found)
    got = [tuple(r) for r in found.collect()]
    unit = {i: (k, np.round(np.array(e) / np.linalg.norm(e), 9)) for i, k, e in data if k is not None and e and None not in e and i not in (100, 103, 104)}
    want = {(k, a, b) for a, (k, x) in unit.items() for b, (other, y) in unit.items() if a < b and k == other and x @ y >= 0.9}
    sure = [p for p in got if 104 not in p[1:]]
    assert len(got) == len(set(got)) and set(sure) == want | {(0, 0, 100)} and len(want) > 40


def test_products_at_the_bound_are_summed_in_order():
    a = np.array([[0.1, 0.2, 0.3], [1.0, 0.0, 0.0]])
    in_order = (0.1 * 0.1 + 0.2 * 0.2) + 0.3 * 0.3
    assert dedup._close_rows(a, a[:1], in_order)[0].tolist() == [0]
    assert dedup._close_rows(a, a[:1], np.nextafter(in_order, 1))[0].tolist() == []
    assert dedup._close_rows(a, np.array([[np.nan, 0, 0]]), 5.0)[0].tolist() == [0, 1]


def test_all_candidates_are_stored_narrow(spark, monkeypatch):
    seen = []

    def spy(df, label):
        seen.append((label, df.columns))
        return df.localCheckpoint()

    monkeypatch.setattr(chain, "stored", spy)
    monkeypatch.setattr(chain, "cut_lineage", lambda df: seen.append(("cut", df.columns)) or df.localCheckpoint())
    candidates, entities, observations = score_inputs(spark, 8)
    candidates = candidates.selectExpr(
        "*", "'web' AS provider", "800L AS width", "600L AS height", "'CC' AS license", "'t' AS title").withColumn(
        "image_url", F.concat(F.lit("https://a.org/"), "cand_id", F.lit(".jpg")))
    scored, _ = chain.profile_candidates(candidates, entities, observations, candidates.selectExpr("cand_id", "seq AS hash"), 2026)
    every, picked = [c for label, c in seen if label == "urls"], [c for label, c in seen if label == "items"]
    assert len(every) == 1 and {"image_url", "lat", "title", "license", "width"}.isdisjoint(every[0])
    assert len(picked) == 1 and "image_url" in picked[0] and ("cut", every[0]) not in seen
    assert "canonical_url" in picked[0] and len(picked[0]) == len(set(picked[0]))


def test_a_file_seen_once_has_no_other_page(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "u", 1, "a", 5, "p1", "d"), (1, "u", 2, "b", 9, "p2", "d"), (1, "v", 3, "c", 5, "p3", "d"), (None, "u", 4, "e", 1, "p4", "d")],
                                 "entity_id int, canonical_url string, seq long, cand_id string, prior long, source_page_url string, source_domain string")
    found = candidate_steps.url_mentions(rows)
    assert [(r.entity_id, r.canonical_url, r.page, r.noted_at.seq) for r in found.collect()] == [(1, "u", "p1", 2)]
    stored = []
    monkeypatch.setattr(candidate_steps, "stored", lambda df, label: stored.append(df.columns) or df)
    given = rows.drop("canonical_url", "prior").withColumn("image_url", F.lit("https://a.org/x.jpg")).withColumn("title", F.lit("t"))
    monkeypatch.setattr(candidate_steps, "with_canonical", lambda df: df.withColumns({"canonical_url": F.col("image_url"), "prior": F.lit(1)}))
    monkeypatch.setattr(candidate_queries, "passed", lambda *_: given)
    candidate_queries.url_mentions(spark, "")
    assert "title" not in stored[0] and "image_url" not in stored[0]


def test_entries_without_all_words_are_not_looked_up(spark):
    costs = spark.createDataFrame([(0, 2, "alpha", 500), (0, 2, "beta", 600), (1, 1, "beta", 600)], "v long, total int, word string, cost long")
    signs = {r.word: r.sign for r in spark.createDataFrame([("alpha",), ("beta",)], "word string").select(
        "word", retrieval._sign(F.col("word")).alias("sign")).collect()}
    assert signs["alpha"] != signs["beta"]
    rows = [("alpha", f"Q{i}", 1.0, signs["alpha"]) for i in range(499)] + [("beta", f"R{i}", 1.0, signs["beta"]) for i in range(599)]
    rows += [(w, "S", 2.0, signs["alpha"] | signs["beta"]) for w in ("alpha", "beta")]
    first, started = retrieval._started(costs, spark.createDataFrame(rows, "word string, qid string, s double, held long"))
    assert sorted(tuple(r) for r in first.collect()) == [(0, 2, "alpha"), (1, 1, "beta")]
    assert [r.qid for r in started.where("v = 0").collect()] == ["S"] and started.where("v = 1").count() == 600


def test_pool_equals_a_plain_loop_over_entries(spark):
    words = ["amber", "birch", "cedar", "delta", "grape", "fjord"]
    names = [" ".join(words[j] for j in range(6) if i >> j & 1) for i in range(1, 64)] * 3
    index = spark.createDataFrame([(f"Q{i}", i % 7) for i in range(len(names))], "qid string, sitelinks long")
    terms = spark.createDataFrame([(f"Q{i}", n, "label") for i, n in enumerate(names)], "qid string, text string, kind string")
    asked = ["amber birch", "cedar nowhere", "amber nowhere delta", "amber birch cedar delta grape fjord", "fjord"]
    variants = spark.createDataFrame([(a, a) for a in asked] + [("fjord", "grape fjord")], "norm string, variant string")
    value = {(r.found, r.qid): r.value for r in retrieval.rated_entries(terms, index).collect()}
    want = {}
    for norm, variant in [(a, a) for a in asked] + [("fjord", "grape fjord")]:
        ws = variant.split()
        held = {q: [value[w, q] for w in ws if (w, q) in value] for q in {q for _, q in value}}
        full = any(len(v) == len(ws) for v in held.values())
        for q, v in held.items():
            if v and (not full or len(v) == len(ws)):
                want[norm, q] = max(want.get((norm, q), 0), round(sum(v) * len(v), 6))
    found = retrieval.search(variants, terms, index, 4)
    assert not [line for line in plan_of(found).split("\n") if "LeftAnti" in line and "qid" in line]
    got = {(r.norm, r["rank"]): (r.qid, round(r.score, 4)) for r in found.collect()}
    for norm in asked:
        best = sorted(((-s, q) for (n, q), s in want.items() if n == norm))[:4]
        assert [got[norm, i + 1] for i in range(len(best))] == [(q, round(-s, 4)) for s, q in best]


def test_an_entrys_words_meet_in_one_shuffle_whose_tasks_grow_with_the_entries(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ENTRIES_PER_TASK", 10)
    terms = spark.createDataFrame(
        [(f"Q{i}", f"North {i % 7} north", "label") for i in range(100)] + [("Q1", "N1", "alias"), (None, "north", "alias"), ("Q2", "x", "odd")],
        "qid string, text string, kind string")
    index = spark.createDataFrame([(f"Q{i}", 9) for i in range(100)] + [("Q3", None)], "qid string, sitelinks int")
    words = retrieval.entry_words(terms, index)
    assert plan_of(words).count("Exchange hashpartitioning(qid") == 2  # words and links
    assert words.rdd.getNumPartitions() == 11
    rows = {(r.qid, r.found): r for r in words.collect()}
    north, alias = rows["Q1", "north"], rows["Q1", "n1"]
    assert (north.tf_names, north.tf_aliases, north.length_names, north.length_aliases, alias.tf_aliases) == (2, 0, 2, 1, 1)
    assert rows[None, "north"].links is None and ("Q2", "x") not in rows
    assert north.links == pytest.approx(1.25) and rows["Q3", "north"].links == pytest.approx(2.25)  # a repeated row counts again


def test_texts_are_normalized_once_per_distinct_text(spark):
    terms = spark.createDataFrame([("Q1", "North University", "label"), ("Q2", "North University", "label")], "qid string, text string, kind string")
    queries = spark.createDataFrame([(1, "North"), (2, "North")], "query_id long, query string")
    for rows in (resolve.normalized_terms(terms), resolve.normalized_queries(queries)[0]):
        plan = plan_of(rows)
        assert "lower(" not in plan and plan.count("FileScan parquet") == 1
