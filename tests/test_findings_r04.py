"""Findings of the fourth round, on rows of their own."""

import numpy as np
import pandas as pd
import pytest

from veriframe.operators import candidates
from veriframe.session import stored
from veriframe.streaming import requests, stateful


class Cell:
    """A value or map state without Spark, and how often it was used."""

    def __init__(self):
        self.value, self.calls, self.entries = None, [], {}

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.value, self.entries = None, {}

    def containsKey(self, key):
        return key in self.entries

    def updateValue(self, key, value):
        self.entries[key] = value


class Store:
    def __init__(self):
        self.timers, self.cells = [], []

    def getValueState(self, *_):
        self.cells.append(Cell())
        return self.cells[-1]

    getMapState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def started(processor):
    processor.init(store := Store())
    return processor, store


def listed(frames):
    rows = [tuple(None if pd.isna(v) else v for v in r) for f in frames for r in f.itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("many, one, kinds", [
    (stateful.Deadlines(60_000_000, 90_000_000), lambda: stateful.Deadline(60_000_000, 90_000_000), ["photos", "source"]),
    (stateful.RequestStates(40_000), lambda: stateful.RequestState(40_000), stateful.RequestStates.KINDS),
])
def test_requests_of_a_bucket_share_calls_and_state(many, one, kinds):
    rng, n = np.random.default_rng(4), 900
    names = np.array([*[f"r{i}" for i in range(60)], None], object)
    events = pd.DataFrame({
        "request_id": names[rng.integers(0, 61, n)], "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 200_000, n), "ms"),
        "event_id": rng.permutation(n), "type": rng.choice(["photos", "source", "stage", "done", "error", "rejected"], n),
        "item_no": rng.integers(0, 13, n), "amount": rng.integers(0, 9, n)}).sort_values("ts")
    numbers = events.assign(at=events["ts"].to_numpy("datetime64[us]").astype(np.int64), kind=[kinds.index(k) if k in kinds else -1 for k in events["type"]])
    many, store = started(many)
    single = {name: started(one())[0] for name in names}
    for low in range(0, n, 300):
        part = numbers[low : low + 300]
        got = list(many.handleInputRows((1,), iter([part[:140], part[140:]]), None))
        want = [out for name, p in single.items() if len(own := part[part["request_id"].isin([name])]) for out in p.handleInputRows((name,), iter([own]), None)]
        assert listed(got) == listed(want) and len(got) == 1
    assert store.cells[0].calls == ["get", "update"] * 3  # not once for each of the 61 requests
    for ms in (30, 130, 230, 400):
        now = pd.Timestamp("2024-01-01").value // 1_000_000 + ms * 1000
        got, want = [], []
        while store.timers and min(store.timers) <= now:
            store.timers.remove(min(store.timers))
            got += many.handleExpiredTimer((1,), Clock(now), Clock(now))
        for name, p in single.items():
            while p.handle.timers and (at := min(p.handle.timers)) <= now:
                p.handle.timers.remove(at)
                want += p.handleExpiredTimer((name,), Clock(now), Clock(at))
        assert listed(got) == listed(want)
        assert sorted(many._get()[0], key=str) == sorted((name for name, p in single.items() if p.handle and any(c.value for c in p.handle.cells)), key=str)
    assert many.state.value is None and not store.timers


def test_a_null_request_is_a_request(spark):
    events = spark.range(2).selectExpr(
        "CAST(NULL AS STRING) AS request_id", "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts",
        "if(id = 0, 'done', 'photos') AS type", "3L AS item_no", "CAST(NULL AS BIGINT) AS amount")
    place = requests.scratch_path(spark, "null-request")
    events.coalesce(1).write.parquet(place)
    stream = spark.readStream.schema(events.schema).parquet(place)
    with stateful.state_store(spark):
        path = requests.run_to_table(stateful.request_state(stream), spark, "null", "update")
    assert [tuple(r)[:5] for r in spark.read.parquet(path).collect()] == [(None, "done", 0, 1, 0)]


def test_a_files_rows_are_shuffled_once_to_find_its_leaders(spark):
    rows = spark.range(40).selectExpr(
        "id % 5 AS entity_id", "concat('u', id % 7) AS canonical_url", "id AS seq", "concat('c', id) AS cand_id", "id % 3 AS prior",
        "concat('p', id % 11) AS source_page_url", "'d' AS source_domain")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = candidates.url_mentions(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2  # the leaders, and the rows that meet them


def test_stored_tables_are_compressed_well(spark):
    frame = stored(spark.range(10).selectExpr("id", "concat('https://a.org/', id) AS url"), "test")
    assert all(".zstd." in path for path in frame.inputFiles()) and frame.count() == 10
