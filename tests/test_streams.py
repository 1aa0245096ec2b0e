"""Streams replayed from several files end in the state the batch twins compute."""

import pandas as pd
from pyspark.sql import functions as F

from veriframe.plans.adapters import adapter
from veriframe.plans.scoring_queries import AS_OF_YEAR, inputs, scored
from veriframe.sources.providers import fresh_profiles, image_fingerprint, read_profiles, write_profiles
from veriframe.streaming import requests, scoring_stream, stateful

SF = "/root/testdata/sf0.001"


def replay(spark, df, path, files=3):
    """Written in time order as several files, read one file per micro-batch."""
    df.repartitionByRange(files, "ts").write.parquet(str(path)) if "ts" in df.columns else df.repartition(files).write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def in_order(spark, df, path, cuts):
    """One file per stretch of time, written one after the other."""
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = df.where(F.lit(True) if low is None else F.col("ts") >= F.lit(low).cast("timestamp_ntz"))
        part = part.where(F.lit(True) if high is None else F.col("ts") < F.lit(high).cast("timestamp_ntz"))
        part.coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


CUTS = ["2024-01-08 11:00:00", "2024-01-21 00:30:00"]


def test_request_state_replay(spark, tmp_path):
    events = adapter(spark, SF, "stream_events")
    batch = requests.profile_state(events)
    for name, stream in (("ordered", in_order(spark, events, tmp_path / "a", CUTS)), ("mixed", replay(spark, events.orderBy("amount"), tmp_path / "b"))):
        with stateful.state_store(spark):
            path = requests.run_to_table(stateful.request_state(stream, 90 * 86_400, "60 days"), spark, "s", "update", path=str(tmp_path / name))
        live = requests.latest_update(spark.read.parquet(path), "request_id")
        assert rows(live.select(*batch.columns)) == rows(batch)
    assert spark.conf.get(stateful.STORE, None) != stateful.ROCKSDB


def test_call_limit_replay(spark, tmp_path):
    calls = adapter(spark, SF, "stream_events").select("event_id", "ts", F.lit(7).cast("long").alias("client"))
    stream = in_order(spark, calls, tmp_path / "calls", CUTS)
    with stateful.state_store(spark):
        path = requests.run_to_table(stateful.call_limit(stream, 3, 3 * 3600), spark, "l", path=str(tmp_path / "out"))
    got = rows(spark.read.parquet(path).select("event_id", "in_window", "allowed"))
    wanted = requests.sliding_limit(calls, 3, 3 * 3600).select("event_id", F.least("in_window", F.lit(4)), "allowed")
    assert got == rows(wanted) and {r[2] for r in got} == {True, False}


class Held:
    """A value state without Spark."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *_):
        return Held()

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def listTimers(self):
        return iter(self.timers)


def test_state_of_a_busy_client_is_as_large_as_the_limit():
    limit = stateful.CallLimit(5, 10_000_000)
    limit.init(Handle())
    times = pd.date_range("2024-01-01", periods=2000, freq="10ms")
    for at in range(0, 2000, 500):
        frame = pd.DataFrame({"ts": times[at : at + 500], "event_id": range(at, at + 500)})
        out = pd.concat(limit.handleInputRows((1,), iter([frame[250:], frame[:250]]), None))
        assert len(limit.recent.get()[0]) == 5 and len(limit.handle.timers) == 1
        assert out["event_id"].tolist() == frame["event_id"].tolist() and out["allowed"].sum() == (5 if not at else 0)
    list(limit.handleExpiredTimer((1,), None, None))
    assert not limit.recent.exists()


def test_deadlines_replay(spark, tmp_path):
    events = adapter(spark, SF, "stream_events").withColumn("request_id", F.substring("request_id", 1, 2))
    hours = 26 * 24  # requests last a month here: the deadline falls into the last file
    stream = in_order(spark, events, tmp_path / "events", CUTS)
    with stateful.state_store(spark):
        path = requests.run_to_table(stateful.deadline_outcomes(stream, hours * 3600), spark, "d", path=str(tmp_path / "out"), side=["outcome"])
    out = spark.read.parquet(path)
    late = requests.late_data(events, hours * 3600).select("event_id", "outcome")
    assert rows(out.where("source IS NULL").select("event_id", "outcome")) == rows(late)
    assert late.select("outcome").distinct().count() == 2
    pruned = spark.read.parquet(path).where("outcome = 'verification_timeout'")
    assert "PartitionFilters: [isnotnull(outcome" in pruned._jdf.queryExecution().executedPlan().toString()
    sources = out.where("source IS NOT NULL").groupBy("request_id", "source").agg(F.max_by("outcome", "batch_id").alias("outcome"))
    wanted = stateful.source_lateness(events, hours * 3600)
    assert rows(sources) == rows(wanted) and "partial" in {r.outcome for r in wanted.collect()}


def test_sessions_replay(spark, tmp_path):
    events = adapter(spark, SF, "stream_events").select("ts", "type", F.lit(1).alias("client"))
    timed = lambda df: df.withColumn("event_time", F.col("ts").cast("timestamp"))
    stream = timed(in_order(spark, events, tmp_path / "events", CUTS)).withWatermark("event_time", "10 minutes")
    path = requests.run_to_table(stateful.session_timings(stream, "40 minutes"), spark, "x", path=str(tmp_path / "out"))
    batch = stateful.session_timings(timed(events), "40 minutes")
    last = events.agg(F.max(F.col("ts").cast("timestamp")) - F.expr("INTERVAL 10 MINUTES")).first()[0]
    assert rows(spark.read.parquet(path).select(*batch.columns)) == rows(batch.where(F.col("over_at") <= F.lit(last)))


def test_dedup_stream(spark, tmp_path):
    events = adapter(spark, SF, "stream_events")
    stream = replay(spark, events.union(events.filter("event_id % 2 = 0")), tmp_path / "events")
    path = requests.run_to_table(requests.dedup_photos_stream(stream, "60 days"), spark, "d", path=str(tmp_path / "out"))
    got = spark.read.parquet(path).select("request_id", "item_no")
    assert rows(got) == rows(requests.dedup_photos(events).select("request_id", "item_no"))


def test_incremental_scoring_equals_batch(spark, tmp_path):
    candidates, entities, observations = inputs(spark, SF)
    stream = replay(spark, observations, tmp_path / "obs")
    path = scoring_stream.score_stream(stream, candidates, entities, spark, AS_OF_YEAR, path=str(tmp_path / "out"))
    done = scoring_stream.finish(candidates, entities, spark, path, AS_OF_YEAR)
    assert rows(done) == rows(scored(spark, SF).select(*done.columns))
    early = scoring_stream.earlier_ids(spark, path, 2, [3])
    plan = early._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters:")[1].split("]")[0] and "ReadSchema: struct<cand_id:string>" in plan
    assert 0 < early.count() < spark.read.parquet(path).where("part < 2").count() / 8
    nothing = scoring_stream.finish(candidates, entities, spark, str(tmp_path / "nowhere"), AS_OF_YEAR)
    assert nothing.count() == candidates.select("cand_id").distinct().count()


def test_sliding_limit_equals_loop(spark):
    calls = spark.createDataFrame(
        [(i, f"2024-01-01 00:{i * 7 % 60:02d}:{i % 60:02d}", i % 2) for i in range(80)], "event_id long, t string, client int"
    ).select("event_id", F.to_timestamp_ntz("t").alias("ts"), "client")
    data = [(r.event_id, r.ts, r.client) for r in calls.collect()]
    got = {r.event_id: r.in_window for r in requests.sliding_limit(calls, 3, 600).collect()}
    for event_id, ts, client in data:
        assert got[event_id] == sum(c == client and 0 <= (ts - t).total_seconds() <= 600 for _, t, c in data)


def test_profiles_round_trip(spark, tmp_path):
    rows_ = [("Q1", "v2", "2024-01-10 00:00:00", []), ("Q1", "v2", "2024-01-12 00:00:00", []), ("Q2", "v2", "2024-01-12 00:00:00", ["x"]),
             ("Q3", "v1", "2024-01-12 00:00:00", []), ("Q4", "v2", "2023-12-01 00:00:00", [])]
    df = spark.createDataFrame(rows_, "qid string, pipeline_version string, t string, degraded array<string>").select(
        "qid", "pipeline_version", F.to_timestamp("t").alias("saved_at"), "degraded")
    write_profiles(df, str(tmp_path / "p"))
    as_of = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    got = read_profiles(spark, str(tmp_path / "p"), "v2", as_of).collect()
    assert [(r.qid, str(r.saved_at)) for r in got] == [("Q1", "2024-01-12 00:00:00")]
    plan = fresh_profiles(spark.read.parquet(str(tmp_path / "p")), "v2", as_of)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pipeline_version" in plan


def test_image_files(spark, tmp_path):
    def png(width, height, gray):
        import struct
        import zlib
        raw = b"".join(b"\0" + bytes(gray(x, y) for x in range(width)) for y in range(height))
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))
                + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    (tmp_path / "a.png").write_bytes(png(90, 80, lambda x, y: x * 2))
    (tmp_path / "b.png").write_bytes(png(45, 40, lambda x, y: 255 - x * 4))
    got = {r.origin.rsplit("/", 1)[1]: r.hash for r in image_fingerprint(spark, str(tmp_path)).collect()}
    assert got == {"a.png": -1, "b.png": 0}
