"""Queries over the request event log: batch twins with checking SQL, and live streams over the same files."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe.functions.text import normalize_name
from veriframe.plans.adapters import ADAPTERS, adapter, ctes
from veriframe.plans.registry import query
from veriframe.plans.scoring_queries import AS_OF_YEAR, SCORED_CTES, inputs
from veriframe.sources.tables import TABLE_SCHEMAS, read_table
from veriframe.streaming import requests, scoring_stream, stateful

STATE_SQL = ctes("stream_events") + """
, base AS (
  SELECT request_id, min(ts) AS started, arg_max(type, (ts, event_id)) FILTER (type IN ('done', 'error', 'not_found')) AS last_terminal,
    max(ts) FILTER (type IN ('done', 'error', 'not_found')) AS ended, max((ts, event_id)) FILTER (type = 'done') AS done_at,
    count(DISTINCT item_no) FILTER (type = 'photos') AS photos FROM stream_events GROUP BY request_id),
src AS (SELECT request_id, item_no % 4 AS s, arg_max(amount % 3, (ts, event_id)) AS st FROM stream_events WHERE type = 'source' GROUP BY ALL),
srcs AS (SELECT request_id, count(*) AS sources, count(*) FILTER (st = 0) AS sources_ok FROM src GROUP BY ALL),
stg AS (SELECT request_id, item_no % 5 AS s, max((ts, event_id)) AS at_, arg_max(amount % 2, (ts, event_id)) AS e FROM stream_events WHERE type = 'stage' GROUP BY ALL),
stgs AS (SELECT request_id, count(*) FILTER (e = 1 OR done_at > at_) AS fin, count(*) FILTER (done_at IS NOT NULL AND at_ > done_at AND e = 0) AS reopened
  FROM stg JOIN base USING (request_id) GROUP BY ALL)
SELECT request_id, coalesce(last_terminal, 'streaming') AS status, CAST(floor(date_diff('microsecond', started, ended) / 1000) AS BIGINT) AS finished_ms,
  photos, coalesce(sources, 0) AS sources, coalesce(sources_ok, 0) AS sources_ok,
  CASE WHEN done_at IS NOT NULL THEN 5 - coalesce(reopened, 0) ELSE coalesce(fin, 0) END AS stages_done
FROM base LEFT JOIN srcs USING (request_id) LEFT JOIN stgs USING (request_id)"""

DEDUP_SQL = ctes("stream_events") + """
SELECT request_id, item_no, arg_min(event_id, (ts, event_id)) AS event_id FROM stream_events WHERE type = 'photos' GROUP BY ALL"""


def live(spark, sf_dir, table):
    """One input table as a file stream."""
    return spark.readStream.schema(TABLE_SCHEMAS[table]).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def live_events(spark, sf_dir):
    return spark.sql(ADAPTERS["stream_events"].replace("FROM events", "FROM {events}"), events=live(spark, sf_dir, "events"))


@query("stream_state", STATE_SQL)
def stream_state(spark, sf_dir):
    return requests.profile_state(adapter(spark, sf_dir, "stream_events"))


@query("stream_state_live", STATE_SQL)
def stream_state_live(spark, sf_dir):
    with stateful.state_store(spark):
        path = requests.run_to_table(stateful.request_state(live_events(spark, sf_dir)), spark, "state", "update")
    return requests.latest_update(spark.read.parquet(path), "request_id")


@query("stream_dedup", DEDUP_SQL)
def stream_dedup(spark, sf_dir):
    return requests.dedup_photos(adapter(spark, sf_dir, "stream_events"))


@query("stream_dedup_live", DEDUP_SQL.replace(", arg_min(event_id, (ts, event_id)) AS event_id", ""))
def stream_dedup_live(spark, sf_dir):
    path = requests.run_to_table(requests.dedup_photos_stream(live_events(spark, sf_dir), "60 days"), spark, "photos")
    return spark.read.parquet(path).select("request_id", "item_no")


CALLS = "SELECT event_id, ts, user_id % 6 AS client FROM events"


def calls(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 6).alias("client"))


@query("rate_sliding", f"""
WITH c AS ({CALLS}),
w AS (SELECT event_id, client, count(*) OVER (PARTITION BY client ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM c)
SELECT event_id, client, in_window, in_window <= 3 AS allowed FROM w""")
def rate_sliding(spark, sf_dir):
    return requests.sliding_limit(calls(spark, sf_dir), 3, 3600).select("event_id", "client", "in_window", "allowed")


@query("rate_sliding_live", f"""
WITH c AS ({CALLS}),
w AS (SELECT event_id, client, count(*) OVER (PARTITION BY client ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM c)
SELECT event_id, client, least(in_window, 4) AS in_window, in_window <= 3 AS allowed FROM w""")
def rate_sliding_live(spark, sf_dir):
    calls_in = live(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 6).alias("client"))
    with stateful.state_store(spark):
        path = requests.run_to_table(stateful.call_limit(calls_in, 3, 3600), spark, "limits")
    return spark.read.parquet(path).select("event_id", "client", "in_window", "allowed")


@query("rate_daily", f"""
WITH c AS ({CALLS}),
w AS (SELECT *, count(*) OVER (PARTITION BY client ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM c),
d AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS place FROM w WHERE in_window <= 3)
SELECT event_id, day, place, place <= 200 AS within_budget FROM d""")
def rate_daily(spark, sf_dir):
    passed = requests.sliding_limit(calls(spark, sf_dir), 3, 3600).filter("allowed")
    return requests.tumbling_budget(passed, 200).select("event_id", "day", "place", "within_budget")


LATE_SQL = ctes("stream_events") + """
, s AS (SELECT request_id, min(ts) + INTERVAL 4 HOUR AS deadline FROM stream_events GROUP BY ALL)
SELECT event_id, CASE WHEN ts > deadline THEN 'verification_timeout' ELSE 'on_time' END AS outcome FROM stream_events JOIN s USING (request_id) WHERE type = 'photos'"""

SOURCES_SQL = ctes("stream_events") + """
, s AS (SELECT request_id, min(ts) + INTERVAL 4 HOUR AS deadline FROM stream_events GROUP BY ALL)
SELECT request_id, item_no % 4 AS source, CASE WHEN bool_and(ts > deadline) THEN 'timeout' WHEN bool_or(ts > deadline) THEN 'partial' ELSE 'ok' END AS outcome
FROM stream_events JOIN s USING (request_id) WHERE type = 'source' GROUP BY ALL"""


@query("late_reject", LATE_SQL)
def late_reject(spark, sf_dir):
    return requests.late_data(adapter(spark, sf_dir, "stream_events"), 4 * 3600).select("event_id", "outcome")


@query("late_sources", SOURCES_SQL)
def late_sources(spark, sf_dir):
    return stateful.source_lateness(adapter(spark, sf_dir, "stream_events"), 4 * 3600)


def deadlines_live(spark, sf_dir):
    """Table of outcomes with a folder per outcome: late items are a side output."""
    with stateful.state_store(spark):
        path = requests.run_to_table(stateful.deadline_outcomes(live_events(spark, sf_dir), 4 * 3600), spark, "deadlines", side=["outcome"])
    return spark.read.parquet(path)


@query("late_reject_live", LATE_SQL)
def late_reject_live(spark, sf_dir):
    return deadlines_live(spark, sf_dir).where("source IS NULL").select("event_id", "outcome")


@query("late_sources_live", SOURCES_SQL + """
HAVING max(deadline) < (SELECT max(ts) - INTERVAL 1 MINUTE FROM stream_events)""")
def late_sources_live(spark, sf_dir):
    """Sources of the requests that the stream has closed: those whose deadline the watermark has passed."""
    reported = deadlines_live(spark, sf_dir).where("source IS NOT NULL").drop("event_id", "batch_id_part")
    return reported.groupBy("request_id", "source").agg(F.max_by("outcome", "batch_id").alias("outcome"))


@query("stage_timings", ctes("stream_events") + """
SELECT request_id, CAST(floor(date_diff('microsecond', min(ts), min(ts) FILTER (type = 'resolved')) / 1000) AS BIGINT) AS resolved_ms,
  CAST(floor(date_diff('microsecond', min(ts), min(ts) FILTER (type = 'photos')) / 1000) AS BIGINT) AS photos_ms,
  CAST(floor(date_diff('microsecond', min(ts), min(ts) FILTER (type = 'done')) / 1000) AS BIGINT) AS done_ms
FROM stream_events GROUP BY request_id""")
def stage_timings(spark, sf_dir):
    return requests.stage_timings(adapter(spark, sf_dir, "stream_events"))


SESSIONS_SQL = ctes("stream_events") + """
, e AS (SELECT *, ascii(request_id[2]) % 7 AS client FROM stream_events),
g AS (SELECT *, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY client ORDER BY ts) > INTERVAL 30 MINUTE, true) AS INTEGER) AS fresh FROM e),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY client ORDER BY ts) AS s FROM g),
t AS (SELECT client, min(ts) AS started, max(ts) AS last, count(*) AS events,
    CAST(floor(date_diff('microsecond', min(ts), min(ts) FILTER (type = 'resolved')) / 1000) AS BIGINT) AS resolved_ms,
    CAST(floor(date_diff('microsecond', min(ts), min(ts) FILTER (type = 'photos')) / 1000) AS BIGINT) AS photos_ms,
    CAST(floor(date_diff('microsecond', min(ts), min(ts) FILTER (type = 'done')) / 1000) AS BIGINT) AS done_ms
  FROM n GROUP BY client, s)
SELECT client, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, events, resolved_ms, photos_ms, done_ms FROM t"""
_CLIENT = "CAST(ascii(substring(request_id, 2, 1)) % 7 AS INT)"


def _sessions(rows):
    return rows.select("client", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "events", "resolved_ms", "photos_ms", "done_ms")


@query("session_timings", SESSIONS_SQL)
def session_timings(spark, sf_dir):
    """The log without its request ids, by client."""
    events = adapter(spark, sf_dir, "stream_events").select(F.expr(_CLIENT).alias("client"), "type", F.col("ts").cast("timestamp").alias("event_time"))
    return _sessions(stateful.session_timings(events, "30 minutes"))


@query("session_timings_live", SESSIONS_SQL + " WHERE last + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM stream_events)")
def session_timings_live(spark, sf_dir):
    """The sessions that are over: those that end before the stream's watermark."""
    events = live_events(spark, sf_dir).select(F.expr(_CLIENT).alias("client"), "type", F.col("ts").cast("timestamp").alias("event_time"))
    sessions = stateful.session_timings(events.withWatermark("event_time", "10 minutes"), "30 minutes")
    path = requests.run_to_table(sessions, spark, "sessions")
    return _sessions(spark.read.parquet(path))


@query("autohold", """
WITH r AS (SELECT event_id * 13 % 700 AS review_id, ts, event_id FROM events WHERE event_type = 'error')
SELECT review_id, count(*) AS reports, CAST(list(ts ORDER BY ts, event_id)[3] AS VARCHAR) AS held_at FROM r GROUP BY review_id""")
def autohold(spark, sf_dir):
    reports = read_table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        (F.col("event_id") * 13 % 700).alias("review_id"), "ts", "event_id")
    held = requests.report_autohold(reports)
    return held.select("review_id", "reports", F.col("held_at").cast("string").alias("held_at"))


@query("autohold_live", """
SELECT event_id * 13 % 700 AS review_id, count(*) AS reports, count(*) >= 3 AS held FROM events WHERE event_type = 'error' GROUP BY ALL""")
def autohold_live(spark, sf_dir):
    reports = live(spark, sf_dir, "events").filter("event_type = 'error'").select((F.col("event_id") * 13 % 700).alias("review_id"))
    path = requests.run_to_table(requests.report_count_stream(reports), spark, "reports", "update")
    return requests.latest_update(spark.read.parquet(path), "review_id")


@query("incremental_scoring", SCORED_CTES + "SELECT cand_id, points, tier, reject_reason FROM scored")
def incremental_scoring(spark, sf_dir):
    candidates, entities, _ = inputs(spark, sf_dir)
    stream = spark.sql(ADAPTERS["observations"].replace("FROM lineitem", "FROM {lineitem}"), lineitem=live(spark, sf_dir, "lineitem"))
    stream = stream.withColumn("secondary_categories", F.split("secondary_list", ","))
    path = scoring_stream.score_stream(stream, candidates, entities, spark, AS_OF_YEAR)
    return scoring_stream.finish(candidates, entities, spark, path, AS_OF_YEAR).drop("entity_id")


@query("resolve_ttl", """
WITH l AS (SELECT 'name ' || (user_id % 60) AS norm, CASE WHEN user_id % 2 = 0 THEN ts ELSE ts - INTERVAL 12 DAY END AS ts, event_id,
    CASE WHEN event_id % 3 = 0 THEN 'not_found' ELSE 'resolved' END AS status FROM events),
n AS (SELECT 'resolve:v6:' || norm AS cache_key, arg_max(status, (ts, event_id)) AS status, max(ts) AS saved_at FROM l WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY ALL)
SELECT cache_key, status, CAST(saved_at AS VARCHAR) AS saved_at FROM n
WHERE saved_at > TIMESTAMP '2024-01-20 00:00:00' - CASE WHEN status = 'not_found' THEN INTERVAL 1 DAY ELSE INTERVAL 7 DAY END""")
def resolve_ttl(spark, sf_dir):
    """All lookups; those of odd users happened twelve days earlier, so that some entries have run out."""
    rows = read_table(spark, sf_dir, "events").select(
        normalize_name(F.concat(F.lit("NAME  "), F.col("user_id") % 60, F.lit("!"))).alias("norm"),
        F.when(F.col("user_id") % 2 == 0, F.col("ts")).otherwise(F.col("ts") - F.expr("INTERVAL 12 DAYS")).alias("ts"), "event_id",
        F.when(F.col("event_id") % 3 == 0, "not_found").otherwise("resolved").alias("status"))
    live_rows = requests.resolve_cache(rows, F.expr("timestamp_ntz'2024-01-20 00:00:00'"))
    return live_rows.select("cache_key", "status", F.col("saved_at").cast("string").alias("saved_at"))
