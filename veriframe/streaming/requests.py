"""Request event log: state per request, re-sent photos, rate limits, timings. Batch twins first, streams below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriframe import config
from veriframe.operators.ranking import positions, top_k
from veriframe.session import scratch_path

SOURCES = 4  # distinct source numbers in the log
STAGES = len(config.STAGES)


def _order() -> Column:
    return F.struct("ts", "event_id")


# --- batch --------------------------------------------------------------------------------


def profile_state(events: DataFrame) -> DataFrame:
    """Final state of every request: terminal status and time, photos, sources, finished stages.

    Every part is a mergeable aggregate, so a request with very many events is reduced before the shuffle.
    """
    terminal = F.col("type").isin(config.TERMINAL_EVENT_TYPES)
    at_done = F.max(F.when(F.col("type") == "done", _order()))
    base = events.groupBy("request_id").agg(
        F.max_by("type", F.when(terminal, _order())).alias("last_terminal"),
        F.max(F.when(terminal, F.col("ts"))).alias("ended"), F.min("ts").alias("started"), at_done.alias("done_at"),
    )
    photos = events.filter("type = 'photos'").select("request_id", "item_no").distinct().groupBy("request_id").agg(
        F.count(F.lit(1)).alias("photos"))
    sources = events.filter("type = 'source'").groupBy("request_id", (F.col("item_no") % SOURCES).alias("source")).agg(
        F.max_by(F.col("amount") % 3, _order()).alias("status")).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("sources"), F.count(F.when(F.col("status") == 0, 1)).alias("sources_ok"))
    stages = events.filter("type = 'stage'").groupBy("request_id", (F.col("item_no") % STAGES).alias("stage")).agg(
        F.max(_order()).alias("at"), F.max_by(F.col("amount") % 2, _order()).alias("ended"))
    joined = stages.join(base.select("request_id", "done_at"), "request_id")
    # A "done" event finishes all stages; a later start reopens one.
    reopened = F.col("done_at").isNotNull() & (F.col("at") > F.col("done_at")) & (F.col("ended") == 0)
    finished = (F.col("ended") == 1) | (F.col("done_at") > F.col("at"))
    per_request = joined.groupBy("request_id").agg(
        F.count(F.when(finished, 1)).alias("finished"), F.count(F.when(reopened, 1)).alias("reopened"))
    out = base.join(photos, "request_id", "left").join(sources, "request_id", "left").join(per_request, "request_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return out.select(
        "request_id", F.coalesce("last_terminal", F.lit("streaming")).alias("status"),
        F.floor(micros("ended", "started") / 1000).cast("bigint").alias("finished_ms"),
        zero("photos").alias("photos"), zero("sources").alias("sources"), zero("sources_ok").alias("sources_ok"),
        F.when(F.col("done_at").isNotNull(), STAGES - zero("reopened")).otherwise(zero("finished")).alias("stages_done"),
    )


def micros(end: str, start: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {start}, {end})")


def dedup_photos(events: DataFrame) -> DataFrame:
    """First occurrence of each photo of a request."""
    return events.filter("type = 'photos'").groupBy("request_id", "item_no").agg(F.min_by("event_id", _order()).alias("event_id"))


def sliding_limit(calls: DataFrame, limit: int, window_s: int) -> DataFrame:
    """Calls of the client in the window up to and including this one, and whether it is allowed.

    Time is cut into slices as long as the window. A slice also receives the calls of the slice before it, so the
    preceding window of a call is always inside its own partition, and a very busy client is spread over its slices.
    Counts are differences of running ones, of the calls up to this one and of those before its window, where it puts a
    mark: a frame that slides would count every window anew.
    """
    width = window_s * 1_000_000
    mark, own, later = 0, 1, 2
    rows = calls.select("client", F.struct(*calls.columns).alias("_call"), F.expr("unix_micros(cast(ts as timestamp))").alias("_us"))
    rows = rows.filter("_us is not null").withColumn("_role", F.explode(F.array(*[F.lit(r) for r in (mark, own, later)])))
    role, us = F.col("_role"), F.col("_us")
    placed = rows.select(
        "client", "_role", "_us", F.when(role == mark, F.col("_call")).alias("_call"),
        (F.floor(us / width) + F.when(role == later, 1).otherwise(0)).alias("_part"),
        F.when(role == mark, us - width).otherwise(us).alias("_at"), F.when(role == mark, 0).otherwise(1).alias("_n"))
    part = Window.partitionBy("client", "_part")
    marked = placed.withColumn("_before", F.sum("_n").over(part.orderBy("_at", "_n").rowsBetween(Window.unboundedPreceding, 0)))
    # From here on a mark stands for its call.
    upto = F.count(F.lit(1)).over(part.orderBy("_us").rangeBetween(Window.unboundedPreceding, 0))
    counted = marked.filter(role != own).withColumn("in_window", upto - F.col("_before")).filter(role == mark)
    return counted.select("_call.*", "in_window").withColumn("allowed", F.col("in_window") <= limit)


def tumbling_budget(allowed: DataFrame, budget: int) -> DataFrame:
    """Place of each allowed call in its day, and whether the day's budget covers it."""
    rows = allowed.withColumns({
        "day": F.date_format("ts", "yyyy-MM-dd"), "_minute": F.hour("ts") * 60 + F.minute("ts"),
    })
    placed = positions(rows, ["day"], ["_minute"], [F.col("ts"), F.col("event_id")], "place").drop("_minute")
    return placed.withColumn("within_budget", F.col("place") <= budget)


def late_data(events: DataFrame, deadline_s: int) -> DataFrame:
    """Items that arrive after their request's deadline stay visible as timeouts."""
    starts = events.groupBy("request_id").agg((F.min("ts") + F.expr(f"INTERVAL {deadline_s} SECONDS")).alias("deadline"))
    items = events.filter("type = 'photos'").join(starts, "request_id")
    return items.withColumn("outcome", F.when(F.col("ts") > F.col("deadline"), "verification_timeout").otherwise("on_time"))


def stage_timings(events: DataFrame) -> DataFrame:
    """Milliseconds from the first event to resolved / first photos / done."""
    first = lambda t: F.min(F.when(F.col("type") == t, F.col("ts"))).alias(t)
    rows = events.groupBy("request_id").agg(F.min("ts").alias("started"), first("resolved"), first("photos"), first("done"))
    ms = lambda c: F.floor(micros(c, "started") / 1000).cast("bigint").alias(f"{c}_ms")
    return rows.select("request_id", ms("resolved"), ms("photos"), ms("done"))


def report_autohold(reports: DataFrame, threshold: int = config.REPORT_THRESHOLD) -> DataFrame:
    """Reports per review and the moment the review is held (its threshold-th report)."""
    counts = reports.groupBy("review_id").agg(F.count(F.lit(1)).alias("reports"))
    third = top_k(reports.select("review_id", "ts", "event_id"), ["review_id"], [F.col("ts"), F.col("event_id")], threshold)
    held = third.filter(F.col("rank") == threshold).select("review_id", F.col("ts").alias("held_at"))
    return counts.join(held, "review_id", "left")


def resolve_cache(lookups: DataFrame, as_of: Column) -> DataFrame:
    """Live entries of the resolve cache: newest answer per versioned key inside its lifetime."""
    key = F.concat(F.lit(f"resolve:v{config.RESOLVER_VERSION}:"), F.col("norm"))
    newest = lookups.filter(F.col("ts") <= as_of).withColumn("cache_key", key).groupBy("cache_key").agg(
        F.max_by("status", _order()).alias("status"), F.max("ts").alias("saved_at"))
    age = F.expr("timestampdiff(SECOND, saved_at, as_of)")
    ttl = F.when(F.col("status") == "not_found", config.NOT_FOUND_TTL_S).otherwise(config.RESOLVE_TTL_S)
    return newest.withColumn("as_of", as_of).filter(age < ttl).drop("as_of")


# --- streams ---------------------------------------------------------------------------------


def dedup_photos_stream(events: DataFrame, delay: str) -> DataFrame:
    """Each photo of a request once, as long as a re-sent copy comes within ``delay``."""
    timed = events.filter("type = 'photos'").withColumn("event_time", F.col("ts").cast("timestamp"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["request_id", "item_no"])


def report_count_stream(reports: DataFrame) -> DataFrame:
    return reports.groupBy("review_id").agg(F.count(F.lit(1)).alias("reports")).withColumn(
        "held", F.col("reports") >= config.REPORT_THRESHOLD)


def run_to_table(stream: DataFrame, spark: SparkSession, label: str, mode: str = "append",
                 checkpoint: str | None = None, path: str | None = None, side: list[str] | None = None) -> str:
    """Drain a stream into a parquet table below the shared folder and return its path.

    Every micro-batch overwrites its own folder, so a batch that is replayed after a lost executor does not count twice.
    ``side`` names columns whose values get tables of their own below each folder: side outputs that readers prune to.
    """
    path = path or scratch_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        writer = batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").partitionBy(*(side or []))
        writer.parquet(f"{path}/batch_id_part={batch_id}")

    run = (stream.writeStream.outputMode(mode).foreachBatch(write)
           .option("checkpointLocation", checkpoint or scratch_path(spark, f"{label}-state")).trigger(availableNow=True).start())
    run.awaitTermination()
    return path


def latest_update(updates: DataFrame, key: str) -> DataFrame:
    """Last emitted row of each key."""
    others = [c for c in updates.columns if c not in (key, "batch_id", "batch_id_part")]
    return updates.groupBy(key).agg(F.max_by(F.struct(*others), "batch_id").alias("r")).select(key, "r.*")
