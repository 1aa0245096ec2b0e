"""Stateful stream operators with bounded state: request state, exact call limits, deadlines with late items, sessions.

They keep typed state (values, maps with a lifetime, timers) in a RocksDB store; ``state_store`` names it for the query
that is started and leaves the session's own setting as it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veriframe import config
from veriframe.streaming.requests import SOURCES, STAGES, micros

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Typed state needs the RocksDB store. A query takes the setting when it starts, so it is put back right after."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype(np.int64)


def _newest(parts: list[tuple], numbers: np.ndarray, values: np.ndarray, at: np.ndarray, ids: np.ndarray) -> None:
    """Keep (time, id, value) of the newest event of each part; a part without one has a value below zero."""
    order = np.lexsort((ids, at))
    last = dict(zip(numbers[order].tolist(), order.tolist()))
    for number, i in last.items():
        row = (int(at[i]), int(ids[i]), int(values[i]))
        if parts[number][2] < 0 or parts[number][:2] < row[:2]:
            parts[number] = row


# --- requests by bucket ---------------------------------------------------------------------------

#: A call of the Python worker, its data frames and its state cost milliseconds: many requests of few events each share them.
BUCKETS = 2048
#: Stands for a null number.
NONE = -(1 << 63)


def _by_bucket(events: DataFrame, delay: str, kinds: list[str]) -> GroupedData:
    """Events as numbers, grouped by a hash of their request: ``at`` in microseconds, ``kind`` as place in ``kinds`` (else -1)."""
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NONE)).alias(c)
    at = F.coalesce(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"), F.lit(NONE)).alias("at")
    kind = F.coalesce(*[F.when(F.col("type") == k, F.lit(i)) for i, k in enumerate(kinds)], F.lit(-1)).alias("kind")
    timed = events.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", delay)
    bucket = F.pmod(F.xxhash64("request_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    return timed.select(bucket, "request_id", "event_time", at, number("event_id"), kind, number("item_no"), number("amount")).groupBy("bucket")


class Requests(StatefulProcessor):
    """The requests of a bucket: a table with a row of numbers for each, read and written once per call.

    The third number of a row is the time in ms at which the request is looked at next. A bucket keeps a timer for the
    earliest of them; when it comes, ``due`` is asked for all requests whose time the watermark has passed.
    """

    #: The numbers of a request without events; the first three are its first and last time and the time of its next look.
    fresh: list[int]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("requests", "ids array<string>, numbers binary, items binary")

    def fold(self, ids: list, numbers: np.ndarray, items: np.ndarray, old: int, chunks: list[tuple]) -> tuple:
        """The numbers and items after the events, and output rows. Requests from ``old`` on are new."""
        raise NotImplementedError

    def due(self, ids: list, numbers: np.ndarray, now: np.ndarray) -> tuple:
        """For the requests of which ``now`` is true: numbers after the look, which of all requests stay, and output rows."""
        raise NotImplementedError

    def _get(self) -> tuple[list, np.ndarray, np.ndarray]:
        known = self.state.get() or ([], b"", b"")
        numbers = np.frombuffer(bytes(known[1]), "<i8").reshape(-1, len(self.fresh)).copy()
        return list(known[0]), numbers, np.frombuffer(bytes(known[2]), "<i8").reshape(-1, 2)

    def _put(self, ids: list, numbers: np.ndarray, items: np.ndarray) -> None:
        self.state.update((ids, numbers.astype("<i8").tobytes(), items.astype("<i8").tobytes()))

    def handleInputRows(self, key, rows, timerValues):
        ids, numbers, items = self._get()
        places, old = dict(zip(ids, range(len(ids)))), len(ids)
        before = int(numbers[:, 2].min()) if old else None
        chunks = []
        for c in rows:
            place = np.array([places.setdefault(i, len(places)) for i in c["request_id"].tolist()], np.int64)
            chunks.append((place, *(c[n].to_numpy(np.int64) for n in ("at", "event_id", "kind", "item_no", "amount"))))
        ids = list(places)
        numbers = np.concatenate([numbers, np.tile(np.array(self.fresh, np.int64), (len(ids) - old, 1))])
        numbers, items, out = self.fold(ids, numbers, items, old, chunks)
        self._put(ids, numbers, items)
        earliest = int(numbers[:, 2].min())
        if before is None or earliest < before:
            self.handle.registerTimer(earliest)
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        ids, numbers, items = self._get()
        if not ids:
            return
        now = numbers[:, 2] <= timerValues.getCurrentWatermarkInMs()
        out = ()
        if now.any():
            numbers, stay, out = self.due(ids, numbers, now)
            if stay.all():
                self._put(ids, numbers, items)
            else:
                items, place = items[stay[items[:, 0]]], np.cumsum(stay) - 1
                ids, numbers = [i for i, s in zip(ids, stay.tolist()) if s], numbers[stay]
                if ids:
                    self._put(ids, numbers, np.column_stack([place[items[:, 0]], items[:, 1]]))
                else:
                    self.state.clear()
        if ids:
            self.handle.registerTimer(int(numbers[:, 2].min()))
        if len(out):
            yield out

    def close(self) -> None:
        pass


# --- request state ------------------------------------------------------------------------------


class RequestState(StatefulProcessor):
    """The state of a request, whatever the order of its events: each part keeps its newest event, so rows fold chunk by chunk.

    Sources and stages are as many as the log's format has and stand in the request's one value, three numbers each; photo
    numbers are a map, one entry each. A timer forgets a request that has been silent for ``keep_ms``.
    """

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.base = handle.getValueState(
            "base", "started long, done_ts long, done_id long, end_ts long, end_id long, status string, photos long, seen long, "
            "sources array<long>, stages array<long>")
        self.photos = handle.getMapState("photos", "item_no long", "there boolean")

    def handleInputRows(self, key, rows, timerValues):
        known = self.base.get()
        started, *ends, status, photos, seen, sources, stages = known or (
            None, -1, -1, -1, -1, "streaming", 0, 0, [0, 0, -1] * SOURCES, [0, 0, -1] * STAGES)
        done, ended = tuple(ends[:2]), tuple(ends[2:])
        added = set()
        sources, stages = (list(zip(flat[::3], flat[1::3], flat[2::3])) for flat in (sources, stages))
        for chunk in rows:
            at, ids = _micros(chunk["ts"]), chunk["event_id"].to_numpy(np.int64)
            kind, item, amount = chunk["type"].to_numpy(), chunk["item_no"].to_numpy(np.int64), chunk["amount"].to_numpy(np.int64)
            started = int(at.min()) if started is None else min(started, int(at.min()))
            seen = max(seen, int(at.max()))
            for number in np.unique(item[kind == "photos"]).tolist():
                # A request that is new has none but those of its first rows.
                if number not in added and (known is None or not self.photos.containsKey((number,))):
                    self.photos.updateValue((number,), (True,))
                    photos += 1
                added.add(number)
            for parts, name, values in ((sources, "source", amount % 3), (stages, "stage", amount % 2)):
                own = kind == name
                _newest(parts, item[own] % len(parts), values[own], at[own], ids[own])
            for i in np.flatnonzero(np.isin(kind, config.TERMINAL_EVENT_TYPES)).tolist():
                order = (int(at[i]), int(ids[i]))
                if order > ended:
                    ended, status = order, str(kind[i])
                if kind[i] == "done" and order > done:
                    done = order
        self.base.update((started, *done, *ended, status, photos, seen, [n for v in sources for n in v], [n for v in stages for n in v]))
        if known is None:
            self.handle.registerTimer(seen // 1000 + self.keep_ms)
        sources = [v[2] for v in sources if v[2] >= 0]
        stages = [v for v in stages if v[2] >= 0]
        if done[0] >= 0:  # all stages are finished, but for those started again later
            finished = STAGES - sum(v[:2] > done and v[2] == 0 for v in stages)
        else:
            finished = sum(v[2] for v in stages)
        yield pd.DataFrame({
            "request_id": [key[0]], "status": [status],
            "finished_ms": pd.array([(ended[0] - started) // 1000 if ended[0] >= 0 else None], dtype="Int64"), "photos": [photos],
            "sources": [len(sources)], "sources_ok": [sources.count(0)], "stages_done": [finished]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        known = self.base.get()
        silent_at = known[7] // 1000 + self.keep_ms if known else 0
        if silent_at > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(silent_at)
        else:
            self.base.clear()
            self.photos.clear()
        return iter([])

    def close(self) -> None:
        pass


class RequestStates(Requests):
    """As ``RequestState``, for all requests of a bucket at once.

    Numbers: first time, last time, next look, then (time, id, value) of the newest event of each source, of each stage, of
    the kind done and of all kinds that end a request. Items are the photos: (place of the request, number).
    """

    DONE, END = SOURCES + STAGES, SOURCES + STAGES + 1
    KINDS = ["photos", "source", "stage", *config.TERMINAL_EVENT_TYPES]
    fresh = [(1 << 63) - 1, NONE, 0, *[0, 0, -1] * (SOURCES + STAGES), *[-1, -1, -1] * 2]

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def fold(self, ids, numbers, items, old, chunks):
        parts = numbers[:, 3:].reshape(len(ids), -1, 3).copy()
        touched = np.zeros(len(ids), bool)
        photos = [items]
        for place, at, event_ids, kind, number, amount in chunks:
            touched[place] = True
            np.minimum.at(numbers[:, 0], place, at)
            np.maximum.at(numbers[:, 1], place, at)
            photos.append(np.unique(np.column_stack([place, number])[kind == 0], axis=0))
            source, stage = kind == 1, kind == 2
            end = (kind > 2) & ((at > -1) | ((at == -1) & (event_ids > -1)))
            done = end & (kind == self.KINDS.index("done"))
            for own, part, value in ((source, number % SOURCES, amount % 3), (stage, SOURCES + number % STAGES, amount % 2),
                                     (done, self.DONE, 0), (end, self.END, kind)):
                self._newest(parts, own, *np.broadcast_arrays(place, part, at, event_ids, value))
        photos = np.unique(np.concatenate(photos), axis=0)
        numbers[:, 3:] = parts.reshape(len(ids), -1)
        numbers[old:, 2] = numbers[old:, 1] // 1000 + self.keep_ms
        return numbers, photos, self._table(ids, numbers, parts, photos, np.flatnonzero(touched))

    def _newest(self, parts, own, place, part, at, event_ids, value) -> None:
        """Put the newest of the ``own`` events of each part where it is newer than what stands there."""
        place, part, at, event_ids, value = (x[own] for x in (place, part, at, event_ids, value))
        order = np.lexsort((event_ids, at, part, place))
        p, n = place[order], part[order]
        last = order[np.append((p[1:] != p[:-1]) | (n[1:] != n[:-1]), True)] if len(order) else order
        there = parts[place[last], part[last]]
        newer = (there[:, 2] < 0) | (there[:, 0] < at[last]) | ((there[:, 0] == at[last]) & (there[:, 1] < event_ids[last]))
        last = last[newer]
        parts[place[last], part[last]] = np.column_stack([at[last], event_ids[last], value[last]])

    def _table(self, ids, numbers, parts, photos, these) -> pd.DataFrame:
        counts = np.bincount(photos[:, 0], minlength=len(ids))[these]
        sources, stages = parts[these, :SOURCES, 2], parts[these, SOURCES : self.DONE]
        done, end = parts[these, self.DONE], parts[these, self.END]
        there = stages[:, :, 2] >= 0
        later = (stages[:, :, 0] > done[:, :1]) | ((stages[:, :, 0] == done[:, :1]) & (stages[:, :, 1] > done[:, 1:2]))
        # All stages of a request that is done are finished, but for those started again later.
        reopened = (there & later & (stages[:, :, 2] == 0)).sum(axis=1)
        finished = np.where(done[:, 0] >= 0, STAGES - reopened, np.where(there, stages[:, :, 2], 0).sum(axis=1))
        spans = [(e - s) // 1000 if e >= 0 else None for e, s in zip(end[:, 0].tolist(), numbers[these, 0].tolist())]
        return pd.DataFrame({
            "request_id": np.array([ids[i] for i in these.tolist()], object),
            "status": np.array([self.KINDS[k] if k >= 0 else "streaming" for k in end[:, 2].tolist()], object),
            "finished_ms": pd.array(spans, dtype="Int64"), "photos": counts, "sources": (sources >= 0).sum(axis=1),
            "sources_ok": (sources == 0).sum(axis=1), "stages_done": finished})

    def due(self, ids, numbers, now):
        silent_at = numbers[:, 1] // 1000 + self.keep_ms
        stay = ~now | (silent_at > numbers[:, 2])
        numbers[:, 2] = np.where(now, silent_at, numbers[:, 2])
        return numbers, stay, ()


REQUEST_SCHEMA = "request_id string, status string, finished_ms long, photos long, sources long, sources_ok long, stages_done long"


def request_state(events: DataFrame, keep_s: int = 14 * 86_400, delay: str = "1 day") -> DataFrame:
    """Update rows of every request that got events, as ``requests.profile_state`` gives them for the whole log.

    A request that has been silent for ``keep_s`` is forgotten; events older than the watermark (``delay``) are not read.
    """
    return _by_bucket(events, delay, RequestStates.KINDS).transformWithStateInPandas(RequestStates(keep_s * 1000), REQUEST_SCHEMA, "Update", "EventTime")


# --- call limit -----------------------------------------------------------------------------------


class CallLimit(StatefulProcessor):
    """Exact sliding limit: the last ``limit`` call times of a client decide, so its state is as large as the limit.

    A timer forgets a client whose last call has left the window.
    """

    def __init__(self, limit: int, window_us: int) -> None:
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", "times array<long>")

    def handleInputRows(self, key, rows, timerValues):
        chunks = [chunk[["ts", "event_id"]] for chunk in rows]
        calls = pd.concat(chunks) if len(chunks) > 1 else chunks[0]
        at, ids = _micros(calls["ts"]), calls["event_id"].to_numpy(np.int64)
        order = np.lexsort((ids, at))
        at, ids = at[order], ids[order]
        known = np.sort(np.concatenate([np.array(self.recent.get()[0] if self.recent.exists() else [], np.int64), at]))
        count = np.searchsorted(known, at, "right") - np.searchsorted(known, at - self.window_us, "left")
        self.recent.update((known[-self.limit :].tolist(),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(known[-1] + self.window_us) // 1000 + 1)
        yield pd.DataFrame({"event_id": ids, "client": key[0], "in_window": np.minimum(count, self.limit + 1), "allowed": count <= self.limit})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.recent.clear()
        return iter([])

    def close(self) -> None:
        pass


def call_limit(calls: DataFrame, limit: int, window_s: int, delay: str = "1 minute") -> DataFrame:
    """(event_id, client, in_window, allowed) per call on arrival; in_window stops at limit + 1.

    Calls of one micro-batch are judged in time order, together with those known before. One that comes late, but within
    ``delay``, is judged by the times that are kept.
    """
    timed = calls.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", delay)
    return timed.groupBy("client").transformWithStateInPandas(
        CallLimit(limit, window_s * 1_000_000), "event_id long, client long, in_window long, allowed boolean", "Append", "EventTime")


# --- deadlines ----------------------------------------------------------------------------------


class Deadline(StatefulProcessor):
    """Items and source answers of a request before and after its deadline; a timer closes the request, another forgets it.

    Its state is one value, read and written once per call: there are many requests of few events each. ``answers`` holds
    the number in time and the number late of every source.
    """

    def __init__(self, deadline_us: int, keep_us: int) -> None:
        self.deadline_us, self.keep_us = deadline_us, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("request", "started long, closed boolean, answers array<long>")

    def _sources(self, answers) -> list[tuple]:
        pairs = enumerate(zip(answers[::2], answers[1::2]))
        return [(None, n, "timeout" if not a else "partial" if b else "ok") for n, (a, b) in pairs if a or b]

    def _table(self, key, rows: list[tuple]) -> pd.DataFrame:
        ids, sources, outcomes = zip(*rows) if rows else ((), (), ())
        return pd.DataFrame({"request_id": [key[0]] * len(rows), "event_id": pd.array(ids, dtype="Int64"),
                             "source": pd.array(sources, dtype="Int64"), "outcome": np.array(outcomes, dtype=object)})

    def handleInputRows(self, key, rows, timerValues):
        known = self.state.get()
        chunks = [(_micros(c["ts"]), c["event_id"].tolist(), c["type"].tolist(), c["item_no"].tolist()) for c in rows]
        first = min(int(at.min()) for at, *_ in chunks)
        if known is None:
            started, closed, answers = first, False, [0] * (2 * SOURCES)
            self.handle.registerTimer((started + self.deadline_us) // 1000 + 1)
        else:
            started, closed, answers = min(known[0], first), known[1], list(known[2])
        out, answered = [], False
        for at, ids, kinds, numbers in chunks:
            for late, event_id, kind, number in zip((at > started + self.deadline_us).tolist(), ids, kinds, numbers):
                if kind == "photos":
                    out.append((event_id, None, "verification_timeout" if late else "on_time"))
                elif kind == "source":
                    answers[2 * (number % SOURCES) + late] += 1
                    answered = True
        self.state.update((started, closed, answers))
        if closed and answered:  # the request was reported already: its sources are reported anew
            out += self._sources(answers)
        if out:
            yield self._table(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        known = self.state.get()
        if known is None:
            return
        started, closed, answers = known
        if not closed:
            self.state.update((started, True, answers))
            self.handle.registerTimer((started + self.deadline_us + self.keep_us) // 1000 + 1)
            if out := self._sources(answers):
                yield self._table(key, out)
        elif expiredTimerInfo.getExpiryTimeInMs() * 1000 > started + self.deadline_us + self.keep_us:
            self.state.clear()

    def close(self) -> None:
        pass


class Deadlines(Requests):
    """As ``Deadline``, for all requests of a bucket at once. Numbers: start, closed or not, next look, answers of each source."""

    fresh = [(1 << 63) - 1, 0, 0, *[0] * (2 * SOURCES)]

    def __init__(self, deadline_us: int, keep_us: int) -> None:
        self.deadline_us, self.keep_us = deadline_us, keep_us

    def _sources(self, ids: list, numbers: np.ndarray, these: np.ndarray) -> pd.DataFrame:
        these = np.flatnonzero(these)
        timely, late = numbers[these, 3::2] > 0, numbers[these, 4::2] > 0
        row, source = np.nonzero(timely | late)
        outcome = np.where(~timely, "timeout", np.where(late, "partial", "ok"))[row, source]
        return self._table([ids[i] for i in these[row].tolist()], None, source, outcome)

    def _table(self, ids: list, event_ids, sources, outcomes: np.ndarray) -> pd.DataFrame:
        none = pd.array([None] * len(ids), dtype="Int64")
        if event_ids is not None:
            event_ids = pd.arrays.IntegerArray(event_ids, event_ids == NONE)
        return pd.DataFrame({"request_id": np.array(ids, object), "event_id": none if event_ids is None else event_ids,
                             "source": none if sources is None else pd.array(sources, dtype="Int64"), "outcome": outcomes.astype(object)})

    def fold(self, ids, numbers, items, old, chunks):
        place, at, event_ids, kind, number, _ = (np.concatenate(c) for c in zip(*chunks))
        np.minimum.at(numbers[:, 0], place, at)
        numbers[old:, 2] = (numbers[old:, 0] + self.deadline_us) // 1000 + 1
        late = at > numbers[place, 0] + self.deadline_us
        photo, answer = kind == 0, kind == 1
        out = [self._table([ids[i] for i in place[photo].tolist()], event_ids[photo], None, np.where(late[photo], "verification_timeout", "on_time"))]
        np.add.at(numbers, (place[answer], 3 + 2 * (number[answer] % SOURCES) + late[answer]), 1)
        # A request that was reported already has its sources reported anew.
        again = np.zeros(len(ids), bool)
        again[place[answer]] = True
        again &= numbers[:, 1] == 1
        if again.any():
            out.append(self._sources(ids, numbers, again))
        return numbers, items, pd.concat(out, ignore_index=True) if len(out) > 1 else out[0]

    def due(self, ids, numbers, now):
        closing = now & (numbers[:, 1] == 0)
        forgotten = now & ~closing
        numbers[closing, 1] = 1
        numbers[closing, 2] = (numbers[closing, 0] + self.deadline_us + self.keep_us) // 1000 + 1
        return numbers, ~forgotten, self._sources(ids, numbers, closing)


def deadline_outcomes(events: DataFrame, deadline_s: int, keep_s: int = 30 * 86_400, delay: str = "1 minute") -> DataFrame:
    """(request_id, event_id, source, outcome): a row per photo, on time or verification_timeout, and rows per source.

    A request closes ``deadline_s`` after its first event, and its sources are reported: ok, or later partial (some answers
    after the deadline) or timeout (all). Rows that come within ``keep_s`` after that are still judged by the deadline.
    """
    return _by_bucket(events, delay, ["photos", "source"]).transformWithStateInPandas(
        Deadlines(deadline_s * 1_000_000, keep_s * 1_000_000), "request_id string, event_id long, source long, outcome string",
        "Append", "EventTime")


def source_lateness(events: DataFrame, deadline_s: int) -> DataFrame:
    """Batch twin of the source rows: (request_id, source, outcome) over all answers."""
    starts = events.groupBy("request_id").agg((F.min("ts") + F.expr(f"INTERVAL {deadline_s} SECONDS")).alias("deadline"))
    answers = events.filter("type = 'source'").join(starts, "request_id").groupBy("request_id", (F.col("item_no") % SOURCES).alias("source"))
    return answers.agg(
        F.when(F.min(F.col("ts") > F.col("deadline")), "timeout").when(F.max(F.col("ts") > F.col("deadline")), "partial").otherwise("ok").alias("outcome"))


# --- sessions -----------------------------------------------------------------------------------


def session_timings(events: DataFrame, gap: str) -> DataFrame:
    """Stage timings of events without a request id: (client, started, events, resolved_ms, photos_ms, done_ms) per session.

    A session is the events of a client with less than ``gap`` between neighbours. Works on tables and, with a watermark
    on ``event_time``, on streams: Spark keeps and merges the open sessions and gives each when it is over.
    """
    first = lambda t: F.min(F.when(F.col("type") == t, F.col("event_time"))).alias(t)
    rows = events.groupBy("client", F.session_window("event_time", gap).alias("session")).agg(
        F.min("event_time").alias("started"), F.count(F.lit(1)).alias("events"), first("resolved"), first("photos"), first("done"))
    ms = lambda c: F.floor(micros(c, "started") / 1000).cast("bigint").alias(f"{c}_ms")
    return rows.select("client", "started", "events", ms("resolved"), ms("photos"), ms("done"), F.col("session.end").alias("over_at"))
