"""Streaming forms of the stateful behaviours; each has a batch twin that tests and queries hold it against.

State lives in RocksDB as values, lists and maps. What depends on order is buffered until the
watermark has passed it, so files may come in any order within the stated delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators import feedback as FB
from tessera.operators.store import UpsertTable

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = pd.Timestamp("1970-01-01")


def _micros(ts: pd.Series) -> pd.Series:
    if getattr(ts.dt, "tz", None) is not None:
        ts = ts.dt.tz_convert("UTC").dt.tz_localize(None)
    return (ts - _EPOCH) // pd.Timedelta(microseconds=1)


class InOrder(StatefulProcessor):
    """Rows of a key (ts, id, value) in event-time order: they wait in a list until the watermark has passed them.

    One event-time timer a key stands at its earliest waiting row. Subclasses take the ready
    rows in order of (ts, id).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            new = list(zip(_micros(pdf.ts).tolist(), pdf.id.tolist(), pdf.value.tolist()))
            self.waiting.appendList(new)
            self.handle.registerTimer(min(new)[0] // 1000)
        yield self.frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1]))
        ready = [r for r in rows if r[0] // 1000 <= now]
        rest = [tuple(r) for r in rows[len(ready) :]]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000)
        else:
            self.waiting.clear()
        yield self.frame([(key[0], *r) for r in self.take(ready)])

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns)

    def close(self) -> None:
        pass


class RateLimit(InOrder):
    """Accepted times of the last window, as a list: never more than the limit."""

    columns = ["user_id", "event_id", "accepted"]

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getListState("held", "at long")

    def take(self, ready: list) -> Iterator[tuple]:
        times = [r[0] for r in self.held.get()] if self.held.exists() else []
        for at, i, _ in ready:
            times = [t for t in times if at - t < self.window]
            ok = len(times) < self.limit
            if ok:
                times.append(at)
            yield i, ok
        if times:
            self.held.put([(t,) for t in times])


class Streaks(InOrder):
    """The current value and the length of its run, as a value."""

    columns = ["user_id", "event_id", "value"]

    def __init__(self, length: int):
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.run = handle.getValueState("run", "value string, n long")

    def take(self, ready: list) -> Iterator[tuple]:
        value, n = self.run.get() if self.run.exists() else (None, 0)
        for _, i, v in ready:
            value, n = v, n + 1 if n and v == value else 1
            if n == self.length:
                yield i, v
        if n:
            self.run.update((value, n))


class Memories(StatefulProcessor):
    """A user's memories that will end, as a list of ids and ends; one event-time timer at the earliest end takes out what has ended and tells so.

    The last end that came in for an id counts, and one that comes in without an end takes it
    back. A batch reads and writes a user's list once, and a timer takes all that has ended.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "id long, ends long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, new = [], {}
        for pdf in rows:
            ends = [None if e is None or e != e else int(e) for e in pdf.ends.tolist()]
            new.update(zip(pdf.id.tolist(), ends))
            out += [(key[0], i, "kept", e) for i, e in zip(pdf.id.tolist(), ends)]
        if self.ttl_ms is not None:
            self.held.appendList([(i, -1 if e is None else e) for i, e in new.items()])
        else:
            before = self._held()
            self._keep({i: e for i, e in (before | new).items() if e is not None}, before)
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = self._held()
        self._keep({i: e for i, e in held.items() if e // 1000 > now}, held)
        yield self.frame([(key[0], i, "ended", e) for i, e in held.items() if e // 1000 <= now])

    def _held(self) -> dict[int, int]:
        return {r[0]: r[1] for r in self.held.get()} if self.held.exists() else {}

    def _keep(self, held: dict[int, int], before: dict[int, int]) -> None:
        if held == before:
            return
        if held:
            self.held.put(list(held.items()))
            self.handle.registerTimer(min(held.values()) // 1000)
        else:
            self.held.clear()

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["user_id", "id", "state", "ends"])
        return out.assign(ends=out.ends.astype("Int64"))

    def close(self) -> None:
        pass


class Confirmations(StatefulProcessor):
    """How often an action was confirmed, as a value that ends `ttl_ms` after the last time."""

    def __init__(self, lock_at: int, ttl_ms: int | None):
        self.lock_at, self.ttl_ms = lock_at, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.n = handle.getValueState("n", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = (self.n.get()[0] if self.n.exists() else 0) + sum(len(pdf) for pdf in rows)
        self.n.update((n,))
        yield pd.DataFrame([(key[0], n, n >= self.lock_at)], columns=["action", "confirmed", "locked"])

    def close(self) -> None:
        pass


def _ordered(stream: DataFrame, processor: InOrder, out: str, value, delay: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = stream.select("user_id", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), value.cast("string").alias("value"))
    return rows.withWatermark("ts", delay).groupBy("user_id").transformWithStateInPandas(processor, out, "append", "EventTime")


def rate_limit(stream: DataFrame, limit: int = 20, window: int = 60, delay: str = "1 minute") -> DataFrame:
    """(user_id, event_id, accepted) of (user_id, event_id, ts): as memory.accepted_hits, whatever order hits come in within `delay`.

    A hit comes out once the watermark has passed it; hits that come later than that are dropped.
    """
    return _ordered(stream, RateLimit(limit, window), "user_id long, event_id long, accepted boolean", F.lit(None), delay)


def streaks(stream: DataFrame, length: int = 3, delay: str = "1 minute") -> DataFrame:
    """(user_id, event_id, value) of (user_id, event_id, ts, value): as memory.streaks, in event-time order within `delay`."""
    return _ordered(stream, Streaks(length), "user_id long, event_id long, value string", F.col("value"), delay)


def memories(stream: DataFrame, delay: str = "1 minute", ttl_ms: int | None = None) -> DataFrame:
    """(user_id, id, state, ends) of (user_id, id, ts, expires_at): `kept` when a memory comes in, `ended` when event time has passed its end (microseconds).

    With ttl_ms memories end that long after they were stored, by the clock, and no more is told.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = stream.select("user_id", "id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("expires_at").cast("timestamp")).alias("ends"))
    mode = "EventTime" if ttl_ms is None else "ProcessingTime"
    rows = rows.withWatermark("ts", delay) if ttl_ms is None else rows
    return rows.groupBy("user_id").transformWithStateInPandas(Memories(ttl_ms), "user_id long, id long, state string, ends long", "append", mode)


def confirmations(stream: DataFrame, lock_at: int = FB.LOCK_AT, ttl_ms: int | None = None) -> DataFrame:
    """(action, confirmed, locked) as confirmations (action) come in; a count ends ttl_ms after its last one."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return stream.groupBy("action").transformWithStateInPandas(Confirmations(lock_at, ttl_ms), "action string, confirmed long, locked boolean", "append", "None" if ttl_ms is None else "ProcessingTime")


def once(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Messages of a stream, each (qa_id, session_id) once while the watermark remembers it; those without a qa_id all pass."""
    rows = stream.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    named = F.coalesce("qa_id", F.lit("")) != ""
    return rows.where(named).dropDuplicatesWithinWatermark(["qa_id", "session_id"]).unionByName(rows.where(~named))


def new_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below root as they appear, as (path, modificationTime, length, content)."""
    return spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(root)


FEEDBACK = ["qa_id", "ts", "query", "response", "rating", "failure_type", "comment", "form_ids"]


def learn_feedback(table: UpsertTable, batch: DataFrame, number: int) -> None:
    """One batch of feedback into the table: what is known of its ids is filled up with what is new, and negatives without a type are diagnosed.

    A rating may come after its question and answer, and later ones replace it. A batch that
    is run again replaces itself, as the table is read without it.
    """
    new = UpsertTable.merged(batch.select(*FEEDBACK), ["qa_id"], F.col("ts"))
    before = table.read(batch.sparkSession, FEEDBACK_SCHEMA, below=number).join(new.select("qa_id"), "qa_id", "left_semi")
    rows = UpsertTable.merged(before.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1))), ["qa_id"], F.col("__new")).drop("__new")
    turns = rows.where("rating <= 2").select("qa_id", F.coalesce("query", F.lit("")).alias("query"), F.coalesce("response", F.lit("")).alias("response"), F.coalesce("form_ids", F.array().cast("array<string>")).alias("shown"))
    found = FB.negative_pipeline(turns).select("qa_id", F.col("failure_type").alias("found"))
    rows = rows.join(found, "qa_id", "left").withColumn("failure_type", F.coalesce(F.nullif("failure_type", F.lit("")), "found")).drop("found")
    table.put(rows.select(*FEEDBACK), number)


FEEDBACK_SCHEMA = "qa_id string, ts timestamp, query string, response string, rating int, failure_type string, comment string, form_ids array<string>"


def feedback_loop(stream: DataFrame, folder: str, checkpoint: str):
    """Start a query that keeps a stream of feedback in an UpsertTable below folder, diagnosed where it is negative."""
    table = UpsertTable(folder, ["qa_id"])
    return stream.writeStream.foreachBatch(lambda batch, number: learn_feedback(table, batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
