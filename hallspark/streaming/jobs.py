"""Event-time jobs, each as a stream and as its batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

c = F.col


def rate_fixed(events: DataFrame, limit: int, window: str = "1 hour", key: str = "key") -> DataFrame:
    """Batch: which events (key, ts, id) a limit per clock-aligned window allows."""
    start = F.window("ts", window)["start"]
    nth = F.row_number().over(Window.partitionBy(key, "window_start").orderBy("ts", "id"))
    return events.withColumn("window_start", start).withColumn("nth", nth).withColumn("allowed", c("nth") <= limit)


def rate_fixed_stream(events: DataFrame, limit: int, window: str = "1 hour", key: str = "key") -> DataFrame:
    """Stream: counts per key and window, and how many were over the limit. Events later than one window are not counted; :func:`rate_fixed_events_stream` gives them out."""
    counted = events.withWatermark("ts", window).groupBy(F.window("ts", window), key).agg(F.count("*").alias("n"))
    return counted.select(key, c("window.start").alias("window_start"), "n", F.greatest(c("n") - limit, F.lit(0)).alias("refused"))


def _anchored(limit: int, seconds: float):
    def run(batches):
        """Rows sorted by key and time; only the opening time and count of one window are carried on."""
        key, opened, n = None, None, 0
        for batch in batches:
            allowed = []
            for own, micros in zip(batch.column(0).to_pylist(), batch.column(1).cast("int64").to_pylist(), strict=True):
                if opened is None or own != key or micros >= opened + seconds * 1e6:
                    key, opened, n = own, micros, 0
                n += 1
                allowed.append(n <= limit)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_())], names=["key", "ts", "id", "allowed"])

    return run


def rate_anchored(events: DataFrame, limit: int, seconds: float) -> DataFrame:
    """Batch: as :func:`rate_fixed`, but a key's window opens at its first event and again at the first one after it has passed. Sequential per key, in constant memory; (key, ts, id). Events without a time are left out."""
    rows = events.where("ts IS NOT NULL").select(c("key").cast("string").alias("key"), c("ts").cast("timestamp").alias("ts"), c("id").cast("long").alias("id"))
    return rows.repartition("key").sortWithinPartitions("key", "ts", "id").mapInArrow(_anchored(limit, seconds), "key string, ts timestamp, id long, allowed boolean")


def _in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """All rows of a key in a micro-batch, in order; their number is bounded by the size of the micro-batch."""
    return pd.concat(list(rows)).sort_values(list(by), kind="stable")


class _EventTime(StatefulProcessor):
    """Stateful operators on event time: rows older than the watermark change no state and are given out as ``late``.

    Subclasses say in :meth:`apply` what a row that is on time does; rows come in order within a micro-batch."""

    by: tuple[str, ...] = ("ts", "id")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows, *self.by)
        late = batch["ts"].map(lambda t: t.timestamp() * 1000 < timer_values.getCurrentWatermarkInMs()).to_numpy(bool)
        if (~late).any():
            yield self.apply(key, batch[~late]).assign(late=False)
        if late.any():
            yield self.late(key, batch[late]).assign(late=True)

    def apply(self, key, batch: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def late(self, key, batch: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def expire_at(self, seconds: float) -> None:
        """The key's one timer: when the watermark passes it, :meth:`handleExpiredTimer` is called."""
        wanted = int(seconds * 1000)
        for at in list(self.handle.listTimers()):
            if at != wanted:
                self.handle.deleteTimer(at)
        self.handle.registerTimer(wanted)

    def close(self) -> None:
        pass


def _on_event_time(events: DataFrame, delay: str) -> DataFrame:
    """A watermark ``delay`` behind the latest event. The column is made anew, as Spark itself would drop late rows of a watermarked column before an operator sees them."""
    return events.withWatermark("ts", delay).withColumn("ts", F.timestamp_micros(F.unix_micros("ts")))


def split_late(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A micro-batch (in foreachBatch) as its rows on time and its late rows, for two sinks."""
    return batch.where("NOT late").drop("late"), batch.where("late").drop("late")


def late_counts(batch: DataFrame, *by: str) -> DataFrame:
    """How many rows a micro-batch had, and how many of them were late, by columns."""
    return batch.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("late").alias("n_late"))


class FixedLimit(_EventTime):
    """A count for each open window of a key; a window that the watermark has passed is forgotten."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "opened long", "n int")

    def apply(self, key, batch: pd.DataFrame) -> pd.DataFrame:
        allowed, starts = [], []
        for t in batch["ts"]:
            start = int(t.timestamp() // self.seconds * self.seconds)
            n = 1 + (self.counts.getValue((start,))[0] if self.counts.containsKey((start,)) else 0)
            self.counts.updateValue((start,), (n,))
            self.handle.registerTimer((start + self.seconds) * 1000)
            allowed.append(n <= self.limit)
            starts.append(pd.Timestamp(start, unit="s"))
        return batch[["key", "ts", "id"]].assign(allowed=allowed, window_start=starts)

    def late(self, key, batch: pd.DataFrame) -> pd.DataFrame:
        return batch[["key", "ts", "id"]].assign(allowed=None, window_start=[pd.Timestamp(int(t.timestamp() // self.seconds * self.seconds), unit="s") for t in batch["ts"]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.removeKey((expiredTimerInfo.getExpiryTimeInMs() // 1000 - self.seconds,))
        return iter(())


def rate_fixed_events_stream(events: DataFrame, limit: int, seconds: int = 3600, delay: str | None = None) -> DataFrame:
    """Stream twin of :func:`rate_fixed`, event by event: (key, ts, id, allowed, window_start, late). In a window events count in the order in which they come. Late ones, behind the watermark (by default a window back), are neither allowed nor refused."""
    out = "key string, ts timestamp, id long, allowed boolean, window_start timestamp, late boolean"
    return _on_event_time(events, delay or f"{seconds} seconds").groupBy("key").transformWithStateInPandas(FixedLimit(limit, seconds), out, "Append", "EventTime")


class AnchoredLimit(_EventTime):
    """Stream twin of :func:`rate_anchored`: the state of a key is the opening time and count of its window. A timer at the window's end clears it, so keys without an open window have no state."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds = limit, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "opened double, n int")

    def apply(self, key, batch: pd.DataFrame) -> pd.DataFrame:
        opened, n = self.state.get() if self.state.exists() else (None, 0)
        allowed = []
        for t in batch["ts"]:
            t = t.timestamp()
            if opened is None or t >= opened + self.seconds:
                opened, n = t, 0
            n += 1
            allowed.append(n <= self.limit)
        self.state.update((opened, n))
        self.expire_at(opened + self.seconds)
        return batch[["key", "ts", "id"]].assign(allowed=allowed)

    def late(self, key, batch: pd.DataFrame) -> pd.DataFrame:
        return batch[["key", "ts", "id"]].assign(allowed=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())


def rate_anchored_stream(events: DataFrame, limit: int, seconds: float, delay: str | None = None) -> DataFrame:
    """(key, ts, id, allowed, late): late events, behind the watermark (by default a window back), are neither allowed nor refused."""
    return _on_event_time(events, delay or f"{seconds} seconds").groupBy("key").transformWithStateInPandas(AnchoredLimit(limit, seconds), "key string, ts timestamp, id long, allowed boolean, late boolean", "Append", "EventTime")


def page_changes(pages: DataFrame) -> DataFrame:
    """Batch: fetches (url, ts, hash, id) whose hash differs from the last of the URL."""
    before = F.lag("hash").over(Window.partitionBy("url").orderBy("ts", "id"))
    return pages.withColumn("before", before).where(~c("hash").eqNullSafe(c("before"))).drop("before")


class LastHash(_EventTime):
    """The last hash of a URL, forgotten ``forget`` seconds after its last fetch, if given."""

    def __init__(self, forget: float | None = None):
        self.forget = forget

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("hash", "hash string")

    def apply(self, key, batch: pd.DataFrame) -> pd.DataFrame:
        known = self.state.exists()
        last, fresh = self.state.get()[0] if known else None, []
        for now in batch["hash"]:
            now = None if pd.isna(now) else now
            fresh.append(now != last)
            last = now
        self.state.update((last,))
        if self.forget is not None:
            self.expire_at(batch["ts"].iloc[-1].timestamp() + self.forget)
        return batch.loc[fresh, ["url", "ts", "hash", "id"]]

    def late(self, key, batch: pd.DataFrame) -> pd.DataFrame:
        return batch[["url", "ts", "hash", "id"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())


def page_changes_stream(pages: DataFrame, delay: str = "1 hour", forget: float | None = None) -> DataFrame:
    """Stream twin of :func:`page_changes`: (url, ts, hash, id, late). Late fetches come out as such, changed or not, and change nothing."""
    return _on_event_time(pages, delay).groupBy("url").transformWithStateInPandas(LastHash(forget), "url string, ts timestamp, hash string, id long, late boolean", "Append", "EventTime")


class ConflictState(_EventTime):
    """Entries of a hall's field: opened by the first, distinct ones appended, repeats ignored, closed by RESOLVED. A map holds the entries and a value their number, so an event costs the same however many there are; closing costs what was opened."""

    by = ("ts",)

    def init(self, handle) -> None:
        self.entries = handle.getMapState("entries", "value string, source_id long", "seen boolean")
        self.size = handle.getValueState("size", "n int")

    def apply(self, key, batch: pd.DataFrame) -> pd.DataFrame:
        n, out = self.size.get()[0] if self.size.exists() else 0, []
        for r in batch.itertuples():
            entry = (None if pd.isna(r.value) else r.value, None if pd.isna(r.source_id) else int(r.source_id))
            if r.kind == "RESOLVED":
                if n:
                    self.entries.clear()
                n = 0
                out.append((*key, "RESOLVED", 0))
            elif not self.entries.containsKey(entry):
                n += 1
                self.entries.updateValue(entry, (True,))
                out.append((*key, "OPEN", n))
        if n:
            self.size.update((n,))
        else:
            self.size.clear()
        return pd.DataFrame(out, columns=["dorm_id", "field", "status", "n_entries"])

    def late(self, key, batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, kind, None) for kind in batch["kind"]], columns=["dorm_id", "field", "status", "n_entries"]).astype({"n_entries": "Int32"})


def conflict_stream(entries: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Stream of (dorm_id, field, value, source_id, ts, kind) to (dorm_id, field, status, n_entries, late). Late events come out with their kind as status and change nothing."""
    return _on_event_time(entries, delay).groupBy("dorm_id", "field").transformWithStateInPandas(ConflictState(), "dorm_id long, field string, status string, n_entries int, late boolean", "Append", "EventTime")


def crawl_counter_stream(logs: DataFrame, window: str = "1 hour") -> DataFrame:
    """Running counters of logs (job_id, level, ts) per job and window; on a batch the same, at once."""
    rows = logs.withWatermark("ts", window) if logs.isStreaming else logs
    out = rows.groupBy(F.window("ts", window), "job_id").agg(F.count("*").alias("n"), F.count_if(c("level") == "error").alias("n_errors"))
    return out.select("job_id", c("window.start").alias("window_start"), "n", "n_errors")


def heartbeat_gaps(logs: DataFrame, minutes: int = 30) -> DataFrame:
    """Batch: gaps of at least ``minutes`` between a job's logs."""
    before = F.lag("ts").over(Window.partitionBy("job_id").orderBy("ts", "id"))
    gap = F.unix_micros(c("ts").cast("timestamp")) - F.unix_micros(c("before").cast("timestamp"))
    return logs.withColumn("before", before).where(gap >= minutes * 60 * 1_000_000).select("job_id", "id", "before", "ts", F.floor(gap / 60_000_000).alias("gap_minutes"))


def heartbeat_sessions(logs: DataFrame, gap: str = "30 minutes") -> DataFrame:
    rows = logs.withWatermark("ts", gap) if logs.isStreaming else logs
    return rows.groupBy("job_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("job_id", c("session_window.start").alias("started"), c("session_window.end").alias("ended"), "n")
