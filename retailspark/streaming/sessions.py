"""Streaming scanner sessions.

``scanner_sink`` gives what the batch operator gives, in event-time order whatever
the order of arrival.  Time is kept per device: a device's events wait in its state until
``delay`` below that device's latest event, or until a timer finds the device idle, so
a clock that is wrong delays no other device.  Events behind their device's horizon
and events without a time go to side tables.

``scanner_sessions`` is the low-latency form with ``applyInPandasWithState``: per
device the state is the pending buffer and the time of the last key, so
it stays bounded whatever the stream length, and it expires (event-time
timeout) once the device has been idle for longer than the gap.  Within a trigger the device's
events are processed in (ts, seq) order; events older than an already
processed one are handled in arrival order, as the listener would.
"""

from __future__ import annotations

import sys

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from retailspark.operators.sessions import ENTER, gap_sessions

# Functions of this module run inside Python workers; pickle them by value so
# executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT_SCHEMA = "device long, code string, ended timestamp_ntz"
STATE_SCHEMA = "buffer string, last_us long"


def _scanner(gap_us: int, terminator: str):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            # Idle for longer than the gap: the next key would clear the buffer
            # anyway, so the state can go.
            state.remove()
            yield pd.DataFrame({"device": [], "code": [], "ended": pd.Series([], dtype="datetime64[us]")})
            return
        buf, last = ("", None)
        if state.exists:
            buf, last = state.get
        codes, ends = [], []
        # All of the trigger's events of the device, whatever their Arrow batches.
        parts = list(pdfs)
        for pdf in [pd.concat(parts).sort_values(["ts", "seq"])] if parts else []:
            for ts, tok in zip(pdf["ts"], pdf["key"]):
                now = pd.Timestamp(ts).value // 1000
                if last is not None and now - last > gap_us:
                    buf = ""
                last = now
                if tok == terminator:
                    if buf:
                        codes.append(buf)
                        ends.append(ts)
                    buf = ""
                elif isinstance(tok, str):
                    buf += tok
        state.update((buf, last))
        if last is not None:
            expiry_ms = (last + gap_us) // 1000 + 1
            state.setTimeoutTimestamp(max(expiry_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"device": [key[0]] * len(codes), "code": codes, "ended": pd.Series(ends, dtype="datetime64[us]")})

    return fn


def scanner_sessions(events: DataFrame, *, gap_seconds: float = 0.3, terminator: str = ENTER, watermark: str = "10 minutes") -> DataFrame:
    """Emit one row per code closed by the terminator: ``device, code, ended``.

    An event-time watermark on ``ts`` (events later than it are dropped) lets a
    device's state expire once it has been idle for longer than the gap, so the
    state covers active devices only."""
    fn = _scanner(int(round(gap_seconds * 1_000_000)), terminator)
    ev = events.select("device", "seq", "ts", "key")
    if isinstance(events.schema["ts"].dataType, T.TimestampNTZType):
        # Watermarks need TIMESTAMP: same epoch value as the wall-clock ts read
        # as UTC (what the state machine uses), whatever the session time zone.
        epoch_us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
        ev = ev.withColumn("_event_time", F.timestamp_micros(epoch_us))
    else:
        ev = ev.withColumn("_event_time", F.col("ts"))
    ev = ev.withWatermark("_event_time", watermark)
    return ev.groupBy("device").applyInPandasWithState(fn, OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def _micros(events: DataFrame) -> Column:
    """``ts`` as microseconds; a wall-clock time is read as UTC."""
    if isinstance(events.schema["ts"].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return F.unix_micros("ts")


def _from_micros(us: str, like: T.DataType) -> Column:
    if isinstance(like, T.TimestampNTZType):
        return F.timestamp_add("MICROSECOND", F.col(us), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.timestamp_micros(us)


#: What waits of a device, and the time up to which its events were handled.
WAITING_SCHEMA = "us array<bigint>, seq array<bigint>, key array<string>, horizon bigint"
_ROWS = "kind string, code string, us long, seq long, key string"


class DeviceTime(StatefulProcessor):
    """One device: its events in the order of its own clock.

    An event newer than the trigger's time plus ``delay`` doesn't move the device's
    horizon (its clock is wrong); it waits until its time has come.  What was handled
    but isn't closed yet goes on waiting, so the state is all that is needed to
    finish the codes (``waiting_codes``)."""

    def __init__(self, gap_us: int, terminator: str, delay_us: int, idle_ms: int):
        self.gap, self.terminator, self.delay, self.idle = gap_us, terminator, delay_us, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", WAITING_SCHEMA)

    def _load(self) -> tuple[list[tuple], int | None]:
        if not self.waiting.exists():
            return [], None
        us, seq, key, horizon = self.waiting.get()
        return list(zip(us, seq, key, strict=True)), horizon

    def _advance(self, events: list[tuple], horizon: int | None, now_ms: int, timers: bool = True) -> list[tuple]:
        """Handle what the horizon has passed; keep the rest and set the timer.  A device
        has few events at a time, so these are plain tuples (us, seq, key)."""
        events = sorted(events, key=lambda e: (e[0], e[1] is None, e[1] or 0))
        n = 0 if horizon is None else sum(e[0] <= horizon for e in events)
        codes, text, start, last = [], [], 0, None
        for i, (us, _, key) in enumerate(events[:n]):
            if last is not None and us - last > self.gap:
                text, start = [], i
            last = us
            if key == self.terminator:
                if text:
                    codes.append(("code", "".join(text), us, None, None))
                text, start = [], i + 1
            elif key:
                text.append(key)
        if last is None or last <= horizon - self.gap:
            start = n
        later = events[start:]
        self.waiting.update(([e[0] for e in later], [e[1] for e in later], [e[2] for e in later], horizon))
        for t in self.handle.listTimers() if timers else ():
            self.handle.deleteTimer(t)
        if later:
            # A key that is dated ahead is due when its time has come.
            self.handle.registerTimer(max(now_ms + self.idle, later[0][0] // 1000))
        return codes

    def _named(self, key, out: list[tuple]) -> Iterator[pd.DataFrame]:
        # Plain objects, as numbers may be missing.
        columns = zip(("kind", "code", "us", "seq", "key"), zip(*out))
        if out:
            yield pd.DataFrame({"device": pd.Series([key[0]] * len(out), dtype=object)} | {c: pd.Series(v, dtype=object) for c, v in columns})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        live, horizon = self._load()
        known, aside = horizon is not None or bool(live), []
        whole = lambda v: None if pd.isna(v) else int(v)
        for part in rows:
            for us, seq, token in zip(part["us"].tolist(), part["seq"].tolist(), part["key"].tolist(), strict=True):
                event = (whole(us), whole(seq), token if isinstance(token, str) else None)
                if event[0] is None:
                    aside.append(("untimed", None, *event))
                elif horizon is not None and event[0] <= horizon:
                    aside.append(("late", None, *event))
                else:
                    live.append(event)
        believed = [e[0] for e in live if e[0] <= now * 1000 + self.delay]
        ahead = horizon
        if believed:
            ahead = max(x for x in (horizon, max(believed) - self.delay) if x is not None)
        return self._named(key, self._advance(live, ahead, now, timers=known) + aside)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing came for ``idle``: what the clock has reached is handled."""
        now = timerValues.getCurrentProcessingTimeInMs()
        waiting, horizon = self._load()
        reached = [e[0] for e in waiting if e[0] <= now * 1000 + self.delay]
        if reached:
            horizon = max(x for x in (horizon, max(reached) + self.gap + 1) if x is not None)
        return self._named(key, self._advance(waiting, horizon, now))

    def close(self) -> None:
        pass


def device_time_sessions(events: DataFrame, *, gap_seconds: float = 0.3, terminator: str = ENTER, delay_seconds: float = 600.0, idle_seconds: float = 600.0) -> DataFrame:
    """``kind, device, code, ended, seq, ts, key`` of a stream of key events: a row
    of kind ``code`` for each code, ``late`` for an event behind its device's
    horizon, ``untimed`` for one without a time.  Needs RocksDB as state store
    (``scanner_sink`` sees to it)."""
    kind = events.schema["ts"].dataType
    processor = DeviceTime(int(round(gap_seconds * 1_000_000)), terminator, int(delay_seconds * 1_000_000), int(idle_seconds * 1000))
    keyed = events.select("device", _micros(events).alias("us"), "seq", "key").groupBy("device")
    rows = keyed.transformWithStateInPandas(processor, f"device long, {_ROWS}", outputMode="append", timeMode="processingTime")
    at = _from_micros("us", kind)
    return rows.select("kind", "device", "code", F.when(F.col("kind") == "code", at).alias("ended"), "seq", F.when(F.col("kind") != "code", at).alias("ts"), "key")


def write_sessions(batch: DataFrame, epoch_id: int, out_dir: str) -> None:
    """One micro-batch of ``scanner_sink``: ``codes`` and ``aside`` (``late`` and
    ``untimed`` events) under ``epoch=<id>``, which a replay overwrites."""
    batch = batch.persist()
    try:
        batch.where("kind = 'code'").select("device", "code", "ended").write.mode("overwrite").parquet(f"{out_dir}/codes/epoch={epoch_id}")
        batch.where("kind <> 'code'").select("kind", "device", "seq", "ts", "key").write.mode("overwrite").parquet(f"{out_dir}/aside/epoch={epoch_id}")
    finally:
        batch.unpersist()


#: Stateful processors need this state store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: With timers, batches without data never end; a query that ends with its input runs none.
NO_DATA = ("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def scanner_sink(events: DataFrame, *, out_dir: str, checkpoint: str, available_now: bool = True, **options):
    """Start the query that keeps ``codes`` and ``aside`` under ``out_dir``; returns it.
    ``options`` are those of ``device_time_sessions``.  Timers fire in a query that
    goes on; one that ends with its input leaves what waits in the state."""
    spark = events.sparkSession
    settings = dict([STATE_STORE, NO_DATA] if available_now else [STATE_STORE])
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        w = device_time_sessions(events, **options).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        w = w.foreachBatch(lambda batch, epoch: write_sessions(batch, epoch, out_dir))
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="2 seconds")
        return w.start()
    finally:  # a started query keeps the settings it was started with
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def waiting_codes(spark: SparkSession, checkpoint: str, *, gap_seconds: float = 0.3, terminator: str = ENTER, like: str = "timestamp_ntz") -> DataFrame:
    """``device, code, ended`` of the codes in the events that still wait: what a
    stopped ``scanner_sink`` would give if nothing came any more.  Reads the
    state of the checkpoint and changes nothing; ``like`` is the type of ``ts``."""
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(checkpoint)
    waiting = state.select(F.col("key.device").alias("device"), F.explode(F.arrays_zip("value.us", "value.seq", "value.key")).alias("e"))
    kind = T.TimestampNTZType() if like == "timestamp_ntz" else T.TimestampType()
    events = waiting.select("device", F.col("e.seq").alias("seq"), F.col("e.us").alias("us"), F.col("e.key").alias("key")).withColumn("ts", _from_micros("us", kind))
    return gap_sessions(events, gap_seconds=gap_seconds, terminator=terminator).select("device", "code", "ended")


def read_codes(spark: SparkSession, out_dir: str, *, like: str = "timestamp_ntz") -> DataFrame:
    """``device, code, ended`` of all epochs so far; ``like`` is the type of ``ts``."""
    return spark.read.schema(f"device long, code string, ended {like}").parquet(f"{out_dir}/codes").select("device", "code", "ended")
