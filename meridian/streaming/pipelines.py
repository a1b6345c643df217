"""Streams: migration, telemetry, monitor roll-ups by event time, and circuit breakers with state."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meridian.operators.mapping import Mapping
from meridian.operators.migrate import transformed

FAILURES, RESET_MS, HALF_OPEN_CALLS = 5, 60_000, 1
_STATES = "source long, ts timestamp, ok boolean, allowed boolean, state string, failures int"


def migrate_stream(source: DataFrame, mapping: Mapping, target: str, checkpoint: str, name: str = "source", available_now: bool = True):
    """Start a stream of store rows through the map into Parquet; the checkpoint makes it resume where it stopped, exactly once."""
    writer = transformed(source, mapping, name).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def telemetry_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a folder of JSON lines, (ts double, event string, wrapper string)."""
    return spark.readStream.schema("ts double, event string, wrapper string").json(folder)


def append_telemetry(events: DataFrame, folder: str, opt_in: str | None = None) -> bool:
    """Append (ts, event, wrapper, extras) rows to a folder of JSON lines; only where it was opted in, by ``opt_in`` or MERIDIAN_TELEMETRY.

    No texts are kept: a column called text or query is refused.
    """
    if (opt_in if opt_in is not None else os.environ.get("MERIDIAN_TELEMETRY", "")).lower() not in ("1", "true", "yes"):
        return False
    if {"text", "query"} & {c.lower() for c in events.columns}:
        raise ValueError("telemetry doesn't keep texts")
    events.write.mode("append").json(folder)
    return True


def windowed_counts(events: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, value) by event-time window, with a watermark; works on tables too."""
    timed = events.withColumn("event_time", F.col(ts).cast("timestamp"))
    marked = timed.withWatermark("event_time", late) if events.isStreaming else timed
    return marked.groupBy(F.window("event_time", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of sessions that a gap ends."""
    timed = events.withColumn("event_time", F.col(ts).cast("timestamp"))
    marked = timed.withWatermark("event_time", late) if events.isStreaming else timed
    return marked.groupBy(key, F.session_window("event_time", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class Breaker:
    """One circuit breaker: CLOSED, OPEN after failures in a row, HALF_OPEN when the reset time is over."""

    def __init__(self, state: str = "CLOSED", failures: int = 0, last: int = 0, calls: int = 0, most: int = FAILURES, reset_ms: int = RESET_MS, half_open_calls: int = HALF_OPEN_CALLS):
        self.state, self.failures, self.last, self.calls = state, failures, last, calls
        self.most, self.reset_ms, self.half_open_calls = most, reset_ms, half_open_calls

    def call(self, ms: int, ok: bool) -> bool:
        """Whether a call at a time is let through, with its outcome taken in."""
        if self.state == "OPEN" and ms - self.last >= self.reset_ms:
            self.state, self.calls = "HALF_OPEN", 0
        if self.state == "OPEN" or (self.state == "HALF_OPEN" and self.calls >= self.half_open_calls):
            return False
        self.calls += self.state == "HALF_OPEN"
        if ok:
            self.state, self.failures = "CLOSED", 0
        else:
            self.failures, self.last = self.failures + 1, ms
            if self.state == "HALF_OPEN" or self.failures >= self.most:
                self.state = "OPEN"
        return True


def _walk(breaker: Breaker, rows: pd.DataFrame) -> pd.DataFrame:
    ms = pd.to_datetime(rows["ts"]).astype("datetime64[us]").astype("int64") // 1000
    out = [(breaker.call(int(t), bool(ok)), breaker.state, breaker.failures) for t, ok in zip(ms, rows["ok"])]
    return rows[["source", "ts", "ok"]].assign(allowed=[a for a, _, _ in out], state=[s for _, s, _ in out], failures=[f for _, _, f in out])


def breaker_states(calls: DataFrame) -> DataFrame:
    """Each call (source, ts, ok, seq) with whether it is allowed, and the breaker's state after it: the batch form, which holds a batch of rows only."""


    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, breaker = None, Breaker()
        for batch in batches:
            parts = []
            for one, rows in batch.groupby((batch["source"] != batch["source"].shift()).cumsum(), sort=False):
                if source is None or rows["source"].iloc[0] != source:
                    source, breaker = rows["source"].iloc[0], Breaker()
                parts.append(_walk(breaker, rows))
            if parts:
                yield pd.concat(parts)

    return calls.repartition("source").sortWithinPartitions("source", "ts", "seq").mapInPandas(walk, _STATES)


def breaker_stream(calls: DataFrame) -> DataFrame:
    """The same on a stream, with the breaker's state kept by source."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        breaker = Breaker(*state.get) if state.exists else Breaker()
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        out = _walk(breaker, rows)
        state.update((breaker.state, breaker.failures, breaker.last, breaker.calls))
        yield out

    return calls.groupBy("source").applyInPandasWithState(step, _STATES, "state string, failures int, last long, calls int", "append", GroupStateTimeout.NoTimeout)
