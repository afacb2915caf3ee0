"""Streams: latest state, sessions, collapsed repeats, bounded buffers.

Sources are tables that grow; with the trigger `availableNow` a stream ends when
it has read what is there, so that its result can be held against a batch query.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of events below a path, with event time as a timestamp."""
    folder, _, name = path.rpartition("/")
    s = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has to say once it has read all there is: an in-memory table of its result."""
    name = f"drained_{uuid.uuid4().hex}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def latest(stream: DataFrame, key: str, order: list[str], values: dict[str, str]) -> DataFrame:
    """For each key the values of its latest row."""
    return stream.groupBy(key).agg(*[F.max_by(v, F.struct(*order)).alias(n) for n, v in values.items()])


def latest_by_stream(spark: SparkSession, d: str) -> DataFrame:
    s = read_events(spark, f"{d}/events.parquet")
    return drain(spark, latest(s, "user_id", ["ts", "event_id"], {"last_line": "event_type", "last_value": "value"}), "complete")


def debounced(stream: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions that end after an idle gap, once the watermark is past them."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, "s.start", "s.end", "n")


def tumbling(stream: DataFrame, ts: str, width: str, late: str, key: str) -> DataFrame:
    """Counts in windows of event time; an extension of ours."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", key, "n")


def collapsed(stream: DataFrame, key: str, line: str, order: str) -> DataFrame:
    """(key, line, n): runs of equal lines as they end; the last run of a key stays in its state."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = []
        for x in rows[line]:
            if n and x == held:
                n += 1
            else:
                if n:
                    out.append((k[0], held, n))
                held, n = x, 1
        state.update((held, n))
        yield pd.DataFrame(out, columns=[key, line, "n"])

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {line} string, n long", "held string, n long", "append", GroupStateTimeout.NoTimeout)


def buffers(stream: DataFrame, key: str, line: str, order: str, most: int = 5000) -> DataFrame:
    """(key, lines): the last lines of each key, at most `most`, after each batch."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        held = (held + rows[line].tolist())[-most:]
        state.update((held,))
        yield pd.DataFrame({key: [k[0]], "lines": [held]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, lines array<string>", "held array<string>", "update", GroupStateTimeout.NoTimeout)


def states(stream: DataFrame, key: str, code: str, order: str) -> DataFrame:
    """(key, state): running until an exit code comes, then stopped for 0 and failed for any other; a later start runs again."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "running"
        for x in pd.concat(list(batches)).sort_values(order, kind="stable")[code]:
            now = "running" if pd.isna(x) else "stopped" if x == 0 else "failed"
        state.update((now,))
        yield pd.DataFrame({key: [k[0]], "state": [now]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, state string", "state string", "update", GroupStateTimeout.NoTimeout)


def subscription(stream: DataFrame, key: str, wanted: list[str] | None) -> DataFrame:
    """The rows of some keys; none named is all of them.  Nothing is skipped for a subscriber that lags: it reads on from its checkpoint."""
    return stream.filter(F.col(key).isin(*wanted)) if wanted else stream


def job_state(spark: SparkSession, name: str, started: dict[str, object]) -> str:
    """idle, running, completed or failed: of the background query of a name among those `started`."""
    q = started.get(name)
    if q is None:
        return "idle"
    if q.isActive:
        return "running"
    return "failed" if q.exception() is not None else "completed"


def start_once(spark: SparkSession, name: str, started: dict[str, object], start) -> bool:
    """Starts a background query unless one of its name runs; whether it did.  `start` returns the query."""
    if job_state(spark, name, started) == "running":
        return False
    started[name] = start()
    return True
