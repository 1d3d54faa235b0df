"""Structured Streaming over serving, reward and session events: ts, event_id, user_id, event_type, value."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout



def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once, within the time that events may be late."""
    rows = events.withWatermark("ts", late)
    return rows.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else rows.dropDuplicates(["event_id"])


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums by tumbling, or sliding, windows and keys."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def reward_join(serving: DataFrame, rewards: DataFrame, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Servings with the rewards of their episode in the time after them. Both: episode_id, ts."""
    s = serving.withWatermark("ts", late).alias("s")
    r = rewards.select(F.col("episode_id").alias("reward_episode"), F.col("ts").alias("reward_ts"), "value").withWatermark("reward_ts", late)
    return s.join(r, (F.col("episode_id") == F.col("reward_episode")) & (F.col("reward_ts") >= F.col("ts")) & (F.col("reward_ts") <= F.col("ts") + F.expr(f"INTERVAL {within}")))


def step_sessions(events: DataFrame, ttl_ms: int = 24 * 3600 * 1000, late: str = "1 hour") -> DataFrame:
    """session_id, status, current_step, context: the state of step sessions after each batch of events.

    events: session_id, ts, action (step, complete, abort), step_order, output. A
    session is active until it completes, is aborted, or has no event for a day
    of event time, when it expires; later events of an ended one change nothing.
    The context keeps the last eight of more than ten lines, and 2000 characters.
    """
    state = "status string, step int, context string"

    def bounded(context: str) -> str:
        lines = context.splitlines()
        return "\n".join(lines[-8:] if len(lines) > 10 else lines)[-2000:]

    def update(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        status, step, context = held.get if held.exists else ("active", 0, "")
        if held.hasTimedOut:
            status = "expired" if status == "active" else status
            held.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "step_order"])
            for row in rows.itertuples():
                if status != "active":
                    break
                if row.action == "step":
                    step, context = max(step, int(row.step_order)), bounded(f"{context}\n{row.output or ''}".strip())
                else:
                    status = {"complete": "completed", "abort": "aborted"}.get(row.action, status)
            # Whatever the events changed, the state is to leave some day.
            last = int(pd.Timestamp(rows["ts"].max()).timestamp() * 1000)
            held.setTimeoutTimestamp(max(last + ttl_ms, held.getCurrentWatermarkMs() + 1))
            held.update((status, step, context))
        yield pd.DataFrame({"session_id": [key[0]], "status": [status], "current_step": [step], "context": [context]})

    rows = events.withWatermark("ts", late).groupBy("session_id")
    return rows.applyInPandasWithState(update, "session_id long, status string, current_step int, context string", state, "update", GroupStateTimeout.EventTimeTimeout)


def requeried(events: DataFrame, seconds: int = 60) -> DataFrame:
    """events with whether the same user asks again within the time."""
    from pyspark.sql import Window

    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return events.withColumn("requeried", F.coalesce(gap <= seconds * 1_000_000, F.lit(False)))


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, into a memory table; for tests and small replays."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


