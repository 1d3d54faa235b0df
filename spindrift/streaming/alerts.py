"""Alerts that have to last: pending, firing, resolved, by rule and key.

A rule's condition is an expression on the sample, and ``hold`` the seconds for
which it has to stay true. A first sample in breach makes the alert pending; the
first one in breach that is ``hold`` seconds later or more makes it fire; one
out of breach resolves a firing alert and drops a pending one. A series that
is silent for more than ``stale`` seconds ends what it had begun, at its last
sample plus that time. Runs don't end where a window does.

``transitions`` works on what is there, ``stream_transitions`` on a stream, with
the same result for the same samples. Of samples of one rule, key and time the
greatest value counts. Rows without a key, a time or a value are no samples.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class Rule(NamedTuple):
    name: str
    condition: Column
    hold: int = 0


def evaluated(samples: DataFrame, rules: list[Rule], key: str = "key") -> DataFrame:
    """rule, key, ts, value, breach, hold: a row for each sample and rule, from one reading. samples: key, ts, value."""
    tried = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.coalesce(r.condition, F.lit(False)).alias("breach"), F.lit(r.hold).cast("long").alias("hold")) for r in rules])
    rows = samples.filter(F.col(key).isNotNull() & F.col("ts").isNotNull() & F.col("value").isNotNull())
    return rows.select(F.col(key).alias("key"), "ts", "value", F.explode(tried).alias("r")).select("r.rule", "key", "ts", "value", "r.breach", "r.hold")


def _micros(x: Column | str) -> Column:
    return F.unix_micros(F.col(x) if isinstance(x, str) else x)


def transitions(samples: DataFrame, stale: int, as_of: Column | None = None) -> DataFrame:
    """rule, key, ts, state of samples as ``evaluated`` gives them. as_of: the time it is now (default: that of the last sample), by which a silent series has ended."""
    once = samples.groupBy("rule", "key", "ts").agg(F.max(F.struct("value", "breach")).alias("x"), F.max("hold").alias("hold")).select("rule", "key", "ts", "x.breach", "hold")
    series = Window.partitionBy("rule", "key").orderBy("ts")
    quiet = F.lit(stale * 1_000_000)
    before, breached = F.lag("ts").over(series), F.lag("breach").over(series)
    begins = F.col("breach") & (before.isNull() | ~breached | (_micros("ts") - _micros(before) > quiet))
    rows = once.select("*", F.lead("ts").over(series).alias("next"), F.last(F.when(begins, F.col("ts")), ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, 0)).alias("since"))
    rows = rows.filter("breach")
    lasted = _micros("ts") - _micros("since") >= F.col("hold") * 1_000_000
    runs = rows.groupBy("rule", "key", "since").agg(F.min(F.when(lasted, F.col("ts"))).alias("fired"), F.max(F.struct("ts", "next")).alias("last"), F.max("hold").alias("hold"))
    if as_of is None:
        as_of = F.lit(samples.agg(F.max("ts")).first()[0])
    last, after = F.col("last.ts"), F.col("last.next")
    spoke = after.isNotNull() & (_micros(after) - _micros(last) <= quiet)
    silent = _micros(F.coalesce(after, as_of.cast("timestamp"))) - _micros(last) > quiet
    ended = F.when(spoke, after).when(silent, F.timestamp_micros(_micros(last) + quiet))
    said = lambda state, ts, when: F.when(when & ts.isNotNull(), F.struct(ts.alias("ts"), F.lit(state).alias("state")))
    steps = F.array(said("pending", F.col("since"), F.col("hold") > 0), said("firing", F.col("fired"), F.lit(True)), said("resolved", ended, F.col("fired").isNotNull()))
    return runs.select("rule", "key", F.explode(F.array_compact(steps)).alias("s")).select("rule", "key", "s.ts", "s.state")


_STATE = "since long, fired boolean, last long"
_NONE = (-1, False, -1)
#: A waiting sample, and the time (in microseconds) whose samples of a series wait in one piece; samples that are sorted at once; changes that are told at once.
_SAMPLE = np.dtype([("us", "<i8"), ("value", "<f8"), ("breach", "?")])
_HOUR, _ROWS, _TOLD = 3_600_000_000, 1 << 20, 1 << 16


def _once(parts: list[np.ndarray]) -> np.ndarray:
    """Samples in order of time; of those of one time the greatest."""
    rows = np.concatenate([np.empty(0, _SAMPLE), *parts])
    rows = rows[np.lexsort((rows["breach"], rows["value"], rows["us"]))]
    return rows[np.append(rows["us"][1:] != rows["us"][:-1], True)] if len(rows) else rows


def advance(state: tuple[int, bool, int], us: np.ndarray, breach: np.ndarray, hold: int, stale: int) -> tuple[tuple[int, bool, int], dict[str, np.ndarray]]:
    """The state (since, fired, last; since below zero: inactive) after samples (time, breach) in order, each time once: with when it came to be pending, firing, resolved. All in microseconds."""
    since, fired, last = state
    if not len(us):
        return state, {}
    on = since >= 0
    quiet = np.diff(us, prepend=last if on else us[0]) > stale
    # A run of breaches goes on until a sample that is none, or that comes after a silence.
    stop = np.append(np.flatnonzero(~breach | quiet), len(us))
    begin = np.flatnonzero(breach & (quiet | np.append(not on, ~breach[:-1])))
    end = stop[np.searchsorted(stop, begin, "right")]
    starts = us[begin]
    if on:
        begin, end, starts = np.append(0, begin), np.append(stop[0], end), np.append(since, starts)
    reached = np.maximum(np.searchsorted(us, starts + hold), begin)
    fires = reached < end
    told = {"pending": starts[int(on) :] if hold > 0 else us[:0]}
    if on and fired:
        told["firing"], fires[0] = us[reached[1:][fires[1:]]], True
    else:
        told["firing"] = us[reached[fires]]
    over = end < len(us)
    before = np.where(end > 0, us[end - 1], last)
    ended = np.where(quiet[np.minimum(end, len(us) - 1)], before + stale, us[np.minimum(end, len(us) - 1)])
    told["resolved"] = ended[over & fires]
    is_on = len(over) > 0 and not over[-1]
    return (int(starts[-1]) if is_on else -1, bool(is_on and fires[-1]), int(us[-1])), told


class _Alerts(StatefulProcessor):
    """Holds samples back until the watermark has passed them, so that order of arrival doesn't matter: packed, a piece for each hour."""

    def __init__(self, holds: dict[str, int], stale: int):
        self.holds, self.stale = holds, stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)
        self.waiting = handle.getMapState("waiting", "hour long", "samples binary")

    def _held(self, hour: int) -> np.ndarray:
        return np.frombuffer(bytes(self.waiting.getValue((hour,))[0]), _SAMPLE)

    def _file(self, parts: list[np.ndarray]) -> None:
        rows = _once(parts)
        hours = rows["us"] // _HOUR
        cuts = [0, *(np.flatnonzero(np.diff(hours)) + 1).tolist(), len(rows)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                hour, own = int(hours[a]), rows[a:b]
                if self.waiting.containsKey((hour,)):
                    own = _once([self._held(hour), own])
                self.waiting.updateValue((hour,), (own.tobytes(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, first = timerValues.getCurrentWatermarkInMs() * 1000, None
        parts, size = [], 0
        for part in rows:
            some = np.empty(len(part), _SAMPLE)
            for name in _SAMPLE.names:
                some[name] = part[name].to_numpy()
            some = some[some["us"] > passed]
            if not len(some):
                continue
            first = int(some["us"].min()) if first is None else min(first, int(some["us"].min()))
            parts.append(some)
            size += len(some)
            if size >= _ROWS:
                self._file(parts)
                parts, size = [], 0
        self._file(parts)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        state = tuple(self.state.get()) if self.state.exists() else _NONE
        said: list[tuple[str, np.ndarray]] = []
        for hour in sorted(k[0] for k in self.waiting.keys()):
            rows = self._held(hour)
            due = rows[rows["us"] <= now]
            state, told = advance(state, due["us"], due["breach"], self.holds[key[0]], self.stale)
            said += told.items()
            if len(due) == len(rows):
                self.waiting.removeKey((hour,))
            else:
                self.handle.registerTimer(-(-int(rows["us"][len(due)]) // 1000))
                if len(due):
                    self.waiting.updateValue((hour,), (rows[len(due) :].tobytes(),))
                break
            if sum(len(t) for _, t in said) > _TOLD:
                yield self._told(key, said)
                said = []
        if state[0] >= 0 and now - state[2] > self.stale:
            said += [("resolved", np.array([state[2] + self.stale]))] if state[1] else []
            state = _NONE
        if state[0] < 0:
            self.state.clear()
        else:
            self.state.update(state)
            self.handle.registerTimer((state[2] + self.stale) // 1000 + 1)
        if any(len(t) for _, t in said):
            yield self._told(key, said)

    def _told(self, key: tuple, said: list[tuple[str, np.ndarray]]) -> pd.DataFrame:
        us = np.concatenate([t for _, t in said]).astype(np.int64)
        return pd.DataFrame({"rule": key[0], "key": key[1], "us": us, "state": np.repeat([s for s, _ in said], [len(t) for _, t in said])})

    def close(self) -> None:
        pass


def stream_transitions(samples: DataFrame, rules: list[Rule], stale: int, late: str = "1 hour", key: str = "key") -> DataFrame:
    """rule, key, ts, state as they come about by the watermark; samples later than that are left out. Needs the RocksDB state store."""
    rows = evaluated(samples.withWatermark("ts", late), rules, key)
    rows = rows.select("rule", F.col("key").cast("string").alias("key"), "ts", _micros("ts").alias("us"), F.col("value").cast("double").alias("value"), "breach")
    held = {r.name: r.hold * 1_000_000 for r in rules}
    out = rows.groupBy("rule", "key").transformWithStateInPandas(_Alerts(held, stale * 1_000_000), "rule string, key string, us long, state string", "append", "eventTime")
    return out.select("rule", "key", F.timestamp_micros("us").alias("ts"), "state")
