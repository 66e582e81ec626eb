"""The alert lifecycle per inverter with event-time timers.

An inverter counts as silent when event time has moved ``gap_after`` past its last reading. While it stays
silent it is observed as such every ``gap_after``; a reading ends the silence. The changes are the same
however the stream was cut into batches: silence between two readings is observed when the second one
arrives, and silence without an end only up to the instant before which every window has been released,
which is the watermark less the width of a window. Any number of due observations is one addition.

Readings are first reduced to one per inverter and window, map-side: a chatty inverter meets
its state with at most one row per window. A fault that starts and ends inside a window, before that
window's latest reading, is therefore not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wattscope.operators.alerts import GAP, diagnose
from wattscope.operators.metrics import ASSET, RECENCY
from wattscope.settings import FleetSettings

CHANGES = ("plant_id string, inverter_id string, change string, alert_type string, severity string, "
           "message string, first_observed_at timestamp, last_observed_at timestamp, "
           "observation_count bigint, sum_loss_kw double, ended_at timestamp")

_STATE = ("heard_ms bigint, timer_ms bigint, alert_type string, severity string, message string, "
          "first_ms bigint, last_ms bigint, observation_count bigint, sum_loss_kw double, opened boolean")


def windowed_latest(events: DataFrame, width: str) -> DataFrame:
    """The latest reading per inverter and window; appended when the window closes."""
    reading = F.struct("active_power_kw", "irradiance_wm2", "status", "availability", "event_time")
    return (events.groupBy(*ASSET, F.window("event_time", width).alias("span"))
            .agg(F.max_by(reading, F.struct(*RECENCY)).alias("r"))
            .select(*ASSET, "span", "r.*"))


_CHANGE = Row(*(c.split()[0] for c in CHANGES.split(", ")))


class _Lifecycle(StatefulProcessor):
    """Takes and returns rows: with a data frame per inverter, making frames costs more than the lifecycle."""

    def __init__(self, gap_ms: int, sustain_ms: int, width_ms: int) -> None:
        self.gap_ms, self.sustain_ms, self.width_ms = gap_ms, sustain_ms, width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("fault", _STATE)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """An inverter of the registry nobody has heard from yet."""
        self._remember(self._fresh(initialState["since_ms"]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self._recall()
        out: list[Row] = []
        for row in sorted(rows, key=lambda r: r["event_us"]):
            at = row["event_us"] // 1000
            if state is None:
                state = self._fresh(at)
            elif at < state["heard_ms"]:
                # Windows are released in order, so this is a reading before the awaited start.
                out.append(self._change(key, state, "SKIPPED", ended_ms=at))
                continue
            out += self._catch_up(key, state, at - 1)
            kind = row["alert_type"]
            loss = float(row["loss_kw"]) if kind else 0.0
            out += self._observe(key, state, at, kind, row["severity"], row["message"], loss)
            state["heard_ms"] = at
        if state is not None:
            self._remember(state)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self._recall()
        out: list[Row] = []
        if state is not None and state["timer_ms"] == expiredTimerInfo.getExpiryTimeInMs():
            state["timer_ms"] = None
            out = self._catch_up(key, state, timerValues.getCurrentWatermarkInMs() - self.width_ms)
            self._remember(state)
        yield from out

    # -- state ---------------------------------------------------------------

    def _fresh(self, heard_ms: int) -> dict:
        return dict(heard_ms=heard_ms, timer_ms=None, alert_type=None, severity=None, message=None,
                    first_ms=None, last_ms=None, observation_count=0, sum_loss_kw=0.0, opened=False)

    def _recall(self) -> dict | None:
        row = self.memory.get() if self.memory.exists() else None
        return None if row is None else dict(zip([c.split()[0] for c in _STATE.split(", ")], row))

    def _next_silence(self, state: dict) -> int:
        """The next instant at which the inverter is silent if nothing is heard until then."""
        silent = state["alert_type"] == GAP
        return (state["last_ms"] if silent else state["heard_ms"]) + self.gap_ms

    def _remember(self, state: dict) -> None:
        """Store the state and make its one timer the pending one: a window's width after the next
        silent instant, when every reading up to that instant has been released."""
        due = self._next_silence(state) + self.width_ms
        if state["timer_ms"] != due:
            if state["timer_ms"] is not None:
                self.handle.deleteTimer(state["timer_ms"])
            self.handle.registerTimer(due)
            state["timer_ms"] = due
        self.memory.update(tuple(state.values()))

    # -- lifecycle -------------------------------------------------------------

    def _catch_up(self, key, state: dict, until: int) -> list[Row]:
        """Observe the silence at every due instant up to ``until``, all at once."""
        first = self._next_silence(state)
        if first > until:
            return []
        steps = (until - first) // self.gap_ms + 1
        message = f"No telemetry received from inverter {key[1]} at plant {key[0]}"
        changes = self._observe(key, state, first, GAP, "CRITICAL", message, 0.0, refresh=False)
        steps -= 1
        if not state["opened"]:
            missing = -(-(state["first_ms"] + self.sustain_ms - first) // self.gap_ms)
            if missing <= steps:
                state["observation_count"] += missing - 1
                changes += self._observe(key, state, first + missing * self.gap_ms, GAP, "CRITICAL", message, 0.0)
                steps, first = steps - missing, first + missing * self.gap_ms
        state["observation_count"] += steps
        state["last_ms"] = first + steps * self.gap_ms
        return changes

    def _observe(self, key, state: dict, at: int, kind, severity, message, loss: float, refresh: bool = True) -> list[Row]:
        changes = []
        if state["alert_type"] is not None and state["alert_type"] != kind:
            if state["opened"]:
                changes.append(self._change(key, state, "RESOLVED", ended_ms=at))
            state.update(alert_type=None)
        if kind is None:
            return changes
        if state["alert_type"] is None:
            state.update(alert_type=kind, first_ms=at, observation_count=0, sum_loss_kw=0.0, opened=False)
        state.update(severity=severity, message=message, last_ms=at,
                     observation_count=state["observation_count"] + 1,
                     sum_loss_kw=state["sum_loss_kw"] + loss)
        if state["opened"]:
            changes += [self._change(key, state, "REFRESHED")] if refresh else []
        elif at - state["first_ms"] >= self.sustain_ms:
            state["opened"] = True
            changes.append(self._change(key, state, "OPENED"))
        return changes

    @staticmethod
    def _change(key, state: dict, change: str, ended_ms: int | None = None) -> Row:
        def instant(ms):
            return None if ms is None else datetime.fromtimestamp(ms // 1000, timezone.utc).replace(microsecond=ms % 1000 * 1000)

        return _CHANGE(key[0], key[1], change, state["alert_type"], state["severity"], state["message"],
                       instant(state["first_ms"]), instant(state["last_ms"]), state["observation_count"],
                       state["sum_loss_kw"], instant(ended_ms))


def tracked_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The keyed state of a stopped or running ``alert_changes`` as a table: what each inverter's fault is now.

    Read from the stream's own checkpoint, as its last finished batch left it: ``plant_id, inverter_id,
    heard_at`` (the latest reading), and the fault if there is one, with ``opened`` telling whether it is an alert.
    """
    stored = spark.read.format("statestore").option("stateVarName", "fault").load(checkpoint)
    at = lambda c: F.timestamp_millis(F.col(f"value.{c}"))
    fault = F.col("value.alert_type").isNotNull()
    kept = lambda c: F.when(fault, c)
    return stored.select(*(F.col(f"key.{c}").alias(c) for c in ASSET), at("heard_ms").alias("heard_at"), F.col("value.alert_type").alias("alert_type"),
                         kept(F.col("value.severity")).alias("severity"), kept(at("first_ms")).alias("first_observed_at"),
                         kept(at("last_ms")).alias("last_observed_at"), kept(F.col("value.observation_count")).alias("observation_count"),
                         kept(F.col("value.sum_loss_kw")).alias("sum_loss_kw"), kept(F.col("value.opened")).alias("opened"))


def alert_changes(events: DataFrame, inverters: DataFrame, width_seconds: int, gap_after_seconds: int,
                  s: FleetSettings = FleetSettings(), silent_since=None,
                  reading_every_seconds: float | None = None) -> DataFrame:
    """Change log of alerts (CHANGES): OPENED, REFRESHED (by a further reading; silence is counted when it
    ends or opens an alert), RESOLVED, and SKIPPED for a reading older than what is known.

    ``events`` is a watermarked stream, observed once per ``width_seconds``. With ``silent_since`` (an
    instant), every inverter of the registry is awaited from then on, so one that never reports
    is found too. ``reading_every_seconds`` is the longest regular distance between readings (default: the
    sample interval). The latest readings of two windows may lie a window and that distance apart, so a gap
    must be longer, or healthy inverters would be called silent.
    """
    every = s.sample_interval_seconds if reading_every_seconds is None else reading_every_seconds
    if gap_after_seconds <= width_seconds + every:
        raise ValueError(f"gap_after_seconds must exceed the window and the distance of readings, {width_seconds + every:g}")
    registry = inverters.select(*ASSET, "rated_power_kw")
    observed = windowed_latest(events, f"{width_seconds} seconds").join(registry, list(ASSET))
    judged = diagnose(observed, s).select(
        *ASSET, F.unix_micros("event_time").alias("event_us"), "event_time", "alert_type", "severity", "message", "loss_kw")
    initial = None
    if silent_since is not None:
        initial = registry.select(*ASSET, F.unix_millis(F.lit(silent_since).cast("timestamp")).alias("since_ms")).groupBy(*ASSET)
    return judged.groupBy(*ASSET).transformWithState(
        _Lifecycle(gap_after_seconds * 1000, s.sustain_seconds * 1000, width_seconds * 1000), CHANGES,
        outputMode="Append", timeMode="EventTime", initialState=initial)
