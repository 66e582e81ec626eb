"""Live plant and portfolio metrics.

Current power is the sum of each inverter's latest reading; average power is the mean over
instants of the plant's total. On a table these are two reductions of the input that meet as
one row per plant. A stream cannot join two of its own aggregations; it keeps both as pane state: for
every pane of event time a row per inverter with its latest reading and a row per instant with the power
at it. Two states of a key merge into one (the later reading, the sum of powers), so tumbling and
sliding windows are folds of the same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattscope import schema
from wattscope.functions import model
from wattscope.operators.pick import first_per_key
from wattscope.settings import FleetSettings

ASSET = ("plant_id", "inverter_id")
RECENCY = ("event_time", "kafka_offset")


def latest_reading(events: DataFrame, keys: tuple[str, ...] = ASSET) -> DataFrame:
    """The most recent row per key; equal times are decided by the offset."""
    if not events.isStreaming:
        return first_per_key(events, keys, [F.desc(c) for c in RECENCY])
    rest = [c for c in events.columns if c not in keys]
    picked = events.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*RECENCY)).alias("row"))
    return picked.select(*(F.col(c) if c in keys else F.col(f"row.{c}").alias(c)
                           for c in events.columns))


def power_timeline(events: DataFrame) -> DataFrame:
    """Plant output at every observed instant."""
    return (events.groupBy("plant_id", "event_time")
            .agg(F.sum("active_power_kw").alias("plant_power_kw")))


_READING = ("active_power_kw", "irradiance_wm2", "status", "availability")


def _fleet_measures(prefix: str = "") -> list[Column]:
    """Figures of a plant from the latest readings of its inverters."""
    power, sun, status, up = (F.col(prefix + c) for c in _READING)
    return [F.sum(power).alias("current_power_kw"),
            F.avg(sun).alias("avg_irradiance_wm2"),
            F.count_if((status != "OFFLINE") & (up > 0)).alias("online_inverters"),
            F.count("inverter_id").alias("reporting_inverters")]


def _instant_measures(instant: str, power: str) -> list[Column]:
    """Bounds and time average; the bounds of a plant's events are those of its instants."""
    return [F.min(instant).alias("first_event_at"), F.max(instant).alias("last_event_at"),
            F.avg(power).alias("avg_power_kw")]


def pane_state(events: DataFrame, *pane: str) -> DataFrame:
    """``plant_id``, the columns ``pane``, ``inverter_id | instant``, ``last``, ``recency``, ``power``.

    A row is about an inverter (its latest reading) or about an instant (the power at it). Rows are as
    many as inverters and instants of a pane, however many events there were, and tasks reduce theirs first.
    """
    reading, recency = F.struct(*_READING), F.struct(*RECENCY)
    per_inverter = F.struct(
        F.col("inverter_id"), F.lit(None).cast("timestamp").alias("instant"),
        F.lit(None).cast("double").alias("power"), reading.alias("reading"),
        recency.alias("recency"))
    # Power is all that counts at an instant.
    per_instant = F.struct(
        F.lit(None).cast("string").alias("inverter_id"), F.col("event_time").alias("instant"),
        F.col("active_power_kw").alias("power"),
        F.when(F.lit(False), reading).alias("reading"), F.when(F.lit(False), recency).alias("recency"))
    return (events
            .select("plant_id", *pane, F.explode(F.array(per_inverter, per_instant)).alias("f"))
            .groupBy("plant_id", *pane, F.col("f.inverter_id").alias("inverter_id"),
                     F.col("f.instant").alias("instant"))
            .agg(F.max_by("f.reading", "f.recency").alias("last"), F.max("f.recency").alias("recency"),
                 F.sum("f.power").alias("power")))


def merge_panes(panes: DataFrame, *by: str) -> DataFrame:
    """Pane states that fall together under ``by`` as one state."""
    return panes.groupBy("plant_id", *by, "inverter_id", "instant").agg(
        F.max_by("last", "recency").alias("last"), F.max("recency").alias("recency"), F.sum("power").alias("power"))


def _folded(state: DataFrame, *by: str) -> DataFrame:
    """Per plant (and ``by``): latest state, bounds and time-averaged power."""
    return state.groupBy("plant_id", *by).agg(*_fleet_measures("last."), *_instant_measures("instant", "power"))


def _streamed_state(events: DataFrame, width: str, slide: str | None) -> DataFrame:
    """Per plant and ``span``. Overlapping windows multiply panes of one step, not events, where windows
    consist of whole steps; else every window is a pane of its own."""
    if slide and _is_multiple(events, width, slide):
        panes = pane_state(events.withColumn("pane", F.window("event_time", slide)), "pane")
        state = merge_panes(panes.withColumn("span", F.window("pane", width, slide)), "span")
    else:
        state = pane_state(events.withColumn("span", F.window("event_time", width, slide)), "span")
    return _folded(state, "span")


def _table_state(events: DataFrame, span: Column | None = None,
                 pane: Column | None = None) -> DataFrame:
    """Per plant (and per ``span``): latest state, bounds and time-averaged power.

    For tables: the two reductions read the input each for themselves, and reduce it in the task without
    sorting it twice over, as one pass for both would have to. Overlapping windows multiply rows. Both reductions therefore come first as far as they
    can: readings to one per inverter and ``pane`` (the piece of time that lies in the same
    windows throughout), power to one sum per instant. Only then are rows spread over windows.
    """
    def spread(df: DataFrame) -> DataFrame:
        return df if span is None else df.withColumn("span", span)

    by = ["plant_id"] if span is None else ["plant_id", "span"]
    readings = events.select(*ASSET, *_READING, *RECENCY)
    if pane is not None:
        readings = latest_reading(readings.withColumn("pane", pane), (*ASSET, "pane")).drop("pane")
    current = (latest_reading(spread(readings), ("inverter_id", *by))
               .groupBy(*by).agg(*_fleet_measures()))
    timeline = spread(power_timeline(events))
    return current.join(timeline.groupBy(*by).agg(
        *_instant_measures("event_time", "plant_power_kw")), by)


def _judge_plants(state: DataFrame, s: FleetSettings) -> DataFrame:
    """Expectation, performance, loss and availability of plant rows joined to the registry.

    Availability is measured against the configured fleet, so a silent inverter counts as
    offline; without a registry row the reporting inverters stand in.
    """
    fleet = F.coalesce("configured_inverters", "reporting_inverters")
    return (state
            .withColumn("expected_power_kw",
                        model.expected_power(F.col("capacity_kw"), F.col("avg_irradiance_wm2"), s))
            .withColumns({
                "performance_pct": model.ratio_pct(F.col("current_power_kw"),
                                                   F.col("expected_power_kw")),
                "estimated_loss_kw": model.shortfall(F.col("expected_power_kw"),
                                                     F.col("current_power_kw")),
                "offline_inverters": F.greatest(fleet - F.col("online_inverters"), F.lit(0)),
                "availability_pct": model.ratio_pct(F.col("online_inverters"), fleet),
            }))


def plant_metrics(events: DataFrame, plant_reference: DataFrame,
                  s: FleetSettings = FleetSettings(), include_silent: bool = False) -> DataFrame:
    """One row per plant for the whole frame (a microbatch, a day, a table).

    ``include_silent`` starts from the registry instead of from the events, so that a plant
    nobody heard from appears with zero output and everything offline.
    """
    state = _folded(pane_state(events)) if events.isStreaming else _table_state(events)
    joined = state.join(plant_reference, "plant_id", "full_outer" if include_silent else "left")
    if include_silent:
        joined = joined.fillna(0.0, ["current_power_kw", "avg_power_kw"]).fillna(
            0, ["online_inverters", "reporting_inverters"])
    return (_judge_plants(joined, s)
            .withColumnsRenamed({"first_event_at": "window_start", "last_event_at": "window_end"})
            .select(*schema.PLANT_METRIC_COLUMNS))


def _is_multiple(df: DataFrame, width: str, slide: str) -> bool:
    w, s = df.sparkSession.sql(
        f"SELECT unix_micros(timestamp_micros(0) + INTERVAL '{width}'), "
        f"unix_micros(timestamp_micros(0) + INTERVAL '{slide}')").first()
    return w % s == 0


def windowed_plant_metrics(events: DataFrame, plant_reference: DataFrame,
                           s: FleetSettings = FleetSettings(), width: str | None = None,
                           slide: str | None = None) -> DataFrame:
    """One row per plant and event-time window (tumbling unless ``slide`` is given).

    The row's identity is the window, so it does not depend on how the stream was cut into
    microbatches. Works on tables and on streams (chained aggregations, append mode).
    """
    width = width or s.window_width
    if events.isStreaming:
        state = _streamed_state(events, width, slide)
    else:
        # A pane of one step serves only where windows consist of whole steps.
        pane = F.window("event_time", slide) if slide and _is_multiple(events, width, slide) else None
        state = _table_state(events, F.window("event_time", width, slide), pane)
    judged = _judge_plants(state.join(plant_reference, "plant_id", "left"), s)
    return (judged
            .withColumns({"window_start": F.col("span.start"), "window_end": F.col("span.end")})
            .select(*schema.PLANT_METRIC_COLUMNS))


def portfolio_metrics(plants: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Plant rows folded into one row (or one per ``by``, e.g. the window columns).

    Performance is a ratio of sums. A plant without an expectation (night) leaves both sides
    of it. ``by`` must be ``window_start, window_end`` or empty.
    """
    lit_plants = F.col("expected_power_kw").isNotNull()
    bounds = [] if by else [F.min("window_start").alias("window_start"),
                            F.max("window_end").alias("window_end")]
    online, offline = F.col("online_inverters"), F.col("offline_inverters")
    return (plants.groupBy(*by).agg(
                *bounds,
                *(F.sum(c).alias(c) for c in (
                    "current_power_kw", "avg_power_kw", "expected_power_kw", "estimated_loss_kw",
                    "online_inverters", "offline_inverters")),
                F.sum(F.when(lit_plants, F.col("current_power_kw"))).alias("comparable_kw"))
            .withColumns({
                "performance_pct": model.ratio_pct(F.col("comparable_kw"), F.col("expected_power_kw")),
                "availability_pct": model.ratio_pct(online, online + offline),
            })
            .select(*schema.PORTFOLIO_METRIC_COLUMNS))


def recent_power(portfolio: DataFrame, points: int = 120) -> DataFrame:
    """The last ``points`` distinct portfolio windows, oldest first (a live chart's buffer)."""
    return (portfolio.where("window_end is not null and current_power_kw is not null")
            .groupBy("window_end")
            .agg(F.max("current_power_kw").alias("current_power_kw"),
                 F.max("expected_power_kw").alias("expected_power_kw"))
            .orderBy(F.desc("window_end")).limit(points)
            .orderBy("window_end"))
