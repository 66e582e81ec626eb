"""Alerts of a stretch of history: sustained runs of one fault, priced.

The fleet is observed once per event-time window in which anything was heard. At each
observation an inverter is faulty in one way or healthy; consecutive observations of the same
fault form one incident, silence included. Silence has no rows, so it is read off as the
distance between an inverter's neighbouring observations and costs one row per run, not one
row per inverter and window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattscope.functions import model
from wattscope.operators import alerts
from wattscope.operators.metrics import ASSET, latest_reading
from wattscope.session import materialize
from wattscope.settings import FleetSettings

INCIDENT_COLUMNS = (
    "plant_id", "inverter_id", "alert_type", "severity", "message", "first_observed_at",
    "last_observed_at", "observation_count", "sum_loss_kw", "ended_at",
)


def incident_id(plant: Column, inverter: Column, kind: Column, started_at: Column) -> Column:
    """The same incident gets the same id on every run."""
    return F.sha2(F.concat_ws("|", plant, inverter, kind,
                              F.unix_micros(started_at).cast("string")), 256)


def observation_clock(seen: DataFrame, width_seconds: int) -> DataFrame:
    """The windows that hold events, numbered 1..n, each with its neighbours' instants.

    ``seen`` has ``frame`` and ``event_time``. Columns: ``frame, tick, observed_at,
    previous_at, next_at``. Windows are ordered within their day and the days among
    themselves, so only a row per day meets in one task.
    """
    clock = (seen.groupBy("frame").agg(F.max("event_time").alias("observed_at"))
             .withColumn("day", F.floor(F.col("frame") * width_seconds / 86400)))
    per_day = clock.groupBy("day").agg(
        F.count(F.lit(1)).alias("n"), F.min("observed_at").alias("opens"),
        F.max("observed_at").alias("closes"))
    order = Window.orderBy("day")
    days = per_day.select(
        "day", F.lag("closes").over(order).alias("closed_before"),
        F.lead("opens").over(order).alias("opens_after"),
        F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("before"))
    inside = Window.partitionBy("day").orderBy("frame")
    return (clock.withColumns({
                "place": F.row_number().over(inside),
                "earlier": F.lag("observed_at").over(inside),
                "later": F.lead("observed_at").over(inside)})
            .join(days, "day")
            .select("frame", (F.col("before") + F.col("place")).alias("tick"), "observed_at",
                    F.coalesce("earlier", "closed_before").alias("previous_at"),
                    F.coalesce("later", "opens_after").alias("next_at")))


def sustained_runs(events: DataFrame, inverters: DataFrame, width_seconds: int,
                   s: FleetSettings = FleetSettings()) -> DataFrame:
    """Every maximal run of one fault of one inverter, sustained or not (INCIDENT_COLUMNS).

    The readings are reduced to one per inverter and window in one pass; all that follows
    (the clock, the registry, the runs) works on that reduced set.
    """
    framed = events.select(
        *ASSET, "active_power_kw", "irradiance_wm2", "status", "availability", "event_time",
        "kafka_offset",
        F.floor(F.unix_micros("event_time") / (width_seconds * 1e6)).alias("frame"))
    seen = materialize(latest_reading(framed, (*ASSET, "frame")), "latest-per-frame")
    clock = observation_clock(seen, width_seconds)
    ends = clock.agg(F.struct(F.max("tick").alias("ticks"), F.min("observed_at").alias("first_at"),
                              F.max("observed_at").alias("final_at"))).scalar()
    registry = inverters.select(*ASSET, "rated_power_kw")
    observed = (alerts.diagnose(seen.join(registry, list(ASSET)), s)
                .join(clock, "frame")
                .select(*ASSET, "tick", "observed_at", "previous_at", "next_at", "alert_type",
                        "severity", "message", "loss_kw"))
    # A row before the first tick for every configured inverter: silence from the start, or
    # throughout, is then a distance like any other.
    unknown = F.lit(None)
    origin = registry.select(
        *ASSET, F.lit(0).cast("long").alias("tick"),
        unknown.cast("timestamp").alias("observed_at"), unknown.cast("timestamp").alias("previous_at"),
        ends["first_at"].alias("next_at"),
        *(unknown.cast("string").alias(c) for c in ("alert_type", "severity", "message")),
        unknown.cast("double").alias("loss_kw"))

    line = Window.partitionBy(*ASSET).orderBy("tick")
    continues = (F.lag("alert_type").over(line).eqNullSafe(F.col("alert_type"))
                 & (F.lag("tick").over(line) == F.col("tick") - 1))
    story = observed.unionByName(origin).withColumns({
        "breaks": F.when(continues, 0).otherwise(1),
        "following_tick": F.lead("tick").over(line),
        "following_at": F.lead("observed_at").over(line),
        "before_following": F.lead("previous_at").over(line),
    }).withColumns({
        "run": F.sum("breaks").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "silent_ticks": F.coalesce(F.col("following_tick") - 1, ends["ticks"]) - F.col("tick"),
    })

    # A row tells of its own fault and of the silence after it; each part has the shape of a run.
    own = F.struct(
        F.col("run"), F.col("tick"), F.col("alert_type"), F.col("severity"), F.col("message"),
        F.col("observed_at").alias("from_at"), F.col("observed_at").alias("to_at"),
        F.lit(1).cast("long").alias("n"), F.col("loss_kw"), F.col("next_at").alias("clear_at"))
    silence = F.struct(
        (-F.col("run") - 1).alias("run"), F.col("tick"), F.lit(alerts.GAP).alias("alert_type"),
        F.lit("CRITICAL").alias("severity"),
        alerts.gap_message(F.col("inverter_id"), F.col("plant_id")).alias("message"),
        F.col("next_at").alias("from_at"),
        F.when(F.col("following_tick").isNull(), ends["final_at"])
         .otherwise(F.col("before_following")).alias("to_at"),
        F.col("silent_ticks").alias("n"), F.lit(0.0).alias("loss_kw"),
        F.col("following_at").alias("clear_at"))
    parts = story.select(*ASSET, F.explode(F.array_compact(F.array(
        F.when(F.col("alert_type").isNotNull(), own),
        F.when(F.col("silent_ticks") > 0, silence)))).alias("p")).select(*ASSET, "p.*")
    newest = F.struct("alert_type", "severity", "message", "clear_at")
    # Grouped as the line was partitioned: no further shuffle.
    return (parts.groupBy(*ASSET, "run")
            .agg(F.max_by(newest, "tick").alias("newest"), F.min("from_at").alias("first_observed_at"),
                 F.max("to_at").alias("last_observed_at"), F.sum("n").alias("observation_count"),
                 F.sum("loss_kw").alias("sum_loss_kw"))
            .select(*ASSET, "newest.alert_type", "newest.severity", "newest.message",
                    "first_observed_at", "last_observed_at", "observation_count", "sum_loss_kw",
                    F.col("newest.clear_at").alias("ended_at"))
            .select(*INCIDENT_COLUMNS))


def priced_alerts(runs: DataFrame, daily_reference: DataFrame,
                  s: FleetSettings = FleetSettings()) -> DataFrame:
    """The sustained runs as alerts, with lost energy and (where the day has a rate) its worth.

    The rate is joined when read, so a feed that arrives late still prices its alerts.
    """
    sustained = runs.where(model.elapsed_seconds(
        F.col("first_observed_at"), F.col("last_observed_at")) >= s.sustain_seconds)
    rates = daily_reference.select("plant_id", "simulation_date", "ppa_rate_per_kwh")
    priced = sustained.withColumns({
        "simulation_date": F.to_date("first_observed_at"),
        "estimated_loss_kwh": model.lost_energy_kwh(
            F.col("sum_loss_kw"), F.col("observation_count"),
            F.col("first_observed_at"), F.col("last_observed_at")),
    }).join(rates, ["plant_id", "simulation_date"], "left")
    return priced.select(
        incident_id(F.col("plant_id"), F.col("inverter_id"), F.col("alert_type"),
                    F.col("first_observed_at")).alias("id"),
        "plant_id", "inverter_id", "alert_type", "severity", "message",
        F.col("first_observed_at").alias("started_at"),
        # Never before the start, should an observation clock run backwards.
        F.when(F.col("ended_at").isNotNull(), F.greatest("ended_at", "first_observed_at"))
         .alias("ended_at"),
        F.when(F.col("ended_at").isNull(), F.lit("ACTIVE")).otherwise(F.lit("RESOLVED")).alias("status"),
        "estimated_loss_kwh",
        (F.col("estimated_loss_kwh") * F.col("ppa_rate_per_kwh")).alias("estimated_revenue_loss"))
