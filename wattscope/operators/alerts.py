"""Fault conditions of inverters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattscope import schema
from wattscope.functions import model
from wattscope.settings import FleetSettings

GAP, OFFLINE, WEAK = "TELEMETRY_GAP", "INVERTER_OFFLINE", "UNDERPERFORMANCE"


def gap_message(inverter: Column, plant: Column) -> Column:
    return F.concat(F.lit("No telemetry received from inverter "), inverter,
                    F.lit(" at plant "), plant)


def diagnose(fleet: DataFrame, s: FleetSettings = FleetSettings()) -> DataFrame:
    """Add ``alert_type``, ``severity``, ``message`` and ``loss_kw`` to inverter rows.

    Needs ``rated_power_kw`` and the reading columns; ``event_time`` is NULL for an inverter
    nobody heard from. At most one fault per inverter: silence explains everything else, and
    an inverter that says it is down explains its missing output. NULL type means healthy.
    """
    power, sun = F.col("active_power_kw"), F.col("irradiance_wm2")
    expected = F.col("rated_power_kw") * model.sunlight_share(F.coalesce(sun, F.lit(0.0)), s)
    performance = model.ratio_pct(power, expected)
    kind = (F.when(F.col("event_time").isNull(), F.lit(GAP))
            .when((F.col("status") == "OFFLINE") | (F.col("availability") == 0), F.lit(OFFLINE))
            .when((sun >= s.min_irradiance_wm2) & (performance < s.underperformance_pct), F.lit(WEAK)))
    subject = F.concat(F.lit("Inverter "), F.col("inverter_id"), F.lit(" at plant "), F.col("plant_id"))
    weak_text = F.concat(subject, F.lit(" generating "), model.rounded(performance, 1).cast("string"),
                         F.lit("% of expected under current irradiance"))
    return (fleet.withColumn("alert_type", kind)
            .withColumns({
                "severity": F.when(F.col("alert_type") == WEAK, F.lit("WARNING"))
                             .when(F.col("alert_type").isNotNull(), F.lit("CRITICAL")),
                # Nobody knows what a silent inverter loses, so nothing is claimed.
                "loss_kw": F.when(F.col("alert_type") == GAP, F.lit(0.0))
                            .when(F.col("alert_type").isNotNull(), F.greatest(
                                expected - F.coalesce(power, F.lit(0.0)), F.lit(0.0))),
                "message": F.when(F.col("alert_type") == GAP,
                                  gap_message(F.col("inverter_id"), F.col("plant_id")))
                            .when(F.col("alert_type") == OFFLINE,
                                  F.concat(subject, F.lit(" reported OFFLINE")))
                            .when(F.col("alert_type") == WEAK, weak_text),
            }))


def conditions(latest: DataFrame, inverters: DataFrame, observed_at: Column,
               s: FleetSettings = FleetSettings()) -> DataFrame:
    """The faults of the configured fleet at one observation instant.

    ``latest`` has one row per reporting inverter. The registry drives the join: absence is
    only visible from there. Both sides are at most one row per inverter.
    """
    seen = latest.select("plant_id", "inverter_id", "active_power_kw", "irradiance_wm2",
                         "status", "availability", "event_time")
    fleet = (inverters.select("plant_id", "inverter_id", "rated_power_kw")
             .join(seen, ["plant_id", "inverter_id"], "left"))
    return (diagnose(fleet, s).where("alert_type is not null")
            .withColumn("observed_at", observed_at)
            .select(*schema.CONDITION_COLUMNS))


def observation_clock(events: DataFrame) -> Column:
    """The instant a frame speaks for, as a scalar subquery: its latest event time."""
    return events.agg(F.max("event_time")).scalar()
