"""Metered energy of a day from a cumulative counter that may restart.

A reading adds its rise over the previous one; the first reading of the day and a reading
lower than the one before it (the counter restarted) add themselves in full.

"The previous reading" is a sequence over one inverter-day, which may be far too large for
one task. The day is therefore cut into slices of event time. Inside a slice the sequence is
local; across slices only each slice's first and last reading matter, one row per slice.
Results are the same for every slice width.

Readings are scanned and moved once, to their slice. What crosses slices is taken from the same
exchange: both branches of a plan need the same columns of it, so Spark runs it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattscope.functions import model
from wattscope.settings import FleetSettings

METER = ("simulation_date", "plant_id", "inverter_id")
_SLICE = (*METER, "slice")
_ORDER = ("event_time", "kafka_offset")


def _sliced(events: DataFrame, seconds: int) -> DataFrame:
    if "simulation_date" not in events.columns:
        events = events.withColumn("simulation_date", F.to_date("event_time"))
    return events.withColumn("slice", F.floor(F.unix_micros("event_time") / (seconds * 1e6)))


def _rise(reading: Column, previous: Column) -> Column:
    return F.when(reading >= previous, reading - previous).otherwise(reading)


def energy_increments(events: DataFrame, s: FleetSettings = FleetSettings()) -> DataFrame:
    """Every reading with ``energy_increment_kwh``, what it adds to its inverter's day."""
    cut = _sliced(events, s.slice_seconds)
    local = Window.partitionBy(*_SLICE).orderBy(*_ORDER)
    read = cut.withColumns({"before_kwh": F.lag("energy_today_kwh").over(local), "place": F.row_number().over(local),
                            "is_last": F.lead(F.lit(True)).over(local).isNull()})
    # The first reading of a slice follows the last one of the slice before it; a slice has one row of each.
    ends = read.where("place = 1 or is_last").withColumn("before_kwh", F.lag("energy_today_kwh").over(
        Window.partitionBy(*METER).orderBy(*_ORDER))).where("place = 1")
    return (read.where("place > 1").unionByName(ends)
            .withColumn("energy_increment_kwh", _rise(F.col("energy_today_kwh"), F.col("before_kwh")))
            .select(*events.columns, *({"simulation_date"} - set(events.columns)),
                    "energy_increment_kwh"))


def inverter_actuals(events: DataFrame, s: FleetSettings = FleetSettings()) -> DataFrame:
    """Energy and observation counts per inverter and day, from one pass over the readings.

    One shuffle of the readings (by slice), then one of slice rows.
    """
    cut = _sliced(events, s.slice_seconds).select(
        *_SLICE, *_ORDER, "energy_today_kwh", "status")
    local = Window.partitionBy(*_SLICE).orderBy(*_ORDER)
    energy, before = F.col("energy_today_kwh"), F.col("before_kwh")
    read = cut.withColumns({
        "before_kwh": F.lag("energy_today_kwh").over(local),
        "is_first": F.row_number().over(local) == 1,
        "is_last": F.lead(F.lit(True)).over(local).isNull(),
    })
    slices = read.groupBy(*_SLICE).agg(
        F.sum(F.when(~F.col("is_first"), _rise(energy, before))).alias("inner_kwh"),
        F.max(F.when(F.col("is_first"), energy)).alias("opening_kwh"),
        F.max(F.when(F.col("is_last"), energy)).alias("closing_kwh"),
        F.count(F.lit(1)).alias("observation_count"),
        F.count_if(F.col("status") == "ONLINE").alias("online_observations"),
        F.count_if(F.col("status") == "OFFLINE").alias("offline_observations"))
    carried = F.lag("closing_kwh").over(Window.partitionBy(*METER).orderBy("slice"))
    return (slices
            .withColumn("slice_kwh", F.coalesce("inner_kwh", F.lit(0.0))
                        + F.coalesce(_rise(F.col("opening_kwh"), carried), F.lit(0.0)))
            .groupBy(*METER)
            .agg(F.sum("slice_kwh").alias("actual_generation_kwh"),
                 *(F.sum(c).alias(c) for c in
                   ("observation_count", "online_observations", "offline_observations"))))


def plant_actuals(events: DataFrame, s: FleetSettings = FleetSettings()) -> DataFrame:
    """Generation, availability and downtime per plant and day.

    Availability is the ONLINE share of what arrived (a WARNING is not ONLINE here). Downtime
    is OFFLINE samples times the sampling interval.
    """
    minutes = s.sample_interval_seconds / 60.0
    return (inverter_actuals(events, s)
            .groupBy("simulation_date", "plant_id")
            .agg(F.sum("actual_generation_kwh").alias("actual_generation_kwh"),
                 F.sum("observation_count").alias("observation_count"),
                 F.count(F.lit(1)).alias("reporting_inverters"),
                 F.sum("online_observations").alias("online"),
                 F.sum("offline_observations").alias("offline"))
            .select("simulation_date", "plant_id", "actual_generation_kwh",
                    model.ratio_pct(F.col("online"), F.col("observation_count"))
                         .alias("availability_pct"),
                    (F.col("offline") * minutes).alias("downtime_minutes"),
                    "observation_count", "reporting_inverters"))


def running_meter(events: DataFrame, hours_per_reading: float,
                  s: FleetSettings = FleetSettings()) -> DataFrame:
    """Every reading with ``meter_kwh``: its inverter's power integrated since midnight."""
    cut = _sliced(events, s.slice_seconds).withColumn(
        "step_kwh", F.col("active_power_kw") * hours_per_reading)
    for c in _SLICE:
        cut = cut.where(F.col(c).isNotNull())
    # A row travels whole: else the totals would ask for fewer columns, which is another exchange. Readings
    # without a key have no meter; said here, the join needs no filter of its own on one side of it.
    moved = cut.select(*_SLICE, F.array(F.struct(*cut.columns)).alias("whole")).repartition(*_SLICE)
    step = lambda c: F.aggregate(c, F.lit(None).cast("double"), lambda _, r: r["step_kwh"])
    earlier = Window.partitionBy(*METER).orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1)
    opening = (moved.groupBy(*_SLICE).agg(F.sum(step("whole")).alias("total_kwh"))
               .withColumn("opening_kwh", F.coalesce(F.sum("total_kwh").over(earlier), F.lit(0.0)))
               .drop("total_kwh"))
    local = (Window.partitionBy(*_SLICE).orderBy(*(F.col("whole")[0][c] for c in _ORDER))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rest = [c for c in (*events.columns, *({"simulation_date"} - set(events.columns))) if c not in _SLICE]
    return (moved.withColumn("local_kwh", F.sum(step("whole")).over(local))
            .join(opening, list(_SLICE))
            .select(*METER, *(F.col("whole")[0][c].alias(c) for c in rest),
                    (F.col("opening_kwh") + F.col("local_kwh")).alias("meter_kwh"))
            .select(*events.columns, *({"simulation_date"} - set(events.columns)), "meter_kwh"))


def archive_presence(events: DataFrame) -> DataFrame:
    """Events and plants per archived day."""
    per_plant = events.groupBy("simulation_date", "plant_id").agg(F.count(F.lit(1)).alias("n"))
    return per_plant.groupBy("simulation_date").agg(
        F.sum("n").alias("events"), F.count(F.lit(1)).alias("plants"))
