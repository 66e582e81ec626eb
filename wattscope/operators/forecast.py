"""The expectation feed, from what was measured: a plant's usual day under its own sun.

The mean irradiance and module temperature of each hour of the day make a plant's profile; its rating under
that profile is the generation to expect. An hour of which a plant has no reading takes the fleet's mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattscope import schema
from wattscope.functions import model

DEFAULT_RATE = 0.085
FULL_SUN_WM2 = 1000.0


def hourly_profile(events: DataFrame) -> DataFrame:
    """``plant_id, hour, irradiance_wm2, module_temp_c``: means over all days, and per hour alone (plant NULL)."""
    return (events.withColumn("hour", F.hour("event_time")).rollup("hour", "plant_id")
            .agg(F.avg("irradiance_wm2").alias("irradiance_wm2"), F.avg("module_temp_c").alias("module_temp_c"),
                 F.grouping("plant_id").alias("fleet"), F.grouping("hour").alias("all")).where("all = 0 and hour is not null").drop("all"))


def forecast_feed(events: DataFrame, plants: DataFrame, inverters: DataFrame, dates: Column, source_version: str = "v1") -> DataFrame:
    """One feed row per plant with inverters and date in ``dates`` (an array column).

    Readings are reduced to a row per plant and hour before anything else; dates multiply the finished rows.
    """
    profile = hourly_profile(events)
    # At most 24 hours.
    fleet = profile.where("fleet = 1").agg(F.collect_list(F.struct(
        "hour", F.col("irradiance_wm2").alias("sun"), F.col("module_temp_c").alias("heat")))).scalar()
    own = profile.where("fleet = 0").select(F.col("plant_id").alias("of"), F.col("hour").alias("at"), "irradiance_wm2", "module_temp_c")
    rated = inverters.groupBy("plant_id").agg(F.sum("rated_power_kw").alias("rated_kw"))
    sites = plants.join(rated, "plant_id")
    if "ppa_rate_per_kwh" not in sites.columns:
        sites = sites.withColumn("ppa_rate_per_kwh", F.lit(None).cast("double"))
    hours = sites.select("plant_id", "capacity_kw", "rated_kw", "ppa_rate_per_kwh", F.inline(fleet))
    met = hours.join(own, (F.col("plant_id") == F.col("of")) & (F.col("hour") == F.col("at")), "left").withColumns({
        "sun": F.coalesce("irradiance_wm2", "sun"), "heat": F.coalesce("module_temp_c", "heat", F.lit(0.0))})
    power = F.col("rated_kw") * F.least(F.col("sun") / FULL_SUN_WM2, F.lit(1.0)) * model.heat_factor(F.col("heat"))
    whole = met.groupBy("plant_id", "capacity_kw", "ppa_rate_per_kwh").agg(
        F.sum(power).alias("generation"), F.max(power).alias("peak"), (F.sum("sun") / 1000.0).alias("sun"))
    return whole.select(
        F.explode(dates).alias("simulation_date"), "plant_id",
        F.round("capacity_kw", 3).alias("plant_capacity_kw"),
        F.round("generation", 3).alias("expected_generation_kwh"),
        F.round("peak", 3).alias("expected_peak_power_kw"),
        F.round("sun", 4).alias("forecast_irradiance_kwh_m2"),
        F.round(F.coalesce("ppa_rate_per_kwh", F.lit(DEFAULT_RATE)), 4).alias("ppa_rate_per_kwh"),
        F.lit(False).alias("maintenance_flag"),
        F.lit(source_version).alias("source_version")).select(*schema.FEED_COLUMNS)
