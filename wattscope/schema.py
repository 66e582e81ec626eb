"""Declared contracts. Nothing in this package infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values of the telemetry contract -----------------------------------
STATUSES = ("ONLINE", "OFFLINE", "WARNING")
SCENARIOS = ("INV_UNDERPERFORMANCE", "INV_OFFLINE", "TELEMETRY_GAP", "RECOVERY")
MAX_IRRADIANCE_WM2 = 1500.0

TELEMETRY = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("plant_id", T.StringType()),
    T.StructField("inverter_id", T.StringType()),
    T.StructField("active_power_kw", T.DoubleType()),
    T.StructField("energy_today_kwh", T.DoubleType()),
    T.StructField("irradiance_wm2", T.DoubleType()),
    T.StructField("module_temp_c", T.DoubleType()),
    T.StructField("inverter_temp_c", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("availability", T.DoubleType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("simulator_scenario", T.StringType()),
])

# The shape a Kafka source delivers; file stand-ins use it too.
RAW_RECORD = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])

# --- fixed values: columns of the archive, the metrics, the alerts, the feed, the summary and the portfolio file
ARCHIVE_COLUMNS = (
    "event_id", "plant_id", "inverter_id", "active_power_kw", "energy_today_kwh",
    "irradiance_wm2", "module_temp_c", "inverter_temp_c", "status", "availability",
    "event_time", "simulator_scenario", "kafka_topic", "kafka_partition",
    "kafka_offset", "simulation_date",
)
ARCHIVE_PARTITIONS = ("simulation_date", "plant_id")

PLANT_METRIC_COLUMNS = (
    "plant_id", "window_start", "window_end", "current_power_kw", "avg_power_kw",
    "expected_power_kw", "avg_irradiance_wm2", "availability_pct", "performance_pct",
    "estimated_loss_kw", "online_inverters", "offline_inverters",
)
PORTFOLIO_METRIC_COLUMNS = (
    "window_start", "window_end", "current_power_kw", "avg_power_kw", "expected_power_kw",
    "online_inverters", "offline_inverters", "availability_pct", "performance_pct",
    "estimated_loss_kw",
)
CONDITION_COLUMNS = (
    "plant_id", "inverter_id", "alert_type", "severity", "message", "loss_kw", "observed_at",
)

FEED_COLUMNS = (
    "simulation_date", "plant_id", "plant_capacity_kw", "expected_generation_kwh",
    "expected_peak_power_kw", "forecast_irradiance_kwh_m2", "ppa_rate_per_kwh",
    "maintenance_flag", "source_version",
)
FEED_NUMBERS = (
    "plant_capacity_kw", "expected_generation_kwh", "expected_peak_power_kw",
    "forecast_irradiance_kwh_m2", "ppa_rate_per_kwh",
)

SUMMARY_COLUMNS = (
    "simulation_date", "plant_id", "actual_generation_kwh", "expected_generation_kwh",
    "performance_pct", "availability_pct", "downtime_minutes", "estimated_lost_energy_kwh",
    "ppa_rate_per_kwh", "estimated_actual_revenue", "estimated_lost_revenue",
    "alert_count", "maintenance_flag",
)

PORTFOLIO_FILE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("capacity_kw", T.DoubleType()),
    T.StructField("timezone", T.StringType()),
    T.StructField("ppa_rate_per_kwh", T.DoubleType()),
    T.StructField("inverters", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("rated_power_kw", T.DoubleType()),
    ]))),
])
