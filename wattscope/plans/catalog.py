"""Every operator as a query over the given tables.

Each entry takes ``(spark, sf_dir)``. Results are made comparable across engines in one
place: doubles rounded to six places, dates as text, instants without zone.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattscope.functions import model
from wattscope.operators import (
    alerts, contract, energy, feed, forecast, incidents, lifecycle, metrics, monitor, quality,
    reconcile, registry, scenarios, serving, telemetry, upsert,
)
from wattscope.plans import testbed as bed
from wattscope.plans.stream_catalog import STREAMS
from wattscope.session import new_folder, prepare
from wattscope.settings import FleetSettings
from wattscope.sources.portfolio_json import read_portfolio
from wattscope.sources.report_csv import export_report

Query = Callable[[SparkSession, str], DataFrame]

S = FleetSettings()
FRAME_HOURS = 6
FRAME = f"{FRAME_HOURS} hours"
OBSERVE_SECONDS = 86400
HOURS_PER_READING = 0.24
_AS_OF = datetime(2024, 1, 30, 23, 59, 0)


def _tidy(df: DataFrame) -> DataFrame:
    def column(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        return c.alias(f.name)

    return df.select(*(column(f) for f in df.schema))


def _as_of() -> Column:
    return F.lit(_AS_OF)


# --- speed layer ---------------------------------------------------------------

def _judged(spark, d):
    return telemetry.judge(telemetry.parse(bed.raw_records(spark, d)))


def _plant_ref(spark, d):
    return registry.plant_reference(bed.plants(spark, d), bed.inverters(spark, d))


def _inverter_ref(spark, d):
    return registry.inverter_reference(bed.inverters(spark, d))


def parse_validate_reasons(spark, d):
    return _judged(spark, d).select("kafka_offset", "event_id", "event_time", "payload_parsed",
                                    "rejection_reason")


_EVENT = ("event_id", "plant_id", "inverter_id", "active_power_kw", "energy_today_kwh",
          "irradiance_wm2", "status", "availability", "event_time", "kafka_offset")


def normalize(spark, d):
    return telemetry.normalize(telemetry.accepted(_judged(spark, d))).select(*_EVENT)


def valid_events(spark, d):
    return telemetry.trusted(telemetry.parse(bed.raw_records(spark, d))).select(*_EVENT)


def dedup_events(spark, d):
    parsed = telemetry.parse(bed.raw_records(spark, d)).where("event_id is not null")
    return telemetry.deduplicate(parsed).select("event_id", "kafka_offset", "active_power_kw")


def quarantine_records(spark, d):
    out = telemetry.quarantine_records(_judged(spark, d), rejected_at=F.col("kafka_timestamp"))
    doc = F.from_json("value", "rejection_reason string, event_id string, plant_id string, "
                               "inverter_id string, event_timestamp_raw string, source_topic string, "
                               "source_partition int, source_offset bigint, raw_payload string")
    return out.select("key", doc.alias("doc"),
                      F.size(F.json_object_keys("value")).alias("fields")).select(
        "key", "fields", "doc.rejection_reason", "doc.event_id", "doc.plant_id", "doc.inverter_id",
        "doc.source_topic", "doc.source_partition", "doc.source_offset",
        F.col("doc.raw_payload").isNull().alias("payload_missing"))


def quarantine_counts(spark, d):
    return (telemetry.rejected(_judged(spark, d)).groupBy("rejection_reason")
            .agg(F.count(F.lit(1)).alias("records")))


def quarantine_rate(spark, d):
    hit = telemetry.rejected(_judged(spark, d))
    return monitor.quarantine_rate(hit, at="kafka_timestamp", span="1 hour")


def producer_contract(spark, d):
    parsed = telemetry.parse(bed.raw_records(spark, d, strict=True))
    checked = contract.producer_reason(parsed, bed.inverters(spark, d))
    return checked.select("kafka_offset", "source_reason",
                          F.array_join(F.array_sort("violations"), ",").alias("violations"))


def archive_rows(spark, d):
    return (telemetry.archive_rows(telemetry.trusted(telemetry.parse(bed.raw_records(spark, d))))
            .select("simulation_date", "plant_id", "event_id", "inverter_id", "energy_today_kwh",
                    "module_temp_c", "kafka_partition", "kafka_offset"))


def latest_reading(spark, d):
    return metrics.latest_reading(bed.telemetry(spark, d)).select(*_EVENT)


def plant_timeline(spark, d):
    return metrics.power_timeline(bed.telemetry(spark, d))


def plant_metrics(spark, d):
    return metrics.plant_metrics(bed.telemetry(spark, d), _plant_ref(spark, d), S)


def plant_metrics_with_silent(spark, d):
    return metrics.plant_metrics(bed.telemetry(spark, d), _plant_ref(spark, d), S, include_silent=True)


def _windowed(spark, d, slide=None):
    return metrics.windowed_plant_metrics(bed.telemetry(spark, d), _plant_ref(spark, d), S, FRAME, slide)


def windowed_plant_metrics(spark, d):
    return _windowed(spark, d)


def sliding_plant_metrics(spark, d):
    return _windowed(spark, d, slide="3 hours")


def portfolio_metrics(spark, d):
    return metrics.portfolio_metrics(plant_metrics(spark, d))


def _portfolio_windows(spark, d):
    return metrics.portfolio_metrics(_windowed(spark, d), by=("window_start", "window_end"))


def windowed_portfolio_metrics(spark, d):
    return _portfolio_windows(spark, d)


def last_n_windows(spark, d):
    return metrics.recent_power(_portfolio_windows(spark, d), 50)


# --- faults and alerts ---------------------------------------------------------

def alert_conditions(spark, d):
    t = bed.telemetry(spark, d)
    return alerts.conditions(metrics.latest_reading(t), _inverter_ref(spark, d),
                             alerts.observation_clock(t), S)


def _runs(spark, d):
    return incidents.sustained_runs(bed.telemetry(spark, d), _inverter_ref(spark, d),
                                    OBSERVE_SECONDS, S)


def _alerts(spark, d):
    return incidents.priced_alerts(_runs(spark, d), bed.daily_reference(spark, d), S)


def alert_runs(spark, d):
    return _runs(spark, d)


def alert_incidents(spark, d):
    return _alerts(spark, d)


def alert_counts(spark, d):
    return reconcile.alert_counts(_alerts(spark, d))


def active_alert_count(spark, d):
    return monitor.active_alerts(_alerts(spark, d))


def alerts_listing(spark, d):
    return serving.alerts_listing(_alerts(spark, d), status="resolved", severity="WARNING", limit=200)


def lifecycle_step(spark, d):
    """Faults tracked up to the middle of the month, then one observation at the end of it."""
    t, registry_rows = bed.telemetry(spark, d), _inverter_ref(spark, d)
    half = t.where("dayofmonth(event_time) <= 15")
    before = lifecycle.still_tracked(lifecycle.step(
        spark.createDataFrame([], lifecycle.TRACKED_SCHEMA),
        alerts.conditions(metrics.latest_reading(half), registry_rows, alerts.observation_clock(half), S),
        alerts.observation_clock(half)))
    now = alerts.observation_clock(t)
    return lifecycle.step(before, alerts.conditions(metrics.latest_reading(t), registry_rows, now, S), now)


# --- batch layer ---------------------------------------------------------------

def energy_increments(spark, d):
    return energy.energy_increments(bed.telemetry(spark, d), S).select(
        "event_id", "plant_id", "inverter_id", "event_time", "energy_today_kwh", "energy_increment_kwh")


def inverter_actuals(spark, d):
    return energy.inverter_actuals(bed.telemetry(spark, d), S)


def _actuals(spark, d):
    return energy.plant_actuals(bed.telemetry(spark, d), S)


def plant_actuals(spark, d):
    return _actuals(spark, d)


def running_meter(spark, d):
    return energy.running_meter(bed.telemetry(spark, d), HOURS_PER_READING, S).select(
        "event_id", "inverter_id", "simulation_date", "event_time", "meter_kwh")


def archive_presence(spark, d):
    return energy.archive_presence(bed.telemetry(spark, d))


def _assessed(spark, d):
    return feed.assess(bed.feed_text(spark, d))


def reference_problems(spark, d):
    active = bed.plants(spark, d).where("active")
    return feed.feed_problems(_assessed(spark, d), active)


def reference_rows(spark, d):
    a = _assessed(spark, d)
    # Only faults inside the file count here; coverage is judged in reference_problems.
    bad = feed.row_problems(a).unionByName(feed.date_problems(a))
    return feed.sound_rows(a, bad)


def _reconciled(spark, d):
    return reconcile.reconcile(bed.daily_reference(spark, d), _actuals(spark, d),
                               reconcile.alert_counts(_alerts(spark, d)))


def reconcile_summary(spark, d):
    return reconcile.summary_rows(_reconciled(spark, d))


def reconcile_published(spark, d):
    return reconcile.publishable(_reconciled(spark, d))


def reconcile_problems(spark, d):
    return reconcile.remarks(_reconciled(spark, d), "problems")


def reconcile_warnings(spark, d):
    return reconcile.remarks(_reconciled(spark, d), "warnings")


def _summary(spark, d):
    return reconcile.summary_rows(reconcile.reconcile(bed.daily_reference(spark, d), _actuals(spark, d)))


def dq_checks(spark, d):
    # Stored figures that disagree with each other wherever maintenance was flagged.
    stored = _summary(spark, d).withColumn(
        "performance_pct", F.when(F.col("maintenance_flag"), F.col("performance_pct") + 1)
        .otherwise(F.col("performance_pct")))
    return quality.summary_problems(stored, bed.daily_reference(spark, d), bed.plants(spark, d))


def constraint_checks(spark, d):
    # Checked against the plants in service only, so references to the others are orphans.
    in_service = bed.plants(spark, d).where("active")
    summary, ref = _summary(spark, d), bed.daily_reference(spark, d)
    return quality.table_violations({
        "daily_plant_summary": (summary, ["simulation_date", "plant_id"], quality.summary_rules()),
        "daily_reference": (ref, ["simulation_date", "plant_id"], quality.reference_rules()),
        "plant_metrics": (_windowed(spark, d), ["plant_id", "window_start", "window_end"], {}),
        "portfolio_metrics": (_portfolio_windows(spark, d), ["window_start", "window_end"], {}),
        "pipeline_health": (pipeline_health(spark, d), ["component"], quality.health_rules()),
        "inverters": (bed.inverters(spark, d), ["plant_id", "inverter_id"], {"rating": F.col("rated_power_kw") > 0}),
    }, in_service)


def alert_constraints(spark, d):
    return quality.alert_violations(_alerts(spark, d), bed.plants(spark, d).where("active"))


def forecast_feed(spark, d):
    return forecast.forecast_feed(bed.telemetry(spark, d), bed.plants(spark, d), _inverter_ref(spark, d), bed.days(spark, d))


def scenario_range_join(spark, d):
    return scenarios.label_events(
        bed.telemetry(spark, d).select("event_id", "plant_id", "inverter_id", "event_time"),
        bed.scenario_windows(spark, d), 300.0)


def upsert_merge(spark, d):
    """The loaded feed, its second half reissued at another rate with new days added."""
    ref = bed.daily_reference(spark, d).select("simulation_date", "plant_id", "ppa_rate_per_kwh")
    reissued = ref.where("dayofmonth(simulation_date) > 15").select(
        F.date_add("simulation_date", 7).alias("simulation_date"), "plant_id",
        (F.col("ppa_rate_per_kwh") + 1).alias("ppa_rate_per_kwh"))
    return upsert.upsert(ref, reissued, ["simulation_date", "plant_id"])


def upsert_by_file(spark, d):
    """As ``upsert_merge``, in a stored table of days in several files each: files without an arriving key stay."""
    ref = bed.daily_reference(spark, d).select("simulation_date", "plant_id", "ppa_rate_per_kwh")
    path = new_folder(spark, "by-file")
    ref.repartition(3, "plant_id").write.partitionBy("simulation_date").parquet(path)
    reissued = ref.where("dayofmonth(simulation_date) > 15").select(
        F.date_add("simulation_date", 7).alias("simulation_date"), "plant_id",
        (F.col("ppa_rate_per_kwh") + 1).alias("ppa_rate_per_kwh"))
    upsert.upsert_files(reissued, path, ["simulation_date", "plant_id"], "simulation_date")
    return spark.read.schema(ref.schema).parquet(path)


def upsert_repeated(spark, d):
    """The feed delivered three times at three rates: the dearest counts."""
    ref = bed.daily_reference(spark, d).select("simulation_date", "plant_id", "ppa_rate_per_kwh")
    thrice = ref.withColumn("ppa_rate_per_kwh", F.explode(F.array(*(F.col("ppa_rate_per_kwh") + x for x in (0.25, 0.5, 0.125)))))
    return upsert.upsert(ref, thrice.where("dayofmonth(simulation_date) > 15"), ["simulation_date", "plant_id"])


# --- registry and serving ------------------------------------------------------

def plant_reference(spark, d):
    return _plant_ref(spark, d)


def portfolio_checks(spark, d):
    # Every inverter, in service or not, against a nameplate that counts those in service.
    return registry.portfolio_problems(bed.plants(spark, d), bed.inverters(spark, d))


def rated_capacity(spark, d):
    return registry.rated_capacity(bed.plants(spark, d), bed.inverters(spark, d))


def installed_capacity(spark, d):
    return registry.installed_capacity(bed.plants(spark, d))


def portfolio_live(spark, d):
    return serving.portfolio_live(_portfolio_windows(spark, d), bed.plants(spark, d), _as_of(), S)


def _hour_live(spark, d):
    # Judged an hour-scale threshold apart, so that plants differ.
    return FleetSettings(stale_after_seconds=6 * 3600)


def plants_list(spark, d):
    return serving.plants_list(bed.plants(spark, d), plant_metrics(spark, d), _as_of(), _hour_live(spark, d))


def plant_live(spark, d):
    return serving.plant_live(bed.plants(spark, d), plant_metrics(spark, d), _as_of(), None,
                              _hour_live(spark, d))


def _one_plant(spark, d) -> str:
    return bed.plants(spark, d).agg(F.min("plant_id")).first()[0]


def plant_live_one(spark, d):
    return serving.plant_live(bed.plants(spark, d), plant_metrics(spark, d), _as_of(), _one_plant(spark, d), _hour_live(spark, d))


def plant_history_one(spark, d):
    return serving.plant_history(_windowed(spark, d), datetime(2024, 1, 5), datetime(2024, 1, 20), _one_plant(spark, d))


def plant_inverters_one(spark, d):
    return serving.plant_inverters(bed.inverters(spark, d), _one_plant(spark, d))


def plant_ranking(spark, d):
    return serving.plant_ranking(plants_list(spark, d)).select("plant_id", "performance_pct")


def plant_history(spark, d):
    return serving.plant_history(_windowed(spark, d), datetime(2024, 1, 1), datetime(2024, 1, 31))


def plant_inverters(spark, d):
    return serving.plant_inverters(bed.inverters(spark, d))


def daily_totals(spark, d):
    return reconcile.totals(_summary(spark, d))


def daily_rollup(spark, d):
    return reconcile.rolled_up(_summary(spark, d))


def daily_report_rows(spark, d):
    return serving.daily_rows(_summary(spark, d), bed.plants(spark, d))


def report_export(spark, d):
    """The daily report written as CSV for people, and read back."""
    rows = daily_report_rows(spark, d)
    folder = new_folder(spark, "report")
    export_report(rows, folder)
    return spark.read.schema(rows.schema).option("header", True).csv(folder)


def portfolio_flatten(spark, d):
    """The registry written as nested portfolio files, read and flattened again."""
    units = bed.inverters(spark, d).groupBy("plant_id").agg(F.collect_list(F.struct(
        F.col("inverter_id").alias("id"), F.col("inverter_name").alias("name"), "rated_power_kw")).alias("inverters"))
    nested = bed.plants(spark, d).join(units, "plant_id").select(
        F.col("plant_id").alias("id"), F.col("plant_name").alias("name"), "capacity_kw", "timezone", "ppa_rate_per_kwh", "inverters")
    folder = new_folder(spark, "portfolio")
    nested.write.json(folder)
    plants, inverters = read_portfolio(spark, folder)
    return inverters.join(plants.select("plant_id", "plant_name"), "plant_id").select(
        "plant_id", "plant_name", "inverter_id", "inverter_name", "rated_power_kw", "active")


def daily_report(spark, d):
    return serving.daily_report(_summary(spark, d), bed.plants(spark, d))


def pipeline_health(spark, d):
    """Health after the whole stream as one microbatch, then a failed daily run."""
    batch = monitor.batch_health(bed.telemetry(spark, d), F.lit(datetime(2024, 2, 1)))
    failed = monitor.status_row(spark, monitor.STREAM, "FAILED", "the batch raised",
                                F.lit(datetime(2024, 2, 2)))
    return monitor.merge_health(batch, failed)


def display_units(spark, d):
    row = plant_metrics(spark, d)
    return row.select("plant_id", model.display_amount(F.col("expected_power_kw"), "W").alias("expected"),
                      model.display_age(F.col("window_end"), _as_of()).alias("age"),
                      model.utc_text(F.col("window_end")).alias("window_end_utc"))


BATCH: tuple[Query, ...] = (
    parse_validate_reasons, normalize, valid_events, dedup_events, quarantine_records,
    quarantine_counts, quarantine_rate, producer_contract, archive_rows, latest_reading,
    plant_timeline, plant_metrics, plant_metrics_with_silent, windowed_plant_metrics,
    sliding_plant_metrics, portfolio_metrics, windowed_portfolio_metrics, last_n_windows,
    alert_conditions, alert_runs, alert_incidents, alert_counts, active_alert_count,
    alerts_listing, lifecycle_step, energy_increments, inverter_actuals, plant_actuals,
    running_meter, archive_presence, reference_problems, reference_rows, reconcile_summary,
    reconcile_published, reconcile_problems, reconcile_warnings, dq_checks, constraint_checks,
    alert_constraints, forecast_feed, scenario_range_join, upsert_merge, upsert_by_file, plant_reference,
    portfolio_checks, rated_capacity, installed_capacity, portfolio_live, plants_list, plant_live,
    plant_live_one, plant_history_one, plant_inverters_one, upsert_repeated,
    report_export, portfolio_flatten,
    plant_ranking, plant_history, plant_inverters, daily_totals, daily_rollup, daily_report_rows, daily_report,
    pipeline_health, display_units,
)


def _bind(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _tidy(query(prepare(spark), sf_dir))

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict[str, Query]:
    return {q.__name__: _bind(q) for q in (*BATCH, *STREAMS)}
