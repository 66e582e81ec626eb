"""The streaming operators as queries: the records are laid out as files, streamed to the end
with ``availableNow``, and the tables the stream leaves behind are the result."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattscope import schema
from wattscope.operators import energy, incidents, lifecycle, metrics, monitor, quality, reconcile, registry, telemetry
from wattscope.plans import daily
from wattscope.plans import testbed as bed
from wattscope.session import materialize, new_folder
from wattscope.settings import FleetSettings
from wattscope.sources import feed_csv
from wattscope.sources.archive import expire_day, fold_day, read_days, write_archive
from wattscope.sources.records import file_records
from wattscope.streaming import silence, sinks
from wattscope.streaming.jobs import start_live, start_speed_layer
from wattscope.streaming.microbatch import LiveTables, alerts_table, live_table, pipeline_health, tracked_faults

NOW = {"availableNow": True}
S = FleetSettings()
WEEK = 7 * 86400
GAP_SECONDS = 3 * 86400


def _first_and_last(spark: SparkSession, sf_dir: str) -> tuple[date, date]:
    """The days of the events, whichever they are."""
    day = F.to_date("event_time")
    return tuple(bed.telemetry(spark, sf_dir).agg(F.min(day), F.max(day)).first())


def _landed(spark: SparkSession, sf_dir: str, work: str, equal_copies: bool = False) -> DataFrame:
    bed.raw_records(spark, sf_dir, equal_copies=equal_copies).write.parquet(f"{work}/records")
    return file_records(spark, f"{work}/records")


def stream_valid(spark, d):
    work = new_folder(spark, "valid")
    # A stream keeps whichever copy it sees first, so copies are equal here and every column can be compared.
    events = telemetry.trusted(telemetry.parse(_landed(spark, d, work, equal_copies=True)), S.watermark)
    rows = events.select("event_id", "plant_id", "inverter_id", "active_power_kw", "energy_today_kwh", "irradiance_wm2", "status",
                         "availability", "event_time")
    sinks.write_table(rows, f"{work}/out", f"{work}/ckpt", NOW).awaitTermination()
    return spark.read.parquet(f"{work}/out")


def stream_windowed_metrics(spark, d):
    """Windows still open when the records end are not written; that is append mode."""
    work = new_folder(spark, "windows")
    plants = registry.plant_reference(bed.plants(spark, d), bed.inverters(spark, d))
    events = telemetry.trusted(telemetry.parse(_landed(spark, d, work)), S.watermark)
    rows = metrics.windowed_plant_metrics(events, plants, S, "6 hours")
    sinks.write_table(rows, f"{work}/out", f"{work}/ckpt", NOW).awaitTermination()
    return spark.read.parquet(f"{work}/out")


def stream_sliding_metrics(spark, d):
    """Overlapping windows of a stream: half a day wide, a new one every three hours."""
    work = new_folder(spark, "sliding")
    plants = registry.plant_reference(bed.plants(spark, d), bed.inverters(spark, d))
    events = telemetry.trusted(telemetry.parse(_landed(spark, d, work)), S.watermark)
    rows = metrics.windowed_plant_metrics(events, plants, S, "6 hours", "3 hours")
    sinks.write_table(rows, f"{work}/out", f"{work}/ckpt", NOW).awaitTermination()
    return spark.read.parquet(f"{work}/out")


def stream_quarantine_rate(spark, d):
    """Rejected records per reason and hour of arrival, as far as the watermark closed the hours."""
    work = new_folder(spark, "rate")
    rejected = telemetry.rejected(telemetry.judge(telemetry.parse(_landed(spark, d, work)))).withWatermark("kafka_timestamp", S.watermark)
    sinks.write_table(monitor.quarantine_rate(rejected, "kafka_timestamp", "1 hour"), f"{work}/out", f"{work}/ckpt", NOW).awaitTermination()
    return spark.read.parquet(f"{work}/out")


def stream_quarantine(spark, d):
    work = new_folder(spark, "quarantine")
    judged = telemetry.judge(telemetry.parse(_landed(spark, d, work)))
    sinks.write_quarantine(judged, f"{work}/ckpt", path=f"{work}/out", trigger=NOW).awaitTermination()
    reason = F.get_json_object("value", "$.rejection_reason").alias("rejection_reason")
    return spark.read.parquet(f"{work}/out").groupBy(reason).agg(F.count(F.lit(1)).alias("records"))


def _archived(spark, d, work):
    accepted = telemetry.normalize(telemetry.accepted(telemetry.judge(
        telemetry.parse(_landed(spark, d, work)))))
    write_archive(accepted, f"{work}/archive", f"{work}/ckpt", NOW,
                  files_per_partition=1).awaitTermination()
    return f"{work}/archive"


def stream_archive_roundtrip(spark, d):
    """Archived by the stream, read back by day: the daily actuals of the records."""
    path = _archived(spark, d, new_folder(spark, "archive"))
    return energy.plant_actuals(read_days(spark, path, *_first_and_last(spark, d)), S)


def archive_compacted(spark, d):
    """As ``stream_archive_roundtrip``, from an archive whose days are folded but for what came late."""
    work = new_folder(spark, "compacted")
    path = _archived(spark, d, work)
    first, last = _first_and_last(spark, d)
    for n in range(0, (last - first).days + 1):
        fold_day(spark, path, first + timedelta(n))
        if n % 3 == 0:
            expire_day(spark, path, first + timedelta(n))
    return energy.plant_actuals(read_days(spark, path, first, last), S)


class _CutShort(LiveTables):
    """Loses its machine when all tables of a batch are written but the batch is not committed."""

    def _commit(self, spark, batch_id):
        raise RuntimeError("cut short")


def _weekly_live(spark, d, cut_short: bool = False) -> LiveTables:
    """A week of records per microbatch, the query stopped and started again in between; the last may be cut short."""
    work = new_folder(spark, "live")
    week = F.floor(F.unix_timestamp("timestamp") / WEEK)
    # Records are made in one pass; a week that arrives is then a copy of its folder, in a file per core, as a stream reads
    # a file of one row group in one task. A key's records lie together as they arrived: of copies the stream keeps the first it meets.
    bed.raw_records(spark, d).withColumn("week", week).write.partitionBy("week").parquet(f"{work}/weeks")
    made = spark.read.schema(T.StructType([*schema.RAW_RECORD.fields, T.StructField("week", T.LongType())])).parquet(f"{work}/weeks")
    low, high = made.agg(F.min("week"), F.max("week")).first()
    cores = spark.sparkContext.defaultParallelism
    inverters = bed.inverters(spark, d)
    live = LiveTables(f"{work}/live", registry.plant_reference(bed.plants(spark, d), inverters),
                      registry.inverter_reference(inverters), S)
    for n in range(low, high + 1):
        made.where(F.col("week") == n).drop("week").repartition(cores, "key").sortWithinPartitions("timestamp", "offset").write.mode("append").parquet(f"{work}/records")
        if cut_short and n == high:
            live = _CutShort(live.root, live.plant_reference, live.inverter_reference, S)
        try:
            start_live(file_records(spark, f"{work}/records"), live, f"{work}/ckpt", NOW).awaitTermination()
        except StreamingQueryException:
            if not isinstance(live, _CutShort):
                raise
    return live


def stream_alert_lifecycle(spark, d):
    return alerts_table(spark, _weekly_live(spark, d).root, bed.daily_reference(spark, d), S)


def stream_live_crash(spark, d):
    """Alerts after the last week's batch was cut short: as the week before left them, as are metrics and health."""
    live = _weekly_live(spark, d, cut_short=True)
    alerts = alerts_table(spark, live.root, bed.daily_reference(spark, d), S)
    seen = live_table(spark, live.root, "plant_metrics").agg(F.count(F.lit(1))).scalar()
    folded = live_table(spark, live.root, "portfolio_metrics").agg(F.count(F.lit(1))).scalar()
    health = pipeline_health(spark, live.root)
    return alerts.select("*", seen.alias("plant_rows"), folded.alias("portfolio_rows"), health.select("status").scalar().alias("health"))


def stream_conditions(spark, d):
    """Faults the live tables track after the last week, alerts or not yet, with what is wrong with their key."""
    live = _weekly_live(spark, d)
    tracked = tracked_faults(spark, live.root)
    twice = quality.duplicate_keys(tracked, "conditions", list(lifecycle.FAULT)).agg(F.count(F.lit(1))).scalar()
    return tracked.select(*lifecycle.FAULT, "severity", "first_observed_at", "last_observed_at", "observation_count", twice.alias("keys_twice"))


def stream_speed_layer(spark, d):
    """All three sinks over the same records, each with its own checkpoint: how many rows each has at the end."""
    work = new_folder(spark, "speed")
    bed.raw_records(spark, d).write.parquet(f"{work}/records")
    inverters = bed.inverters(spark, d)
    live = LiveTables(f"{work}/live", registry.plant_reference(bed.plants(spark, d), inverters), registry.inverter_reference(inverters), S)
    for q in start_speed_layer(lambda: file_records(spark, f"{work}/records"), live, f"{work}/archive", f"{work}/ckpt", invalid_path=f"{work}/invalid", trigger=NOW):
        q.awaitTermination()
    of = lambda name, df: df.agg(F.lit(name).alias("sink"), F.count(F.lit(1)).alias("row_count"))
    return quality.union_all([of("live", live_table(spark, live.root, "plant_metrics")), of("archive", spark.read.parquet(f"{work}/archive")),
                              of("quarantine", spark.read.parquet(f"{work}/invalid"))])


def stream_live_metrics(spark, d):
    """The plant metrics the microbatches wrote, read back."""
    rows = live_table(spark, _weekly_live(spark, d).root, "plant_metrics")
    return rows.drop("metric_date", "batch_id")


def stream_live_portfolio(spark, d):
    rows = live_table(spark, _weekly_live(spark, d).root, "portfolio_metrics")
    return rows.select("window_start", "window_end", "current_power_kw", "online_inverters", "offline_inverters", "estimated_loss_kw")


def stream_live_health(spark, d):
    """Health as the last microbatch, which brought nothing more, left it."""
    return pipeline_health(spark, _weekly_live(spark, d).root).drop("last_success_at")


def stream_silence(spark, d):
    """Alert changes by event-time timers, silence included."""
    work = new_folder(spark, "silence")
    events = telemetry.trusted(telemetry.parse(_landed(spark, d, work)), S.watermark)
    inverters = registry.inverter_reference(bed.inverters(spark, d))
    changes = silence.alert_changes(events, inverters, 6 * 3600, GAP_SECONDS, S,
                                    silent_since=datetime(2024, 1, 1))
    sinks.write_table(changes, f"{work}/out", f"{work}/ckpt", NOW).awaitTermination()
    return spark.read.parquet(f"{work}/out")


def stream_state(spark, d):
    """Every inverter's fault as the silence stream's own state has it, keys checked."""
    work = new_folder(spark, "state")
    events = telemetry.trusted(telemetry.parse(_landed(spark, d, work)), S.watermark)
    changes = silence.alert_changes(events, registry.inverter_reference(bed.inverters(spark, d)), 6 * 3600, GAP_SECONDS, S,
                                    silent_since=datetime(2024, 1, 1))
    sinks.write_table(changes, f"{work}/out", f"{work}/ckpt", NOW).awaitTermination()
    state = silence.tracked_state(spark, f"{work}/ckpt")
    twice = quality.duplicate_keys(state, "state", ["plant_id", "inverter_id"]).agg(F.count(F.lit(1))).scalar()
    return state.where("alert_type is not null").drop("heard_at").withColumn("keys_twice", twice)


def _daily_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The plants, all of them in service, and the expectations. A row per plant (and day), derived from all
    events and customers: written down, as every step of the daily job asks for them."""
    plants = materialize(bed.plants(spark, sf_dir), "plants")
    return plants.withColumn("active", F.lit(True)), materialize(bed.daily_reference(spark, sf_dir, plants), "reference")


def _landed_days(spark: SparkSession, work: str) -> tuple[date, date]:
    """``_first_and_last`` of landed records: each first copy arrives at its event's own instant."""
    day = F.to_date("timestamp")
    landed = spark.read.schema(schema.RAW_RECORD).parquet(f"{work}/records").where(F.col("offset") < bed.REPEAT_OFFSET)
    return tuple(landed.agg(F.min(day), F.max(day)).first())


def _daily_tables(spark, d, with_alerts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Feed files and archive in, published summaries out, for the whole month in one run. The alerts of the
    month, if it counts them, come from the archive too: records are made and decoded once."""
    work = new_folder(spark, "daily")
    archive = _archived(spark, d, work)
    first, last = _landed_days(spark, work)
    plants, reference = _daily_inputs(spark, d)
    feed_csv.write_feed(reference, f"{work}/feed")
    alerts = events = None
    if with_alerts:
        # Copies are taken out once, for the alerts and the meters.
        events = materialize(read_days(spark, archive, first, last).select(
            *energy.METER, "active_power_kw", "energy_today_kwh", "irradiance_wm2", "status", "availability", "event_time", "kafka_offset"), "events")
        inverters = registry.inverter_reference(bed.inverters(spark, d))
        alerts = incidents.priced_alerts(incidents.sustained_runs(events, inverters, 86400, S), reference, S)
    tables = daily.DailyTables(f"{work}/tables")
    daily.run_days(spark, archive, f"{work}/feed", plants, tables, first, last, alerts, S, events=events)
    return daily.read_summary(spark, tables), daily.issues(spark, tables)


def daily_job(spark, d):
    return reconcile.totals(_daily_tables(spark, d)[0])


def daily_job_rerun(spark, d):
    """The daily job as changes drive it: readings of the fifth day's evening arrive when all days have been run
    once, and then that day alone is run again. ``reran`` marks it."""
    work = new_folder(spark, "rerun")
    first, last = _first_and_last(spark, d)
    records = bed.raw_records(spark, d)
    late = F.date_trunc("day", "timestamp").eqNullSafe(F.lit(first + timedelta(4)).cast("timestamp")) & (F.hour("timestamp") >= 18)
    plants, reference = _daily_inputs(spark, d)
    feed_csv.write_feed(reference, f"{work}/feed")
    tables = daily.DailyTables(f"{work}/tables")
    ran = []
    for part in (records.where(~late), records.where(late)):
        part.write.mode("append").parquet(f"{work}/records")
        accepted = telemetry.normalize(telemetry.accepted(telemetry.judge(telemetry.parse(file_records(spark, f"{work}/records")))))
        write_archive(accepted, f"{work}/archive", f"{work}/ckpt", NOW, files_per_partition=1).awaitTermination()
        ran.append(daily.run_changed(spark, f"{work}/archive", f"{work}/feed", plants, tables))
    again = F.array(*(F.lit(x) for x in ran[1])) if ran[1] else F.array().cast("array<date>")
    return reconcile.totals(daily.read_summary(spark, tables)).withColumn("reran", F.array_contains(again, F.col("simulation_date")))


def feed_files(spark, d):
    """Feed files of which no two have the same header: columns turned about by a file's day and one more in every
    third. Read back by name, with what is said about the files."""
    work = new_folder(spark, "feed")
    ref = bed.daily_reference(spark, d)
    text = ref.select(F.col("simulation_date").alias("day"), *(F.col(c).cast("string").alias(c) for c in schema.FEED_COLUMNS))
    n = F.dayofmonth("day")
    turned = lambda a: F.concat(F.slice(a, n % 9 + 1, F.lit(9)), F.slice(a, F.lit(1), n % 9))
    extra = F.when(n % 3 == 0, F.array(F.concat(F.lit("note_"), n.cast("string")))).otherwise(F.array().cast("array<string>"))
    names = F.array_join(F.concat(turned(F.array(*map(F.lit, schema.FEED_COLUMNS))), extra), ",")
    values = F.array_join(F.concat(turned(F.array(*(F.concat(F.lit('"'), c, F.lit('"')) for c in schema.FEED_COLUMNS))), extra), ",")
    lines = text.select("day", F.lit(0).alias("at"), F.lit("").alias("plant_id"), names.alias("line")).distinct().union(text.select("day", F.lit(1), "plant_id", values.alias("line")))
    (lines.repartition("day").sortWithinPartitions("day", "at", "plant_id").select("day", "line").write.partitionBy("day").text(f"{work}/feed"))
    rows, problems = feed_csv.read_feed(spark, f"{work}/feed")
    said = problems.groupBy("feed_date").agg(F.max("level").alias("level"), F.max("detail").alias("detail"))
    return rows.join(said, "feed_date", "left").drop("simulation_date")


def daily_job_issues(spark, d):
    """What the daily job found wrong: of the feed, in reconciling, in what was published."""
    return _daily_tables(spark, d)[1]


def daily_job_summary(spark, d):
    """The published rows, with the alerts of each plant and day counted."""
    return _daily_tables(spark, d, with_alerts=True)[0]


STREAMS = (stream_valid, stream_windowed_metrics, stream_sliding_metrics, stream_quarantine, stream_quarantine_rate,
           stream_archive_roundtrip, archive_compacted,
           stream_alert_lifecycle, stream_live_metrics, stream_live_portfolio, stream_live_health, stream_live_crash, stream_silence,
           daily_job, daily_job_summary, daily_job_rerun, daily_job_issues, feed_files,
           stream_conditions, stream_state, stream_speed_layer)
