"""What a microbatch does to the live tables.

Every write of batch N goes to a place that belongs to N alone, so a batch that is run again
after a failure overwrites its own output:

* metric rows and resolved alerts: a partition ``batch_id=N``;
* the batch's events, tracked faults, health and the commit record: one of two alternating slots. Batch N reads the slot
  of N-1 and writes the other one, so what it read is still there if it has to start over.

The commit record is what a batch writes last. Every reader takes batches up to the newest one, so all
tables of a batch become visible at once, and a batch that runs or has failed is in none of them. A batch
that raises leaves a note, which health shows as FAILED until that batch is committed.

No figure passes through the driver.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from datetime import date
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattscope import schema
from wattscope.operators import alerts, incidents, lifecycle, metrics, monitor
from wattscope.operators.upsert import read_table, replace_partitions
from wattscope.settings import FleetSettings
from wattscope.sources.folding import TARGET_BYTES, DayTable

_EVENTS, _TRACKED, _HEALTH, _COMMIT, _FAILURE = "batch_events", "tracked_faults", "pipeline_health", "commits", "failure"
# What metrics, faults and health read of an event.
BATCH_COLUMNS = ("plant_id", "inverter_id", "active_power_kw", "irradiance_wm2", "status", "availability", "event_time", "kafka_offset")
_COMMIT_SCHEMA = "committed_at timestamp"


def _metric_schema(columns: tuple[str, ...]) -> str:
    kinds = {"plant_id": "string", "window_start": "timestamp", "window_end": "timestamp", "online_inverters": "bigint", "offline_inverters": "bigint"}
    return ", ".join(f"{c} {kinds.get(c, 'double')}" for c in columns) + ", metric_date date, batch_id bigint"


LIVE_SCHEMAS = {"plant_metrics": _metric_schema(schema.PLANT_METRIC_COLUMNS), "portfolio_metrics": _metric_schema(schema.PORTFOLIO_METRIC_COLUMNS)}


def _slot(root: str, table: str, batch_id: int) -> str:
    return f"{root}/{table}/slot={batch_id % 2}"


def _read_slot(spark: SparkSession, root: str, table: str, batch_id: int, columns: str) -> DataFrame:
    """The table as batch ``batch_id`` left it; empty if that batch never ran."""
    if batch_id < 0:
        return spark.createDataFrame([], columns)
    stored = read_table(spark, _slot(root, table, batch_id), f"{columns}, as_of_batch bigint")
    return stored.where(F.col("as_of_batch") == batch_id).drop("as_of_batch")


def _write_slot(rows: DataFrame, root: str, table: str, batch_id: int) -> None:
    (rows.withColumn("as_of_batch", F.lit(batch_id).cast("long"))
     .write.mode("overwrite").parquet(_slot(root, table, batch_id)))


@dataclass
class LiveTables:
    """The microbatch function and the tables it maintains under ``root``.

    ``plant_reference`` and ``inverter_reference`` are the registry; an empty registry is
    refused, since silence could not be seen without it.
    """

    root: str
    plant_reference: DataFrame
    inverter_reference: DataFrame
    settings: FleetSettings = field(default_factory=FleetSettings)

    def __post_init__(self) -> None:
        if self.inverter_reference.isEmpty():
            raise ValueError("the inverter registry is empty: gaps in telemetry cannot be detected")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        try:
            self._advance(batch, batch_id)
        except Exception as e:
            self._note_failure(batch.sparkSession, batch_id, e)
            raise

    def _advance(self, batch: DataFrame, batch_id: int) -> None:
        spark, s = batch.sparkSession, self.settings
        read = partial(_read_slot, spark, self.root)
        tracked = read(_TRACKED, batch_id - 1, lifecycle.TRACKED_SCHEMA)
        events = self._events(batch, batch_id)
        if events.isEmpty():
            # Alive but idle: faults stay as they are.
            _write_slot(tracked, self.root, _TRACKED, batch_id)
        else:
            self._write_metrics(events, batch_id)
            self._advance_faults(events, tracked, batch_id)
        health = monitor.merge_health(
            read(_HEALTH, batch_id - 1, monitor.HEALTH_SCHEMA),
            monitor.batch_health(events, F.current_timestamp()))
        _write_slot(health, self.root, _HEALTH, batch_id)
        self._commit(spark, batch_id)

    def _events(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The batch as a table written once. Every job on the batch itself would run the stream's plan again,
        deduplication against its state included; a cached batch is run again too, where a plan does not find it."""
        rows = batch.select(*BATCH_COLUMNS)
        _write_slot(rows, self.root, _EVENTS, batch_id)
        return batch.sparkSession.read.schema(rows.schema).parquet(_slot(self.root, _EVENTS, batch_id))

    def _commit(self, spark: SparkSession, batch_id: int) -> None:
        _write_slot(spark.range(1).select(F.current_timestamp().alias("committed_at")), self.root, _COMMIT, batch_id)

    def _note_failure(self, spark: SparkSession, batch_id: int, error: Exception) -> None:
        """Never hides the error it reports: the note is of use only if it can still be written."""
        said = f"batch {batch_id} failed: {type(error).__name__}: {error}".splitlines()[0][:500]
        try:
            _write_slot(monitor.status_row(spark, monitor.STREAM, "FAILED", said, F.current_timestamp()), self.root, _FAILURE, batch_id)
        except Exception:
            logging.getLogger(__name__).exception("the failure of batch %d could not be noted", batch_id)

    def _write_metrics(self, events: DataFrame, batch_id: int) -> None:
        plants = metrics.plant_metrics(events, self.plant_reference, self.settings).persist()
        try:
            for table, rows in (("plant_metrics", plants),
                                ("portfolio_metrics", metrics.portfolio_metrics(plants))):
                replace_partitions(
                    rows.withColumns({"metric_date": F.to_date("window_end"), "batch_id": F.lit(batch_id)}),
                    f"{self.root}/{table}", ["metric_date", "batch_id"])
        finally:
            plants.unpersist()

    def _advance_faults(self, events: DataFrame, tracked: DataFrame, batch_id: int) -> None:
        now = alerts.observation_clock(events)
        observed = alerts.conditions(metrics.latest_reading(events), self.inverter_reference,
                                     now, self.settings)
        stepped = lifecycle.step(tracked, observed, now).persist()
        try:
            _write_slot(lifecycle.still_tracked(stepped), self.root, _TRACKED, batch_id)
            resolved = lifecycle.just_resolved(stepped, self.settings)
            replace_partitions(resolved.withColumn("batch_id", F.lit(batch_id)),
                               f"{self.root}/resolved_faults", ["batch_id"])
        finally:
            stepped.unpersist()


def last_committed(spark: SparkSession, root: str) -> Column:
    """The newest batch all of whose tables are written; NULL while there is none."""
    return read_table(spark, f"{root}/{_COMMIT}", f"{_COMMIT_SCHEMA}, as_of_batch bigint, slot int").agg(F.max("as_of_batch")).scalar()


def _committed_slot(spark: SparkSession, root: str, table: str, columns: str) -> DataFrame:
    """The table as the last committed batch left it, which may be empty."""
    stored = read_table(spark, f"{root}/{table}", f"{columns}, as_of_batch bigint, slot int")
    return stored.where(F.col("as_of_batch") == last_committed(spark, root)).drop("as_of_batch", "slot")


def pipeline_health(spark: SparkSession, root: str) -> DataFrame:
    """Health after the last committed batch; FAILED if a later one has raised, without moving what it knew."""
    known = _committed_slot(spark, root, _HEALTH, monitor.HEALTH_SCHEMA)
    noted = read_table(spark, f"{root}/{_FAILURE}", f"{monitor.HEALTH_SCHEMA}, as_of_batch bigint, slot int")
    later = noted.where(F.col("as_of_batch") > F.coalesce(last_committed(spark, root), F.lit(-1)))
    return monitor.merge_health(known, later.drop("as_of_batch", "slot"))


def tracked_faults(spark: SparkSession, root: str) -> DataFrame:
    """Faults seen at the last committed observation, whether they have lasted long enough for an alert or not."""
    return _committed_slot(spark, root, _TRACKED, lifecycle.TRACKED_SCHEMA)


def fault_history(spark: SparkSession, root: str) -> DataFrame:
    """Faults tracked now (``ended_at`` NULL) and those that ended as alerts."""
    open_now = (tracked_faults(spark, root)
                .withColumn("ended_at", F.lit(None).cast("timestamp"))
                .select(*incidents.INCIDENT_COLUMNS))
    resolved = read_table(spark, f"{root}/resolved_faults",
                          f"{lifecycle.TRACKED_SCHEMA}, ended_at timestamp, batch_id bigint")
    return open_now.unionByName(resolved.where(F.col("batch_id") <= last_committed(spark, root)).select(*incidents.INCIDENT_COLUMNS))


def alerts_table(spark: SparkSession, root: str, daily_reference: DataFrame,
                 s: FleetSettings = FleetSettings()) -> DataFrame:
    """Open and resolved alerts, priced with the rates known at this moment."""
    return incidents.priced_alerts(fault_history(spark, root), daily_reference, s)


def live_table(spark: SparkSession, root: str, name: str, since: Column | None = None) -> DataFrame:
    """``plant_metrics`` or ``portfolio_metrics`` of committed batches, from day ``since`` on (pruned by directory)."""
    rows = _days_of(root, name).read_all(spark).where(F.col("batch_id") <= last_committed(spark, root))
    return rows if since is None else rows.where(F.col("metric_date") >= since)


def _days_of(root: str, name: str) -> DayTable:
    return DayTable(f"{root}/{name}", "metric_date", T._parse_datatype_string(LIVE_SCHEMAS[name]), ("batch_id",), ("window_end",))


def live_days(spark: SparkSession, root: str, name: str, first: date, last: date | None = None) -> DataFrame:
    """``live_table`` of a range of days, from folded days and the batches beside them; no other day is listed."""
    return _days_of(root, name).read(spark, first, last).where(F.col("batch_id") <= last_committed(spark, root))


def fold_live_day(spark: SparkSession, root: str, name: str, day: date, target_bytes: int = TARGET_BYTES) -> int:
    """Fold the committed batches of a day, a folder each until then, into few files. Run it where no batch runs
    or for days that are over; a batch that may still be run again is left out."""
    last = spark.range(1).select(last_committed(spark, root)).first()[0]
    return _days_of(root, name).fold(spark, day, target_bytes, lambda n: last is not None and int(n.split("/")[0].split("=")[1]) <= last)


def expire_live_day(spark: SparkSession, root: str, name: str, day: date) -> int:
    """Remove the batches' folders that the folded day replaces; ``live_days`` goes on reading them all."""
    return _days_of(root, name).expire(spark, day)
