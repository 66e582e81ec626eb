"""How the pipeline itself is doing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STREAM, BATCH = "telemetry-stream", "daily-reconciliation"
HEALTH_SCHEMA = ("component string, status string, last_event_at timestamp, "
                 "last_success_at timestamp, message string")


def quarantine_rate(rejected: DataFrame, at: str = "rejected_at", span: str = "1 minute") -> DataFrame:
    """Rejected records per reason and ``span``, and per second."""
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return (rejected.groupBy(F.window(at, span).alias("w"), "rejection_reason")
            .agg(F.count(F.lit(1)).alias("records"))
            .select(F.col("w.start").alias("window_start"), "rejection_reason", "records",
                    (F.col("records") / seconds).alias("per_second")))


def batch_health(batch: DataFrame, at: Column, component: str = STREAM) -> DataFrame:
    """One health row for a microbatch: alive either way, DEGRADED if it brought nothing."""
    seen = batch.agg(F.count(F.lit(1)).alias("n"), F.max("event_time").alias("last_event_at"),
                     F.count_distinct("plant_id").alias("plants"))
    return seen.select(
        F.lit(component).alias("component"),
        F.when(F.col("n") > 0, F.lit("HEALTHY")).otherwise(F.lit("DEGRADED")).alias("status"),
        "last_event_at", at.alias("last_success_at"),
        F.when(F.col("n") > 0, F.format_string("processed %d events across %d plants", "n", "plants"))
         .otherwise(F.lit("no telemetry in this microbatch")).alias("message"))


def status_row(spark, component: str, status: str, message: str, at: Column) -> DataFrame:
    """A health row somebody reports; a failure does not count as a success."""
    ok = F.lit(None).cast("timestamp") if status == "FAILED" else at
    return spark.range(1).select(
        F.lit(component).alias("component"), F.lit(status).alias("status"),
        F.lit(None).cast("timestamp").alias("last_event_at"), ok.alias("last_success_at"),
        F.lit(message).alias("message"))


def merge_health(known: DataFrame, reported: DataFrame) -> DataFrame:
    """Newest status per component; the time columns only ever move forward."""
    k, r = known.alias("k"), reported.alias("r")
    marks = ("last_event_at", "last_success_at")

    def pick(c: str) -> Column:
        return F.when(F.col("r.status").isNotNull(), F.col(f"r.{c}")).otherwise(F.col(f"k.{c}")).alias(c)

    return k.join(r, "component", "full_outer").select(
        "component", pick("status"),
        *(F.greatest(f"k.{c}", f"r.{c}").alias(c) for c in marks), pick("message"))


def active_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.where("status = 'ACTIVE'").agg(F.count(F.lit(1)).alias("active_alerts"))
