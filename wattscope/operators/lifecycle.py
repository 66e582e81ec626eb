"""The alert lifecycle one observation at a time: observe, sustain, refresh, resolve.

The tracked faults are a table of one row per fault. A step joins it with the faults observed
now and yields the table after the observation plus the faults that ended. Whether an alert is
open follows from the row (it has lasted long enough), so there is no second table to keep in
step, and one open alert per asset and kind holds by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattscope.functions import model
from wattscope.operators.incidents import INCIDENT_COLUMNS
from wattscope.settings import FleetSettings

FAULT = ("plant_id", "inverter_id", "alert_type")
TRACKED_SCHEMA = (
    "plant_id string, inverter_id string, alert_type string, severity string, message string, "
    "first_observed_at timestamp, last_observed_at timestamp, observation_count bigint, "
    "sum_loss_kw double"
)


def step(tracked: DataFrame, observed: DataFrame, observed_at: Column) -> DataFrame:
    """All faults after one observation; ``ended_at`` is set on those no longer seen.

    ``observed`` is the output of ``alerts.conditions``. Seeing an instant again (a replayed
    batch, or one that ran backwards) neither counts nor adds loss twice.
    """
    now = observed.select(
        *(F.coalesce(c, F.lit("")).alias(c) if c == "inverter_id" else c for c in FAULT),
        F.col("severity").alias("now_severity"), F.col("message").alias("now_message"),
        F.coalesce("loss_kw", F.lit(0.0)).alias("now_loss_kw"), F.col("observed_at").alias("now_at"))
    both = tracked.join(now, list(FAULT), "full_outer")
    fresh = F.col("now_at").isNotNull() & (
        F.col("last_observed_at").isNull() | (F.col("now_at") > F.col("last_observed_at")))
    # A condition seen at the latest known instant or later describes the fault best.
    current = F.col("now_at") >= F.coalesce("last_observed_at", "now_at")
    return both.select(
        *FAULT,
        F.when(current, F.col("now_severity")).otherwise(F.col("severity")).alias("severity"),
        F.when(current, F.col("now_message")).otherwise(F.col("message")).alias("message"),
        F.coalesce("first_observed_at", "now_at").alias("first_observed_at"),
        F.greatest("last_observed_at", "now_at").alias("last_observed_at"),
        (F.coalesce("observation_count", F.lit(0)) + fresh.cast("long")).alias("observation_count"),
        (F.coalesce("sum_loss_kw", F.lit(0.0))
         + F.when(fresh, F.col("now_loss_kw")).otherwise(0.0)).alias("sum_loss_kw"),
        F.when(F.col("now_at").isNull(), F.greatest(observed_at, F.col("first_observed_at")))
         .alias("ended_at"),
    ).select(*INCIDENT_COLUMNS)


def still_tracked(stepped: DataFrame) -> DataFrame:
    return stepped.where("ended_at is null").drop("ended_at")


def just_resolved(stepped: DataFrame, s: FleetSettings = FleetSettings()) -> DataFrame:
    """Ended faults that had become alerts; the others were blips and leave no trace."""
    lasted = model.elapsed_seconds(F.col("first_observed_at"), F.col("last_observed_at"))
    return stepped.where(F.col("ended_at").isNotNull() & (lasted >= s.sustain_seconds))
