"""The queries a dashboard asks, as DataFrames over the serving tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattscope.functions import model
from wattscope.operators.reconcile import totals
from wattscope.operators.registry import installed_capacity
from wattscope.settings import FleetSettings

MAX_HISTORY = timedelta(days=31)
MAX_ALERTS = 500

REPORT_COLUMNS = (
    "plant_id", "plant_name", "actual_generation_kwh", "expected_generation_kwh",
    "performance_pct", "availability_pct", "lost_energy_kwh", "lost_revenue", "alert_count",
    "maintenance_flag",
)
_LIVE = ("current_power_kw", "avg_power_kw", "expected_power_kw", "availability_pct",
         "performance_pct", "estimated_loss_kw", "online_inverters", "offline_inverters")


def require_plant(plants: DataFrame, plant_id: str) -> None:
    if plants.where(F.col("plant_id") == plant_id).isEmpty():
        raise LookupError(f"unknown plant: {plant_id}")


def _latest_metrics(metrics: DataFrame) -> DataFrame:
    """The newest row per plant: one row per plant and task before the shuffle."""
    newest = metrics.groupBy("plant_id").agg(
        F.max_by(F.struct("window_end", *_LIVE), F.struct("window_end", "window_start")).alias("m"))
    return newest.select("plant_id", F.col("m.window_end").alias("last_update"),
                         *(F.col(f"m.{c}").alias(c) for c in _LIVE))


def portfolio_live(portfolio: DataFrame, plants: DataFrame, as_of: Column,
                   s: FleetSettings = FleetSettings()) -> DataFrame:
    """The newest portfolio row with installed capacity; one row even when there is none yet."""
    newest = portfolio.agg(
        F.max_by(F.struct("window_end", *_LIVE), F.struct("window_end", "window_start")).alias("m"))
    return newest.select(
        F.col("m.window_end").alias("timestamp"),
        installed_capacity(plants).scalar().alias("installed_capacity_kw"),
        *(F.col(f"m.{c}").alias(c) for c in _LIVE),
        model.freshness(F.col("m.window_end"), as_of, s.stale_after_seconds).alias("data_status"))


def plants_list(plants: DataFrame, metrics: DataFrame, as_of: Column,
                s: FleetSettings = FleetSettings()) -> DataFrame:
    """Every plant, active or not, with its newest figures."""
    return (plants.join(_latest_metrics(metrics), "plant_id", "left")
            .select("plant_id", "plant_name", "capacity_kw", "active", "current_power_kw",
                    "performance_pct", "availability_pct",
                    model.freshness(F.col("last_update"), as_of, s.stale_after_seconds)
                         .alias("data_status"), "last_update")
            .orderBy("plant_id"))


def plant_live(plants: DataFrame, metrics: DataFrame, as_of: Column, plant_id: str | None = None,
               s: FleetSettings = FleetSettings()) -> DataFrame:
    """Live figures of one plant (all plants with ``None``); NULLs and NO_DATA if never heard."""
    if plant_id is not None:
        require_plant(plants, plant_id)
        plants = plants.where(F.col("plant_id") == plant_id)
        metrics = metrics.where(F.col("plant_id") == plant_id)
    return plants.join(_latest_metrics(metrics), "plant_id", "left").select(
        "plant_id", "plant_name", "capacity_kw", F.col("last_update").alias("timestamp"), *_LIVE,
        model.freshness(F.col("last_update"), as_of, s.stale_after_seconds).alias("data_status"))


def plant_ranking(listed: DataFrame) -> DataFrame:
    """Best performance first, plants without one last."""
    return listed.orderBy(F.coalesce("performance_pct", F.lit(-1.0)).desc(), "plant_id")


def plant_history(metrics: DataFrame, start: datetime, end: datetime,
                  plant_id: str | None = None) -> DataFrame:
    """Metric rows whose window ends in ``[start, end]``, in order; at most 31 days."""
    if start > end:
        raise ValueError("start must not be after end")
    if (end - start).days > MAX_HISTORY.days:
        raise ValueError(f"range exceeds {MAX_HISTORY.days} days")
    chosen = metrics.where(F.col("window_end").between(F.lit(start), F.lit(end)))
    if plant_id is not None:
        chosen = chosen.where(F.col("plant_id") == plant_id)
    return chosen.select(
        "plant_id", "window_start", "window_end", "current_power_kw", "avg_power_kw",
        "expected_power_kw", "performance_pct", "availability_pct").orderBy("plant_id", "window_end")


def plant_inverters(inverters: DataFrame, plant_id: str | None = None) -> DataFrame:
    if plant_id is not None:
        inverters = inverters.where(F.col("plant_id") == plant_id)
    return inverters.select("plant_id", "inverter_id", "inverter_name", "rated_power_kw",
                            "active").orderBy("plant_id", "inverter_id")


def alerts_listing(alerts: DataFrame, status: str | None = None, plant_id: str | None = None,
                   severity: str | None = None, limit: int = 100) -> DataFrame:
    """Open alerts first, newest first within; the top ``limit`` of them."""
    if not 1 <= limit <= MAX_ALERTS:
        raise ValueError(f"limit must lie in 1..{MAX_ALERTS}")
    wanted = {"status": status and status.upper(), "plant_id": plant_id, "severity": severity}
    for column, value in wanted.items():
        if value is not None:
            alerts = alerts.where(F.col(column) == value)
    return alerts.orderBy((F.col("status") == "ACTIVE").desc(), F.desc("started_at"), "id").limit(limit)


def daily_rows(summary: DataFrame, plants: DataFrame) -> DataFrame:
    """Report rows per day, weakest plant first."""
    named = summary.join(plants.select("plant_id", "plant_name"), "plant_id")
    return (named.withColumnsRenamed({"estimated_lost_energy_kwh": "lost_energy_kwh",
                                      "estimated_lost_revenue": "lost_revenue"})
            .select("simulation_date", *REPORT_COLUMNS)
            .orderBy("simulation_date", F.asc_nulls_last("performance_pct"), "plant_id"))


def daily_report(summary: DataFrame, plants: DataFrame) -> DataFrame:
    """Per reconciled day: portfolio totals with the best and the worst performer.

    Ranked are the plants with a performance; ties go by plant id. One aggregation yields all
    of it, so the summary is read once.
    """
    named = summary.join(plants.select("plant_id", "plant_name"), "plant_id", "left")
    who = F.struct("plant_id", "plant_name", "performance_pct")
    rank = F.when(F.col("performance_pct").isNotNull() & F.col("plant_name").isNotNull(),
                  F.struct("performance_pct", "plant_id"))
    report = totals(named, F.max_by(who, rank).alias("best"), F.min_by(who, rank).alias("worst"))
    ends = [F.col(f"{end}.{c}").alias(f"{end}_{c}")
            for end in ("best", "worst") for c in ("plant_id", "plant_name", "performance_pct")]
    kept = [c for c in report.columns if c not in ("best", "worst")]
    return report.select(*kept, *ends).orderBy("simulation_date")
