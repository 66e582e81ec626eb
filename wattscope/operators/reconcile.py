"""Metered generation against the expectation, priced, for any number of days at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattscope import schema
from wattscope.functions import model

# A day this far above its forecast is a scaling error, not weather (percent, exclusive).
IMPLAUSIBLE_PCT = 300.0

_DAY_PLANT = ["simulation_date", "plant_id"]


def alert_counts(alerts: DataFrame) -> DataFrame:
    """Alerts per plant and the UTC day they started."""
    return (alerts.groupBy(F.to_date("started_at").alias("simulation_date"), "plant_id")
            .agg(F.count(F.lit(1)).alias("alert_count")))


def _listed(*flags: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(hit, F.lit(name)) for name, hit in flags)))


def reconcile(reference: DataFrame, actuals: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row per plant and day of either side: the summary columns, ``problems``, ``warnings``.

    The feed defines the portfolio. A plant without telemetry produced nothing, which is a
    result and only a warning; telemetry without a feed row cannot be valued and is a problem.
    Both sides hold a row per plant and day, so one equi-join settles both directions.
    """
    ref = reference.select(*_DAY_PLANT, "expected_generation_kwh", "ppa_rate_per_kwh",
                           "maintenance_flag")
    met = actuals.select(*_DAY_PLANT, F.col("actual_generation_kwh").alias("metered_kwh"),
                         "availability_pct", "downtime_minutes", F.lit(True).alias("metered"))
    both = ref.withColumn("referenced", F.lit(True)).join(met, _DAY_PLANT, "full_outer")
    if counts is None:
        both = both.withColumn("alert_count", F.lit(0).cast("long"))
    else:
        both = both.join(counts, _DAY_PLANT, "left")

    silent = F.col("metered").isNull()
    actual = F.coalesce("metered_kwh", F.lit(0.0))
    expected, rate = F.col("expected_generation_kwh"), F.col("ppa_rate_per_kwh")
    performance = model.ratio_pct(actual, expected)
    unreferenced = F.col("referenced").isNull()
    problems = _listed(
        ("NO_REFERENCE_ROW", unreferenced),
        ("NEGATIVE_GENERATION", ~unreferenced & (actual < 0)),
        ("EXPECTATION_NOT_POSITIVE", ~unreferenced & (actual >= 0) & (expected <= 0)),
        ("IMPLAUSIBLE_PERFORMANCE", ~unreferenced & (actual >= 0) & (performance > IMPLAUSIBLE_PCT)))
    fine = F.size("problems") == 0
    lost = F.greatest(expected - actual, F.lit(0.0))
    return (both.withColumns({
                "problems": problems,
                "actual_generation_kwh": actual,
                "performance_pct": performance,
            })
            .withColumns({
                "warnings": _listed(
                    ("NO_TELEMETRY", silent),
                    ("ABOVE_FORECAST", fine & (F.col("performance_pct") > 100.0)),
                    ("MAINTENANCE", fine & F.col("maintenance_flag"))),
                "availability_pct": F.when(silent, F.lit(0.0)).otherwise(F.col("availability_pct")),
                "downtime_minutes": F.coalesce("downtime_minutes", F.lit(0.0)),
                "estimated_lost_energy_kwh": lost,
                "estimated_actual_revenue": actual * rate,
                "estimated_lost_revenue": lost * rate,
                "alert_count": F.coalesce("alert_count", F.lit(0).cast("long")),
            })
            .select(*schema.SUMMARY_COLUMNS, "problems", "warnings"))


def summary_rows(reconciled: DataFrame) -> DataFrame:
    """Rows that reconcile, whatever became of the other plants of their day."""
    return reconciled.where(F.size("problems") == 0).select(*schema.SUMMARY_COLUMNS)


def publishable(reconciled: DataFrame) -> DataFrame:
    """Summary rows of days without a single problem: a day is published whole or not at all."""
    bad = reconciled.where(F.size("problems") > 0).select("simulation_date").distinct()
    return summary_rows(reconciled).join(bad, "simulation_date", "left_anti")


def remarks(reconciled: DataFrame, kind: str) -> DataFrame:
    """``(simulation_date, plant_id, remark, performance_pct)`` for ``problems`` or ``warnings``."""
    return reconciled.select(*_DAY_PLANT, F.explode(kind).alias("remark"), "performance_pct")


def unreferenced_days(dates: DataFrame, reference: DataFrame) -> DataFrame:
    """Requested days for which no feed was loaded."""
    return dates.join(reference.select("simulation_date").distinct(), "simulation_date", "left_anti")


_SUMS = {
    "actual_generation_kwh": "actual_generation_kwh",
    "expected_generation_kwh": "expected_generation_kwh",
    "lost_energy_kwh": "estimated_lost_energy_kwh",
    "actual_revenue": "estimated_actual_revenue",
    "lost_revenue": "estimated_lost_revenue",
}


def rolled_up(summary: DataFrame) -> DataFrame:
    """Figures of each plant and day, of each day, and of all, from one pass: ``level`` says which, and what a row
    adds up over is NULL. A ratio is of sums at every level, so it is no mean of the ratios below it."""
    return (summary.rollup("simulation_date", "plant_id")
            .agg(*(F.sum(c).alias(name) for name, c in _SUMS.items()), F.count(F.lit(1)).alias("row_count"),
                 F.sum("alert_count").alias("alert_count"), F.grouping_id().alias("_level"))
            .withColumns({
                "level": F.when(F.col("_level") == 0, "plant").when(F.col("_level") == 1, "day").otherwise("all"),
                "performance_pct": model.ratio_pct(F.col("actual_generation_kwh"), F.col("expected_generation_kwh"))})
            # Without rows there is no total either.
            .where("row_count > 0").drop("_level"))


def totals(summary: DataFrame, *more: Column) -> DataFrame:
    """Portfolio figures per day; a day without rows has no row. Performance is a ratio of sums.

    ``more`` are further aggregates over the same rows.
    """
    return (summary.groupBy("simulation_date")
            .agg(*(F.sum(c).alias(name) for name, c in _SUMS.items()),
                 F.count(F.lit(1)).alias("plant_count"), *more)
            .withColumn("performance_pct", model.ratio_pct(F.col("actual_generation_kwh"),
                                                           F.col("expected_generation_kwh"))))
