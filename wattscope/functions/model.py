"""Column expressions of the performance and money model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattscope.settings import FleetSettings

PCT = 100.0


def sunlight_share(irradiance: Column, s: FleetSettings) -> Column:
    """Share of the nameplate the sunlight supports, at most one."""
    return F.least(irradiance / s.reference_irradiance_wm2, F.lit(1.0))


def expected_power(rating: Column, irradiance: Column, s: FleetSettings) -> Column:
    """Rating times sunlight share; unknown (NULL) in the dark."""
    return F.when(irradiance >= s.min_irradiance_wm2, rating * sunlight_share(irradiance, s))


def ratio_pct(part: Column, whole: Column) -> Column:
    """``part / whole`` in percent; NULL unless the whole is positive. Not clamped."""
    return F.when(whole > 0, part / whole * PCT)


def rounded(value: Column, places: int) -> Column:
    """To ``places`` decimals by scaling, as SQL engines do it: a quotient an ulp below a half goes up where scaling
    reaches the half. ``F.round`` goes by the shortest decimal text instead, and there it stays below."""
    scale = float(10 ** places)
    return F.round(value * scale) / scale


def shortfall(expected: Column, actual: Column) -> Column:
    """Missing output, never negative; NULL when nothing can be expected."""
    return F.when(expected.isNotNull(), F.greatest(expected - actual, F.lit(0.0)))


def elapsed_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def lost_energy_kwh(sum_loss_kw: Column, observations: Column,
                    first_at: Column, last_at: Column) -> Column:
    """Mean shortfall over the life of a fault times its hours."""
    return F.try_divide(sum_loss_kw, observations) * (elapsed_seconds(first_at, last_at) / 3600.0)


def freshness(latest: Column, as_of: Column, stale_after_seconds: int) -> Column:
    """NO_DATA / STALE / LIVE of a figure, judged at ``as_of`` in the same time domain."""
    return (F.when(latest.isNull(), F.lit("NO_DATA"))
            .when(elapsed_seconds(latest, as_of) > stale_after_seconds, F.lit("STALE"))
            .otherwise(F.lit("LIVE")))


def heat_factor(module_temp_c: Column, rated_at_c: float = 25.0, per_degree: float = 0.004,
                floor: float = 0.80) -> Column:
    """Efficiency left at a module temperature."""
    excess = F.greatest(module_temp_c - rated_at_c, F.lit(0.0))
    return F.greatest(1.0 - excess * per_degree, F.lit(floor))


def display_amount(value: Column, unit: str) -> Column:
    """``1.25 MW`` / ``940.0 kW``: thousands switch unit; NULL shows as a dash."""
    big = F.concat(F.format_string("%.2f", value / 1000.0), F.lit(f" M{unit}"))
    small = F.concat(F.format_string("%.1f", value), F.lit(f" k{unit}"))
    return F.coalesce(F.when(F.abs(value) >= 1000.0, big).when(value.isNotNull(), small), F.lit("—"))


def display_age(at: Column, as_of: Column) -> Column:
    """``42s ago`` / ``5m ago`` / ``3h ago``."""
    secs = F.greatest(F.round(elapsed_seconds(at, as_of)).cast("long"), F.lit(0))
    mins = F.round(secs / 60.0).cast("long")
    hours = F.round(mins / 60.0).cast("long")
    text = (F.when(secs < 60, F.concat(secs.cast("string"), F.lit("s ago")))
            .when(mins < 60, F.concat(mins.cast("string"), F.lit("m ago")))
            .otherwise(F.concat(hours.cast("string"), F.lit("h ago"))))
    return F.when(at.isNull(), F.lit("—")).otherwise(text)


def utc_text(at: Column) -> Column:
    """An instant as unambiguous UTC text, for text sinks."""
    return F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("+00"))
