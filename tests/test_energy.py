from __future__ import annotations

from datetime import timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wattscope.operators import energy
from wattscope.settings import FleetSettings
from tests.conftest import DAWN


def readings(*values, inv="INV_01", step=600):
    return [dict(inv=inv, energy=float(v), sec=n * step) for n, v in enumerate(values)]


@pytest.mark.parametrize("values,total", [
    ((0, 1200, 3400), 3400), ((400, 1000, 200, 600), 1600), ((500, 2000), 2000), ((700,), 700)])
@pytest.mark.parametrize("slice_seconds", [60, 900, 86400])
def test_day_total(events, values, total, slice_seconds):
    s = FleetSettings(slice_seconds=slice_seconds)
    rows = events(*readings(*values))
    assert energy.inverter_actuals(rows, s).first().actual_generation_kwh == total
    assert energy.energy_increments(rows, s).agg(F.sum("energy_increment_kwh")).first()[0] == total


def test_counter_restarts_at_midnight(events):
    rows = events(dict(energy=900.0, sec=0), dict(energy=1000.0, sec=86400))
    got = {r.simulation_date.day: r.actual_generation_kwh for r in energy.inverter_actuals(rows).collect()}
    assert got == {21: 900, 22: 1000}


def test_plant_roll_up(events):
    rows = events(*readings(0, 100), *readings(0, 50, inv="INV_02"),
                  dict(inv="INV_03", status="OFFLINE", up=0.0), dict(inv="INV_03", status="WARNING", sec=3))
    row = energy.plant_actuals(rows).first()
    assert (row.actual_generation_kwh, row.observation_count, row.reporting_inverters) == (150, 6, 3)
    # WARNING is not ONLINE here; one OFFLINE sample is three seconds.
    assert row.availability_pct == pytest.approx(400 / 6) and row.downtime_minutes == 0.05


def brute(values):
    out, before = [], None
    for v in values:
        out.append(v if before is None or v < before else v - before)
        before = v
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=30), st.sampled_from([300, 1800, 7200]))
def test_slices_do_not_matter(events, values, width):
    rows = events(*readings(*values))
    got = energy.energy_increments(rows, FleetSettings(slice_seconds=width)).orderBy("event_time").collect()
    assert [r.energy_increment_kwh for r in got] == brute(values)
    assert sum(brute(values)) >= max(values)


def test_equal_times_go_by_offset(events):
    rows = events(dict(energy=30.0, offset=2), dict(energy=10.0, offset=1), dict(energy=20.0, offset=3))
    got = energy.energy_increments(rows).orderBy("kafka_offset").collect()
    assert [r.energy_increment_kwh for r in got] == [10, 20, 20]


def test_running_meter(events):
    rows = events(dict(power=100.0, sec=0), dict(power=50.0, sec=4000), dict(power=10.0, sec=86400))
    got = energy.running_meter(rows, 0.5, FleetSettings(slice_seconds=60)).orderBy("event_time").collect()
    assert [r.meter_kwh for r in got] == [50, 75, 5]


@pytest.mark.parametrize("make", [energy.energy_increments, lambda e: energy.running_meter(e, 0.5), energy.plant_actuals])
def test_readings_are_read_and_moved_once(spark, tmp_path, events, make):
    """Each but the first use of the readings' exchange is a reused one, and no other exchange holds whole readings."""
    path = str(tmp_path / "readings")
    events(*(dict(inv=f"I{n % 3}", sec=n * 600, energy=float(n)) for n in range(40))).write.parquet(path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = make(spark.read.parquet(path))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() > 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("FileScan") == 1
    assert sum("Exchange hashpartitioning" in line and "slice" in line and "ReusedExchange" not in line and "opening" not in line
               for line in plan.splitlines()) <= 2


def test_readings_without_a_time_have_no_meter(events):
    rows = events(dict(power=100.0), dict(power=50.0)).withColumn("event_time", F.when(F.col("kafka_offset") == 0, F.col("event_time")))
    assert [r.meter_kwh for r in energy.running_meter(rows, 0.5).collect()] == [50]


def test_presence(events):
    rows = events(dict(), dict(plant="B"), dict(sec=86400)).withColumn("simulation_date", F.to_date("event_time"))
    got = energy.archive_presence(rows).orderBy("simulation_date").collect()
    assert [(r.events, r.plants) for r in got] == [(2, 2), (1, 1)]
