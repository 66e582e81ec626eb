from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattscope.operators import metrics
from wattscope.settings import FleetSettings
from tests.conftest import DAWN

TWO = [dict(inv="INV_01", power=100.0), dict(inv="INV_02", power=150.0),
       dict(inv="INV_01", power=200.0, sec=3), dict(inv="INV_02", power=250.0, sec=3)]


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_current_is_latest_per_inverter_and_average_is_over_instants(events, sites):
    row = one(metrics.plant_metrics(events(*TWO), sites(("PLANT_01", 1000.0, 2))))
    assert row.current_power_kw == 450 and row.avg_power_kw == 350
    assert (row.window_start, row.window_end) == (DAWN, DAWN + timedelta(seconds=3))
    assert (row.expected_power_kw, row.performance_pct, row.estimated_loss_kw) == (500, 90, 50)
    assert (row.online_inverters, row.offline_inverters, row.availability_pct) == (2, 0, 100)


def test_equal_times_go_by_offset(events):
    row = one(metrics.latest_reading(events(dict(power=111.0, offset=1), dict(power=222.0, offset=2))))
    assert row.active_power_kw == 222


@pytest.mark.parametrize("sun,power,expected,performance,loss", [
    (1200.0, 900.0, 1000.0, 90.0, 100.0),     # capped at the rating
    (149.9, 0.0, None, None, None),           # night: unknown, not zero
    (150.0, 75.0, 150.0, 50.0, 75.0),
    (500.0, 600.0, 500.0, 120.0, 0.0),        # better than the model: not clamped, no loss
])
def test_performance_model(events, sites, sun, power, expected, performance, loss):
    row = one(metrics.plant_metrics(events(dict(power=power, sun=sun)), sites(("PLANT_01", 1000.0, 1))))
    assert (row.expected_power_kw, row.performance_pct, row.estimated_loss_kw) == (expected, performance, loss)


def test_silent_inverter_counts_as_offline(events, sites):
    row = one(metrics.plant_metrics(events(dict()), sites(("PLANT_01", 1000.0, 2))))
    assert (row.online_inverters, row.offline_inverters, row.availability_pct) == (1, 1, 50)


def test_warning_is_online_and_unavailable_is_not(events, sites):
    rows = events(dict(inv="A", status="WARNING"), dict(inv="B", up=0.0), dict(inv="C", status="OFFLINE", up=0.0))
    assert one(metrics.plant_metrics(rows, sites(("PLANT_01", 1000.0, 3)))).online_inverters == 1


def test_plant_outside_the_registry(events, sites):
    row = one(metrics.plant_metrics(events(dict()), sites(("PLANT_09", 1000.0, 2))))
    assert row.availability_pct == 100 and row.expected_power_kw is None


def test_silent_plants_on_request(events, sites):
    rows = metrics.plant_metrics(events(dict()), sites(("PLANT_01", 1000.0, 1), ("PLANT_02", 1000.0, 4)),
                                 include_silent=True).orderBy("plant_id").collect()
    assert [(r.current_power_kw, r.online_inverters, r.offline_inverters) for r in rows] == [(100, 1, 0), (0, 0, 4)]


PLANT = ("plant_id string, window_start timestamp, window_end timestamp, current_power_kw double, "
         "avg_power_kw double, expected_power_kw double, estimated_loss_kw double, online_inverters int, "
         "offline_inverters int")


def plant_row(pid, current, expected, online=1, offline=0):
    loss = None if expected is None else max(expected - current, 0.0)
    return (pid, DAWN, DAWN, current, current, expected, loss, online, offline)


def test_portfolio_is_weighted(spark):
    rows = spark.createDataFrame([plant_row("A", 4750.0, 5000.0, 5, 1), plant_row("B", 250.0, 500.0, 2, 2)], PLANT)
    row = one(metrics.portfolio_metrics(rows))
    assert row.performance_pct == pytest.approx(90.909, abs=1e-3)
    assert (row.current_power_kw, row.estimated_loss_kw, row.availability_pct) == (5000, 500, 70)


def test_dark_plant_leaves_both_sides(spark):
    rows = spark.createDataFrame([plant_row("A", 450.0, 500.0), plant_row("B", 0.0, None)], PLANT)
    row = one(metrics.portfolio_metrics(rows))
    assert (row.performance_pct, row.current_power_kw) == (90, 450)


def test_all_dark(spark):
    row = one(metrics.portfolio_metrics(spark.createDataFrame([plant_row("A", 0.0, None)], PLANT)))
    assert row.performance_pct is None and row.expected_power_kw is None


def test_windows_split_and_slide(events, sites):
    rows = events(dict(power=10.0, sec=0), dict(power=20.0, sec=59), dict(power=30.0, sec=60))
    ref = sites(("PLANT_01", 1000.0, 1))
    got = metrics.windowed_plant_metrics(rows, ref, width="60 seconds").orderBy("window_start").collect()
    assert [(r.current_power_kw, r.avg_power_kw) for r in got] == [(20, 15), (30, 30)]
    sliding = metrics.windowed_plant_metrics(rows, ref, width="60 seconds", slide="30 seconds")
    assert sliding.count() == 4


def test_windows_do_not_mix_plants(events, sites):
    rows = events(dict(plant="A", power=1.0), dict(plant="B", power=2.0))
    got = metrics.windowed_plant_metrics(rows, sites(("A", 10.0, 1), ("B", 10.0, 1)), width="1 minute")
    assert sorted(r.current_power_kw for r in got.collect()) == [1, 2]


def test_recent_power(spark):
    rows = spark.createDataFrame([(DAWN + timedelta(seconds=n // 2), float(n // 2), None) for n in range(20)],
                                 "window_end timestamp, current_power_kw double, expected_power_kw double")
    got = metrics.recent_power(rows, 3).collect()
    assert [r.current_power_kw for r in got] == [7, 8, 9]


def test_hot_inverter_is_reduced_before_the_shuffle(events):
    plan = metrics.latest_reading(events(dict()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.index("Final") < plan.index("Partial")


@pytest.mark.parametrize("bad", [dict(reference_irradiance_wm2=0), dict(min_irradiance_wm2=-1),
                                 dict(underperformance_pct=0), dict(underperformance_pct=101),
                                 dict(sustain_seconds=-1), dict(slice_seconds=0)])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        FleetSettings(**bad)
