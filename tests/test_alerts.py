from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattscope.operators import alerts, incidents, lifecycle, metrics
from wattscope.settings import FleetSettings
from tests.conftest import DAWN

S = FleetSettings()
HOUR = 3600


def found(events_df, registry):
    rows = alerts.conditions(metrics.latest_reading(events_df), registry, F.lit(DAWN), S).collect()
    return {r.inverter_id: r for r in rows}


def test_one_condition_per_inverter_in_priority_order(events, fleet):
    registry = fleet(*(("PLANT_01", f"INV_0{n}", 1000.0) for n in range(1, 6)))
    got = found(events(
        dict(inv="INV_01", power=450.0), dict(inv="INV_02", power=0.0, status="OFFLINE", up=0.0),
        dict(inv="INV_03", power=0.0, up=0.0), dict(inv="INV_04", power=399.9)), registry)
    assert {k: r.alert_type for k, r in got.items()} == {
        "INV_02": "INVERTER_OFFLINE", "INV_03": "INVERTER_OFFLINE", "INV_04": "UNDERPERFORMANCE",
        "INV_05": "TELEMETRY_GAP"}
    assert (got["INV_04"].severity, got["INV_02"].severity) == ("WARNING", "CRITICAL")
    assert got["INV_04"].loss_kw == pytest.approx(100.1) and got["INV_02"].loss_kw == 500 and got["INV_05"].loss_kw == 0
    assert got["INV_04"].message.endswith("generating 80.0% of expected under current irradiance")
    assert "No telemetry" in got["INV_05"].message and got["INV_05"].observed_at == DAWN


def test_shares_are_rounded_as_sql_does(events, fleet):
    """2.01 of 60 kW is 3.3499999999999996 %; scaled by ten that is 33.5."""
    got = found(events(dict(inv="INV_01", power=2.01, sun=600.0)), fleet(("PLANT_01", "INV_01", 100.0)))
    assert got["INV_01"].message.endswith("generating 3.4% of expected under current irradiance")


def test_threshold_is_exclusive_and_night_is_not_judged(events, fleet):
    registry = fleet(("PLANT_01", "INV_01", 1000.0), ("PLANT_01", "INV_02", 1000.0))
    assert not found(events(dict(inv="INV_01", power=400.0), dict(inv="INV_02", power=0.0, sun=149.0)), registry)


def test_dark_healthy_fleet_divides_by_nothing(events, fleet):
    assert not found(events(dict(power=0.0, sun=0.0)), fleet(("PLANT_01", "INV_01", 1000.0)))


# --- history ------------------------------------------------------------------

REFERENCE = "plant_id string, simulation_date date, ppa_rate_per_kwh double"


def reference(spark, rate=0.15):
    return spark.createDataFrame([("PLANT_01", DAWN.date(), rate)], REFERENCE)


def weak(hour, inv="INV_01", power=100.0):
    return dict(inv=inv, power=power, at=DAWN + timedelta(hours=hour))


def priced(spark, rows, registry, rate=True):
    ref = reference(spark) if rate else reference(spark).where("false")
    return incidents.priced_alerts(incidents.sustained_runs(rows, registry, HOUR, S), ref, S)


@pytest.mark.parametrize("hours,loss,money", [(1, 400.0, 60.0), (2, 800.0, 120.0)])
def test_sustained_loss(spark, events, fleet, hours, loss, money):
    rows = events(*(weak(h) for h in range(hours + 1)))
    row = priced(spark, rows, fleet(("PLANT_01", "INV_01", 1000.0))).first()
    assert (row.status, row.estimated_loss_kwh, row.ended_at) == ("ACTIVE", loss, None)
    assert row.estimated_revenue_loss == pytest.approx(money)


def test_no_rate_no_price(spark, events, fleet):
    row = priced(spark, events(weak(0), weak(1)), fleet(("PLANT_01", "INV_01", 1000.0)), rate=False).first()
    assert row.estimated_loss_kwh == 400 and row.estimated_revenue_loss is None


def test_blip_is_no_alert(spark, events, fleet):
    rows = events(weak(0), weak(1, power=500.0), weak(2))
    assert priced(spark, rows, fleet(("PLANT_01", "INV_01", 1000.0))).isEmpty()


def test_recurrence_is_a_new_incident(spark, events, fleet):
    rows = events(weak(0), weak(1), weak(2, power=500.0), weak(3), weak(4))
    got = priced(spark, rows, fleet(("PLANT_01", "INV_01", 1000.0))).orderBy("started_at").collect()
    assert [(r.status, r.started_at.hour, r.ended_at and r.ended_at.hour) for r in got] == \
        [("RESOLVED", 5, 7), ("ACTIVE", 8, None)]
    assert got[0].id != got[1].id


def test_silence_before_between_after_and_throughout(spark, events, fleet):
    registry = fleet(*(("PLANT_01", f"INV_0{n}", 1000.0) for n in (1, 2, 3)))
    # INV_01 sets the clock, INV_02 is heard twice, INV_03 never.
    rows = events(*(weak(h, power=500.0) for h in range(9)), weak(2, "INV_02", 500.0), weak(5, "INV_02", 500.0))
    got = {(r.inverter_id, r.first_observed_at.hour): (r.last_observed_at.hour, r.observation_count,
                                                       r.ended_at and r.ended_at.hour)
           for r in incidents.sustained_runs(rows, registry, HOUR, S).collect()}
    assert got == {("INV_02", 5): (6, 2, 7), ("INV_02", 8): (9, 2, 10), ("INV_02", 11): (13, 3, None),
                   ("INV_03", 5): (13, 9, None)}


def test_history_equals_stepping_through_it(spark, events, fleet):
    """The batch form and the one-observation-at-a-time form agree."""
    registry = fleet(*(("PLANT_01", f"INV_0{n}", 1000.0) for n in (1, 2, 3, 4)))
    rows = []
    for h in range(30):
        rows.append(weak(h, power=500.0 if h % 5 else 100.0))
        if h % 7 not in (3, 4):
            rows.append(weak(h, "INV_02", 100.0 if h % 7 < 3 else 450.0))
        if h > 20:
            rows.append(dict(inv="INV_03", power=0.0, status="OFFLINE", up=0.0, at=DAWN + timedelta(hours=h)))
    df = events(*rows).cache()
    batch = incidents.sustained_runs(df, registry, HOUR, S)

    tracked = spark.createDataFrame([], lifecycle.TRACKED_SCHEMA)
    ended = []
    for h in range(30):
        frame = df.where(F.date_trunc("hour", "event_time") == F.lit(DAWN + timedelta(hours=h)))
        now = alerts.observation_clock(frame)
        stepped = lifecycle.step(tracked, alerts.conditions(metrics.latest_reading(frame), registry, now, S), now)
        rows_now = stepped.collect()
        ended += [r for r in rows_now if r.ended_at is not None]
        tracked = spark.createDataFrame([tuple(r)[:-1] for r in rows_now if r.ended_at is None],
                                        lifecycle.TRACKED_SCHEMA)

    def key(r):
        return (r.inverter_id, r.alert_type, r.message, r.first_observed_at, r.last_observed_at,
                r.observation_count, round(r.sum_loss_kw, 6), r.ended_at)

    stepwise = {key(r) for r in ended} | {(*key_open(r), None) for r in tracked.collect()}
    assert {key(r) for r in batch.collect()} == stepwise


def key_open(r):
    return (r.inverter_id, r.alert_type, r.message, r.first_observed_at, r.last_observed_at,
            r.observation_count, round(r.sum_loss_kw, 6))


# --- one step --------------------------------------------------------------------

CONDITION = ("plant_id string, inverter_id string, alert_type string, severity string, message string, "
             "loss_kw double, observed_at timestamp")


def seen(spark, *rows):
    return spark.createDataFrame(
        [("P", inv, kind, "WARNING", f"{kind} {loss}", loss, at) for inv, kind, loss, at in rows], CONDITION)


def test_replay_counts_once(spark):
    first = seen(spark, ("A", "UNDERPERFORMANCE", 10.0, DAWN))
    tracked = lifecycle.still_tracked(lifecycle.step(
        spark.createDataFrame([], lifecycle.TRACKED_SCHEMA), first, F.lit(DAWN)))
    again = lifecycle.step(tracked, first, F.lit(DAWN)).first()
    assert (again.observation_count, again.sum_loss_kw) == (1, 10)


def test_change_of_kind_ends_the_old_fault(spark):
    later = DAWN + timedelta(hours=2)
    tracked = spark.createDataFrame(
        [("P", "A", "UNDERPERFORMANCE", "WARNING", "m", DAWN, DAWN + timedelta(hours=1), 2, 20.0)],
        lifecycle.TRACKED_SCHEMA)
    stepped = lifecycle.step(tracked, seen(spark, ("A", "INVERTER_OFFLINE", 5.0, later)), F.lit(later))
    assert lifecycle.just_resolved(stepped, S).first().ended_at == later
    assert lifecycle.still_tracked(stepped).first().alert_type == "INVERTER_OFFLINE"


def test_plant_wide_fault_has_an_empty_inverter(spark):
    rows = seen(spark, (None, "TELEMETRY_GAP", None, DAWN))
    row = lifecycle.step(spark.createDataFrame([], lifecycle.TRACKED_SCHEMA), rows, F.lit(DAWN)).first()
    assert (row.inverter_id, row.sum_loss_kw) == ("", 0)


def test_clock_running_backwards_never_ends_before_start(spark):
    tracked = spark.createDataFrame([("P", "A", "UNDERPERFORMANCE", "WARNING", "m", DAWN, DAWN, 1, 1.0)],
                                    lifecycle.TRACKED_SCHEMA)
    row = lifecycle.step(tracked, seen(spark).where("false"), F.lit(DAWN - timedelta(hours=1))).first()
    assert row.ended_at == DAWN
