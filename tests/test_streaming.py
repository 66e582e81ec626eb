"""Streams against their batch twins, restarts and replays included."""

from __future__ import annotations

import json
import tempfile
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wattscope import schema
from wattscope.operators import energy, incidents, metrics, quality, telemetry
from wattscope.settings import FleetSettings
from wattscope.sources.archive import read_days, write_archive
from wattscope.sources.records import file_records
from wattscope.streaming import microbatch, silence, sinks
from wattscope.streaming.jobs import ProgressBook, start_live, start_speed_layer, start_windowed
from wattscope.streaming.microbatch import LiveTables
from tests.conftest import DAWN

NOW = {"availableNow": True}
S = FleetSettings(watermark="2 minutes")


@pytest.fixture
def work():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.fixture
def land(spark, work):
    """Append records to the stream's folder: dicts as in the events fixture, or raw text."""
    count = [0]

    def put(*rows):
        data = []
        for r in rows:
            count[0] += 1
            n = r.get("offset", count[0]) if isinstance(r, dict) else count[0]
            if isinstance(r, dict):
                at = r.get("at") or DAWN + timedelta(seconds=r.get("sec", 0))
                doc = dict(event_id=r.get("event_id", f"e{n}"), plant_id=r.get("plant", "PLANT_01"),
                           inverter_id=r.get("inv", "INV_01"), active_power_kw=r.get("power", 100.0),
                           energy_today_kwh=r.get("energy", 0.0), irradiance_wm2=r.get("sun", 500.0),
                           status=r.get("status", "ONLINE"), availability=r.get("up", 1.0),
                           timestamp=at.isoformat() + "Z")
                text = json.dumps(doc)
            else:
                at, text = DAWN, r
            data.append((bytearray(b"k"), bytearray(text.encode()), "t", 0, n, at))
        spark.createDataFrame(data, schema.RAW_RECORD).write.mode("append").parquet(f"{work}/records")
    return put


def records(spark, work):
    return file_records(spark, f"{work}/records")


def test_duplicates_across_batches_and_late_rows(spark, work, land):
    def run():
        events = telemetry.trusted(telemetry.parse(records(spark, work)), S.watermark)
        sinks.write_table(events.select("event_id", "event_time"), f"{work}/out", f"{work}/ckpt", NOW).awaitTermination()

    land(dict(event_id="a"), dict(event_id="a"), dict(event_id="b", sec=30))
    run()
    land(dict(event_id="a"), dict(event_id="c", sec=3600))
    run()
    land(dict(event_id="d", sec=3601))
    run()
    land(dict(event_id="late", sec=10), dict(event_id="e", sec=3602))
    run()
    got = sorted(r.event_id for r in spark.read.parquet(f"{work}/out").collect())
    assert got == ["a", "b", "c", "d", "e"]


def test_windows_equal_the_batch(spark, work, land, sites):
    rows = [dict(plant=f"P{n % 2}", inv=f"I{n % 3}", power=float(n), sec=n * 7) for n in range(100)]
    land(*rows[:50])
    ref = sites(("P0", 1000.0, 3), ("P1", 1000.0, 4))
    s = FleetSettings(window_width="60 seconds", window_slide="30 seconds")
    run = lambda: start_windowed(records(spark, work), ref, f"{work}/out", f"{work}/ckpt", s, NOW).awaitTermination()
    run()
    land(*rows[50:])
    run()
    batch = metrics.windowed_plant_metrics(
        telemetry.trusted(telemetry.parse(spark.read.parquet(f"{work}/records"))), ref, s, s.window_width, s.window_slide)
    closed = batch.where(F.col("window_end") <= F.lit(DAWN + timedelta(seconds=99 * 7 - 120)))
    key = lambda df: sorted(map(tuple, df.select("plant_id", "window_start", "current_power_kw", "avg_power_kw",
                                                 "availability_pct", "offline_inverters").collect()))
    assert key(spark.read.parquet(f"{work}/out")) == key(closed) and not closed.isEmpty()


def test_sliding_windows_multiply_panes_not_events(spark, work, land, sites):
    """Events are gathered by pane before windows, and late ones of a pane still count in it."""
    rows = [dict(plant=f"P{n % 2}", inv=f"I{n % 3}", power=float(n), sec=n * 7) for n in range(100)]
    ref = sites(("P0", 1000.0, 3), ("P1", 1000.0, 4))
    for part in (rows[:30], [rows[-1]], rows[30:-1]):
        land(*part)
    events = telemetry.trusted(telemetry.parse(records(spark, work)), "1 hour")
    moved = metrics.windowed_plant_metrics(events, ref, S, "60 seconds", "15 seconds")
    plan = moved._jdf.queryExecution().analyzed().toString()
    assert plan.index("Expand") < plan.index("Generate explode")
    sinks.write_table(moved, f"{work}/out", f"{work}/ckpt", NOW).awaitTermination()
    land(dict(plant="P0", at=DAWN + timedelta(days=1)))
    sinks.write_table(metrics.windowed_plant_metrics(telemetry.trusted(telemetry.parse(records(spark, work)), "1 hour"), ref, S, "60 seconds", "15 seconds"),
                      f"{work}/out", f"{work}/ckpt", NOW).awaitTermination()
    batch = metrics.windowed_plant_metrics(telemetry.trusted(telemetry.parse(spark.read.parquet(f"{work}/records"))), ref, S, "60 seconds", "15 seconds")
    key = lambda df: sorted(map(tuple, df.where(F.col("window_end") < F.lit(DAWN + timedelta(hours=1))).collect()))
    assert key(spark.read.parquet(f"{work}/out")) == key(batch) and batch.count() > 100


def test_archive_keeps_what_the_speed_layer_drops(spark, work, land):
    def run():
        accepted = telemetry.normalize(telemetry.accepted(telemetry.judge(telemetry.parse(records(spark, work)))))
        write_archive(accepted, f"{work}/archive", f"{work}/ckpt", NOW).awaitTermination()

    land(dict(event_id="a", energy=10.0), dict(event_id="a", energy=10.0), dict(event_id="b", energy=30.0, sec=7200))
    run()
    land(dict(event_id="late", energy=20.0, sec=60), "{{ corrupt")
    run()
    day = read_days(spark, f"{work}/archive", DAWN.date())
    assert sorted(r.event_id for r in day.collect()) == ["a", "b", "late"]
    assert energy.plant_actuals(day).first().actual_generation_kwh == 30
    assert Path(work, "archive", "simulation_date=2026-08-21", "plant_id=PLANT_01").is_dir()
    plan = read_days(spark, f"{work}/archive", DAWN.date())._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(simulation_date" in plan
    assert read_days(spark, f"{work}/archive", DAWN.date() + timedelta(1)).isEmpty()


def test_whole_speed_layer(spark, work, land, sites, fleet):
    land(dict(inv="INV_01"), dict(inv="INV_02", power=10.0), "{{ corrupt", dict(status="X"))
    live = LiveTables(f"{work}/live", sites(("PLANT_01", 1000.0, 2)),
                      fleet(("PLANT_01", "INV_01", 100.0), ("PLANT_01", "INV_02", 100.0)), S)
    book = ProgressBook()
    spark.streams.addListener(book)
    try:
        for q in start_speed_layer(lambda: records(spark, work), live, f"{work}/archive", f"{work}/ckpt",
                                   invalid_path=f"{work}/invalid", trigger=NOW):
            q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10000)
    finally:
        spark.streams.removeListener(book)
    assert microbatch.live_table(spark, live.root, "portfolio_metrics").first().current_power_kw == 110
    assert microbatch.pipeline_health(spark, live.root).first().status in ("HEALTHY", "DEGRADED")
    assert spark.read.parquet(f"{work}/archive").count() == 2
    invalid = [json.loads(r.value)["rejection_reason"] for r in spark.read.parquet(f"{work}/invalid").collect()]
    assert sorted(invalid) == ["INVALID_STATUS", "UNPARSEABLE_JSON"]
    assert book.latest["quarantine"]["quarantined"] == 2 and not book.failed


def test_batches_bring_what_is_read_and_are_tables(spark, work, land, sites, fleet):
    """The text of a record is not moved, and the stream's plan runs once for all that a batch does."""
    land(dict(inv="INV_01"), dict(inv="INV_01", power=10.0, sec=60))
    brought = []

    class Noting(LiveTables):
        def _write_metrics(self, events, batch_id):
            brought.append(events.columns)
            assert all(f.startswith("file:") for f in events.inputFiles()) and events.inputFiles()
            super()._write_metrics(events, batch_id)

    live = Noting(f"{work}/live", sites(("PLANT_01", 1000.0, 1)), fleet(("PLANT_01", "INV_01", 100.0)), S)
    start_live(records(spark, work), live, f"{work}/ckpt", NOW).awaitTermination()
    assert brought == [list(microbatch.BATCH_COLUMNS)]
    assert microbatch.live_table(spark, live.root, "portfolio_metrics").first().current_power_kw == 10


def hourly(h, inv="INV_01", power=500.0):
    return dict(inv=inv, power=power, at=DAWN + timedelta(hours=h))


STORY = {h: [hourly(h), *([hourly(h, "INV_02", 100.0)] if h not in (2, 3) else []),
             *([hourly(h, "INV_03", 50.0)] if h < 4 else [hourly(h, "INV_03")])] for h in range(7)}


def test_alerts_equal_history_over_restarts(spark, work, land, sites, fleet):
    registry = fleet(*(("PLANT_01", f"INV_0{n}", 1000.0) for n in range(1, 5)))
    live = LiveTables(f"{work}/live", sites(("PLANT_01", 4000.0, 4)), registry, S)
    for h in range(7):
        land(*STORY[h])
        start_live(records(spark, work), live, f"{work}/ckpt", NOW).awaitTermination()
    events = telemetry.trusted(telemetry.parse(spark.read.parquet(f"{work}/records")))
    runs = incidents.sustained_runs(events, registry, 3600, S)
    ref = spark.createDataFrame([("PLANT_01", DAWN.date(), 0.1)], "plant_id string, simulation_date date, ppa_rate_per_kwh double")
    key = lambda df: sorted((r.id, r.status, r.message, str(r.ended_at), round(r.estimated_loss_kwh, 6)) for r in df.collect())
    got = key(microbatch.alerts_table(spark, live.root, ref, S))
    assert got == key(incidents.priced_alerts(runs, ref, S)) and len(got) == 5


def test_a_fleet_that_recovers_has_no_open_alert(spark, work, events, sites, fleet):
    """After the batch that clears the last fault, its slot has no rows: nothing may be taken from an older one."""
    live = LiveTables(f"{work}/live", sites(("PLANT_01", 1000.0, 1)), fleet(("PLANT_01", "INV_01", 1000.0)), S)
    ref = spark.createDataFrame([("PLANT_01", DAWN.date(), 0.1)], "plant_id string, simulation_date date, ppa_rate_per_kwh double")
    for n, power in enumerate((100.0, 100.0, 500.0, 500.0)):
        live(events(hourly(n, power=power)), n)
        rows = microbatch.alerts_table(spark, live.root, ref, S).collect()
        assert [r.status for r in rows] == [[], ["ACTIVE"], ["RESOLVED"], ["RESOLVED"]][n]
        assert quality.alert_violations(microbatch.alerts_table(spark, live.root, ref, S), sites(("PLANT_01", 1000.0, 1))).isEmpty()


@pytest.mark.parametrize("step", ["_write_metrics", "_advance_faults", "_commit", "health"])
def test_a_batch_cut_short_is_in_no_table(spark, work, events, sites, fleet, monkeypatch, step):
    """Fault, fault, then a healthy batch that is lost after each of its writes: nothing of it is seen, and its rerun is."""
    plants = sites(("PLANT_01", 1000.0, 1))
    live = LiveTables(f"{work}/live", plants, fleet(("PLANT_01", "INV_01", 1000.0)), S)
    ref = spark.createDataFrame([("PLANT_01", DAWN.date(), 0.1)], "plant_id string, simulation_date date, ppa_rate_per_kwh double")

    def state():
        return [sorted(map(str, df.collect())) for df in (
            microbatch.alerts_table(spark, live.root, ref, S), microbatch.fault_history(spark, live.root),
            *(microbatch.live_table(spark, live.root, t) for t in ("plant_metrics", "portfolio_metrics")),
            microbatch.pipeline_health(spark, live.root).drop("status", "message"))]

    def lost(self, *a, **k):
        done = getattr(LiveTables, f"real{step}", None)
        if done and step != "_commit":
            done(self, *a, **k)
        raise RuntimeError("cut short")

    for n, power in enumerate((100.0, 100.0)):
        live(events(hourly(n, power=power)), n)
    before = state()
    with monkeypatch.context() as m:
        if step == "health":
            m.setattr(microbatch.monitor, "batch_health", lost)
        else:
            m.setattr(LiveTables, f"real{step}", getattr(LiveTables, step), raising=False)
            m.setattr(LiveTables, step, lost)
        for _ in range(2):
            with pytest.raises(RuntimeError, match="cut short"):
                live(events(hourly(2)), 2)
            assert state() == before
    health = microbatch.pipeline_health(spark, live.root).first()
    assert health.status == "FAILED" and "batch 2 failed: RuntimeError: cut short" in health.message
    assert quality.alert_violations(microbatch.alerts_table(spark, live.root, ref, S), plants).isEmpty()
    live(events(hourly(2)), 2)
    assert microbatch.pipeline_health(spark, live.root).first().status == "HEALTHY"
    assert [r.status for r in microbatch.alerts_table(spark, live.root, ref, S).collect()] == ["RESOLVED"]
    assert microbatch.live_table(spark, live.root, "plant_metrics").count() == 3


def test_nothing_is_seen_before_the_first_commit(spark, work, events, sites, fleet, monkeypatch):
    live = LiveTables(f"{work}/live", sites(("PLANT_01", 1000.0, 1)), fleet(("PLANT_01", "INV_01", 1000.0)), S)
    assert microbatch.live_table(spark, live.root, "plant_metrics").isEmpty() and microbatch.pipeline_health(spark, live.root).isEmpty()
    monkeypatch.setattr(LiveTables, "_commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        live(events(hourly(0, power=100.0)), 0)
    assert microbatch.live_table(spark, live.root, "plant_metrics").isEmpty() and microbatch.fault_history(spark, live.root).isEmpty()
    assert microbatch.pipeline_health(spark, live.root).first().status == "FAILED"


def test_replayed_batch_changes_nothing(spark, work, events, sites, fleet):
    live = LiveTables(f"{work}/live", sites(("PLANT_01", 1000.0, 2)),
                      fleet(("PLANT_01", "INV_01", 1000.0), ("PLANT_01", "INV_02", 1000.0)), S)
    frames = [events(*STORY[h]) for h in range(5)]

    def state():
        keep = lambda df: sorted(map(str, df.drop("last_success_at").collect()))
        return (keep(microbatch.fault_history(spark, live.root)), keep(microbatch.live_table(spark, live.root, "plant_metrics")),
                keep(microbatch.live_table(spark, live.root, "portfolio_metrics")), keep(microbatch.pipeline_health(spark, live.root)))

    for n, frame in enumerate(frames):
        live(frame, n)
        once = state()
        live(frame, n)
        assert state() == once
    # An idle batch keeps the faults and says so.
    live(frames[0].where("false"), 5)
    assert state()[0] == once[0] and microbatch.pipeline_health(spark, live.root).first().status == "DEGRADED"
    live(frames[4], 6)
    assert microbatch.live_table(spark, live.root, "plant_metrics").count() == 6


def test_empty_registry_is_refused(spark, work, sites, fleet):
    with pytest.raises(ValueError):
        LiveTables(work, sites(("A", 1.0, 1)), fleet(("A", "B", 1.0)).where("false"))


def silence_story(spark, work, land, fleet, cut, hours=24, width=60, gap=7200):
    """INV_01 reports hourly; INV_02 is silent from 07:00 to 19:00 and reports a fault at 22:00; INV_03 never
    reports. ``cut`` batches; a last batch brings the closing record of another inverter."""
    registry = fleet(*(("PLANT_01", f"INV_0{n}", 1000.0) for n in (1, 2, 3, 9)))

    def run():
        events = telemetry.trusted(telemetry.parse(records(spark, work)), S.watermark)
        changes = silence.alert_changes(events, registry, width, gap, S, silent_since=DAWN, reading_every_seconds=3600)
        sinks.write_table(changes, f"{work}/out", f"{work}/ckpt", NOW).awaitTermination()

    for h in range(hours):
        land(hourly(h), *([hourly(h, "INV_02", power=100.0 if h >= 20 else 500.0)] if h < 3 or h >= 14 else []), hourly(h, "INV_09"))
        if (h + 1) % (hours // cut) == 0:
            run()
    run()
    return sorted((r.inverter_id, r.change, r.alert_type, r.first_observed_at, r.last_observed_at, r.observation_count, r.sum_loss_kw,
                   r.ended_at or DAWN) for r in spark.read.parquet(f"{work}/out").collect())


@pytest.mark.parametrize("cut", [1, 4, 12])
def test_silence_does_not_depend_on_the_cut(spark, work, land, fleet, cut):
    """Silence counts from two hours after the last reading; how the stream was cut changes nothing."""
    at = lambda h: DAWN + timedelta(hours=h)
    got = silence_story(spark, work, land, fleet, cut)
    assert got == sorted([
        ("INV_02", "OPENED", "TELEMETRY_GAP", at(4), at(6), 2, 0.0, DAWN),
        ("INV_02", "RESOLVED", "TELEMETRY_GAP", at(4), at(12), 5, 0.0, at(14)),
        ("INV_02", "OPENED", "UNDERPERFORMANCE", at(20), at(21), 2, 800.0, DAWN),
        ("INV_02", "REFRESHED", "UNDERPERFORMANCE", at(20), at(22), 3, 1200.0, DAWN),
        ("INV_03", "OPENED", "TELEMETRY_GAP", at(2), at(4), 2, 0.0, DAWN)])


def test_gap_must_exceed_window_and_reading_distance(spark, work, land, fleet):
    """An hourly healthy inverter, seen through six-hour windows, is never silent."""
    land(*(hourly(h) for h in range(3)))
    events = telemetry.trusted(telemetry.parse(records(spark, work)), S.watermark)
    for gap in (7200, 6 * 3600, 7 * 3600):
        with pytest.raises(ValueError):
            silence.alert_changes(events, fleet(("PLANT_01", "INV_01", 1000.0)), 6 * 3600, gap, S, reading_every_seconds=3600)
    land(*(hourly(h) for h in range(3, 40)))
    changes = silence.alert_changes(events, fleet(("PLANT_01", "INV_01", 1000.0)), 6 * 3600, 7 * 3600 + 1, S, reading_every_seconds=3600)
    sinks.write_table(changes, f"{work}/out", f"{work}/ckpt", NOW).awaitTermination()
    assert spark.read.parquet(f"{work}/out").count() == 0


def test_faults_by_event_time(spark, work, land, fleet):
    registry = fleet(("PLANT_01", "INV_01", 1000.0))
    land(*(hourly(h, power=100.0 if 1 <= h <= 3 else 500.0) for h in range(6)))
    changes = silence.alert_changes(telemetry.trusted(telemetry.parse(records(spark, work)), S.watermark), registry, 60, 86400, S, reading_every_seconds=3600)
    sinks.write_table(changes, f"{work}/out", f"{work}/ckpt", NOW).awaitTermination()
    got = sorted((r.last_observed_at.hour, r.change, r.observation_count, r.sum_loss_kw, r.ended_at and r.ended_at.hour)
                 for r in spark.read.parquet(f"{work}/out").collect())
    assert got == [(7, "OPENED", 2, 800, None), (8, "REFRESHED", 3, 1200, None), (8, "RESOLVED", 3, 1200, 9)]


def test_kafka_source_and_sink_options(spark, events):
    """What the connector would be handed; there is no broker here."""
    from unittest.mock import MagicMock

    from wattscope.sources.records import kafka_records
    session, given = MagicMock(), {}
    reader = session.readStream.format.return_value
    reader.option.side_effect = lambda k, v: given.update({k: v}) or reader
    kafka_records(session, "broker:9092", "telemetry", "latest", 500)
    session.readStream.format.assert_called_once_with("kafka")
    assert given == {"kafka.bootstrap.servers": "broker:9092", "subscribe": "telemetry", "startingOffsets": "latest",
                     "failOnDataLoss": "false", "maxOffsetsPerTrigger": 500}
    reader.load.return_value.select.assert_called_once_with("key", "value", "topic", "partition", "offset", "timestamp")
    with pytest.raises(ValueError):
        sinks.write_quarantine(None, "ckpt")
    with pytest.raises(ValueError):
        sinks.write_quarantine(None, "ckpt", path="p", kafka={"topic": "t"})


def test_lifecycle_takes_rows(spark, work, land, fleet):
    """No data frame is made for an inverter."""
    land(dict(inv="INV_01"))
    events = telemetry.trusted(telemetry.parse(records(spark, work)), S.watermark)
    changes = silence.alert_changes(events, fleet(("PLANT_01", "INV_01", 1000.0)), 60, 86400, S)
    assert "TransformWithStateInPySpark" in changes._jdf.queryExecution().analyzed().toString()
    assert not hasattr(silence, "pd")
