"""Reconciliation, stored-table checks, registry, serving queries, upsert, health, scenarios."""

from __future__ import annotations

import tempfile
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wattscope.functions import model
from wattscope.operators import monitor, quality, reconcile, registry, scenarios, serving, upsert
from wattscope.sources import portfolio_json, report_csv
from tests.conftest import DAWN

DAY = date(2026, 8, 21)
REF = "simulation_date date, plant_id string, expected_generation_kwh double, ppa_rate_per_kwh double, maintenance_flag boolean"
ACT = ("simulation_date date, plant_id string, actual_generation_kwh double, availability_pct double, "
       "downtime_minutes double")


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.fixture
def settle(spark):
    def run(ref, act, counts=None):
        r = spark.createDataFrame([(DAY, p, e, 0.15, m) for p, e, m in ref], REF)
        a = spark.createDataFrame([(DAY, p, k, 95.0, 12.0) for p, k in act], ACT)
        return reconcile.reconcile(r, a, counts)
    return run


def test_worked_example(spark, settle):
    counts = spark.createDataFrame([(DAY, "A", 2)], "simulation_date date, plant_id string, alert_count long")
    row = settle([("A", 1000.0, False)], [("A", 800.0)], counts).first()
    assert (row.performance_pct, row.estimated_lost_energy_kwh) == (80, 200)
    assert row.estimated_actual_revenue == pytest.approx(120) and row.estimated_lost_revenue == pytest.approx(30)
    assert (row.alert_count, row.availability_pct, row.downtime_minutes, row.problems, row.warnings) == (2, 95, 12, [], [])


@pytest.mark.parametrize("ref,act,problems,warnings", [
    ((("A", 1000.0, False),), (), [], ["NO_TELEMETRY"]),
    ((("A", 1000.0, False),), (("A", 1000.0),), [], []),
    ((("A", 1000.0, False),), (("A", 1200.0),), [], ["ABOVE_FORECAST"]),
    ((("A", 1000.0, True),), (("A", 500.0),), [], ["MAINTENANCE"]),
    ((("A", 1000.0, False),), (("A", 3000.0),), [], ["ABOVE_FORECAST"]),
    ((("A", 1000.0, True),), (("A", 3000.1),), ["IMPLAUSIBLE_PERFORMANCE"], []),
    ((("A", 1000.0, False),), (("A", -1.0),), ["NEGATIVE_GENERATION"], []),
    ((("A", 0.0, False),), (("A", 1.0),), ["EXPECTATION_NOT_POSITIVE"], []),
    ((), (("A", 1.0),), ["NO_REFERENCE_ROW"], []),
])
def test_verdicts(settle, ref, act, problems, warnings):
    row = settle(ref, act).first()
    assert (row.problems, row.warnings) == (problems, warnings)


def test_silent_plant_is_zero_not_missing(settle):
    row = settle([("A", 1000.0, False)], []).first()
    assert (row.actual_generation_kwh, row.performance_pct, row.availability_pct) == (0, 0, 0)
    assert row.estimated_lost_revenue == 150


def test_beating_the_forecast_is_no_negative_loss(settle):
    row = settle([("A", 1000.0, False)], [("A", 1200.0)]).first()
    assert (row.estimated_lost_energy_kwh, row.estimated_lost_revenue) == (0, 0)


def test_a_day_is_published_whole_or_not_at_all(settle):
    done = settle([("A", 1000.0, False), ("B", 1.0, False)], [("A", 800.0), ("B", 9.0)])
    assert reconcile.summary_rows(done).count() == 1 and reconcile.publishable(done).isEmpty()


def test_totals_are_weighted(settle):
    row = reconcile.totals(reconcile.summary_rows(
        settle([("A", 1000.0, False), ("B", 100.0, False)], [("A", 900.0), ("B", 40.0)]))).first()
    assert row.performance_pct == pytest.approx(940 / 1100 * 100) and row.plant_count == 2


def test_days_without_feed(spark):
    days = spark.createDataFrame([(DAY,), (DAY + timedelta(1),)], "simulation_date date")
    ref = spark.createDataFrame([(DAY, "A", 1.0, 1.0, False)], REF)
    assert [r[0] for r in reconcile.unreferenced_days(days, ref).collect()] == [DAY + timedelta(1)]


# --- stored tables ---------------------------------------------------------------

@pytest.fixture
def plants(spark):
    return spark.createDataFrame([("A", "Alpha", 100.0, True), ("B", "Beta", 50.0, True), ("C", "Gone", 10.0, False)],
                                 "plant_id string, plant_name string, capacity_kw double, active boolean")


def test_summary_checks(spark, settle, plants):
    good = reconcile.summary_rows(settle([("A", 1000.0, False), ("B", 100.0, False)], [("A", 900.0), ("B", 40.0)]))
    ref = spark.createDataFrame([(DAY, p, 1.0, 1.0, False) for p in "AB"], REF)
    assert quality.summary_problems(good, ref, plants).isEmpty()
    broken = good.where("plant_id = 'A'").withColumns({
        "performance_pct": F.lit(50.0), "estimated_lost_revenue": F.lit(None).cast("double"),
        "estimated_actual_revenue": F.lit(-1.0)})
    got = {(r.plant_id, r.problem) for r in quality.summary_problems(broken, ref, plants).collect()}
    assert got == {("B", "PLANT_NOT_SUMMARISED"), (None, "ROW_COUNT_DIFFERS"), ("A", "PERFORMANCE_INCONSISTENT"),
                   ("A", "LOST_REVENUE"), ("A", "ACTUAL_REVENUE")}
    with pytest.raises(quality.QualityError) as e:
        quality.gate(quality.summary_problems(broken, ref, plants), "stored", show=2)
    assert e.value.count == 5 and len(e.value.examples) == 2


ALERT = ("id string, plant_id string, inverter_id string, alert_type string, severity string, message string, "
         "started_at timestamp, ended_at timestamp, status string, estimated_loss_kwh double, estimated_revenue_loss double")


def alert(spark, *rows):
    base = dict(id="1", plant="A", inv="I", kind="UNDERPERFORMANCE", sev="WARNING", start=DAWN, end=None, status="ACTIVE")
    data = []
    for r in rows:
        r = {**base, **r}
        data.append((r["id"], r["plant"], r["inv"], r["kind"], r["sev"], "m", r["start"], r["end"], r["status"], 1.0, None))
    return spark.createDataFrame(data, ALERT)


def test_alert_checks(spark, plants):
    assert quality.alert_violations(alert(spark, {}), plants).isEmpty()
    bad = alert(spark, {}, dict(id="2"), dict(id="3", plant="X"), dict(id="4", inv="J", end=DAWN),
                dict(id="5", status="RESOLVED", end=DAWN - timedelta(1)), dict(id="6", kind="OTHER", inv="K"),
                dict(id="6", inv="L"))
    got = {(r.check, r.key) for r in quality.alert_violations(bad, plants).collect()}
    assert got == {("PRIMARY_KEY", "6"), ("FOREIGN_KEY", "X"), ("CHECK", "end_matches_status:4"),
                   ("CHECK", "interval_ordered:5"), ("CHECK", "kind:6"), ("ONE_ACTIVE", "A|I|UNDERPERFORMANCE")}


# --- registry ----------------------------------------------------------------------

def test_portfolio_file(spark):
    path = folder() + "/portfolio.json"
    Path(path).write_text("\n".join([
        '{"id":"A","name":"Alpha","capacity_kw":4000,"inverters":[{"id":"1","rated_power_kw":2000},{"id":"2","name":"Two","rated_power_kw":2000}]}',
        '{"id":"B","capacity_kw":1000,"inverters":[{"id":"1","rated_power_kw":500},{"id":"1","rated_power_kw":-1}]}',
        '{"id":"B","capacity_kw":0,"inverters":[{"id":" ","rated_power_kw":5}]}',
        '{"id":"C","capacity_kw":10,"inverters":[]}']))
    plants, units = portfolio_json.read_portfolio(spark, path)
    row = plants.where("plant_id = 'A'").first()
    assert (row.plant_name, row.timezone, row.active) == ("Alpha", "UTC", True)
    assert {r.inverter_name for r in units.where("plant_id = 'A'").collect()} == {"1", "Two"}
    got = {(r.plant_id, r.inverter_id, r.level, r.problem) for r in registry.portfolio_problems(plants, units).collect()}
    assert {("B", None, "error", "PLANT_DUPLICATE"), ("B", None, "error", "CAPACITY_NOT_POSITIVE"),
            ("C", None, "error", "NO_INVERTERS"), ("B", None, "error", "INVERTER_ID_MISSING"),
            ("B", "1", "error", "INVERTER_DUPLICATE"), ("B", "1", "error", "RATING_NOT_POSITIVE"),
            ("B", None, "warning", "CAPACITY_MISMATCH")} == got
    assert ("B", None, "error", "CAPACITY_MISMATCH") in {
        (r.plant_id, r.inverter_id, r.level, r.problem)
        for r in registry.portfolio_problems(plants, units, strict=True).collect()}


def test_references_count_what_is_in_service(spark, plants):
    units = spark.createDataFrame([("A", "1", 10.0, True), ("A", "2", 10.0, False), ("C", "1", 5.0, True)],
                                  "plant_id string, inverter_id string, rated_power_kw double, active boolean")
    got = {r.plant_id: (r.capacity_kw, r.configured_inverters) for r in registry.plant_reference(plants, units).collect()}
    assert got == {"A": (100, 1), "B": (50, 0)}
    assert registry.installed_capacity(plants).first()[0] == 150
    assert registry.installed_capacity(plants.where("false")).first()[0] == 0


# --- serving -----------------------------------------------------------------------

METRIC = ("plant_id string, window_start timestamp, window_end timestamp, current_power_kw double, avg_power_kw double, "
          "expected_power_kw double, availability_pct double, performance_pct double, estimated_loss_kw double, "
          "online_inverters long, offline_inverters long")


@pytest.fixture
def live(spark):
    def row(p, minute, power, perf):
        at = DAWN + timedelta(minutes=minute)
        return (p, at, at, power, power, 10.0, 100.0, perf, 0.0, 1, 0)
    return spark.createDataFrame([row("A", 0, 1.0, 10.0), row("A", 5, 2.0, 20.0), row("C", 1, 3.0, None)], METRIC)


def at(minute, second=0):
    return F.lit(DAWN + timedelta(minutes=minute, seconds=second))


def test_plants_list(plants, live):
    got = serving.plants_list(plants, live, at(6)).collect()
    assert [(r.plant_id, r.active, r.current_power_kw, r.data_status) for r in got] == [
        ("A", True, 2, "LIVE"), ("B", True, None, "NO_DATA"), ("C", False, 3, "STALE")]
    assert [r.plant_id for r in serving.plant_ranking(serving.plants_list(plants, live, at(6))).collect()] == ["A", "B", "C"]


@pytest.mark.parametrize("second,status", [(60, "LIVE"), (61, "STALE"), (-5, "LIVE")])
def test_freshness_boundary(spark, second, status):
    row = spark.range(1).select(model.freshness(at(0), at(0, second), 60).alias("s")).first()
    assert row.s == status


def test_plant_live(plants, live):
    assert serving.plant_live(plants, live, at(6), "A").first().current_power_kw == 2
    row = serving.plant_live(plants, live, at(6), "B").first()
    assert (row.data_status, row.timestamp, row.online_inverters) == ("NO_DATA", None, None)
    with pytest.raises(LookupError):
        serving.plant_live(plants, live, at(6), "X")


def test_portfolio_live(plants, live):
    row = serving.portfolio_live(live.drop("plant_id"), plants, at(5, 30)).first()
    assert (row.current_power_kw, row.installed_capacity_kw, row.data_status) == (2, 150, "LIVE")
    row = serving.portfolio_live(live.where("false"), plants, at(5)).first()
    assert (row.current_power_kw, row.installed_capacity_kw, row.data_status) == (None, 150, "NO_DATA")


def test_history_is_inclusive_and_bounded(live):
    got = serving.plant_history(live, DAWN, DAWN + timedelta(minutes=5), "A").collect()
    assert [r.current_power_kw for r in got] == [1, 2]
    with pytest.raises(ValueError):
        serving.plant_history(live, DAWN, DAWN - timedelta(1))
    with pytest.raises(ValueError):
        serving.plant_history(live, DAWN, DAWN + timedelta(32))


def test_alerts_listing(spark):
    rows = alert(spark, dict(id="1", start=DAWN), dict(id="2", start=DAWN + timedelta(1), status="RESOLVED", end=DAWN + timedelta(2)),
                 dict(id="3", start=DAWN + timedelta(1), plant="B", sev="CRITICAL"))
    ids = lambda **f: [r.id for r in serving.alerts_listing(rows, **f).collect()]
    assert ids() == ["3", "1", "2"] and ids(limit=1) == ["3"]
    assert ids(status="resolved") == ["2"] and ids(plant_id="B") == ["3"] and ids(severity="WARNING") == ["1", "2"]
    for limit in (0, 501):
        with pytest.raises(ValueError):
            ids(limit=limit)


def test_report(spark, settle, plants):
    summary = reconcile.summary_rows(settle([("A", 1000.0, False), ("B", 100.0, False)], [("A", 900.0), ("B", 40.0)]))
    row = serving.daily_report(summary, plants).first()
    assert (row.best_plant_id, row.worst_plant_name, row.plant_count) == ("A", "Beta", 2)
    tied = summary.withColumn("performance_pct", F.lit(7.0))
    row = serving.daily_report(tied, plants).first()
    assert (row.best_plant_id, row.worst_plant_id) == ("B", "A")
    none = serving.daily_report(summary.withColumn("performance_pct", F.lit(None).cast("double")), plants).first()
    assert none.best_plant_id is None and none.plant_count == 2
    assert serving.daily_report(summary.where("false"), plants).isEmpty()
    assert [r.plant_id for r in serving.daily_rows(summary, plants).collect()] == ["B", "A"]


def test_report_export(spark, settle, plants):
    summary = reconcile.summary_rows(settle([("A", 1000.0, False)], [("A", 900.0)])).withColumn(
        "availability_pct", F.lit(None).cast("double"))
    quoted = plants.withColumn("plant_name", F.lit('The "big", one'))
    out = folder() + "/report"
    report_csv.export_report(serving.daily_rows(summary, quoted), out)
    text = next(Path(out, "simulation_date=2026-08-21").glob("*.csv")).read_text().splitlines()
    assert text[0].startswith("plant_id,plant_name,") and text[1].startswith('A,"The ""big"", one",900.0,1000.0,90.0,,')


def test_display(spark):
    row = spark.createDataFrame([(1250.0, 940.0, None)], "a double, b double, c double").select(
        *(model.display_amount(F.col(c), "W").alias(c) for c in "abc"),
        model.display_age(at(0), at(0, 42)).alias("s"), model.display_age(at(0), at(5)).alias("m"),
        model.display_age(at(0), at(180)).alias("h"), model.utc_text(at(0)).alias("t")).first()
    assert tuple(row) == ("1.25 MW", "940.0 kW", "—", "42s ago", "5m ago", "3h ago", "2026-08-21 05:00:00.000+00")


# --- upsert, health, scenarios ----------------------------------------------------------

def test_upsert_touches_only_what_arrives(spark):
    path = folder() + "/t"
    ddl = "day date, k string, v int"
    rows = lambda *r: spark.createDataFrame([(DAY + timedelta(d), k, v) for d, k, v in r], ddl)
    upsert.upsert_partitions(rows((0, "a", 1), (0, "b", 1), (1, "a", 1)), path, ["day", "k"], "day")
    untouched = sorted(Path(path, f"day={DAY + timedelta(1)}").glob("*.parquet"))
    for _ in range(2):
        upsert.upsert_partitions(rows((0, "b", 2), (0, "c", 2)), path, ["day", "k"], "day")
    got = {(r.day.day, r.k, r.v) for r in spark.read.parquet(path).collect()}
    assert got == {(21, "a", 1), (21, "b", 2), (21, "c", 2), (22, "a", 1)}
    assert sorted(Path(path, f"day={DAY + timedelta(1)}").glob("*.parquet")) == untouched


def test_an_upsert_rewrites_the_files_that_hold_its_keys(spark, monkeypatch):
    path = folder() + "/t"
    ddl = "day date, k string, v int"
    rows = lambda *r: spark.createDataFrame([(None if d is None else DAY + timedelta(d), k, v) for d, k, v in r], ddl)
    for k in "abcdefgh":
        rows((0, k, 1), (0, k + k, 1)).coalesce(1).write.mode("append").partitionBy("day").parquet(path)
    rows((1, "a", 1), (None, "n", 1)).write.mode("append").partitionBy("day").parquet(path)
    files = lambda: set(Path(path).rglob("*.parquet"))
    held = lambda: sorted((str(r.day), r.k, r.v) for r in spark.read.schema(ddl).parquet(path).collect())
    before = files()
    assert upsert.upsert_files(rows((0, "c", 2), (0, "new", 2)), path, ["day", "k"], "day") == 1
    want = sorted([(str(DAY), k * n, 2 if k * n == "c" else 1) for k in "abcdefgh" for n in (1, 2)] + [(str(DAY), "new", 2), (str(DAY + timedelta(1)), "a", 1), ("None", "n", 1)])
    assert len(before - files()) == 1 and held() == want
    # Cut short before it is decided, and when the new files are in and the old ones not yet out.
    for name, value in (("_carry_out", "d"), ("unquote", "e")):
        with monkeypatch.context() as m:
            m.setattr(upsert, name, lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                upsert.upsert_files(rows((0, value, 3)), path, ["day", "k"], "day")
        upsert.recover(spark, path)
        want = sorted((*r[:2], 3) if r[:2] == (str(DAY), value) else r for r in want)
        assert held() == want
    undecided = Path(path, "_upserts", "x", "new")
    undecided.mkdir(parents=True)
    assert upsert.upsert_files(rows((5, "x", 1)), path, ["day", "k"], "day") == 0 and len(held()) == len(want) + 1
    assert not list(Path(path, "_upserts").iterdir())


def test_fused_checks_find_what_the_single_ones_find(spark):
    """And read the table once."""
    plants = spark.createDataFrame([("A",), ("B",)], "plant_id string")
    ddl = "plant_id string, k int, v double, w double"
    rows = [("A", 1, 1.0, 1.0), ("A", 1, -1.0, 1.0), ("A", 1, -1.0, None), ("B", 2, None, -5.0), ("C", 2, -1.0, -1.0), (None, None, 1.0, 1.0), (None, None, -1.0, 1.0)]
    path = folder() + "/t"
    spark.createDataFrame(rows, ddl).write.parquet(path)
    df, rules = spark.read.parquet(path), {"v": F.col("v") >= 0, "w": F.col("w") >= 0}
    for key in (["plant_id", "k"], ["k"]):
        got = quality.fused_violations(df, "t", key, rules, plants)
        want = quality.union_all([quality.duplicate_keys(df, "t", key), quality.orphans(df, "t", plants), quality.broken_rows(df, "t", key, rules)])
        show = lambda x: sorted(map(str, x.collect()))
        assert show(got) == show(want) and got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan") == 1
    assert quality.fused_violations(df.where("false"), "t", ["k"], rules, plants).isEmpty()
    assert show(quality.fused_violations(df.drop("plant_id"), "t", ["k"], {}, plants)) == show(quality.duplicate_keys(df, "t", ["k"]))


def test_rollup_levels(spark):
    ddl = "simulation_date date, plant_id string, actual_generation_kwh double, expected_generation_kwh double, estimated_lost_energy_kwh double, estimated_actual_revenue double, estimated_lost_revenue double, alert_count bigint"
    rows = spark.createDataFrame([(DAY, "A", 50.0, 100.0, 50.0, 1.0, 1.0, 2), (DAY, "B", 300.0, 300.0, 0.0, 2.0, 0.0, 0), (DAY + timedelta(1), "A", 0.0, 0.0, 0.0, 0.0, 0.0, 1)], ddl)
    got = {(r.level, r.simulation_date, r.plant_id): (r.performance_pct, r.row_count, r.alert_count) for r in reconcile.rolled_up(rows).collect()}
    assert len(got) == 6 and got["day", DAY, None] == (87.5, 2, 2) and got["all", None, None] == (87.5, 3, 3) and got["plant", DAY + timedelta(1), "A"] == (None, 1, 1)
    assert reconcile.rolled_up(rows.where("false")).isEmpty()


def test_health_marks_only_move_forward(spark, events):
    ok = monitor.batch_health(events(dict(sec=60)), F.lit(DAWN + timedelta(hours=1)))
    idle = monitor.batch_health(events(dict()).where("false"), F.lit(DAWN + timedelta(hours=2)))
    failed = monitor.status_row(spark, monitor.STREAM, "FAILED", "x", F.lit(DAWN + timedelta(hours=9)))
    a = monitor.merge_health(ok, idle).first()
    assert (a.status, a.last_event_at, a.last_success_at.hour) == ("DEGRADED", DAWN + timedelta(seconds=60), 7)
    b = monitor.merge_health(monitor.merge_health(ok, idle), failed).first()
    assert (b.status, b.last_success_at.hour, b.message) == ("FAILED", 7, "x")


def test_quarantine_rate(spark):
    rows = spark.createDataFrame([(DAWN + timedelta(seconds=s), "X") for s in (0, 30, 59, 60)],
                                 "rejected_at timestamp, rejection_reason string")
    assert [(r.records, r.per_second) for r in monitor.quarantine_rate(rows).orderBy("window_start").collect()] == \
        [(3, 0.05), (1, 1 / 60)]


WINDOW = ("scenario string, start_second double, end_second double, plant_id string, inverter_id string, "
          "power_factor double")


def test_scenarios_match_by_time_and_target(spark, events):
    script = spark.createDataFrame([("INV_UNDERPERFORMANCE", 90.0, 150.0, "A", "1", 0.45), ("TELEMETRY_GAP", 150.0, 160.0, "A", None, None),
                                    ("RECOVERY", 160.0, 170.0, None, None, None)], WINDOW)
    midnight = datetime(2026, 8, 21)
    scale = 86400 / 300

    def ev(second, plant, inv):
        return dict(plant=plant, inv=inv, at=midnight + timedelta(seconds=second * scale))

    rows = events(ev(89.99, "A", "1"), ev(90, "A", "1"), ev(90, "A", "2"), ev(149.99, "A", "1"), ev(150, "A", "2"),
                  ev(155, "B", "1"), ev(165, "B", "9"), ev(170, "B", "9"))
    got = scenarios.label_events(rows, script, 300.0).orderBy("kafka_offset").collect()
    assert [r.scenario and r.scenario[:3] for r in got] == [None, "INV", None, "INV", "TEL", None, "REC", None]


def test_schedule_problems(spark):
    script = spark.createDataFrame([
        ("INV_UNDERPERFORMANCE", 0.0, 10.0, "A", "1", None), ("INV_OFFLINE", 5.0, 20.0, None, "1", 0.5),
        ("RECOVERY", 30.0, 30.0, None, None, None), ("RECOVERY", 290.0, 301.0, None, None, None),
        ("INV_UNDERPERFORMANCE", -1.0, 0.0, "A", "1", 1.0)], WINDOW)
    got = {(r.start_second, r.problem) for r in scenarios.schedule_problems(script, 300.0).collect()}
    assert got == {(0, "FACTOR_MISSING"), (5, "INVERTER_WITHOUT_PLANT"), (5, "FACTOR_NOT_APPLICABLE"), (5, "OVERLAPS"),
                   (30, "EMPTY"), (290, "ENDS_AFTER_DAY"), (-1, "STARTS_BEFORE_DAY"), (-1, "FACTOR_OUT_OF_RANGE")}
