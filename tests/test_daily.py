from __future__ import annotations

import tempfile
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wattscope import schema
from wattscope.operators import telemetry
from wattscope.operators.quality import QualityError
from wattscope.plans import daily, stream_catalog
from wattscope.plans import testbed as bed
from wattscope.session import prepare
from wattscope.sources import archive

D1 = date(2026, 8, 21)
D2, D3 = D1 + timedelta(1), D1 + timedelta(2)


@pytest.fixture
def setup(spark, events):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = events(*(dict(plant=p, energy=800.0, sec=s) for p in ("A", "B") for s in (0, 86400))).withColumns({
        "module_temp_c": F.lit(1.0), "inverter_temp_c": F.lit(1.0), "simulator_scenario": F.lit(None).cast("string"),
        "kafka_topic": F.lit("t"), "kafka_partition": F.lit(0)})
    telemetry.archive_rows(rows).write.partitionBy(*schema.ARCHIVE_PARTITIONS).parquet(f"{root}/archive")
    Path(root, "feed").mkdir()
    plants = spark.createDataFrame([("A", "Alpha", True), ("B", "Beta", True)], "plant_id string, plant_name string, active boolean")
    return root, plants, daily.DailyTables(f"{root}/tables")


def put(root, day, *rows):
    head = ",".join(schema.FEED_COLUMNS)
    text = [head, *(f"{day},{p},4000,{e},3800,5.2,0.15,false,v1" for p, e in rows)]
    Path(root, "feed", f"daily_reference_{day}.csv").write_text("\n".join(text) + "\n")


def run(spark, setup, first=D1, last=D3, **kw):
    root, plants, tables = setup
    daily.run_days(spark, f"{root}/archive", f"{root}/feed", plants, tables, first, last, **kw)
    got = {(r.simulation_date.day, r.plant_id): r.performance_pct for r in daily.read_summary(spark, tables).collect()}
    found = {(r.simulation_date.day, r.stage, r.plant_id, r.problem) for r in daily.issues(spark, tables).collect()}
    return got, found


def test_range_backfill_and_correction(spark, setup):
    root, plants, tables = setup
    put(root, D1, ("A", 1000), ("B", 1600))
    put(root, D2, ("A", 1000))                      # a plant is missing
    put(root, D3, ("A", 1000), ("B", 1600))         # nothing was archived
    got, found = run(spark, setup)
    assert got == {(21, "A"): 80, (21, "B"): 50}
    assert found == {(22, "feed", "B", "PLANT_NOT_IN_FEED"), (23, "archive", None, "ARCHIVE_EMPTY")}
    assert daily.health(spark, tables, D1, D3).first().status == "FAILED"
    assert daily.health(spark, tables, D1).first().status == "HEALTHY"

    # The feed is reissued: its day is published and its issue gone; other days stay.
    put(root, D2, ("A", 800), ("B", 800))
    for _ in range(2):
        got, found = run(spark, setup, D2, D2)
        assert got == {(21, "A"): 80, (21, "B"): 50, (22, "A"): 100, (22, "B"): 100}
        assert found == {(23, "archive", None, "ARCHIVE_EMPTY")}


def test_implausible_plant_holds_back_its_day(spark, setup):
    root, plants, tables = setup
    put(root, D1, ("A", 1000), ("B", 100))
    got, found = run(spark, setup, D1, D1)
    assert got == {} and found == {(21, "reconcile", "B", "IMPLAUSIBLE_PERFORMANCE")}
    with pytest.raises(QualityError):
        run(spark, setup, D1, D1, strict=True)


def test_day_without_feed(spark, setup):
    put(setup[0], D1, ("A", 1000), ("B", 1600))
    got, found = run(spark, setup, D1, D2)
    assert len(got) == 2 and found == {(22, "feed", None, "FEED_MISSING")}


def test_rerun_withdraws_what_no_longer_holds(spark, setup):
    """A day whose archive is gone loses its actuals; one that fails now is not served from an older run."""
    root, plants, tables = setup
    put(root, D1, ("A", 1000), ("B", 1600))
    put(root, D2, ("A", 1000), ("B", 1600))
    got, found = run(spark, setup, D1, D2)
    assert len(got) == 4 and not found
    Path(root, "archive", f"simulation_date={D2}").rename(Path(root, "moved"))
    put(root, D1, ("A", 1000), ("B", 100))
    got, found = run(spark, setup, D1, D2)
    assert got == {} and found == {(21, "reconcile", "B", "IMPLAUSIBLE_PERFORMANCE"), (22, "archive", None, "ARCHIVE_EMPTY")}
    Path(root, "moved").rename(Path(root, "archive", f"simulation_date={D2}"))
    got, found = run(spark, setup, D2, D2)
    assert set(got) == {(22, "A"), (22, "B")}


def late(spark, events, root, day, event, energy):
    rows = events(dict(event_id=event, plant="A", energy=energy, sec=3600 + 86400 * (day - D1).days)).withColumns({
        "module_temp_c": F.lit(1.0), "inverter_temp_c": F.lit(1.0), "simulator_scenario": F.lit(None).cast("string"),
        "kafka_topic": F.lit("t"), "kafka_partition": F.lit(0)})
    telemetry.archive_rows(rows).write.mode("append").partitionBy(*schema.ARCHIVE_PARTITIONS).parquet(f"{root}/archive")


def test_only_changed_days_run_again(spark, setup, events):
    root, plants, tables = setup
    for day in (D1, D2, D3):
        put(root, day, ("A", 1000), ("B", 1600))
    changed = lambda: daily.run_changed(spark, f"{root}/archive", f"{root}/feed", plants, tables)
    summary = lambda: {(r.simulation_date.day, r.plant_id): r.performance_pct for r in daily.read_summary(spark, tables).collect()}
    assert changed() == [D1, D2, D3] and changed() == []
    before = summary()
    assert before == {(d, p): x for d in (21, 22) for p, x in (("A", 80), ("B", 50))}
    late(spark, events, root, D2, "late", 900.0)
    assert changed() == [D2] and summary() == before | {(22, "A"): 90}
    # A fold moves no figure and starts no run, nor does what it replaces going away.
    archive.fold_day(spark, f"{root}/archive", D2)
    assert changed() == []
    archive.expire_day(spark, f"{root}/archive", D2)
    assert changed() == []
    late(spark, events, root, D2, "later", 950.0)
    assert changed() == [D2] and summary() == before | {(22, "A"): 95}
    put(root, D1, ("A", 800), ("B", 1600))
    late(spark, events, root, D3, "third", 500.0)
    assert changed() == [D1, D3] and summary()[21, "A"] == 100 and changed() == []
    Path(root, "feed", f"daily_reference_{D1}.csv").rename(Path(root, "kept"))
    assert changed() == [D1] and (21, "A") not in summary() and changed() == []


def test_given_tables_are_worked_through_once(spark, monkeypatch):
    """The job's summary with alerts makes and decodes its records once and derives plants and expectations once."""
    calls = []
    for owner, name in ((bed, "raw_records"), (bed, "plants"), (bed, "daily_reference"), (telemetry, "parse"), (stream_catalog, "read_days"), (daily, "read_days")):
        real = getattr(owner, name)
        monkeypatch.setattr(owner, name, lambda *a, _real=real, _name=name, **kw: calls.append(_name) or _real(*a, **kw))
    assert stream_catalog.daily_job_summary(prepare(spark), "/root/testdata/sf0.001").count() > 0
    assert sorted(calls) == ["daily_reference", "parse", "plants", "raw_records", "read_days"]


def test_events_already_read(spark, setup):
    root, plants, tables = setup
    put(root, D1, ("A", 1000), ("B", 1600))
    put(root, D2, ("A", 1000), ("B", 1600))
    want = run(spark, setup, D1, D2)
    events = archive.read_days(spark, f"{root}/archive", D1, D2)
    assert run(spark, (root, plants, daily.DailyTables(f"{root}/again")), D1, D2, events=events) == want
