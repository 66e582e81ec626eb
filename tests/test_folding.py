"""Folded days hold the same rows in few files, and readers switch at one instant."""

from __future__ import annotations

import tempfile
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wattscope import schema
from wattscope.operators.telemetry import archive_rows
from wattscope.session import hadoop_files
from wattscope.settings import FleetSettings
from wattscope.sources import folding
from wattscope.sources.archive import ARCHIVE, expire_day, fold_day, read_days
from wattscope.streaming import microbatch
from wattscope.streaming.microbatch import LiveTables

START = datetime(2026, 8, 1)


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def written(spark, root, rows, files=4):
    """Rows (event_id, plant, day, second, power) in some files for each day and plant."""
    data = [(e, p, "INV_1", w, 1.0, 1.0, None, None, "ONLINE", 1.0, START + timedelta(days=d, seconds=s), None, "t", 0, n) for n, (e, p, d, s, w) in enumerate(rows)]
    names = [c for c in schema.ARCHIVE_COLUMNS if c != "simulation_date"]
    df = spark.createDataFrame(data, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ARCHIVE if f.name in names))
    archive_rows(df).repartition(files).write.mode("append").partitionBy(*schema.ARCHIVE_PARTITIONS).parquet(root)


def held(df):
    return sorted(map(tuple, df.select("event_id", "plant_id", "active_power_kw", "event_time", "simulation_date").collect()))


def read_files(df):
    return [f for f in df.inputFiles()]


def test_a_folded_day_is_the_same_in_few_files(spark, root):
    day = START.date()
    rows = [(f"e{i}", f"P {i % 7}/x", i % 3, i * 7, float(i)) for i in range(900)] + [("e3", "P 3/x", 0, 21, 3.0)] * 5
    written(spark, root, rows, 12)
    before = {n: held(read_days(spark, root, day + timedelta(n))) for n in range(3)}
    assert len(before[0]) == 300
    many = len(read_files(read_days(spark, root, day)))
    size = sum(f.stat().st_size for f in Path(root, f"simulation_date={day}").rglob("*.parquet"))
    assert fold_day(spark, root, day, size // 3) == many and fold_day(spark, root, day) == 0
    folded = read_days(spark, root, day)
    files = read_files(folded)
    assert held(folded) == before[0] and len(files) <= 4 < many and all("_folded" in f for f in files)
    # No copies to look for, so no exchange.
    assert "Exchange" not in folded._jdf.queryExecution().executedPlan().toString()
    # Files are ranges of plants: one file names few of them.
    assert max(spark.read.parquet(f).select("plant_id").distinct().count() for f in files) < 7
    # Late rows, one of them a copy, lie beside it and go in next time.
    written(spark, root, [("late", "P 0/x", 0, 1, 5.0), ("e9", "P 2/x", 0, 63, 9.0)], 1)
    late = sorted([*before[0], ("late", "P 0/x", 5.0, START + timedelta(seconds=1), day)])
    assert held(read_days(spark, root, day)) == late and len(read_files(read_days(spark, root, day))) == len(files) + 2
    assert fold_day(spark, root, day) == 2 and held(read_days(spark, root, day)) == late and len(read_files(read_days(spark, root, day))) == 1
    # What is replaced can go.
    assert expire_day(spark, root, day) == many + 2 and held(read_days(spark, root, day)) == late
    assert not list(Path(root, f"simulation_date={day}").rglob("*.parquet")) and fold_day(spark, root, day) == 0
    written(spark, root, [("later", "P 0/x", 0, 2, 5.0)], 1)
    assert fold_day(spark, root, day) == 1 and len(read_days(spark, root, day).collect()) == 302
    assert held(read_days(spark, root, day + timedelta(1), day + timedelta(2))) == sorted(before[1] + before[2])


def test_a_fold_that_dies_changes_nothing(spark, root, monkeypatch):
    day = START.date()
    written(spark, root, [(f"e{i}", "P", 0, i, 1.0) for i in range(50)])
    before = held(read_days(spark, root, day))
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            fold_day(spark, root, day)
    again = read_days(spark, root, day)
    assert held(again) == before and not any("_folded" in f for f in read_files(again))
    assert fold_day(spark, root, day) > 0 and held(read_days(spark, root, day)) == before


def test_one_of_thirty_days_is_listed(spark, root):
    day = START.date()
    written(spark, root, [(f"e{i}", f"P{i % 2}", i % 30, i, 1.0) for i in range(120)], 2)
    fold_day(spark, root, day + timedelta(5))
    for n in (4, 5):
        df = read_days(spark, root, day + timedelta(n))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryFileIndex(1 paths)" in plan and "PartitionFilters: [isnotnull(simulation_date" in plan
        assert df.count() == 4 and {f.split("simulation_date=")[1][:10] for f in read_files(df)} == {str(day + timedelta(n))}
    both = read_days(spark, root, day + timedelta(4), day + timedelta(5))
    assert both.count() == 8
    assert read_days(spark, root, day + timedelta(40)).isEmpty() and read_days(spark, f"{root}/none", day).isEmpty()


def test_live_days_fold_committed_batches_only(spark, root, events, sites, fleet, monkeypatch):
    live = LiveTables(f"{root}/live", sites(("PLANT_01", 1000.0, 1)), fleet(("PLANT_01", "INV_01", 1000.0)), FleetSettings())
    for n in range(3):
        live(events(dict(sec=n)), n)
    with monkeypatch.context() as m:
        m.setattr(LiveTables, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            live(events(dict(sec=3)), 3)
    day = microbatch.live_table(spark, live.root, "plant_metrics").first().metric_date
    state = lambda: [sorted(map(str, df.collect())) for df in (microbatch.live_days(spark, live.root, "plant_metrics", day),
                                                               microbatch.live_table(spark, live.root, "plant_metrics"))]
    before = state()
    assert before[0] == before[1] and len(before[0]) == 3
    assert microbatch.fold_live_day(spark, live.root, "plant_metrics", day) == 3 and state() == before
    assert len(read_files(microbatch.live_days(spark, live.root, "plant_metrics", day))) == 2  # the folded one and the batch cut short
    assert microbatch.expire_live_day(spark, live.root, "plant_metrics", day) == 3 and state() == before
    live(events(dict(sec=4)), 3)
    assert len(state()[0]) == 4 and microbatch.fold_live_day(spark, live.root, "plant_metrics", day) == 1 and len(state()[1]) == 4
    assert microbatch.live_table(spark, live.root, "plant_metrics", F.lit(day + timedelta(1))).isEmpty()
    path, files = hadoop_files(spark, f"{live.root}/plant_metrics/_folded/lists")
    assert files.exists(path) and folding.TARGET_BYTES > 1 << 20
