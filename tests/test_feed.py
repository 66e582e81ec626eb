from __future__ import annotations

import tempfile
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wattscope import schema
from wattscope.operators import feed, forecast
from wattscope.sources import feed_csv

DAY = date(2026, 8, 21)
ROW = dict(simulation_date="2026-08-21", plant_id="PLANT_01", plant_capacity_kw="4000",
           expected_generation_kwh="20000", expected_peak_power_kw="3800", forecast_irradiance_kwh_m2="5.2",
           ppa_rate_per_kwh="0.15", maintenance_flag="false", source_version="v1")


@pytest.fixture
def rows(spark):
    def build(*changes):
        data = [(DAY, n, *({**ROW, **c}[k] for k in schema.FEED_COLUMNS)) for n, c in enumerate(changes, 1)]
        return spark.createDataFrame(data, "feed_date date, position long, "
                                     + ", ".join(f"{c} string" for c in schema.FEED_COLUMNS))
    return build


@pytest.fixture
def expected(spark):
    return spark.createDataFrame([("PLANT_01",), ("PLANT_02",)], "plant_id string")


def problems(assessed, expected):
    return sorted((r.position or 0, r.problem) for r in feed.feed_problems(assessed, expected).collect())


def test_sound_feed(rows, expected):
    a = feed.assess(rows({}, {"plant_id": " PLANT_02 ", "maintenance_flag": "Yes"}))
    assert problems(a, expected) == []
    got = feed.sound_rows(a, feed.feed_problems(a, expected)).orderBy("plant_id").collect()
    assert [(r.plant_id, r.maintenance_flag, r.plant_capacity_kw) for r in got] == \
        [("PLANT_01", False, 4000), ("PLANT_02", True, 4000)]


@pytest.mark.parametrize("change,want", [
    ({"plant_capacity_kw": "lots"}, "NOT_A_NUMBER"), ({"plant_capacity_kw": ""}, "NOT_A_NUMBER"),
    ({"plant_capacity_kw": None}, "NOT_A_NUMBER"), ({"ppa_rate_per_kwh": "nan"}, "NUMBER_MISSING"),
    ({"plant_capacity_kw": "-1"}, "CAPACITY_NOT_POSITIVE"), ({"expected_generation_kwh": "0"}, "GENERATION_NOT_POSITIVE"),
    ({"expected_peak_power_kw": "0"}, "PEAK_NOT_POSITIVE"), ({"forecast_irradiance_kwh_m2": "-0.1"}, "IRRADIANCE_NEGATIVE"),
    ({"ppa_rate_per_kwh": "-1"}, "RATE_NEGATIVE"), ({"expected_peak_power_kw": "4000.1"}, "PEAK_ABOVE_CAPACITY"),
    ({"expected_generation_kwh": "56001"}, "SUN_HOURS_IMPLAUSIBLE"), ({"maintenance_flag": "perhaps"}, "NOT_A_BOOLEAN"),
    ({"source_version": " "}, "SOURCE_VERSION_MISSING"), ({"simulation_date": ""}, "DATE_MISSING"),
    ({"simulation_date": "21.08.2026"}, "DATE_INVALID"),
])
def test_row_problems(rows, expected, change, want):
    a = feed.assess(rows({}, {**change, "plant_id": "PLANT_02"}))
    assert (2, want) in problems(a, expected)


def test_limits_are_inclusive(rows, expected):
    a = feed.assess(rows({"expected_peak_power_kw": "4000", "expected_generation_kwh": "56000"}, {"plant_id": "PLANT_02"}))
    assert problems(a, expected) == []


def test_every_problem_is_reported(rows, expected):
    a = feed.assess(rows({"plant_capacity_kw": "x", "maintenance_flag": "x"}, {}, {"plant_id": ""}, {"plant_id": "PLANT_09"}))
    assert problems(a, expected) == [
        (0, "PLANT_NOT_IN_FEED"), (0, "PLANT_UNKNOWN"), (1, "NOT_A_BOOLEAN"), (1, "NOT_A_NUMBER"),
        (2, "DUPLICATE_PLANT"), (3, "PLANT_ID_MISSING")]
    assert feed.sound_rows(a, feed.feed_problems(a, expected)).isEmpty()


def test_empty_registry_asks_for_nothing(rows, expected):
    assert problems(feed.assess(rows({})), expected.where("false")) == []


def test_dates(rows, expected):
    mixed = feed.assess(rows({}, {"plant_id": "PLANT_02", "simulation_date": "2026-08-22"}))
    assert problems(mixed, expected) == [(0, "DATES_MIXED")]
    other = feed.assess(rows(*({"plant_id": p, "simulation_date": "2026-08-20T00:00:00"} for p in ("PLANT_01", "PLANT_02"))))
    assert problems(other, expected) == [(0, "DATE_NOT_REQUESTED")]


# --- files ---------------------------------------------------------------------

@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def put(folder, day, lines, header=",".join(schema.FEED_COLUMNS)):
    Path(folder, f"daily_reference_{day}.csv").write_text("\n".join([header, *lines]) + "\n")


def line(**c):
    return ",".join({**ROW, **c}[k] for k in schema.FEED_COLUMNS)


def test_read_numbers_rows_in_file_order(spark, folder):
    put(folder, "2026-08-21", [line(), line(plant_id="PLANT_02"), line()])
    put(folder, "2026-08-22", [line(simulation_date="2026-08-22")])
    rows, bad = feed_csv.read_feed(spark, folder)
    got = [(str(r.feed_date), r.position, r.plant_id) for r in rows.orderBy("feed_date", "position").collect()]
    assert got == [("2026-08-21", 1, "PLANT_01"), ("2026-08-21", 2, "PLANT_02"), ("2026-08-21", 3, "PLANT_01"),
                   ("2026-08-22", 1, "PLANT_01")]
    assert bad.isEmpty()


def test_columns_are_found_by_name(spark, folder):
    put(folder, "2026-08-21", [line()])
    turned = list(reversed(schema.FEED_COLUMNS))
    put(folder, "2026-08-22", [",".join([*(ROW[c] for c in turned), "z"])], ",".join([*turned, "note"]))
    put(folder, "2026-08-23", [line().rsplit(",", 1)[0]], ",".join(schema.FEED_COLUMNS[:-1]))
    put(folder, "2026-08-24", [])
    rows, bad = feed_csv.read_feed(spark, folder)
    assert {(r.feed_date.day, r.plant_id, r.source_version) for r in rows.collect()} == \
        {(21, "PLANT_01", "v1"), (22, "PLANT_01", "v1")}
    assert {(r.feed_date.day, r.level, r.problem) for r in bad.collect()} == {
        (22, "warning", "COLUMN_UNEXPECTED"), (23, "error", "COLUMN_MISSING"), (24, "error", "NO_ROWS")}


def test_two_hundred_headers_are_one_read(spark, folder):
    """Each file has its own header; lines are placed by it, quoted fields too, and nothing is read twice."""
    for n in range(200):
        names = list(schema.FEED_COLUMNS[n % 9:] + schema.FEED_COLUMNS[:n % 9]) + [f"x{n}"] * (n % 2)
        row = {**ROW, "plant_id": f"P{n}", "source_version": 'v "1", a'}
        text = [",".join('"' + row.get(c, "z").replace('"', '\\"') + '"' if c == "source_version" else row.get(c, "z") for c in names)]
        put(folder, date(2026, 1, 1) + timedelta(n), ["", *text, "  ", *text], "\ufeff" * (n % 3 == 0) + ",".join(names))
    rows, bad = feed_csv.read_feed(spark, folder)
    got = rows.collect()
    assert len(got) == 400 and {r.plant_id for r in got} == {f"P{n}" for n in range(200)} and {r.position for r in got} == {1, 2}
    assert {r.source_version for r in got} == {'v "1", a'} and all(r.plant_capacity_kw == ROW["plant_capacity_kw"] for r in got)
    assert sorted(r.detail for r in bad.collect()) == sorted(f"x{n}" for n in range(1, 200, 2))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert folder not in plan


def test_forecast_survives_its_own_validation(spark, folder):
    plants = spark.createDataFrame([("PLANT_01", 4000.0, 0.15), ("PLANT_02", 2000.0, None)],
                                   "plant_id string, capacity_kw double, ppa_rate_per_kwh double")
    units = spark.createDataFrame([("PLANT_01", f"I{n}", 1000.0) for n in range(4)] + [("PLANT_02", "I", 2000.0)],
                                  "plant_id string, inverter_id string, rated_power_kw double")
    days = F.array(F.lit(DAY), F.lit(date(2026, 8, 22)))
    # PLANT_01 was seen at six and twelve, on two days; PLANT_02 never, so it takes the fleet's hours.
    at = lambda n, h: datetime(2026, 8, n, h)
    seen = spark.createDataFrame([("PLANT_01", at(1, 6), 100.0, 20.0), ("PLANT_01", at(2, 6), 300.0, 20.0), ("PLANT_01", at(1, 12), 800.0, 45.0),
                                  ("PLANT_03", at(1, 12), 1600.0, 45.0)], "plant_id string, event_time timestamp, irradiance_wm2 double, module_temp_c double")
    made = forecast.forecast_feed(seen, plants, units, days)
    feed_csv.write_feed(made, folder)
    rows, bad = feed_csv.read_feed(spark, folder)
    a = feed.assess(rows)
    assert bad.isEmpty() and feed.feed_problems(a, plants).isEmpty()
    back = {(r.simulation_date, r.plant_id): r for r in feed.typed_rows(a).collect()}
    assert len(back) == 4 and back[(DAY, "PLANT_02")].ppa_rate_per_kwh == 0.085
    one, two = back[(DAY, "PLANT_01")], back[(DAY, "PLANT_02")]
    # A fifth and four fifths of full sun, noon at twenty degrees too many.
    assert one.expected_generation_kwh == pytest.approx(800 + 3200 * 0.92) and one.expected_peak_power_kw == pytest.approx(3200 * 0.92)
    assert one.forecast_irradiance_kwh_m2 == 1.0 and two.forecast_irradiance_kwh_m2 == pytest.approx(1.4)
    assert two.expected_generation_kwh == pytest.approx(400 + 2000 * 0.92)


def test_writing_refuses(spark, folder):
    plants = spark.createDataFrame([("A", 10.0)], "plant_id string, capacity_kw double")
    units = spark.createDataFrame([("A", "I", 10.0)], "plant_id string, inverter_id string, rated_power_kw double")
    seen = spark.createDataFrame([("PLANT_01", datetime(2026, 8, 1, 12), 800.0, 20.0)], "plant_id string, event_time timestamp, irradiance_wm2 double, module_temp_c double")
    made = forecast.forecast_feed(seen, plants, units, F.array(F.lit(DAY)))
    with pytest.raises(feed_csv.FeedError, match="empty"):
        feed_csv.write_feed(made.where("false"), folder)
    with pytest.raises(feed_csv.FeedError, match="twice"):
        feed_csv.write_feed(made.unionByName(made), folder)
    feed_csv.write_feed(made, folder)
    with pytest.raises(feed_csv.FeedError, match="already"):
        feed_csv.write_feed(made, folder)
    feed_csv.write_feed(made, folder, overwrite=True)
    with pytest.raises(Exception):
        feed_csv.read_feed(spark, folder + "/nothing")
