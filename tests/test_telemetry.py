from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wattscope import schema
from wattscope.operators import contract, telemetry

GOOD = {
    "event_id": "11111111-1111-4111-8111-111111111111", "plant_id": "PLANT_01", "inverter_id": "INV_01",
    "active_power_kw": 422.7, "energy_today_kwh": 2150.2, "irradiance_wm2": 782.4,
    "module_temp_c": 47.3, "inverter_temp_c": 51.0, "status": "ONLINE", "availability": 1.0,
    "timestamp": "2026-08-21T05:00:00Z", "simulator_scenario": None,
}


def record(offset=0, text=None, **changes):
    body = json.dumps({**GOOD, **changes}) if text is None else text
    value = None if body == "<null>" else bytearray(body.encode())
    return (bytearray(b"PLANT_01:INV_01"), value, "t", 0, offset, datetime(2026, 8, 21, 5) + timedelta(seconds=offset))


@pytest.fixture(scope="module")
def raw(spark):
    return lambda *rows: spark.createDataFrame(list(rows), schema.RAW_RECORD)


def reasons(raw, *rows):
    judged = telemetry.judge(telemetry.parse(raw(*rows)))
    return [r.rejection_reason for r in judged.orderBy("kafka_offset").collect()]


def test_parse_keeps_every_field(raw):
    row = telemetry.parse(raw(record())).first()
    assert row.payload_parsed and row.active_power_kw == 422.7 and row.kafka_key == "PLANT_01:INV_01"
    assert row.event_time == datetime(2026, 8, 21, 5) and row.event_timestamp_raw == GOOD["timestamp"]


def test_parse_never_drops(raw):
    rows = telemetry.parse(raw(record(0, "{{ corrupt"), record(1, "<null>"), record(2, "[]"), record(3, "{}"))) \
        .orderBy("kafka_offset").collect()
    assert [r.payload_parsed for r in rows] == [False, False, False, True]
    assert rows[0].raw_payload == "{{ corrupt" and rows[1].raw_payload is None


def test_offset_in_timestamp_is_honoured(raw):
    row = telemetry.parse(raw(record(timestamp="2026-08-21T07:00:00+02:00"))).first()
    assert row.event_time == datetime(2026, 8, 21, 5)


def test_reasons(raw):
    cases = [
        ({}, None), ({"text": "{{ corrupt"}, "UNPARSEABLE_JSON"), ({"text": "<null>"}, "UNPARSEABLE_JSON"),
        ({"active_power_kw": "not-a-number"}, "UNPARSEABLE_JSON"), ({"text": "{}"}, "MISSING_EVENT_ID"),
        ({"plant_id": None}, "MISSING_PLANT_ID"), ({"inverter_id": None}, "MISSING_INVERTER_ID"),
        ({"timestamp": "not-a-timestamp"}, "INVALID_TIMESTAMP"), ({"timestamp": None}, "INVALID_TIMESTAMP"),
        ({"status": None}, "INVALID_STATUS"), ({"status": "BROKEN"}, "INVALID_STATUS"),
        ({"active_power_kw": -0.1}, "NEGATIVE_ACTIVE_POWER"), ({"energy_today_kwh": -1.0}, "NEGATIVE_ENERGY"),
        ({"irradiance_wm2": -1.0}, "NEGATIVE_IRRADIANCE"), ({"irradiance_wm2": 1500.1}, "IRRADIANCE_OUT_OF_RANGE"),
        ({"irradiance_wm2": 1500.0}, None), ({"availability": 1.1}, "AVAILABILITY_OUT_OF_RANGE"),
        ({"availability": 0.5}, None), ({"active_power_kw": float("nan")}, "NON_FINITE_READING"),
        ({"active_power_kw": None}, None),
        # The first broken rule names the record.
        ({"event_id": None, "active_power_kw": -1.0}, "MISSING_EVENT_ID"),
    ]
    rows = [record(n, **dict(c)) for n, (c, _) in enumerate(cases)]
    assert reasons(raw, *rows) == [want for _, want in cases]


def test_normalize_fills_gaps(raw):
    bare = dict(active_power_kw=None, energy_today_kwh=None, irradiance_wm2=None, availability=None)
    parsed = telemetry.parse(raw(record(0, **bare), record(1, **bare, status="OFFLINE")))
    rows = telemetry.normalize(telemetry.accepted(telemetry.judge(parsed))).orderBy("kafka_offset").collect()
    assert [(r.active_power_kw, r.energy_today_kwh, r.irradiance_wm2, r.availability) for r in rows] == \
        [(0, 0, 0, 1), (0, 0, 0, 0)]


def test_first_arrival_wins(raw):
    rows = [record(5, active_power_kw=1.0), record(2, active_power_kw=2.0), record(9, active_power_kw=3.0)]
    got = telemetry.trusted(telemetry.parse(raw(*rows))).collect()
    assert [(r.active_power_kw, r.kafka_offset) for r in got] == [(2.0, 2)]


def test_quarantine_keeps_nulls_and_source(raw):
    row = telemetry.quarantine_records(telemetry.judge(telemetry.parse(raw(record(7, "{{ x"))))).first()
    doc = json.loads(row.value)
    assert len(doc) == 10 and doc["plant_id"] is None and doc["source_offset"] == 7
    assert doc["raw_payload"] == "{{ x" and doc["rejection_reason"] == "UNPARSEABLE_JSON" and doc["rejected_at"]


def test_unattributed_key(spark, raw):
    keyless = raw(record(0, "{{ x")).withColumn("key", F.lit(None).cast("binary"))
    assert telemetry.quarantine_records(telemetry.judge(telemetry.parse(keyless))).first().key == "unattributed"


def test_json_is_decoded_once(raw):
    plan = telemetry.trusted(telemetry.parse(raw(record())))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_archive_day_is_event_day(raw):
    late = record(0, timestamp="2026-08-20T23:59:59Z")
    row = telemetry.archive_rows(telemetry.trusted(telemetry.parse(raw(late)))).first()
    assert str(row.simulation_date) == "2026-08-20" and tuple(row.asDict()) == schema.ARCHIVE_COLUMNS


def test_strict_contract(spark, raw, fleet):
    registry = fleet(("PLANT_01", "INV_01", 500.0))
    cases = [
        ({}, None, []), ({"inverter_id": "INV_77"}, "UNKNOWN_ASSET", []),
        ({"active_power_kw": 500.1}, "POWER_EXCEEDS_RATING", []),
        ({"status": "OFFLINE"}, "STATUS_INCONSISTENT", []),
        ({"status": "OFFLINE", "availability": 0, "active_power_kw": 0}, None, []),
        ({"status": "WARNING", "availability": 0}, "STATUS_INCONSISTENT", []),
        ({"availability": 0.5}, "AVAILABILITY_OUT_OF_RANGE", ["availability"]),
        ({"module_temp_c": 121}, "SCHEMA_VIOLATION", ["module_temp_c"]),
        ({"timestamp": "2026-08-21 05:00:00"}, "SCHEMA_VIOLATION", ["timestamp"]),
        ({"simulator_scenario": "OTHER"}, "SCHEMA_VIOLATION", ["simulator_scenario"]),
        ({"extra": 1}, "SCHEMA_VIOLATION", ["+extra"]),
        ({"active_power_kw": -1, "status": "X"}, "NEGATIVE_ACTIVE_POWER", ["active_power_kw", "status"]),
        ({"event_id": "nope"}, "SCHEMA_VIOLATION", ["event_id"]),
    ]
    rows = [record(n, **c) for n, (c, _, _) in enumerate(cases)]
    got = contract.producer_reason(telemetry.parse(raw(*rows)), registry).orderBy("kafka_offset").collect()
    assert [(r.source_reason, sorted(r.violations)) for r in got] == [(w, v) for _, w, v in cases]


def test_missing_key_is_a_violation(raw):
    doc = {k: v for k, v in GOOD.items() if k != "simulator_scenario"}
    got = contract.producer_reason(telemetry.parse(raw(record(0, json.dumps(doc))))).first()
    assert got.violations == ["simulator_scenario"] and got.source_reason == "SCHEMA_VIOLATION"


value = st.one_of(st.none(), st.floats(-10, 2000), st.just("text"))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.fixed_dictionaries({"active_power_kw": value, "irradiance_wm2": value, "availability": value,
                                       "status": st.sampled_from(["ONLINE", "OFFLINE", "X", None])}), min_size=1))
def test_split_partitions_the_input(raw, rows):
    judged = telemetry.judge(telemetry.parse(raw(*(record(n, **r) for n, r in enumerate(rows)))))
    assert telemetry.accepted(judged).count() + telemetry.rejected(judged).count() == len(rows)
