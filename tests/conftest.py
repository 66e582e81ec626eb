from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wattscope.session import build_session  # noqa: E402

DAWN = datetime(2026, 8, 21, 5, 0, 0)


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
        "spark.log.level": "ERROR",
        # Compiling costs more than it saves on a handful of rows.
        "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"})
    yield session
    session.stop()


EVENTS = ("event_id string, plant_id string, inverter_id string, active_power_kw double, "
          "energy_today_kwh double, irradiance_wm2 double, status string, availability double, "
          "event_time timestamp, kafka_offset long")


@pytest.fixture
def events(spark):
    """Events from dicts; what a test does not say is a healthy default."""
    def build(*rows: dict):
        out = []
        for n, r in enumerate(rows):
            out.append((r.get("event_id", f"e{n}"), r.get("plant", "PLANT_01"), r.get("inv", "INV_01"),
                        r.get("power", 100.0), r.get("energy", 0.0), r.get("sun", 500.0),
                        r.get("status", "ONLINE"), r.get("up", 1.0),
                        r.get("at") or DAWN + timedelta(seconds=r.get("sec", 0)), r.get("offset", n)))
        return spark.createDataFrame(out, EVENTS)
    return build


@pytest.fixture
def fleet(spark):
    def build(*rows):
        return spark.createDataFrame(list(rows), "plant_id string, inverter_id string, rated_power_kw double")
    return build


@pytest.fixture
def sites(spark):
    def build(*rows):
        return spark.createDataFrame(list(rows), "plant_id string, capacity_kw double, configured_inverters int")
    return build
