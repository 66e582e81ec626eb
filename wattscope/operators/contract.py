"""The strict profile of the telemetry contract, as a producer applies it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattscope import schema

# Fixed values of the contract.
ID_PATTERN = r"^[A-Z][A-Z0-9_]*$"
ID_MAX_LENGTH = 64
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
INSTANT_PATTERN = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"
TEMPERATURE_RANGE = (-50.0, 120.0)

_ASSET = ["plant_id", "inverter_id"]


def _field_rules() -> dict[str, Column]:
    """Per contract field, what a conforming value satisfies."""
    def asset_id(c: str) -> Column:
        return F.col(c).rlike(ID_PATTERN) & (F.length(c) <= ID_MAX_LENGTH)

    return {
        "event_id": F.col("event_id").rlike(UUID_PATTERN),
        "plant_id": asset_id("plant_id"),
        "inverter_id": asset_id("inverter_id"),
        "active_power_kw": F.col("active_power_kw") >= 0,
        "energy_today_kwh": F.col("energy_today_kwh") >= 0,
        "irradiance_wm2": F.col("irradiance_wm2").between(0, schema.MAX_IRRADIANCE_WM2),
        "module_temp_c": F.col("module_temp_c").between(*TEMPERATURE_RANGE),
        "inverter_temp_c": F.col("inverter_temp_c").between(*TEMPERATURE_RANGE),
        "status": F.col("status").isin(*schema.STATUSES),
        "availability": F.col("availability").isin(0.0, 1.0),
        "timestamp": F.col("event_timestamp_raw").rlike(INSTANT_PATTERN),
        "simulator_scenario": (F.col("simulator_scenario").isNull()
                               | F.col("simulator_scenario").isin(*schema.SCENARIOS)),
    }


def contract_violations(parsed: DataFrame) -> DataFrame:
    """Add ``violations``: every contract field that is absent or out of bounds, and every
    key the contract does not know (``+name``). Empty for a conforming record."""
    names = [f.name for f in schema.TELEMETRY]
    present = F.coalesce(F.json_object_keys("raw_payload"), F.array().cast("array<string>"))
    broken = [F.when(~F.coalesce(ok, F.lit(False)) | ~F.array_contains(present, name), F.lit(name))
              for name, ok in _field_rules().items()]
    unknown = F.transform(F.array_except(present, F.array(*(F.lit(n) for n in names))),
                          lambda k: F.concat(F.lit("+"), k))
    return parsed.withColumn(
        "violations",
        F.when(F.col("payload_parsed"), F.concat(F.array_compact(F.array(*broken)), unknown))
        .otherwise(F.array(F.lit("<record>"))))


def producer_reason(parsed: DataFrame, inverters: DataFrame | None = None) -> DataFrame:
    """Add ``violations`` and ``source_reason`` (NULL when the record may be published).

    Text that is no telemetry at all is a contract breach and nothing else; then an asset missing from
    ``inverters`` outranks everything; a contract breach is named
    after the physical fault behind it where there is one; then come the checks that need
    the asset's rating or compare fields with each other.
    """
    checked = contract_violations(parsed)
    if inverters is None:
        checked = checked.withColumn("rated_power_kw", F.lit(None).cast("double"))
        unknown_asset = F.lit(False)
    else:
        known = inverters.select(*_ASSET, "rated_power_kw")
        checked = checked.join(known, _ASSET, "left")
        unknown_asset = F.col("rated_power_kw").isNull()

    breach = F.size("violations") > 0
    power, sun, up, status = (F.col(c) for c in
                              ("active_power_kw", "irradiance_wm2", "availability", "status"))
    inconsistent = F.when(status == "OFFLINE", (up != 0) | (power != 0)).otherwise(up != 1)
    ladder = [
        ("SCHEMA_VIOLATION", ~F.col("payload_parsed")),
        ("UNKNOWN_ASSET", unknown_asset),
        ("NEGATIVE_ACTIVE_POWER", breach & (power < 0)),
        ("NEGATIVE_ENERGY", breach & (F.col("energy_today_kwh") < 0)),
        ("NEGATIVE_IRRADIANCE", breach & (sun < 0)),
        ("IRRADIANCE_OUT_OF_RANGE", breach & (sun > schema.MAX_IRRADIANCE_WM2)),
        ("INVALID_STATUS", breach & ~status.isin(*schema.STATUSES)),
        ("AVAILABILITY_OUT_OF_RANGE", breach & ~up.isin(0.0, 1.0)),
        ("SCHEMA_VIOLATION", breach),
        ("POWER_EXCEEDS_RATING", power > F.col("rated_power_kw")),
        ("STATUS_INCONSISTENT", inconsistent),
    ]
    return (checked.withColumn("source_reason",
                               F.coalesce(*(F.when(hit, F.lit(r)) for r, hit in ladder)))
            .drop("rated_power_kw"))
