"""From raw records to trusted events: parse, judge, split, normalize, deduplicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattscope import schema
from wattscope.operators.pick import first_per_key

_CORRUPT = "_corrupt_record"


def parse(raw: DataFrame) -> DataFrame:
    """Typed telemetry columns next to the transport columns and the original text.

    Keeps every record. The payload's ``timestamp`` is read as text so that one bad
    date does not void the record; ``event_time`` is NULL where it is no instant.
    """
    contract = T.StructType([*schema.TELEMETRY.fields, T.StructField(_CORRUPT, T.StringType())])
    body = F.col("value").cast("string")
    doc = F.from_json(body, contract, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    # Generated columns are a wall for the optimizer: a filter on the verdict would otherwise be
    # pushed below the decoding and decode the text again for every field it mentions.
    decoded = raw.select(
        F.inline(F.array(doc)),
        F.col("key").cast("string").alias("kafka_key"),
        *(F.col(c).alias(f"kafka_{c}") for c in ("topic", "partition", "offset", "timestamp")),
        body.alias("raw_payload"))
    return decoded.withColumnRenamed("timestamp", "event_timestamp_raw").select(
        *("event_timestamp_raw" if f.name == "timestamp" else f.name for f in schema.TELEMETRY),
        "kafka_key", "kafka_topic", "kafka_partition", "kafka_offset", "kafka_timestamp",
        "raw_payload",
        # Bad text still yields a struct, so only the corrupt column tells.
        (F.col("raw_payload").isNotNull() & F.col(_CORRUPT).isNull()).alias("payload_parsed"),
        F.try_to_timestamp("event_timestamp_raw").alias("event_time"))


def _rejections() -> list[tuple[str, Column]]:
    power, energy = F.col("active_power_kw"), F.col("energy_today_kwh")
    sun, up = F.col("irradiance_wm2"), F.col("availability")
    non_finite = F.lit(False)
    for reading in (power, energy, sun, up):
        # Infinity fails a range check or is caught here; NaN compares above every bound.
        non_finite = non_finite | F.coalesce(F.isnan(reading) | (F.abs(reading) == float("inf")),
                                             F.lit(False))
    return [
        ("UNPARSEABLE_JSON", ~F.col("payload_parsed")),
        ("MISSING_EVENT_ID", F.col("event_id").isNull()),
        ("MISSING_PLANT_ID", F.col("plant_id").isNull()),
        ("MISSING_INVERTER_ID", F.col("inverter_id").isNull()),
        ("INVALID_TIMESTAMP", F.col("event_time").isNull()),
        ("INVALID_STATUS", ~F.coalesce(F.col("status").isin(*schema.STATUSES), F.lit(False))),
        ("NEGATIVE_ACTIVE_POWER", power < 0),
        ("NEGATIVE_ENERGY", energy < 0),
        ("NEGATIVE_IRRADIANCE", sun < 0),
        ("IRRADIANCE_OUT_OF_RANGE", sun > schema.MAX_IRRADIANCE_WM2),
        ("AVAILABILITY_OUT_OF_RANGE", (up < 0) | (up > 1)),
        # Ours: a NaN power passes "< 0" and would poison every sum it enters.
        ("NON_FINITE_READING", non_finite),
    ]


def judge(parsed: DataFrame) -> DataFrame:
    """Add ``rejection_reason``: the first rule a record breaks, NULL when it is usable."""
    return parsed.withColumn(
        "rejection_reason",
        F.coalesce(*(F.when(broken, F.lit(reason)) for reason, broken in _rejections())))


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where("rejection_reason is null").drop("rejection_reason")


def rejected(judged: DataFrame) -> DataFrame:
    return judged.where("rejection_reason is not null")


def normalize(events: DataFrame) -> DataFrame:
    """Fill what an accepted event left out: no reading is zero, availability follows status."""
    implied = F.when(F.col("status") == "OFFLINE", 0.0).otherwise(1.0)
    return events.withColumns({
        **{c: F.coalesce(F.col(c), F.lit(0.0))
           for c in ("active_power_kw", "energy_today_kwh", "irradiance_wm2")},
        "availability": F.coalesce(F.col("availability"), implied),
    })


def deduplicate(events: DataFrame, watermark: str = "2 minutes") -> DataFrame:
    """One row per ``event_id``.

    On a stream: within the watermark, so the remembered ids stay bounded. On a table: the
    copy that arrived first. The copies collapse before the shuffle, so an id repeated
    millions of times costs one row per task.
    """
    if events.isStreaming:
        return (events.withWatermark("event_time", watermark)
                .dropDuplicatesWithinWatermark(["event_id"]))
    arrival = [F.col(c) for c in ("kafka_timestamp", "kafka_partition", "kafka_offset")
               if c in events.columns]
    return first_per_key(events, ["event_id"], arrival) if arrival else events.dropDuplicates(["event_id"])


def trusted(parsed: DataFrame, watermark: str = "2 minutes") -> DataFrame:
    """Accepted, normalized, deduplicated telemetry."""
    return deduplicate(normalize(accepted(judge(parsed))), watermark)


def quarantine_records(judged: DataFrame, rejected_at: Column | None = None) -> DataFrame:
    """Rejected records as key/value for the invalid topic; nulls are kept in the JSON."""
    body = F.struct(
        F.col("rejection_reason"),
        (F.current_timestamp() if rejected_at is None else rejected_at).alias("rejected_at"),
        F.col("event_id"), F.col("plant_id"), F.col("inverter_id"), F.col("event_timestamp_raw"),
        F.col("kafka_topic").alias("source_topic"),
        F.col("kafka_partition").alias("source_partition"),
        F.col("kafka_offset").alias("source_offset"),
        F.col("raw_payload"),
    )
    return rejected(judged).select(
        F.coalesce(F.col("kafka_key"), F.lit("unattributed")).alias("key"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def archive_rows(events: DataFrame) -> DataFrame:
    """The archive's columns; the day is the event's own, not the day it was processed."""
    return (events.withColumn("simulation_date", F.to_date("event_time"))
            .select(*schema.ARCHIVE_COLUMNS))
