"""Sinks of the speed layer that need no per-batch code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wattscope.operators.telemetry import quarantine_records

CONSOLE_COLUMNS = ("event_time", "plant_id", "inverter_id", "active_power_kw", "irradiance_wm2",
                   "status", "simulator_scenario", "payload_parsed")


def write_quarantine(judged: DataFrame, checkpoint: str, path: str | None = None,
                     kafka: dict[str, str] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Rejected records to the invalid topic (``kafka``: the sink's options) or to files.

    Counted on the way by ``observe``: progress events carry ``quarantined``, with no job of
    its own. A batch without rejects writes nothing.
    """
    if (path is None) == (kafka is None):
        raise ValueError("give either a path or kafka options")
    records = quarantine_records(judged).observe("quarantine", F.count(F.lit(1)).alias("quarantined"))
    writer = (records.writeStream.queryName("quarantine").outputMode("append")
              .option("checkpointLocation", checkpoint))
    if trigger:
        writer = writer.trigger(**trigger)
    if kafka is not None:
        return writer.format("kafka").options(**kafka).start()
    return writer.format("parquet").option("path", path).start()


def write_console(parsed: DataFrame, checkpoint: str) -> StreamingQuery:
    """Decoded telemetry on the console, to see that anything arrives at all."""
    return (parsed.select(*CONSOLE_COLUMNS).writeStream.format("console").outputMode("append")
            .option("truncate", "false").option("numRows", 20)
            .option("checkpointLocation", checkpoint).start())


def write_table(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append finished rows (closed windows) as Parquet. Each row is written exactly once."""
    writer = (rows.writeStream.format("parquet").outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint))
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
