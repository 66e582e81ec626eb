"""The immutable telemetry archive: Parquet by day and plant."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wattscope import schema
from wattscope.operators.telemetry import archive_rows, deduplicate
from wattscope.sources.folding import TARGET_BYTES, DayTable

_OWN_TYPES = {"event_time": T.TimestampType(), "kafka_partition": T.IntegerType(), "kafka_offset": T.LongType(), "simulation_date": T.DateType()}
_READ_TYPES = {f.name: f.dataType for f in schema.TELEMETRY} | _OWN_TYPES
ARCHIVE = T.StructType([T.StructField(c, _READ_TYPES.get(c, T.StringType())) for c in schema.ARCHIVE_COLUMNS])


def write_archive(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                  files_per_partition: int = 16) -> StreamingQuery:
    """Append accepted, normalized events; own checkpoint, so no other sink holds it up.

    Feed it events *before* deduplication: the stream's deduplication also drops late events,
    and the archive exists so that the daily job sees them. Rows are gathered by day and plant
    (otherwise every task writes a sliver of every plant), each plant over a few tasks so that
    a large one does not sit in a single file.
    """
    rows = archive_rows(events)
    part = F.pmod(F.xxhash64("event_id"), F.lit(files_per_partition))
    writer = (rows.repartition(*schema.ARCHIVE_PARTITIONS, part)
              .writeStream.format("parquet").outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint)
              .partitionBy(*schema.ARCHIVE_PARTITIONS))
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()


def _table(path: str) -> DayTable:
    day, *inner = schema.ARCHIVE_PARTITIONS
    return DayTable(path, day, ARCHIVE, tuple(inner), ("plant_id", "inverter_id", "event_time"), deduplicate)


def read_days(spark: SparkSession, path: str, first: date, last: date | None = None) -> DataFrame:
    """The archive's events of a day or an inclusive range of days, each event once.

    Only the folders of these days are listed. Days that are folded hold each event once already; copies are
    looked for where files lie beside them. A file of a batch that was cut short is read too: its events come
    again with the batch, as copies.
    """
    return _table(path).read(spark, first, last).select(*schema.ARCHIVE_COLUMNS)


def archived_days(spark: SparkSession, path: str) -> list[date]:
    return _table(path).days(spark)


def fold_day(spark: SparkSession, path: str, day: date, target_bytes: int = TARGET_BYTES) -> int:
    """Fold a day that is over into few files; late events are read beside them and folded next time."""
    return _table(path).fold(spark, day, target_bytes)


def expire_day(spark: SparkSession, path: str, day: date) -> int:
    """Remove what the folded day replaces. From then on only ``read_days`` can read the archive: the stream's own
    list of files still names what is gone."""
    return _table(path).expire(spark, day)
