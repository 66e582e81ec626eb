"""The speed layer as a set of streaming queries over one record stream."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from wattscope.operators import metrics, telemetry
from wattscope.settings import FleetSettings
from wattscope.sources.archive import write_archive
from wattscope.streaming.microbatch import BATCH_COLUMNS, LiveTables
from wattscope.streaming.sinks import write_quarantine, write_table


def start_live(records: DataFrame, live: LiveTables, checkpoint: str,
               trigger: dict | None = None) -> StreamingQuery:
    """Metrics, faults and health per microbatch. Only what these read is moved to the event's id."""
    sound = telemetry.normalize(telemetry.accepted(telemetry.judge(telemetry.parse(records))))
    events = telemetry.deduplicate(sound.select("event_id", *BATCH_COLUMNS), live.settings.watermark)
    writer = (events.writeStream.queryName("live").outputMode("append")
              .option("checkpointLocation", checkpoint).foreachBatch(live))
    return (writer.trigger(**trigger) if trigger else writer).start()


def start_windowed(records: DataFrame, plant_reference: DataFrame, path: str, checkpoint: str,
                   s: FleetSettings = FleetSettings(), trigger: dict | None = None) -> StreamingQuery:
    """Plant metrics per event-time window, each row written once when its window closes."""
    events = telemetry.trusted(telemetry.parse(records), s.watermark)
    rows = metrics.windowed_plant_metrics(events, plant_reference, s, s.window_width, s.window_slide)
    return write_table(rows, path, checkpoint, trigger)


def start_speed_layer(records: Callable[[], DataFrame], live: LiveTables, archive_path: str,
                      checkpoints: str, invalid_path: str | None = None,
                      invalid_topic: dict[str, str] | None = None,
                      trigger: dict | None = None) -> list[StreamingQuery]:
    """Live tables, archive and quarantine, each with its own source and checkpoint, so that
    none can hold back or replay another. ``records`` opens the source.

    The caller waits with ``spark.streams.awaitAnyTermination()``: the pipeline is whole only
    while all three run.
    """
    judged = lambda: telemetry.judge(telemetry.parse(records()))
    return [
        start_live(records(), live, f"{checkpoints}/live", trigger),
        write_archive(telemetry.normalize(telemetry.accepted(judged())), archive_path,
                      f"{checkpoints}/archive", trigger),
        write_quarantine(judged(), f"{checkpoints}/quarantine", invalid_path, invalid_topic, trigger),
    ]


class ProgressBook(StreamingQueryListener):
    """Keeps the newest figures of each query: rows, watermark, quarantined records."""

    def __init__(self) -> None:
        self.latest: dict[str, dict] = {}
        self.failed: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self.latest.setdefault(event.name or str(event.id), {"started_at": datetime.now()})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        book = self.latest.setdefault(p.name or str(p.id), {})
        book.update(batch_id=p.batchId, rows=p.numInputRows, at=p.timestamp)
        newest = (p.eventTime or {}).get("max")
        if newest:
            # Text in ISO form, so the later instant is the greater string.
            book["last_event_at"] = max(newest, book.get("last_event_at", ""))
        for row in (p.observedMetrics or {}).values():
            for name, value in row.asDict().items():
                book[name] = book.get(name, 0) + value

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed[str(event.id)] = event.exception
