"""Scripted fault windows matched to telemetry by time of day and target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SECONDS_PER_DAY = 86400


def _with_overlaps(windows: DataFrame, slot_seconds: int) -> DataFrame:
    """Add ``overlaps``: whether the window starts inside one that comes before it (by start, then end).

    A window is listed under each slot of the day it touches; what it starts inside of is listed under the
    slot of its start, so slots are looked at by themselves and no task sees the whole script.
    """
    named = windows.withColumn("_id", F.monotonically_increasing_id())
    begin = F.floor(F.col("start_second") / slot_seconds)
    end = F.greatest(F.ceil(F.col("end_second") / slot_seconds) - 1, begin)
    listed = named.select("_id", "start_second", "end_second", begin.alias("_own"), F.explode(F.sequence(begin, end)).alias("_slot"))
    before = (Window.partitionBy("_slot").orderBy("start_second", "end_second", "_id").rowsBetween(Window.unboundedPreceding, -1))
    judged = (listed.withColumn("_until", F.max("end_second").over(before)).where("_slot = _own")
              .select("_id", F.coalesce(F.col("start_second") < F.col("_until"), F.lit(False)).alias("overlaps")))
    return named.join(judged, "_id").drop("_id")


def schedule_problems(windows: DataFrame, day_seconds: float, slot_seconds: int = 900) -> DataFrame:
    """``(scenario, start_second, problem)`` for windows that cannot be trusted."""
    weak = F.col("scenario") == "INV_UNDERPERFORMANCE"
    factor = F.col("power_factor")
    flags = [
        ("STARTS_BEFORE_DAY", F.col("start_second") < 0),
        ("EMPTY", F.col("end_second") <= F.col("start_second")),
        ("ENDS_AFTER_DAY", F.col("end_second") > day_seconds),
        ("INVERTER_WITHOUT_PLANT", F.col("inverter_id").isNotNull() & F.col("plant_id").isNull()),
        ("FACTOR_MISSING", weak & factor.isNull()),
        ("FACTOR_OUT_OF_RANGE", weak & ((factor < 0) | (factor >= 1))),
        ("FACTOR_NOT_APPLICABLE", ~weak & factor.isNotNull()),
        ("OVERLAPS", F.col("overlaps")),
    ]
    checked = _with_overlaps(windows, slot_seconds)
    return checked.select("scenario", "start_second", F.explode(F.array_compact(F.array(
        *(F.when(hit, F.lit(name)) for name, hit in flags)))).alias("problem"))


def label_events(events: DataFrame, windows: DataFrame, reference_day_seconds: float,
                 slot_seconds: int = 900, spread: int = 16) -> DataFrame:
    """Events with the scripted ``scenario`` covering them, NULL where none does.

    Windows are half-open, in seconds of a day of ``reference_day_seconds``, and are scaled to
    the real day. A missing plant or inverter in a window means all of them. A window is listed
    under each slot of the day it touches (at most 86400 / ``slot_seconds`` copies), so the
    match is an equi-join on the slot with the exact bounds as a filter. Spark broadcasts the
    script while it is small; should it not be, a slot is divided by ``spread``, so that a busy
    quarter of an hour does not meet in one task. Windows do not overlap, hence at most one
    match per event.
    """
    scale = _SECONDS_PER_DAY / reference_day_seconds
    script = windows.select(
        "scenario", "power_factor", F.col("plant_id").alias("w_plant"),
        F.col("inverter_id").alias("w_inverter"),
        (F.col("start_second") * scale).alias("w_start"), (F.col("end_second") * scale).alias("w_end"))
    script = script.withColumn("slot", F.explode(F.sequence(
        F.floor(F.col("w_start") / slot_seconds),
        F.greatest(F.ceil(F.col("w_end") / slot_seconds) - 1, F.floor(F.col("w_start") / slot_seconds)))))
    script = script.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    second = F.pmod(F.unix_micros("event_time"), F.lit(_SECONDS_PER_DAY * 1_000_000)) / 1e6
    timed = events.withColumn("second", second).withColumns({
        "slot": F.floor(F.col("second") / slot_seconds),
        "share": F.pmod(F.xxhash64("event_id"), F.lit(spread)).cast("int")})
    e, w = timed.alias("e"), script.alias("w")
    hit = ((F.col("e.slot") == F.col("w.slot")) & (F.col("e.share") == F.col("w.share"))
           & (F.col("e.second") >= F.col("w.w_start")) & (F.col("e.second") < F.col("w.w_end"))
           & (F.col("w.w_plant").isNull() | (F.col("w.w_plant") == F.col("e.plant_id")))
           & (F.col("w.w_inverter").isNull() | (F.col("w.w_inverter") == F.col("e.inverter_id"))))
    return e.join(w, hit, "left").select(
        *(F.col(f"e.{c}") for c in events.columns), "w.scenario", "w.power_factor")
