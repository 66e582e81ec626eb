"""The daily reconciliation job, for a range of days in one run.

Feed present and sound -> archive present -> feed loaded -> energy metered -> reconciled ->
published -> checked. A day that fails a gate is not published and leaves an issue row; the
other days of the range go on. Running days again replaces what is known of them and of no others: a
day whose archive is gone loses its actuals, and one that fails now is withdrawn if it was published before.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattscope import schema
from wattscope.operators import energy, feed, monitor, quality, reconcile
from wattscope.operators.upsert import read_table, replace_partitions, upsert_partitions
from wattscope.session import hadoop_files, materialize
from wattscope.settings import FleetSettings
from wattscope.sources.archive import archived_days, read_days
from wattscope.sources.feed_csv import feed_date, read_feed

ISSUE_COLUMNS = ("simulation_date", "stage", "plant_id", "problem")
ACTUALS_SCHEMA = ("simulation_date date, plant_id string, actual_generation_kwh double, "
                  "availability_pct double, downtime_minutes double, observation_count bigint, "
                  "reporting_inverters bigint")
REFERENCE_SCHEMA = ("simulation_date date, plant_id string, "
                    + ", ".join(f"{c} double" for c in schema.FEED_NUMBERS)
                    + ", maintenance_flag boolean, source_version string")
SUMMARY_SCHEMA = ", ".join(
    f"{c} " + {"simulation_date": "date", "plant_id": "string", "alert_count": "bigint",
               "maintenance_flag": "boolean"}.get(c, "double") for c in schema.SUMMARY_COLUMNS)
RUNS_SCHEMA = "archived boolean, archived_at timestamp, fed_at timestamp, simulation_date date"
ISSUES_SCHEMA = "simulation_date date, step string, stage string, plant_id string, problem string"


@dataclass(frozen=True)
class DailyTables:
    root: str

    @property
    def reference(self) -> str:
        return f"{self.root}/daily_reference"

    @property
    def actuals(self) -> str:
        return f"{self.root}/daily_actuals"

    @property
    def summary(self) -> str:
        return f"{self.root}/daily_plant_summary"

    @property
    def runs(self) -> str:
        return f"{self.root}/daily_runs"

    @property
    def issues(self) -> str:
        return f"{self.root}/daily_issues"


def _issues(df: DataFrame, stage: str, day: str, problem: str) -> DataFrame:
    plant = F.col("plant_id") if "plant_id" in df.columns else F.lit(None)
    return df.select(F.col(day).alias("simulation_date"), F.lit(stage).alias("stage"),
                     plant.cast("string").alias("plant_id"), F.col(problem).alias("problem"))


def run_days(spark: SparkSession, archive: str, feed_path: str, plants: DataFrame,
             tables: DailyTables, first: date, last: date | None = None,
             alerts: DataFrame | None = None, s: FleetSettings = FleetSettings(),
             strict: bool = False, events: DataFrame | None = None) -> None:
    """Reconcile every day of ``[first, last]``. With ``strict`` any issue raises at the end.

    ``events`` are what ``read_days`` has of these days, if the caller has read it already.
    """
    last = last or first
    active = plants.where("active")
    dates = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("simulation_date"))
    requested = F.col("feed_date").between(F.lit(first), F.lit(last))

    rows, files = read_feed(spark, feed_path)
    assessed = materialize(feed.assess(rows.where(requested)), "assessed-feed")
    feed_problems = feed.feed_problems(assessed, active)
    file_errors = files.where(requested & (F.col("level") == "error"))
    undelivered = (dates.join(assessed.select(F.col("feed_date").alias("simulation_date")).distinct(),
                              "simulation_date", "left_anti").withColumn("problem", F.lit("FEED_MISSING")))

    # Each stage is a table the next one reads: lost executors repeat one stage, not the run.
    actuals = energy.plant_actuals(read_days(spark, archive, first, last) if events is None else events, s)
    _replace_days(actuals, dates, tables.actuals)
    day = F.col("simulation_date")
    in_range = day.between(F.lit(first), F.lit(last))
    actuals = read_table(spark, tables.actuals, ACTUALS_SCHEMA).where(in_range & F.col("plant_id").isNotNull())
    empty = (dates.join(actuals.select("simulation_date").distinct(), "simulation_date", "left_anti")
             .withColumn("problem", F.lit("ARCHIVE_EMPTY")))
    gate = quality.union_all([
        _issues(feed_problems, "feed", "feed_date", "problem"),
        _issues(file_errors, "feed", "feed_date", "problem"),
        _issues(undelivered, "feed", "simulation_date", "problem"),
        _issues(empty, "archive", "simulation_date", "problem"),
    ])
    _record(gate, dates, tables, "inputs")
    refused = (_stored_issues(spark, tables).where((F.col("step") == "inputs") & in_range)
               .select("simulation_date").distinct())

    sound = (feed.typed_rows(assessed).drop("feed_date")
             .join(refused, "simulation_date", "left_anti").select(*schema.FEED_COLUMNS))
    upsert_partitions(sound, tables.reference, ["simulation_date", "plant_id"], "simulation_date")
    reference = (read_table(spark, tables.reference, REFERENCE_SCHEMA).where(in_range)
                 .join(refused, "simulation_date", "left_anti"))

    counts = reconcile.alert_counts(alerts) if alerts is not None else None
    reconciled = materialize(reconcile.reconcile(reference, actuals.join(refused, "simulation_date", "left_anti"), counts), "reconciled")
    _replace_days(reconcile.publishable(reconciled), dates, tables.summary)
    problems = _issues(reconcile.remarks(reconciled, "problems"), "reconcile", "simulation_date", "remark")

    # What landed is checked, not what was meant to land.
    unpublished = refused.unionByName(problems.select("simulation_date")).distinct()
    stored = read_summary(spark, tables).where(in_range)
    checked = quality.summary_problems(
        stored.join(unpublished, "simulation_date", "left_anti"),
        reference.join(unpublished, "simulation_date", "left_anti"), plants)
    outcome = problems.unionByName(_issues(checked, "quality", "simulation_date", "problem"))
    _record(outcome, dates, tables, "outcome")
    if strict:
        quality.gate(issues(spark, tables).where(in_range), f"daily run {first}..{last}")


def _newest_files(spark: SparkSession, paths: list[str], day: Column, pattern: str) -> DataFrame:
    """``simulation_date, newest``: when the newest file of each day was written. Files are listed, not read."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(paths)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "simulation_date date, newest timestamp")
    return (files.select(day.alias("simulation_date"), "modificationTime").where("simulation_date is not null")
            .groupBy("simulation_date").agg(F.max("modificationTime").alias("newest")))


def _inputs(spark: SparkSession, archive: str, feed_path: str) -> DataFrame:
    """``simulation_date, archived, archived_at, fed_at``: whether a day has an archive, and how new its inputs are."""
    days = archived_days(spark, archive)
    there = spark.createDataFrame([(d, True) for d in days], "simulation_date date, archived boolean")
    folder = F.to_date(F.nullif(F.regexp_extract("path", r"/simulation_date=(\d{4}-\d{2}-\d{2})/", 1), F.lit("")))
    folders = [f"{archive}/simulation_date={d}" for d in days]
    written = _newest_files(spark, [f for f in folders if (at := hadoop_files(spark, f))[1].exists(at[0])], folder, "*.parquet")
    fed = _newest_files(spark, [feed_path], feed_date(F.col("path")), "*.csv").withColumnRenamed("newest", "fed_at")
    return (there.join(written.withColumnRenamed("newest", "archived_at"), "simulation_date", "left")
            .join(fed, "simulation_date", "full_outer"))


def run_changed(spark: SparkSession, archive: str, feed_path: str, plants: DataFrame, tables: DailyTables,
                alerts: DataFrame | None = None, s: FleetSettings = FleetSettings()) -> list[date]:
    """Run the days whose archive or feed has changed since they were last run; which days those were.

    A run leaves, for each of its days, how new the inputs were when it began, so what arrives meanwhile is
    seen next time. Files that expire do not make a day change; a day whose input is gone altogether does.
    """
    inputs = materialize(_inputs(spark, archive, feed_path), "inputs")
    known = read_table(spark, tables.runs, RUNS_SCHEMA)
    now, was = inputs.alias("now"), known.alias("was")
    newer = lambda c: F.coalesce(F.col(f"now.{c}") > F.col(f"was.{c}"), F.col(f"now.{c}").isNotNull())
    held = lambda c: F.coalesce(c, F.lit(False))
    changed = now.join(was, "simulation_date", "full_outer").where(
        newer("archived_at") | newer("fed_at") | (held(F.col("now.archived")) != held(F.col("was.archived")))
        | (F.col("now.fed_at").isNull() & F.col("was.fed_at").isNotNull())).select("simulation_date")
    days = sorted(r[0] for r in changed.collect())
    start = 0
    for n, day in enumerate(days):
        if n + 1 == len(days) or days[n + 1] != day + timedelta(1):
            run_days(spark, archive, feed_path, plants, tables, days[start], day, alerts, s)
            start = n + 1
    if days:
        ran = spark.createDataFrame([(d,) for d in days], "simulation_date date")
        replace_partitions(ran.join(inputs, "simulation_date", "left"), tables.runs, ["simulation_date"])
    return days


def _replace_days(rows: DataFrame, dates: DataFrame, path: str) -> None:
    """Replace every requested day. A day without rows gets an empty mark (no plant), so that nothing older stays."""
    replace_partitions(rows.unionByName(dates, allowMissingColumns=True), path, ["simulation_date"])


def _record(found: DataFrame, dates: DataFrame, tables: DailyTables, step: str) -> None:
    """Replace the issues of every requested day; a day without any leaves an empty mark, so
    that what an earlier run found is gone."""
    marks = dates.select("simulation_date", *(F.lit(None).cast("string").alias(c)
                                              for c in ISSUE_COLUMNS[1:]))
    replace_partitions(found.unionByName(marks).withColumn("step", F.lit(step)), tables.issues,
                       ["step", "simulation_date"])


def _stored_issues(spark: SparkSession, tables: DailyTables) -> DataFrame:
    return read_table(spark, tables.issues, ISSUES_SCHEMA).where("problem is not null")


def issues(spark: SparkSession, tables: DailyTables) -> DataFrame:
    return _stored_issues(spark, tables).select(*ISSUE_COLUMNS)


def read_summary(spark: SparkSession, tables: DailyTables) -> DataFrame:
    return read_table(spark, tables.summary, SUMMARY_SCHEMA).where("plant_id is not null")


def health(spark: SparkSession, tables: DailyTables, first: date, last: date | None = None) -> DataFrame:
    """One health row for the range: FAILED if any of its days has an issue."""
    day = F.col("simulation_date").between(F.lit(first), F.lit(last or first))
    bad = issues(spark, tables).where(day).agg(F.count(F.lit(1))).scalar()
    done = read_summary(spark, tables).where(day).agg(F.count(F.lit(1))).scalar()
    return spark.range(1).select(
        F.lit(monitor.BATCH).alias("component"),
        F.when(bad > 0, F.lit("FAILED")).otherwise(F.lit("HEALTHY")).alias("status"),
        F.lit(None).cast("timestamp").alias("last_event_at"),
        F.when(bad == 0, F.current_timestamp()).alias("last_success_at"),
        F.format_string("reconciled %d plant-day(s), %d issue(s)", done, bad).alias("message"))
