"""The daily expectation feed as CSV: one file per day, named for its day."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattscope import schema
from wattscope.session import materialize

# Fixed formats: the day in a file's name, or in its folder's.
_DAY = r"(?:daily_reference_|day=)(\d{4}-\d{2}-\d{2})"


class FeedError(ValueError):
    """The feed cannot be read or may not be written."""


def _headers(lines: DataFrame) -> DataFrame:
    """``feed_path, header_id, header`` of every file: the first line of its start that is not blank."""
    return (lines.where("block = 0").groupBy("feed_path")
            .agg(F.min_by("value", "line_id").alias("header"), F.min("line_id").alias("header_id")))


def _fields(text: Column, width: int) -> Column:
    """The fields of a line of CSV as an array of ``width``."""
    parsed = F.from_csv(text, ", ".join(f"c{i} string" for i in range(width)))
    return F.array(*(parsed[f"c{i}"] for i in range(width)))


def feed_date(file_path: Column) -> Column:
    """The day a feed file is for, by its name."""
    return F.to_date(F.nullif(F.regexp_extract(file_path, _DAY, 1), F.lit("")))


def read_feed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, file_problems)`` of all feed files under ``path`` (a folder or a glob).

    Everything is read as text. ``rows`` has the contract's columns, ``feed_date`` and the
    row's ``position`` in its file. ``file_problems`` has a row for each file without a
    contract column (its rows are left out), with unexpected columns (a warning; they are
    ignored) or without any row. The files are read once, whatever their headers: lines are written down,
    and a line's fields are placed by the header of its own file, which it meets by the file's name.
    """
    try:
        text = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FeedError(f"no feed file at {path}") from e
    lines = materialize(text.select(
        F.col("_metadata.file_path").alias("feed_path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"), "value").where(F.col("value").rlike(r"\S")), "feed-lines")
    first = _headers(lines)
    commas = F.char_length(F.regexp_replace("header", "[^,]", ""))
    width = first.agg(F.max(commas)).first()[0]
    if width is None:
        raise FeedError(f"no feed file at {path}")
    width += 1
    contract = F.array(*(F.lit(c) for c in schema.FEED_COLUMNS))
    bare = F.regexp_replace("header", "^\ufeff", "")
    names = F.slice(F.transform(_fields(bare, width), lambda n: F.trim(F.coalesce(n, F.lit("")))), F.lit(1), commas + 1)
    headers = materialize(first.withColumn("names", names).select(
        "feed_path", "header_id", F.transform(contract, lambda c: F.array_position("names", c).cast("int")).alias("places"),
        F.filter(contract, lambda c: ~F.array_contains("names", c)).alias("missing"),
        F.filter("names", lambda n: ~F.array_contains(contract, n)).alias("extra")), "feed-headers")

    fields = lines.join(headers.where(F.size("missing") == 0), "feed_path").where("line_id <> header_id")
    rows = fields.withColumn("fields", _fields(F.col("value"), width)).select(
        *(F.get("fields", F.col("places")[i] - 1).alias(c) for i, c in enumerate(schema.FEED_COLUMNS)), "feed_path", "block", "line_id")

    def problem(level: str, name: str, columns: str) -> Column:
        return F.when(F.size(columns) > 0, F.struct(F.lit(level).alias("level"), F.lit(name).alias("problem"), F.array_join(columns, ", ").alias("detail")))

    day = feed_date(F.col("feed_path")).alias("feed_date")
    of_header = headers.select(day, F.explode(F.array_compact(F.array(
        problem("error", "COLUMN_MISSING", "missing"), problem("warning", "COLUMN_UNEXPECTED", "extra")))).alias("p")).select("feed_date", "p.*")
    empty = (headers.where(F.size("missing") == 0).join(rows.select("feed_path"), "feed_path", "left_anti")
             .select(day, F.lit("error").alias("level"), F.lit("NO_ROWS").alias("problem"), F.lit("").alias("detail")))
    return _with_position(rows), empty.unionByName(of_header)


def _with_position(rows: DataFrame) -> DataFrame:
    """Row numbers in file order: counted within each block of a file, then shifted by the
    blocks before, so a file of many blocks is not drawn into one task."""
    block = ["feed_path", "block"]
    sizes = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(*block, F.coalesce(
        F.sum("n").over(Window.partitionBy("feed_path").orderBy("block")
                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(*block).orderBy("line_id"))
    return (rows.withColumn("place", place).join(before, block)
            .select(*schema.FEED_COLUMNS, feed_date(F.col("feed_path")).alias("feed_date"),
                    (F.col("before") + F.col("place")).cast("long").alias("position")))


def _written_days(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        there = spark.read.option("header", True).csv(folder)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return there.select(F.col("day").cast("string").alias("day")).distinct()


def write_feed(feed: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Feed rows as CSV, one file per day (``day=...``), in contract order and rounding.

    Refuses an empty feed, a plant twice in a day, and (without ``overwrite``) a day that
    is there already. A day replaces itself at commit, so no reader sees half a file.
    """
    if feed.isEmpty():
        raise FeedError("refusing to write an empty feed")
    twice = (feed.groupBy("simulation_date", "plant_id").agg(F.count(F.lit(1)).alias("n"))
             .where("n > 1").limit(5).collect())
    if twice:
        raise FeedError("plant twice in a day: "
                        + ", ".join(f"{r.simulation_date} {r.plant_id}" for r in twice))
    digits = {"forecast_irradiance_kwh_m2": 4, "ppa_rate_per_kwh": 4}
    text = feed.select(
        F.col("simulation_date").cast("string").alias("day"),
        *(F.round(c, digits.get(c, 3)).alias(c) if c in schema.FEED_NUMBERS
          else F.col(c).cast("string").alias(c) for c in schema.FEED_COLUMNS))
    there = None if overwrite else _written_days(feed.sparkSession, folder)
    if there is not None:
        clash = text.select("day").distinct().join(there, "day").limit(5).collect()
        if clash:
            raise FeedError("day already written: " + ", ".join(r.day for r in clash))
    (text.repartition("day").sortWithinPartitions("day", "plant_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("header", True).partitionBy("day").csv(folder))
