"""The daily expectation feed: every problem of every file, then the rows of sound files.

``rows`` holds the feed as text: the contract's columns plus ``feed_date`` (the day the file
was delivered for) and ``position`` (its row number in the file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattscope import schema
from wattscope.functions import parsing

# More full-power hours than this in a day is a unit error, not sunshine.
MAX_SUN_HOURS = 14.0

PROBLEM_COLUMNS = ("feed_date", "position", "plant_id", "problem", "detail")


def _issue(broken: Column, problem: str, detail: Column) -> Column:
    return F.when(broken, F.struct(F.lit(problem).alias("problem"),
                                   F.coalesce(detail.cast("string"), F.lit("")).alias("detail")))


def _row_issues() -> list[Column]:
    """Checks of one row, given its typed columns ``t_*``; each NULL when it holds."""
    v = {c: F.col(f"t_{c}") for c in schema.FEED_NUMBERS}
    capacity, generation = v["plant_capacity_kw"], v["expected_generation_kwh"]
    peak = v["expected_peak_power_kw"]
    day = parsing.text(F.col("simulation_date"))
    issues = [
        _issue(day == "", "DATE_MISSING", F.lit("")),
        _issue((day != "") & F.col("t_simulation_date").isNull(), "DATE_INVALID", day),
    ]
    for c in schema.FEED_NUMBERS:
        fault = parsing.number_fault(F.col(c))
        issues.append(F.when(fault.isNotNull(), F.struct(
            fault.alias("problem"), F.concat(F.lit(c), F.lit("="), parsing.text(F.col(c))).alias("detail"))))
    issues += [
        _issue(F.col("t_maintenance_flag").isNull(), "NOT_A_BOOLEAN", F.col("maintenance_flag")),
        _issue(parsing.text(F.col("source_version")) == "", "SOURCE_VERSION_MISSING", F.lit("")),
        _issue(capacity <= 0, "CAPACITY_NOT_POSITIVE", capacity),
        _issue(generation <= 0, "GENERATION_NOT_POSITIVE", generation),
        _issue(peak <= 0, "PEAK_NOT_POSITIVE", peak),
        _issue(v["forecast_irradiance_kwh_m2"] < 0, "IRRADIANCE_NEGATIVE", v["forecast_irradiance_kwh_m2"]),
        _issue(v["ppa_rate_per_kwh"] < 0, "RATE_NEGATIVE", v["ppa_rate_per_kwh"]),
        # A zero on either side has its own problem already and is not compared.
        _issue((capacity != 0) & (peak != 0) & (peak > capacity), "PEAK_ABOVE_CAPACITY", peak),
        _issue((generation != 0) & (F.try_divide(generation, capacity) > MAX_SUN_HOURS),
               "SUN_HOURS_IMPLAUSIBLE", generation),
    ]
    return issues


def assess(rows: DataFrame) -> DataFrame:
    """Rows with typed columns ``t_*`` and ``issues``, all that is wrong with each.

    The first row of a plant in its file counts; later ones are duplicates and are not looked
    at further. First positions are aggregated, so a plant repeated without end is one row per
    task when it is shuffled.
    """
    typed = rows.withColumns({
        "t_plant_id": parsing.text(F.col("plant_id")),
        "t_simulation_date": parsing.iso_date(F.col("simulation_date")),
        **{f"t_{c}": parsing.number(F.col(c)) for c in schema.FEED_NUMBERS},
        "t_maintenance_flag": parsing.flag(F.col("maintenance_flag")),
    })
    first = (typed.groupBy("feed_date", "t_plant_id")
             .agg(F.min("position").alias("first_position")))
    nameless = F.col("t_plant_id") == ""
    repeated = F.col("position") > F.col("first_position")

    def only(problem: str, detail: Column) -> Column:
        return F.array(F.struct(F.lit(problem).alias("problem"), detail.alias("detail")))

    return (typed.join(first, ["feed_date", "t_plant_id"])
            .withColumn("issues",
                        F.when(nameless, only("PLANT_ID_MISSING", F.lit("")))
                        .when(repeated, only("DUPLICATE_PLANT", F.col("t_plant_id")))
                        .otherwise(F.array_compact(F.array(*_row_issues()))))
            .withColumn("counted", ~(nameless | repeated))
            .drop("first_position"))


def row_problems(assessed: DataFrame) -> DataFrame:
    return (assessed.select("feed_date", "position", F.col("t_plant_id").alias("plant_id"),
                            F.explode("issues").alias("i"))
            .select("feed_date", "position", "plant_id", "i.problem", "i.detail"))


def coverage_problems(assessed: DataFrame, expected_plants: DataFrame) -> DataFrame:
    """Plants a file lacks, and plants it should not know.

    Every expected plant is paired with the delivered days by a generator over the day list
    (one entry per file), then matched by key: no product of two tables.
    """
    seen = (assessed.where("counted")
            .select("feed_date", F.col("t_plant_id").alias("plant_id")).distinct())
    days = assessed.agg(F.collect_set("feed_date")).scalar()
    expected = expected_plants.select("plant_id").distinct()
    owed = expected.select(F.explode(days).alias("feed_date"), "plant_id")
    missing = owed.join(seen, ["feed_date", "plant_id"], "left_anti").withColumn("problem", F.lit("PLANT_NOT_IN_FEED"))
    unknown = (seen.join(expected, "plant_id", "left_anti")
               .where(expected.agg(F.count(F.lit(1))).scalar() > 0)
               .select("feed_date", "plant_id", F.lit("PLANT_UNKNOWN").alias("problem")))
    return missing.unionByName(unknown).select(
        "feed_date", F.lit(None).cast("long").alias("position"), "plant_id", "problem",
        F.lit("").alias("detail"))


def date_problems(assessed: DataFrame) -> DataFrame:
    """Files that mix days, or are for another day than they were delivered for."""
    days = (assessed.where("counted and t_simulation_date is not null")
            .groupBy("feed_date")
            .agg(F.min("t_simulation_date").alias("low"), F.max("t_simulation_date").alias("high")))
    problem = (F.when(F.col("low") != F.col("high"), F.lit("DATES_MIXED"))
               .when(F.col("low") != F.col("feed_date"), F.lit("DATE_NOT_REQUESTED")))
    return (days.withColumn("problem", problem).where("problem is not null")
            .select("feed_date", F.lit(None).cast("long").alias("position"),
                    F.lit(None).cast("string").alias("plant_id"), "problem",
                    F.concat_ws("..", F.col("low").cast("string"), F.col("high").cast("string"))
                     .alias("detail")))


def feed_problems(assessed: DataFrame, expected_plants: DataFrame) -> DataFrame:
    """Everything wrong with the assessed files (PROBLEM_COLUMNS)."""
    return (row_problems(assessed)
            .unionByName(coverage_problems(assessed, expected_plants))
            .unionByName(date_problems(assessed))
            .select(*PROBLEM_COLUMNS))


def typed_rows(assessed: DataFrame) -> DataFrame:
    """Counted rows whose every field could be typed, in contract order."""
    needed = ["simulation_date", *schema.FEED_NUMBERS, "maintenance_flag"]
    whole = assessed.where("counted")
    for c in needed:
        whole = whole.where(F.col(f"t_{c}").isNotNull())
    return whole.select(
        "feed_date",
        *(parsing.text(F.col(c)).alias(c) if c == "source_version" else F.col(f"t_{c}").alias(c)
          for c in schema.FEED_COLUMNS))


def sound_rows(assessed: DataFrame, problems: DataFrame) -> DataFrame:
    """The typed rows of files without any problem: a file is loaded whole or not at all."""
    bad = problems.select("feed_date").distinct()
    return typed_rows(assessed).join(bad, "feed_date", "left_anti").drop("feed_date")
