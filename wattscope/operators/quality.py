"""Checks of stored tables. Each returns rows for what is wrong and none when all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattscope.functions import model

PERFORMANCE_TOLERANCE = 0.01


class QualityError(ValueError):
    """A gate found problems; carries how many, and the first few for the message."""

    def __init__(self, what: str, count: int, examples: list[str]) -> None:
        self.count, self.examples = count, examples
        super().__init__(f"{what}: {count} problem(s)\n  - " + "\n  - ".join(examples))


def gate(problems: DataFrame, what: str, show: int = 20) -> None:
    """Raise QualityError if there is any problem. Only ``show`` rows reach the driver."""
    few = problems.limit(show).collect()
    if few:
        raise QualityError(what, problems.count(), [str(r.asDict()) for r in few])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def summary_problems(summary: DataFrame, reference: DataFrame, plants: DataFrame) -> DataFrame:
    """What is wrong with the stored daily summaries of the days the feed covers.

    ``(simulation_date, plant_id, problem)``.
    """
    none = F.lit(None).cast("string")

    # Configured plants of every day, paired by a generator over the day list.
    days = reference.agg(F.collect_set("simulation_date")).scalar()
    owed = plants.where("active").select(F.explode(days).alias("simulation_date"), "plant_id")
    missing = (owed.join(summary, ["simulation_date", "plant_id"], "left_anti")
               .withColumn("problem", F.lit("PLANT_NOT_SUMMARISED")))

    def per_day(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("simulation_date").agg(F.count(F.lit(1)).alias(name))

    uneven = (per_day(reference, "n_ref").join(per_day(summary, "n_sum"), "simulation_date", "full_outer")
              .where("coalesce(n_ref, 0) <> coalesce(n_sum, 0)")
              .select("simulation_date", none.alias("plant_id"),
                      F.lit("ROW_COUNT_DIFFERS").alias("problem")))

    def bad(ok: Column) -> Column:
        return ~F.coalesce(ok, F.lit(False))

    recomputed = model.ratio_pct(F.col("actual_generation_kwh"), F.col("expected_generation_kwh"))
    flags = [
        ("ACTUAL_GENERATION", bad(F.col("actual_generation_kwh") >= 0)),
        ("EXPECTED_GENERATION", bad(F.col("expected_generation_kwh") > 0)),
        ("LOST_ENERGY", bad(F.col("estimated_lost_energy_kwh") >= 0)),
        ("ACTUAL_REVENUE", bad(F.col("estimated_actual_revenue") >= 0)),
        ("LOST_REVENUE", bad(F.col("estimated_lost_revenue") >= 0)),
        ("PERFORMANCE_INCONSISTENT",
         F.abs(recomputed - F.col("performance_pct")) > PERFORMANCE_TOLERANCE),
    ]
    rows = summary.select(
        "simulation_date", "plant_id",
        F.explode(F.array_compact(F.array(*(F.when(hit, F.lit(n)) for n, hit in flags)))).alias("problem"))
    return union_all([missing.select("simulation_date", "plant_id", "problem"), uneven, rows])


def _found(df: DataFrame, table: str, check: str, key: Column) -> DataFrame:
    return df.select(F.lit(table).alias("table"), F.lit(check).alias("check"),
                     key.cast("string").alias("key"))


def _key(columns: list[str]) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def duplicate_keys(df: DataFrame, table: str, key: list[str]) -> DataFrame:
    twice = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _found(twice, table, "PRIMARY_KEY", _key(key))


def orphans(df: DataFrame, table: str, plants: DataFrame) -> DataFrame:
    """Plant ids a table refers to and the registry does not know."""
    ids = df.select("plant_id").distinct()
    return _found(ids.join(plants.select("plant_id"), "plant_id", "left_anti"), table,
                  "FOREIGN_KEY", F.col("plant_id"))


def broken_rows(df: DataFrame, table: str, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """Rows a rule does not hold for; like SQL CHECK, a rule that is NULL holds."""
    hits = F.array_compact(F.array(*(
        F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items())))
    return _found(df.select(*key, F.explode(hits).alias("rule")), table, "CHECK",
                  F.concat_ws(":", F.col("rule"), _key(key)))


def alert_rules() -> dict[str, Column]:
    ended, status = F.col("ended_at"), F.col("status")
    return {
        "kind": F.col("alert_type").isin("UNDERPERFORMANCE", "INVERTER_OFFLINE", "TELEMETRY_GAP"),
        "severity": F.col("severity").isin("WARNING", "CRITICAL"),
        "status": status.isin("ACTIVE", "RESOLVED"),
        "end_matches_status": ((status == "ACTIVE") & ended.isNull())
                              | ((status == "RESOLVED") & ended.isNotNull()),
        "interval_ordered": ended >= F.col("started_at"),
    }


def reference_rules() -> dict[str, Column]:
    return {
        "capacity": F.col("plant_capacity_kw") > 0,
        "generation": F.col("expected_generation_kwh") > 0,
        "peak": F.col("expected_peak_power_kw") > 0,
        "irradiance": F.col("forecast_irradiance_kwh_m2") >= 0,
        "rate": F.col("ppa_rate_per_kwh") >= 0,
    }


def summary_rules() -> dict[str, Column]:
    return {"actual": F.col("actual_generation_kwh") >= 0}


def health_rules() -> dict[str, Column]:
    return {"status": F.col("status").isin("HEALTHY", "DEGRADED", "STALE", "FAILED")}


def alert_violations(alerts: DataFrame, plants: DataFrame) -> DataFrame:
    """Keys, references, row rules, and at most one open alert per asset and kind."""
    asset = ["plant_id", "inverter_id", "alert_type"]
    open_twice = (alerts.where("status = 'ACTIVE'")
                  .groupBy("plant_id", F.coalesce("inverter_id", F.lit("")).alias("inverter_id"),
                           "alert_type")
                  .agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return union_all([
        fused_violations(alerts, "alerts", ["id"], alert_rules(), plants),
        _found(open_twice, "alerts", "ONE_ACTIVE", _key(asset)),
    ])


def fused_violations(df: DataFrame, table: str, key: list[str], rules: dict[str, Column], plants: DataFrame) -> DataFrame:
    """Key, reference and row checks of a table in one pass over it.

    One aggregation by key counts rows and broken rules; what it finds, and the plants it names, are then
    counted once more by check, which leaves a row for each plant to look up in the registry.
    """
    text = _key(key)
    refs = "plant_id" in df.columns
    within = refs and "plant_id" not in key
    keyed = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.count_if(~F.coalesce(rule, F.lit(True))).alias(f"broken_{i}") for i, rule in enumerate(rules.values())),
        *([F.collect_set(F.struct("plant_id")).alias("refs")] if within else []))

    def found(check: str, of: Column, times: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), of.cast("string").alias("key"), times.cast("long").alias("times"))

    finds = [found("PRIMARY_KEY", text, (F.col("rows") > 1).cast("long")),
             *(found("CHECK", F.concat_ws(":", F.lit(name), text), F.col(f"broken_{i}")) for i, name in enumerate(rules))]
    if refs and not within:
        finds.append(found("FOREIGN_KEY", F.col("plant_id"), F.lit(1)))
    listed = F.array(*finds)
    if within:
        listed = F.concat(listed, F.transform("refs", lambda r: found("FOREIGN_KEY", r["plant_id"], F.lit(1))))
    counted = (keyed.select(F.explode(F.filter(listed, lambda x: x["times"] > 0)).alias("x")).select("x.*")
               .groupBy("check", "key").agg(F.sum("times").alias("times")))
    if refs:
        known = plants.select(F.col("plant_id").alias("known")).distinct()
        counted = counted.join(known, (F.col("check") == "FOREIGN_KEY") & (F.col("key") == F.col("known")), "left_anti")
    again = F.when(F.col("check") == "CHECK", F.col("times")).otherwise(F.lit(1)).cast("int")
    return counted.select(F.lit(table).alias("table"), "check", "key", F.explode(F.array_repeat(F.lit(1), again)).alias("_")).drop("_")


def table_violations(tables: dict[str, tuple[DataFrame, list[str], dict[str, Column]]],
                     plants: DataFrame) -> DataFrame:
    """Key, reference and row checks of several tables, each read once: ``name -> (frame, key, rules)``."""
    return union_all([fused_violations(df, name, key, rules, plants) for name, (df, key, rules) in tables.items()])
