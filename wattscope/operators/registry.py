"""The asset registry: loading it from nested portfolio files, checking it, summarising it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY_TOLERANCE = 0.25


def flatten_portfolio(nested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(plants, inverters)`` of nested portfolio rows; blanks get their defaults."""
    def clean(c):
        return F.nullif(F.trim(c), F.lit(""))

    pid = clean(F.col("id"))
    plants = nested.select(
        pid.alias("plant_id"), F.coalesce(clean(F.col("name")), pid).alias("plant_name"),
        "capacity_kw", F.coalesce(clean(F.col("timezone")), F.lit("UTC")).alias("timezone"),
        "ppa_rate_per_kwh", F.lit(True).alias("active"))
    unit = F.col("unit")
    inverters = nested.select(pid.alias("plant_id"), F.explode("inverters").alias("unit")).select(
        "plant_id", clean(unit["id"]).alias("inverter_id"),
        F.coalesce(clean(unit["name"]), clean(unit["id"])).alias("inverter_name"),
        unit["rated_power_kw"].alias("rated_power_kw"), F.lit(True).alias("active"))
    return plants, inverters


def rated_capacity(plants: DataFrame, inverters: DataFrame) -> DataFrame:
    """Per plant: summed inverter ratings and their ratio to the nameplate."""
    rated = inverters.groupBy("plant_id").agg(
        F.sum("rated_power_kw").alias("inverter_capacity_kw"),
        F.count(F.lit(1)).alias("inverter_count"))
    return (plants.select("plant_id", "capacity_kw").join(rated, "plant_id", "left")
            .withColumns({
                "inverter_count": F.coalesce("inverter_count", F.lit(0)),
                "capacity_ratio": F.try_divide(F.col("inverter_capacity_kw"), F.col("capacity_kw")),
            }))


def portfolio_problems(plants: DataFrame, inverters: DataFrame, strict: bool = False) -> DataFrame:
    """``(plant_id, inverter_id, level, problem)`` for everything wrong with a portfolio.

    A capacity that does not match the inverters is a warning, or with ``strict`` an error.
    """
    def rows(df: DataFrame, level: str, problem: str, inverter: str | None = None) -> DataFrame:
        return df.select(
            "plant_id", (F.col(inverter) if inverter else F.lit(None).cast("string")).alias("inverter_id"),
            F.lit(level).alias("level"), F.lit(problem).alias("problem"))

    def finite_positive(c: str):
        value = F.col(c)
        return F.coalesce((value > 0) & (value < float("inf")), F.lit(False))

    rated = rated_capacity(plants, inverters)
    drift = F.abs(F.col("capacity_ratio") - 1.0) > CAPACITY_TOLERANCE
    checks = [
        rows(plants.where("plant_id is null"), "error", "PLANT_ID_MISSING"),
        rows(plants.groupBy("plant_id").agg(F.count(F.lit(1)).alias("n"))
             .where("n > 1 and plant_id is not null"), "error", "PLANT_DUPLICATE"),
        rows(plants.where(~finite_positive("capacity_kw")), "error", "CAPACITY_NOT_POSITIVE"),
        rows(rated.where("inverter_count = 0"), "error", "NO_INVERTERS"),
        rows(rated.where(drift), "error" if strict else "warning", "CAPACITY_MISMATCH"),
        rows(inverters.where("inverter_id is null"), "error", "INVERTER_ID_MISSING", "inverter_id"),
        rows(inverters.groupBy("plant_id", "inverter_id").agg(F.count(F.lit(1)).alias("n"))
             .where("n > 1 and inverter_id is not null"), "error", "INVERTER_DUPLICATE", "inverter_id"),
        rows(inverters.where(~finite_positive("rated_power_kw")), "error", "RATING_NOT_POSITIVE",
             "inverter_id"),
    ]
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


def plant_reference(plants: DataFrame, inverters: DataFrame) -> DataFrame:
    """Active plants with their capacity and the number of active inverters."""
    configured = (inverters.where("active").groupBy("plant_id")
                  .agg(F.count(F.lit(1)).alias("configured_inverters")))
    return (plants.where("active").select("plant_id", "capacity_kw")
            .join(configured, "plant_id", "left")
            .withColumn("configured_inverters",
                        F.coalesce("configured_inverters", F.lit(0)).cast("int")))


def inverter_reference(inverters: DataFrame) -> DataFrame:
    return inverters.where("active").select("plant_id", "inverter_id", "rated_power_kw")


def installed_capacity(plants: DataFrame) -> DataFrame:
    return plants.where("active").agg(
        F.coalesce(F.sum("capacity_kw"), F.lit(0.0)).alias("installed_capacity_kw"))
