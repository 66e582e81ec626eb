"""The given tables read as a fleet: customers are inverters, nations are plants, events are
readings. Everything is derived from whole tables by Spark; nothing is made up beside them.

``props`` holds a number 0..99 per event. It stands for the sunlight, and some of its values
mark the records that arrive damaged, repeated or incomplete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattscope import schema

REPEATED_FROM, REPEATED_TO = 40, 44
REPEAT_OFFSET = 10_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plant_id(nation: Column) -> Column:
    return F.concat(F.lit("PLANT_"), F.lpad(nation.cast("string"), 2, "0"))


def inverters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers; in service are those that report or (by a negative balance) should."""
    heard = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("heard", F.lit(True))
    c = table(spark, sf_dir, "customer").join(heard, F.col("c_custkey") == F.col("user_id"), "left")
    return c.select(
        _plant_id(F.col("c_nationkey")).alias("plant_id"),
        F.concat(F.lit("INV_"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("inverter_id"),
        F.col("c_name").alias("inverter_name"),
        (F.floor(F.abs("c_acctbal") / 50) + 40).cast("double").alias("rated_power_kw"),
        ((F.col("c_acctbal") < 0) | F.col("heard").isNotNull()).alias("active"))


def plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nations; those of region 4 are out of service."""
    rated = (inverters(spark, sf_dir).where("active").groupBy("plant_id")
             .agg(F.sum("rated_power_kw").alias("capacity_kw")))
    n = table(spark, sf_dir, "nation").withColumn("plant_id", _plant_id(F.col("n_nationkey")))
    return n.join(rated, "plant_id").select(
        "plant_id", F.col("n_name").alias("plant_name"), "capacity_kw", F.lit("UTC").alias("timezone"),
        F.when(F.col("n_regionkey") != 3, F.round(0.07 + 0.002 * F.col("n_nationkey"), 4))
         .alias("ppa_rate_per_kwh"),
        (F.col("n_regionkey") != 4).alias("active"), "n_nationkey", "n_regionkey")


def _sunlight(props: Column) -> Column:
    return F.regexp_extract(props, "([0-9]+)", 1).cast("int")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as normalized telemetry with the archive's columns."""
    e = table(spark, sf_dir, "events")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    k = F.col("k")
    clock_hours = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")) / 3600
    return (e.join(c, F.col("user_id") == F.col("c_custkey"))
            .withColumn("k", _sunlight(F.col("props")))
            .select(
                F.col("event_id").cast("string").alias("event_id"),
                _plant_id(F.col("c_nationkey")).alias("plant_id"),
                F.concat(F.lit("INV_"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("inverter_id"),
                F.col("value").alias("active_power_kw"),
                # A counter that grows with the hours and restarts at every signup.
                F.when(F.col("event_type") == "signup", F.col("value"))
                 .otherwise(F.round(clock_hours * 10 + F.col("value"), 3)).alias("energy_today_kwh"),
                (k * 12).cast("double").alias("irradiance_wm2"),
                (k / 2 + 20).cast("double").alias("module_temp_c"),
                (k / 4 + 20).cast("double").alias("inverter_temp_c"),
                F.when(F.col("event_type") == "error", "OFFLINE")
                 .when(F.col("event_type") == "signup", "WARNING").otherwise("ONLINE").alias("status"),
                F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias("availability"),
                F.col("ts").cast("timestamp").alias("event_time"),
                F.lit(None).cast("string").alias("simulator_scenario"),
                F.lit("telemetry").alias("kafka_topic"),
                F.col("c_nationkey").cast("int").alias("kafka_partition"),
                F.col("event_id").alias("kafka_offset"),
                F.to_date("ts").alias("simulation_date"),
                "k"))


def raw_records(spark: SparkSession, sf_dir: str, strict: bool = False, equal_copies: bool = False) -> DataFrame:
    """The telemetry as JSON records of a Kafka topic, some damaged, some delivered twice.

    Copies differ in their power unless they are to be equal. With ``strict`` the ids and instants have the form the producer's contract asks for.
    """
    k = F.col("k")
    event_id = F.col("event_id")
    pattern = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    if strict:
        event_id = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad("event_id", 12, "0"))
        pattern = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    t = telemetry(spark, sf_dir).withColumn("copy", F.explode(
        F.when(k.between(REPEATED_FROM, REPEATED_TO), F.array(F.lit(0), F.lit(1)))
        .otherwise(F.array(F.lit(0)))))
    missing = k == 93
    doc = F.struct(
        F.when(k != 81, event_id).alias("event_id"),
        F.when(k != 82, F.col("plant_id")).alias("plant_id"),
        F.when(k != 83, F.col("inverter_id")).alias("inverter_id"),
        # The repeated copy reads one kW more: only the first arrival may count.
        F.when(k == 86, -1.0).when(~missing, F.col("active_power_kw") + (F.lit(0) if equal_copies else F.col("copy")))
         .alias("active_power_kw"),
        F.when(k == 87, -1.0).when(~missing, F.col("energy_today_kwh")).alias("energy_today_kwh"),
        F.when(k == 88, -1.0).when(k == 89, 1600.0).when(~missing, F.col("irradiance_wm2"))
         .alias("irradiance_wm2"),
        "module_temp_c", "inverter_temp_c",
        F.when(k == 85, "BROKEN").otherwise(F.col("status")).alias("status"),
        F.when(k == 90, 2.0).when(~missing, F.col("availability")).alias("availability"),
        F.when(k == 84, "not-a-timestamp").otherwise(F.date_format("event_time", pattern)).alias("timestamp"),
        "simulator_scenario")
    text = F.to_json(doc, {"ignoreNullFields": "false"})
    body = (F.when(k == 80, F.lit("{{ corrupt"))
            .when(k == 91, F.regexp_replace(text, '"active_power_kw":[^,]*', '"active_power_kw":"n/a"'))
            .when(k == 94, F.regexp_replace(text, r"\}$", ',"extra":1}'))
            .when(k != 92, text))
    return t.select(
        F.concat_ws(":", "plant_id", "inverter_id").cast("binary").alias("key"),
        body.cast("binary").alias("value"),
        F.col("kafka_topic").alias("topic"), F.col("kafka_partition").alias("partition"),
        (F.col("kafka_offset") + F.col("copy") * REPEAT_OFFSET).alias("offset"),
        (F.col("event_time") + F.make_dt_interval(secs=F.col("copy"))).alias("timestamp"))


def days(spark: SparkSession, sf_dir: str) -> Column:
    """Every day from the first event to the last, as an array column."""
    day = F.to_date("ts")
    return (table(spark, sf_dir, "events")
            .agg(F.sequence(F.min(day), F.max(day)).alias("days")).scalar())


def _expectations(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    p = (plants(spark, sf_dir) if known is None else known).withColumn("d", F.explode(days(spark, sf_dir)))
    # One day's file lacks the plants of one region.
    return p.where(~((F.col("n_regionkey") == 2) & (F.dayofmonth("d") == 13)))


def daily_reference(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """The loaded expectation feed: a row per plant and day. ``known`` are the plants, if they have been derived."""
    nth = F.dayofmonth("d")
    return _expectations(spark, sf_dir, known).select(
        F.col("d").alias("simulation_date"), "plant_id",
        F.col("capacity_kw").alias("plant_capacity_kw"),
        F.round(F.col("capacity_kw") * (0.3 + 0.04 * nth), 3).alias("expected_generation_kwh"),
        F.round(F.col("capacity_kw") * 0.9, 3).alias("expected_peak_power_kw"),
        F.lit(5.2).alias("forecast_irradiance_kwh_m2"),
        F.round(0.07 + 0.002 * F.col("n_nationkey"), 4).alias("ppa_rate_per_kwh"),
        (F.col("n_nationkey") + 1 == nth).alias("maintenance_flag"),
        F.lit("v1").alias("source_version"))


def feed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as delivered: text, with a fault on every eighth day or so."""
    n, nth = F.col("n_nationkey"), F.dayofmonth("d")

    def at(plant: int, day: int) -> Column:
        return (n == plant) & (nth == day)

    rows = _expectations(spark, sf_dir).withColumn("copy", F.explode(
        F.when(at(3, 5), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(
        F.col("d").alias("feed_date"),
        (n * 10 + F.col("copy") + 1).cast("long").alias("position"),
        F.when(at(4, 6), "").when(at(5, 6), " PLANT_99 ").otherwise(F.col("plant_id")).alias("plant_id"),
        F.when(at(6, 6), "").when(at(7, 6), "06/01/2024").when(at(8, 7), "2024-01-08")
         .when(nth == 9, "2024-01-10").otherwise(F.col("d").cast("string")).alias("simulation_date"),
        F.when(at(9, 6), "abc").when(at(10, 6), "nan").when(at(11, 6), "0")
         .otherwise("4000").alias("plant_capacity_kw"),
        F.when(at(12, 6), "56001").when(at(13, 6), "-5").otherwise("20000").alias("expected_generation_kwh"),
        F.when(at(14, 6), "4001").when(at(15, 6), "0").otherwise("3800").alias("expected_peak_power_kw"),
        F.when(at(16, 6), "-0.5").otherwise("5.2").alias("forecast_irradiance_kwh_m2"),
        F.when(at(17, 6), "-0.1").otherwise("0.15").alias("ppa_rate_per_kwh"),
        F.when(at(18, 6), "maybe").when(n == 19, "YES").when(n == 20, "").otherwise("false").alias("maintenance_flag"),
        F.when(at(21, 6), " ").otherwise("v1").alias("source_version"))


def scenario_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scripted window per nation, in seconds of a 300-second day. The first hits every
    plant, those of region 1 the plant's first inverter, the others the whole plant."""
    first = (table(spark, sf_dir, "customer").groupBy("c_nationkey")
             .agg(F.min("c_custkey").alias("first_inverter")))
    n = table(spark, sf_dir, "nation").join(first, F.col("n_nationkey") == F.col("c_nationkey"))
    start = F.col("n_nationkey") * 12
    names = F.array(*(F.lit(s) for s in schema.SCENARIOS))
    return n.select(
        F.element_at(names, F.least(F.col("n_regionkey") + 1, F.lit(4)).cast("int")).alias("scenario"),
        start.cast("double").alias("start_second"), (start + 9).cast("double").alias("end_second"),
        F.when(F.col("n_nationkey") > 0, _plant_id(F.col("n_nationkey"))).alias("plant_id"),
        F.when(F.col("n_regionkey") == 1,
               F.concat(F.lit("INV_"), F.lpad(F.col("first_inverter").cast("string"), 8, "0")))
         .alias("inverter_id"),
        F.when(F.col("n_regionkey") == 0, 0.45).alias("power_factor"))
