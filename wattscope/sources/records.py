"""Raw telemetry records: a Kafka topic, or files holding the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattscope import schema


def kafka_records(spark: SparkSession, servers: str, topic: str,
                  starting_offsets: str = "earliest", max_per_trigger: int | None = None) -> DataFrame:
    """One topic as a stream. Lost offsets (retention, a reset topic) do not stop the job.

    Needs the Kafka connector on the cluster's class path.
    """
    reader = (spark.readStream.format("kafka")
              .option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic)
              .option("startingOffsets", starting_offsets)
              .option("failOnDataLoss", "false"))
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load().select(*schema.RAW_RECORD.fieldNames())


def file_records(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same columns from Parquet files, as a stream."""
    reader = spark.readStream.schema(schema.RAW_RECORD)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
