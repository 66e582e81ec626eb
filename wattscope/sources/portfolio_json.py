"""Portfolio files: one JSON object per plant with its inverters nested inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattscope import schema
from wattscope.operators import registry


def read_portfolio(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(plants, inverters)`` of JSON-lines portfolio files."""
    return registry.flatten_portfolio(spark.read.schema(schema.PORTFOLIO_FILE).json(path))
