"""The daily report as CSV for people."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wattscope.operators.serving import REPORT_COLUMNS


def export_report(rows: DataFrame, folder: str) -> None:
    """Report rows (``serving.daily_rows``) with a header, a folder per day.

    NULL is an empty field; quotes inside a value are doubled.
    """
    (rows.select("simulation_date", *REPORT_COLUMNS)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("header", True).option("nullValue", "").option("emptyValue", "")
     .option("quote", '"').option("escape", '"')
     .partitionBy("simulation_date").csv(folder))
