"""CSV and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.operators.metrics import report


def last_saved(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row saved under each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("place__", place).where("place__ = 1").drop("place__")


def write_csv(df: DataFrame, path: str, key: str, order: str) -> None:
    last_saved(df, key, order).write.mode("append").option("header", True).csv(path)


def write_metric_report(df: DataFrame, path: str, metric: str, names: list[str]) -> None:
    """``<metric>_raw`` with each row, and ``<metric>_summary`` with the statistics of each class."""
    df.write.mode("overwrite").option("header", True).csv(f"{path}/{metric}_raw")
    report(df, names).write.mode("overwrite").option("header", True).csv(f"{path}/{metric}_summary")


def write_stats(df: DataFrame, path: str) -> None:
    """Statistics as JSON lines, one for each case."""
    df.write.mode("overwrite").json(path)
