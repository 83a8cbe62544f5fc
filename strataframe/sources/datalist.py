"""Data lists in JSON, and CSV tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType


def read_datalist(spark: SparkSession, path: str, section: str = "training", base_dir: str | None = None, keys: tuple[str, ...] = ("image", "label")) -> DataFrame:
    """Items of a section; a list of plain strings becomes a column ``image``; paths get the base folder."""
    whole = spark.read.option("multiLine", True).json(path)
    if section not in whole.columns:
        raise ValueError(f"no section {section} in the data list; it has {whole.columns}")
    kind = whole.schema[section].dataType
    items = whole.select(F.explode(section).alias("item"))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
        items = items.select(F.col("item").alias("image"))
    elif isinstance(kind.elementType, StructType):
        items = items.select("item.*")
    if base_dir is None:
        return items
    joined = lambda c: F.when(F.col(c).startswith("/"), F.col(c)).otherwise(F.concat(F.lit(base_dir.rstrip("/") + "/"), F.col(c)))
    return items.withColumns({k: joined(k) for k in keys if k in items.columns and dict(items.dtypes)[k] == "string"})


def split_fold(items: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(training, validation): validation is the fold's items; those without a fold are for training."""
    own = F.coalesce(F.col("fold") == fold, F.lit(False))
    return items.where(~own), items.where(own)


def read_tables(spark: SparkSession, paths: list[str], schema: str | None = None, how: str = "inner", on: list[str] | None = None) -> DataFrame:
    """CSV tables joined in order on their common columns."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reduce(lambda a, b: a.join(b, on or [c for c in a.columns if c in b.columns], how), [reader.csv(p) for p in paths])
