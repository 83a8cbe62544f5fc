"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most this many bytes, as measured before the join, may be broadcast.
BROADCAST_LIMIT = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session leaves it unset (local tests), a temporary folder is made once and set; on a
    cluster other machines couldn't see that, so there it's an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        java = spark.sparkContext._jsc.sc()
        if java.getCheckpointDir().isEmpty():
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strataframe-"))
        found = java.getCheckpointDir().get()
    return found.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    It cuts the lineage, keeps later jobs from repeating the work, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> DataFrame:
    """All columns inside one struct, so that extra columns can't clash with an operator's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row__"))


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The packed columns and ``new`` ones; a new column replaces an old one of the same name."""
    taken = {name.lower() for name in new}
    old = [F.col(f"row__.`{c}`").alias(c) for c in columns if c.lower() not in taken]
    return df.select(*old, *[value.alias(name) for name, value in new.items()])


def small_enough(rows: int, row_bytes: int, limit: int = BROADCAST_LIMIT) -> bool:
    return rows * row_bytes <= limit


def hinted(df: DataFrame, broadcast: bool) -> DataFrame:
    return F.broadcast(df) if broadcast else df
