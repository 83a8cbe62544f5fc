"""Chunked files as streams, and bounded shuffling of a stream."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_chunks(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv", files: int = 1, **options) -> DataFrame:
    """A folder of files as a stream that takes ``files`` of them in each micro-batch."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).options(**options).load(path)


def shuffled(stream: DataFrame, buffer: int, seed: int = 0) -> DataFrame:
    """Rows in a random order that looks ``buffer`` rows ahead.

    Each partition of a micro-batch holds at most ``buffer`` rows; once they are that many, a random
    one is emitted and the next takes its place, and the rest follow at the end of the partition.  No
    state outlives the micro-batch, so nothing is held back when the stream ends."""
    names = stream.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pick, held = random.Random(f"{seed}:{TaskContext.get().partitionId()}"), []
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False, name=None):
                if len(held) < buffer:
                    held.append(row)
                else:
                    i = pick.randrange(buffer)
                    out.append(held[i])
                    held[i] = row
            yield pd.DataFrame(out, columns=names).astype(frame.dtypes)
        pick.shuffle(held)
        if held:
            yield pd.DataFrame(held, columns=names)

    return stream.mapInPandas(run, stream.schema)


def rolling_cache(df: DataFrame, index: str, size: int, replace: int, total: int, epoch: int) -> DataFrame:
    """The rows that a cache of ``size`` rows holds in an epoch if ``replace`` of them change each time."""
    start = epoch * replace % total
    return df.where(F.pmod(F.col(index) - start, F.lit(total)) < size)
