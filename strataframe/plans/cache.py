"""A table of computed rows that outlives the session, keyed by the content of inputs and by the steps taken."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.operators.columns import item_hash

HASH = "item_hash"


class NamedStep(NamedTuple):
    """A step over rows: its name and parameters stand for it in the cache's key, so they must tell all it does.

    ``run(df, **params)`` gives one row for each row and keeps the column ``item_hash``.  Random steps aren't cached,
    nor is what follows them."""

    name: str
    run: Callable[..., DataFrame]
    params: dict = {}
    random: bool = False


class RowCache:
    """Rows after the first steps of a pipeline, computed once for each different item.

    An item is a row of inputs, told by the md5 of its columns as JSON; the steps' names and parameters make up
    the fingerprint, a folder each, so a changed step shares nothing with what was there.  What misses is
    found by an anti join on hashes, computed by Spark and written as a batch of its own; the batch counts only
    once its name stands in the table of commits, which is one small file that appears whole or not at all.
    A run that's killed midway leaves a batch that nothing reads.  Two runs at once may compute the same item;
    readers take one row of each hash.  ``count`` steps at most are cached, up to the first random one."""

    def __init__(self, spark: SparkSession, folder: str, steps: Sequence[NamedStep], count: int | None = None):
        cut = next((i for i, s in enumerate(steps) if s.random), len(steps))
        cut = cut if count is None else min(cut, count)
        self.spark, self.steps, self.rest, self.computed = spark, list(steps[:cut]), list(steps[cut:]), 0
        told = json.dumps([[s.name, s.params] for s in self.steps], sort_keys=True, default=str)
        self.fingerprint = hashlib.sha256(told.encode()).hexdigest()
        self.folder = f"{folder.rstrip('/')}/{self.fingerprint}"

    def _commits(self) -> list[str]:
        try:
            rows = self.spark.read.schema("batch string").parquet(f"{self.folder}/commits").collect()  # a row for each run that computed something
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return [r.batch for r in rows]

    def stored(self) -> DataFrame | None:
        """All committed rows of these steps, one of each item; None if there are none yet."""
        batches = self._commits()
        if not batches:
            return None
        return self.spark.read.parquet(*[f"{self.folder}/{b}" for b in batches]).dropDuplicates([HASH])

    @staticmethod
    def _through(df: DataFrame, steps: Sequence[NamedStep]) -> DataFrame:
        for step in steps:
            df = step.run(df, **step.params)
        if HASH not in df.columns:
            raise ValueError(f"a step dropped the column {HASH}")
        return df

    def fetch(self, items: DataFrame) -> DataFrame:
        """For each row of ``items`` its row after all steps; ``computed`` then tells how many different items missed.

        Repeated items are computed once and given as often as they stand in ``items``."""
        hashed = items.withColumn(HASH, item_hash(items))
        known = self.stored()
        missing = hashed.dropDuplicates([HASH])
        if known is not None:
            missing = missing.join(known.select(HASH), HASH, "left_anti")
        made, name = self._through(missing, self.steps), f"batch-{uuid.uuid4().hex}"
        made.write.parquet(f"{self.folder}/{name}")
        fresh = self.spark.read.schema(made.schema).parquet(f"{self.folder}/{name}")
        self.computed = fresh.count()
        if self.computed:
            self.spark.createDataFrame([(name,)], "batch string").coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        both = fresh if known is None else known.unionByName(fresh)
        return self._through(hashed.select(HASH).join(both, HASH), self.rest)
