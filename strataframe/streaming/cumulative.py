"""Sums that grow batch by batch in a shared folder, each batch counted once, and read as a whole at any time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class CumulativeSums:
    """Partial sums by key of every batch, one small table a batch, under ``folder``/epoch=…/part=….

    ``sums`` are named columns whose sums make up the metric (counts of hits, squared errors, weights, ...); whatever
    can be derived from sums is derived from ``current``.  A batch that comes again, after a failure or a restart,
    replaces its own table, so it's counted once.  Several streams or jobs may add to one folder under names of
    their own; nothing is gathered but their sums.  ``reset`` begins a new epoch; earlier ones can still be read."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], sums: Mapping[str, Column], source: str = "all"):
        self.spark, self.folder, self.keys, self.sums, self.source, self.epoch = spark, folder.rstrip("/"), list(keys), dict(sums), source, 0

    def add(self, batch: DataFrame, number: int) -> None:
        """Sums of one batch, made where it's read."""
        partial = batch.groupBy(*self.keys).agg(*[F.sum(value).alias(name) for name, value in self.sums.items()])
        partial.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/epoch={self.epoch}/source={self.source}/part={number}")

    def attach(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """The stream's micro-batches added as they come; their numbers are the parts'."""
        writer = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def current(self, epoch: int | None = None) -> DataFrame | None:
        """Keys and total sums of all sources and batches of an epoch; None before the first."""
        try:
            rows = self.spark.read.option("basePath", self.folder).parquet(f"{self.folder}/epoch={self.epoch if epoch is None else epoch}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        return rows.groupBy(*self.keys).agg(*[F.sum(name).alias(name) for name in self.sums])

    def reset(self) -> None:
        self.epoch += 1


def counts_of_agreement(pred: Column, truth: Column) -> dict[str, Column]:
    """The sums behind confusion metrics of two booleans: tp, fp, fn, tn; a null on either side counts nowhere."""
    one = lambda test: F.when(test, 1).otherwise(0)
    return {"tp": one(pred & truth), "fp": one(pred & ~truth), "fn": one(~pred & truth), "tn": one(~pred & ~truth)}
