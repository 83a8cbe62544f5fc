"""Tables of the driver, and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it's unset, as in tests, a temporary folder of this machine.

    On a cluster other machines can't see such a folder, so there it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        java = spark.sparkContext._jsc.sc()
        if java.getCheckpointDir().isEmpty():
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strataframe-"))
        found = java.getCheckpointDir().get()
    return found.rstrip("/")


#: Rows of a written table beyond which it's never broadcast by the size of its files.
BROADCAST_ROWS = 100_000


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: a cut in the lineage that survives executors.

    Files of regular numbers are a hundredth of what a broadcast makes of them in the driver's memory, so a
    table of over ``BROADCAST_ROWS`` rows asks for joins by shuffle, whatever its files' size."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back.hint("merge") if back.count() > BROADCAST_ROWS else back


def with_row_index(df: DataFrame, *order: str | Column, name: str = "row_index") -> DataFrame:
    """``df`` with the place of each row in the given total order, from 0.

    The rows are dealt into ranges of the order and sorted there; the place within a range is known
    from the row's own task, and the ranges' sizes, one number for each, give the rest.  No task sees
    more than its range, unlike ``row_number`` over one window."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    mark = F.monotonically_increasing_id()
    rows = saved(dealt.withColumn("mark__", mark))
    part = F.shiftright("mark__", 33)
    sizes = rows.groupBy(part.alias("part__")).agg(F.count(F.lit(1)).alias("n__"))
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part__", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("start__"))
    both = rows.withColumn("part__", part).join(F.broadcast(starts), "part__")
    place = F.col("start__") + F.col("mark__").bitwiseAND((1 << 33) - 1)
    return both.select(*[F.col(f"`{c}`") for c in df.columns], place.cast("long").alias(name))


def with_running_sums(df: DataFrame, order: Column, sums: dict[str, str], keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with running sums ``{new name: column}`` in the given order, the row's own value included.

    Within ``keys`` a window does it.  Over a whole table the rows are dealt into ranges of the order,
    summed within each, and the sums of earlier ranges, one row for each, are added; so no task sees
    more than its range."""
    if keys:
        down = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(c).over(down) for name, c in sums.items()})
    rows = saved(df.repartitionByRange(order).withColumn("part__", F.spark_partition_id()))
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("part__").agg(*[F.sum(c).alias(f"{name}__") for name, c in sums.items()])
    starts = ranges.select("part__", *[F.coalesce(F.sum(f"{name}__").over(before), F.lit(0)).alias(f"{name}__") for name in sums])
    within = Window.partitionBy("part__").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.join(F.broadcast(starts), "part__")
    return both.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.sum(c).over(within) + F.col(f"{name}__")).alias(name) for name, c in sums.items()])


def whole_groups(frames: Iterator[pd.DataFrame], key: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups out of a task's batches, which are sorted by ``key``: a group that a batch cuts waits for the next one."""
    key, held = list(key), []
    alike = lambda frame, row: ((frame[key] == row[key]) | (frame[key].isna() & row[key].isna())).all(axis=1).to_numpy()
    for frame in frames:
        if not len(frame):
            continue
        if held and not alike(frame.iloc[:1], held[-1].iloc[-1])[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        last = alike(frame, frame.iloc[-1])
        if last.all():
            held.append(frame)
            continue
        yield pd.concat([*held, frame[~last]], ignore_index=True)
        held = [frame[last]]
    if held:
        yield pd.concat(held, ignore_index=True)
