"""Buffers that live across micro-batches: shuffling a stream, and holding its latest rows."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LANE = "lane__"


class _Shuffle(StatefulProcessor):
    """Holds up to ``size`` rows of a lane; more than that push random ones out, and a quiet spell empties it."""

    def __init__(self, schema, size: int, wait_ms: int, seed: int):
        self.schema, self.size, self.wait_ms, self.seed = schema, size, wait_ms, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)
        self.count = handle.getValueState("seen", "n long")
        self.timer = handle.getValueState("timer", "at long")

    def _lane(self, key, held: list[tuple], seen: int) -> random.Random:
        return random.Random(f"{self.seed}:{key[0]}:{seen}:{len(held)}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        seen = self.count.get()[0] if self.count.exists() else 0
        pick, out = self._lane(key, held, seen), []
        names = self.schema.names
        for frame in rows:
            for row in frame[names].itertuples(index=False, name=None):
                seen += 1
                if len(held) < self.size:
                    held.append(row)
                    continue
                i = pick.randrange(self.size + 1)
                if i < self.size:
                    held[i], row = row, held[i]
                out.append(row)
        self.held.put([tuple(plain(v) for v in row) for row in held])
        self.count.update((seen,))
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        at = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
        self.handle.registerTimer(at)
        self.timer.update((at,))
        yield pd.DataFrame(out, columns=names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        self._lane(key, held, -1).shuffle(held)
        self.held.clear()
        self.timer.clear()
        yield pd.DataFrame(held, columns=self.schema.names)

    def close(self) -> None:
        pass


def plain(value):
    """A number or time as Python has it, as states want them."""
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value.item() if hasattr(value, "item") else value


def shuffle_buffer(stream: DataFrame, size: int, lanes: int = 8, wait_ms: int = 2000, seed: int = 0) -> DataFrame:
    """The rows of a stream in a random order that looks ``size`` rows ahead in each of ``lanes``, across micro-batches.

    A row goes to a lane by its hash.  A lane holds its rows in state; each new row pushes out one of them or
    passes by, at random.  ``wait_ms`` after its last row a lane is emptied.  Every row leaves exactly once, also
    if the query stops and goes on from its checkpoint, as buffer and progress are committed together.  A lane
    is one group in memory of at most ``size`` rows and its share of a micro-batch.  The session needs the RocksDB
    state store (``spark.sql.streaming.stateStore.providerClass``) and a query in append mode."""
    lane = F.pmod(F.xxhash64(*stream.columns), F.lit(lanes)).cast("int")
    dealt = stream.withColumn(LANE, lane)
    processor = _Shuffle(stream.schema, size, wait_ms, seed)
    return dealt.groupBy(LANE).transformWithStateInPandas(statefulProcessor=processor, outputStructType=stream.schema, outputMode="Append", timeMode="ProcessingTime")
