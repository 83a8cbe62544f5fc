"""Steps that can be undone: each row keeps the names of what was applied to it, in order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.operators.partition import hash_unit

TRACE = "applied"


@dataclass(frozen=True)
class Traced:
    """A column function with its inverse, applied to rows with chance ``prob``.

    The chance is a hash of seed and identity columns, one draw for all keys, so reruns agree.  Names of a
    pipeline must differ, as the trace holds names only."""

    name: str
    keys: Sequence[str]
    apply: Callable[[Column], Column]
    undo: Callable[[Column], Column]
    prob: float = 1.0
    seed: int = 0
    identity: Sequence[str] = ()

    def __call__(self, df: DataFrame) -> DataFrame:
        if TRACE not in df.columns:
            df = df.withColumn(TRACE, F.array().cast("array<string>"))
        go = F.lit(True) if self.prob >= 1 else hash_unit(self.seed, *self.identity) < self.prob
        marked = df.withColumn("go__", go)
        changed = {k: F.when(F.col("go__"), self.apply(F.col(k))).otherwise(F.col(k)) for k in self.keys}
        trace = F.when(F.col("go__"), F.array_append(TRACE, F.lit(self.name))).otherwise(F.col(TRACE))
        return marked.withColumns({**changed, TRACE: trace}).drop("go__")


def undo(df: DataFrame, steps: Sequence[Traced], keys: Sequence[str] | None = None) -> DataFrame:
    """Rows as they were before ``steps``: the last name of each row's trace is undone first.

    ``keys`` limits what is undone to some columns; the trace is shortened either way.  A row whose trace
    doesn't end with the steps, in their order, is an error when it's read."""
    if len({s.name for s in steps}) != len(steps):
        raise ValueError("steps need names of their own")
    if TRACE not in df.columns:
        raise KeyError(f"no column {TRACE}: nothing was traced")
    for step in reversed(steps):
        last = F.coalesce(F.try_element_at(TRACE, F.lit(-1)) == step.name, F.lit(False))
        marked = df.withColumn("go__", last)
        changed = {k: F.when(F.col("go__"), step.undo(F.col(k))).otherwise(F.col(k)) for k in step.keys if keys is None or k in keys}
        strayed = F.array_contains(TRACE, step.name)
        shorter = F.when(F.col("go__"), F.slice(TRACE, F.lit(1), F.size(TRACE) - 1)).when(strayed, F.raise_error(F.lit(f"{step.name} isn't the last step applied"))).otherwise(F.col(TRACE))
        df = marked.withColumns({**changed, TRACE: shorter}).drop("go__")
    return df


def some_of(steps: Sequence[Callable[[Column], Column]], keys: Sequence[str], seed: int, *identity: str, least: int | None = None, most: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """Some of several column functions for each row, in an order drawn for the row.

    All of them in random order by default; between ``least`` and ``most`` of them otherwise.  Both draws are
    hashes of the identity columns."""
    n = len(steps)
    low, high = (n if least is None else least), (n if most is None else most)
    if not 0 <= low <= high <= n:
        raise ValueError("between 0 and all of the steps can be taken")

    def step(df: DataFrame) -> DataFrame:
        order = F.transform(F.array_sort(F.array(*[F.struct(hash_unit(seed + 1 + i, *identity).alias("h"), F.lit(i).alias("i")) for i in range(n)])), lambda x: x["i"])
        count = F.lit(low) + F.floor(hash_unit(seed, *identity) * (high - low + 1)).cast("int")
        df = df.withColumns({"order__": F.slice(order, F.lit(1), count)})
        for place in range(high):
            at = F.get("order__", F.lit(place))
            made = {}
            for k in keys:
                value = F.col(k)
                choice = F.when(at.isNull(), value)
                for i, f in enumerate(steps):
                    choice = choice.when(at == i, f(value))
                made[k] = choice.otherwise(value)
            df = df.withColumns(made)
        return df.drop("order__")

    return step
