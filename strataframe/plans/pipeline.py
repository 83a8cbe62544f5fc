"""Pipelines of steps over tables, chosen, skipped or repeated by rule."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


class Pipeline:
    """Steps in order; a pipeline is a step too, and flattens into another."""

    def __init__(self, *steps: Step):
        self.steps = [s for step in steps for s in (step.steps if type(step) is Pipeline else [step])]

    def __call__(self, df: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
        for step in self.steps[start:end]:
            df = step(df)
        return df

    def __len__(self) -> int:
        return len(self.steps)


def on_columns(keys: Sequence[str], f: Callable[[Column], Column], allow_missing: bool = False) -> Step:
    """A column function applied to each key; a key that isn't there is an error, or is skipped."""

    def step(df: DataFrame) -> DataFrame:
        missing = [k for k in keys if k not in df.columns]
        if missing and not allow_missing:
            raise KeyError(f"columns are missing: {missing}")
        return df.withColumns({k: f(F.col(k)) for k in keys if k in df.columns})

    return step


def unit_hash(seed: int, *columns: str) -> Column:
    """A number in [0, 1) for each row, alike on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 53)) / float(1 << 53)


def sometimes(keys: Sequence[str], f: Callable[[Column], Column], prob: float, seed: int, *identity: str) -> Step:
    """A column function applied to each row with chance ``prob``, all keys together."""

    def step(df: DataFrame) -> DataFrame:
        chosen = df.withColumn("go__", unit_hash(seed, *identity) < prob)
        return chosen.withColumns({k: F.when(F.col("go__"), f(F.col(k))).otherwise(F.col(k)) for k in keys}).drop("go__")

    return step


def one_of(keys: Sequence[str], choices: Sequence[Callable[[Column], Column]], weights: Sequence[float] | None, seed: int, *identity: str) -> Step:
    """One of several column functions for each row, chosen by weight."""
    weights = list(weights or [1.0] * len(choices))
    total, ends, so_far = sum(weights), [], 0.0
    for w in weights:
        so_far += w / total
        ends.append(so_far)

    def step(df: DataFrame) -> DataFrame:
        marked = df.withColumn("at__", unit_hash(seed, *identity))

        def picked(k: str) -> Column:
            out = None
            for end, f in zip(ends[:-1], choices[:-1], strict=True):
                test = F.col("at__") < end
                out = F.when(test, f(F.col(k))) if out is None else out.when(test, f(F.col(k)))
            return choices[-1](F.col(k)) if out is None else out.otherwise(choices[-1](F.col(k)))

        return marked.withColumns({k: picked(k) for k in keys}).drop("at__")

    return step
