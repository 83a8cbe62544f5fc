"""Joining, selecting, defaulting and grouping columns of record tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.core.storage import with_row_index


def join_tables(frames: list[DataFrame], on: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Equi-joins in order, on ``on`` or else on all columns that both sides have."""

    def pair(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, on or [c for c in left.columns if c in right.columns], how)

    return reduce(pair, frames)


def with_defaults(df: DataFrame, defaults: dict[str, object], types: dict[str, str] | None = None) -> DataFrame:
    """Null and NaN become the default first; casts come after."""
    new: dict[str, Column] = {}
    kinds = dict(df.dtypes)
    for name, value in defaults.items():
        column = F.col(name)
        if kinds[name] in ("double", "float"):
            column = F.when(F.isnan(column), None).otherwise(column)
        new[name] = F.coalesce(column, F.lit(value))
    for name, kind in (types or {}).items():
        new[name] = new.get(name, F.col(name)).cast(kind)
    return df.withColumns(new)


def group_columns(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One array column of several columns, in the given order."""
    return df.withColumn(name, F.array(*columns))


def select_rows(df: DataFrame, wanted: list[int | tuple[int, int]], *order: str) -> DataFrame:
    """Rows by place or by [start, end) range; a row asked for twice comes twice."""
    ranges = [(w, w + 1) if isinstance(w, int) else w for w in wanted]
    indexed = with_row_index(df, *order)
    hits = F.filter(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ranges]), lambda r: (r["a"] <= F.col("row_index")) & (F.col("row_index") < r["b"]))
    return indexed.withColumn("hit__", F.explode(hits)).drop("hit__")


def zip_tables(left: DataFrame, left_order: str, right: DataFrame, right_order: str) -> DataFrame:
    """Rows at equal places side by side, as long as the shorter table."""
    return with_row_index(left, left_order).join(with_row_index(right, right_order), "row_index")


def chunk_join(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str], on: tuple[str, str], size: int) -> DataFrame:
    """Joins chunk i of one table with chunk i of the other only."""
    a = with_row_index(left, *left_order).withColumn("chunk", F.floor(F.col("row_index") / size)).drop("row_index")
    b = with_row_index(right, *right_order).withColumn("chunk_b", F.floor(F.col("row_index") / size)).drop("row_index")
    return a.join(b, (a[on[0]] == b[on[1]]) & (a["chunk"] == b["chunk_b"])).drop("chunk_b")


def missing_references(df: DataFrame, key: str, there: DataFrame, key_there: str) -> DataFrame:
    """Rows whose key is nowhere in the other table."""
    return df.join(there.select(F.col(key_there).alias("there__")).distinct(), F.col(key) == F.col("there__"), "left_anti")


def flatten_struct(df: DataFrame, column: str, prefix: str | None = None) -> DataFrame:
    """Fields of a struct as columns ``prefix_field``; a clash of names is an error."""
    fields = df.schema[column].dataType.fieldNames()
    names = [f"{prefix}_{f}" if prefix else f for f in fields]
    clash = set(names) & set(df.columns) - {column}
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    return df.select(*[c for c in df.columns if c != column], *[F.col(f"{column}.{f}").alias(n) for f, n in zip(fields, names, strict=True)])


def override_column(df: DataFrame, key: str, value: str, table: DataFrame, new_value: str) -> DataFrame:
    """``value`` taken from a table that must have every key; NaN, and what the column's type can't hold, is null."""
    fresh = table.select(F.col(key).alias("k__"), F.col(new_value).alias("v__"))
    both = df.join(fresh, F.col(key) == F.col("k__"), "left")
    taken = F.when(F.col("k__").isNull(), F.raise_error(F.concat(F.lit("no override for "), F.col(key).cast("string")))).otherwise(F.col("v__"))
    if table.schema[new_value].dataType.typeName() in ("double", "float"):
        taken = F.when(~F.isnan(taken), taken)
    return both.withColumn(value, taken.try_cast(df.schema[value].dataType)).drop("k__", "v__")
