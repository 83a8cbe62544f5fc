"""Columns of a record table: choosing, dropping, copying, joining and casting them, and hashing rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _known(df: DataFrame, keys: Sequence[str], allow_missing: bool) -> list[str]:
    missing = [k for k in keys if k not in df.columns]
    if missing and not allow_missing:
        raise KeyError(f"no columns {missing}")
    return [k for k in keys if k in df.columns]


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def select_columns(df: DataFrame, keys: Sequence[str], allow_missing: bool = False) -> DataFrame:
    """Only the columns ``keys``, in that order; a missing one is an error unless allowed."""
    return df.select(*[_quoted(k) for k in _known(df, keys, allow_missing)])


def delete_columns(df: DataFrame, keys: Sequence[str], separator: str = ".", pattern: bool = False) -> DataFrame:
    """``df`` without ``keys``; ``a.b`` is field b of the struct a.  As patterns, keys match whole paths.

    What isn't there is left alone; a struct that loses all its fields goes too."""

    def paths(schema, before=()):
        for f in schema.fields:
            yield (*before, f.name)
            if f.dataType.typeName() == "struct":
                yield from paths(f.dataType, (*before, f.name))

    every = [p for p in paths(df.schema)]
    wanted = lambda p: any(re.fullmatch(k, separator.join(p)) if pattern else k == separator.join(p) for k in keys)
    gone = {p for p in every if any(wanted(p[: i + 1]) for i in range(len(p)))}
    for path in sorted(every, key=len, reverse=True):  # a struct of which nothing is left
        inner = [p for p in every if len(p) == len(path) + 1 and p[: len(path)] == path]
        if inner and all(p in gone for p in inner):
            gone.add(path)
    out = []
    for name in df.columns:
        if (name,) not in gone:
            least = [p for p in gone if p[0] == name and len(p) > 1 and p[:-1] not in gone]
            fields = [".".join(f"`{x}`" for x in p[1:]) for p in least]
            out.append(_quoted(name).dropFields(*fields).alias(name) if fields else _quoted(name))
    return df.select(*out)


def copy_columns(df: DataFrame, keys: Sequence[str], names: Sequence[str], times: int = 1, allow_missing: bool = False) -> DataFrame:
    """``times`` copies of the columns ``keys``, named by ``names``: all of the first copy, then of the next."""
    if times < 1 or len(names) != times * len(keys) or len(set(names)) != len(names):
        raise ValueError("each copy of each column needs a name of its own")
    taken = set(names) & set(df.columns)
    if taken:
        raise KeyError(f"columns exist already: {sorted(taken)}")
    there = set(_known(df, keys, allow_missing))
    pairs = [(k, names[t * len(keys) + i]) for t in range(times) for i, k in enumerate(keys) if k in there]
    return df.withColumns({name: _quoted(k) for k, name in pairs})


def concat_columns(df: DataFrame, keys: Sequence[str], name: str, allow_missing: bool = False) -> DataFrame:
    """Arrays one after the other, or plain values as one array, in the order of ``keys``; null if one is null."""
    there = _known(df, keys, allow_missing)
    kinds = {df.schema[k].dataType.typeName() for k in there}
    if "array" in kinds and len(kinds) > 1:
        raise TypeError("arrays and plain values can't be joined")
    columns = [_quoted(k) for k in there]
    some = F.lit(False)
    for c in columns:
        some = some | c.isNull()
    joined = F.concat(*columns) if kinds == {"array"} else F.array(*columns)
    return df.withColumn(name, F.when(~some, joined))


def cast_columns(df: DataFrame, kinds: dict[str, str], allow_missing: bool = False) -> DataFrame:
    """Columns as the given types; what doesn't fit is null."""
    return df.withColumns({k: _quoted(k).try_cast(kinds[k]) for k in _known(df, list(kinds), allow_missing)})


def squeeze(df: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """An array column of one element as that element; other lengths are an error."""
    one = F.when(F.size(key) == 1, F.get(F.col(key), F.lit(0))).when(F.col(key).isNotNull(), F.raise_error(F.lit(f"{key}: not one element")))
    return df.withColumn(name or key, one)


def split_column(df: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """The elements of an array column as columns of their own; missing elements are null."""
    return df.select(*[_quoted(c) for c in df.columns if c != key], *[F.get(F.col(key), F.lit(i)).alias(n) for i, n in enumerate(names)])


def item_hash(df: DataFrame, keys: Sequence[str] | None = None) -> Column:
    """md5 of a row as JSON with its keys in order: alike for equal items, whatever the order of columns."""
    return F.md5(F.to_json(F.struct(*[_quoted(k) for k in sorted(keys or df.columns)]), {"ignoreNullFields": "false"}))


def distinct_values(df: DataFrame, key: str) -> DataFrame:
    """Distinct values of a column and how many rows hold each; null is a value."""
    return df.groupBy(_quoted(key).alias(key)).agg(F.count(F.lit(1)).alias("n"))
