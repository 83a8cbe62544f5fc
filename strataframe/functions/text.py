"""Names, paths, JSON maps and edit distances as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column, suffix: str = ".") -> Column:
    """The last part of a path before its first dot."""
    return F.element_at(F.split(basename(path), r"\."), 1)


def output_name(path: Column, postfix: str, ext: str, root: str) -> Column:
    """root/stem/stem_postfix.ext"""
    name = stem(path)
    return F.concat(F.lit(f"{root}/"), name, F.lit("/"), name, F.lit(f"_{postfix}{ext}"))


def str_to_bool(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin("yes", "true", "t", "y", "1"), True).when(low.isin("no", "false", "f", "n", "0"), False)


def str_to_list(value: Column) -> Column:
    return F.transform(F.split(value, ","), F.trim)


def json_number(value: Column, path: str) -> Column:
    return F.get_json_object(value, path).cast("double")


@F.pandas_udf(IntegerType())
def edit_distance_with_swaps(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance that counts a swap of neighbours as one step; null if either side is."""

    def one(s, t):
        if s is None or t is None:
            return None
        older, row = [], list(range(len(t) + 1))
        for i in range(1, len(s) + 1):
            new = [i] + [0] * len(t)
            for j in range(1, len(t) + 1):
                new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (s[i - 1] != t[j - 1]))
                if i > 1 and j > 1 and s[i - 1] == t[j - 2] and s[i - 2] == t[j - 1]:
                    new[j] = min(new[j], older[j - 2] + 1)
            older, row = row, new
        return row[-1]

    return pd.Series([one(s, t) for s, t in zip(a, b, strict=True)], dtype="Int32")
