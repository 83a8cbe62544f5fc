"""Column operators, array functions and box modes on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from strataframe.core.storage import with_running_sums
from strataframe.operators import boxes, columns, elements, partition


def test_choosing_columns(spark):
    df = spark.createDataFrame([(1, "a", (2, (3, 4)))], "x int, `y.z` string, s struct<p: int, q: struct<u: int, v: int>>")
    assert columns.select_columns(df, ["y.z", "x", "no"], allow_missing=True).columns == ["y.z", "x"]
    with pytest.raises(KeyError):
        columns.select_columns(df, ["no"])
    assert columns.delete_columns(df, ["s.q.u", "x"]).select("s.*").schema.simpleString() == "struct<p:int,q:struct<v:int>>"
    assert columns.delete_columns(df, ["s.q.u", "s.q.v", "s.p"]).columns == ["x", "y.z"]
    assert columns.delete_columns(df, ["s.q.*", "x"], pattern=True).select("s.*").columns == ["p"]
    assert columns.copy_columns(df, ["x"], ["x0", "x1"], 2).select("x0", "x1").first() == (1, 1)
    for names, times, error in ((["x0"], 2, ValueError), (["s"], 1, KeyError), (["x0"], 0, ValueError)):
        with pytest.raises(error):
            columns.copy_columns(df, ["x"], names, times)


def test_joining_and_casting_columns(spark):
    df = spark.createDataFrame([([1, 2], [3], 4), (None, [5], 6), ([], [], None)], "a array<int>, b array<int>, c int")
    assert [r.j for r in columns.concat_columns(df, ["a", "b"], "j").collect()] == [[1, 2, 3], None, []]
    assert [r.j for r in columns.concat_columns(df, ["c", "c"], "j").collect()] == [[4, 4], [6, 6], None]
    with pytest.raises(TypeError):
        columns.concat_columns(df, ["a", "c"], "j")
    text = spark.createDataFrame([("1.5",), ("x",), (None,)], "t string")
    assert [r.t for r in columns.cast_columns(text, {"t": "double"}).collect()] == [1.5, None, None]
    assert columns.squeeze(df.where("c = 6"), "b").first().b == 5
    with pytest.raises(Exception, match="not one element"):
        columns.squeeze(df, "a").collect()
    assert columns.split_column(df.where("c = 4"), "a", ["x", "y", "z"]).select("x", "y", "z").first() == (1, 2, None)
    swapped = df.select("c", "b", "a")
    assert [r.h for r in df.select(columns.item_hash(df).alias("h")).collect()] == [r.h for r in swapped.select(columns.item_hash(swapped).alias("h")).collect()]
    assert {(r.c, r.n) for r in columns.distinct_values(df.union(df), "c").collect()} == {(4, 2), (6, 2), (None, 2)}


def test_array_functions(spark):
    v, empty = F.array(*map(F.lit, [3.0, 0.0, 3.0, -1.0])), F.array().cast("array<double>")
    row = spark.range(1).select(
        elements.softplus(F.lit(800.0)).alias("softplus"), elements.floor_divide(F.lit(-7), F.lit(2)).alias("whole"), elements.floor_divide(F.lit(1), F.lit(0)).alias("none"),
        elements.clip(v, 0.0, 2.0).alias("clip"), elements.nonzero(v).alias("nonzero"), elements.argsort(v).alias("argsort"), elements.unique(v).alias("unique"), elements.mode(v).alias("mode"),
        elements.searchsorted(elements.unique(v), F.lit(0.0)).alias("left"), elements.searchsorted(elements.unique(v), F.lit(0.0), True).alias("right"),
        elements.percentile(v, 50.0).alias("median"), elements.percentile(empty, 50.0).alias("no_median"), elements.mask_values(v, elements.foreground(v, 0.0, True)).alias("masked"),
        elements.swap_axes(F.array(v, v))[0].alias("swapped"), elements.swap_axes(F.array(empty)).alias("nothing"), elements.all_close(v, v).alias("close"), elements.all_close(v, empty).alias("far"),
        elements.remove_repeated(elements.repeat(v, 2), 2).alias("again"), *[c.alias(f"s_{n}") for n, c in elements.summary(empty).items()],
    ).first()
    assert (row.softplus, row.whole, row.none, row.clip, row.nonzero, row.argsort) == (800.0, -4, None, [2.0, 0.0, 2.0, 0.0], [0, 2, 3], [3, 1, 0, 2])
    assert (row.unique, row["mode"], row.left, row.right, row.median, row.no_median, row.masked) == ([-1.0, 0.0, 3.0], 3.0, 1, 2, 1.5, None, [0.0, 0.0, 0.0, -1.0])
    assert (row.swapped, row.nothing, row.close, row.far, row.again) == ([3.0, 3.0], [], True, False, [3.0, 0.0, 3.0, -1.0])
    assert all(row[f"s_{n}"] is None for n in ("max", "mean", "min", "sum", "std"))


def test_box_modes(spark):
    flat = F.array(*map(F.lit, [1.0, 2.0, 5.0, 8.0]))
    row = spark.range(1).select(
        boxes.convert_mode(flat, "xyxy", "ccwh").alias("c"), boxes.convert_mode(flat, "xyxy", "xxyy").alias("p"), boxes.convert_mode(flat, "xywh", "xyxy").alias("w"),
        boxes.valid_box(flat, "xyxy").alias("ok"), boxes.valid_box(flat, "xxyy").alias("also"), boxes.box_volume(flat, "xyxy").alias("area"),
        boxes.center_distance(flat, flat, "xywh").alias("near"), boxes.convert_mode(F.lit(None).cast("array<double>"), "xyxy", "ccwh").alias("null"),
    ).first()
    assert (row.c, row.p, row.w) == ([3.0, 5.0, 4.0, 6.0], [1.0, 5.0, 2.0, 8.0], [1.0, 2.0, 6.0, 10.0])
    assert (row.ok, row.also, row.area, row.near, row["null"]) == (True, True, 24.0, 0.0, None)
    for source, target in (("xyxy", "cccwhd"), ("xyxy", "no"), ("nono", "xyxy")):
        with pytest.raises(ValueError):
            boxes.convert_mode(flat, source, target)


def test_running_sums_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("k"), (F.col("id") % 7).alias("v")).repartition(5)
    for keys in ((), ("g",)):
        rows = with_running_sums(df.withColumn("g", F.lit(1)), F.desc("k"), {"up": "v"}, keys).orderBy(F.desc("k")).collect()
        total = 0
        for r in rows:
            total += r.v
            assert r.up == total
    assert with_running_sums(df.limit(0), F.asc("k"), {"up": "v"}).count() == 0


def test_weighted_draws_follow_their_weights(spark):
    df = spark.createDataFrame([(i, float(w)) for i, w in enumerate([0, 5, 0, 1, 94])], "i long, w double")
    n = {r.i: r["count"] for r in partition.weighted_pick(df, "w", 2000, "i").groupBy("i").count().collect()}
    assert set(n) == {1, 3, 4} and sum(n.values()) == 2000 and math.isclose(n[4] / 2000, 0.94, abs_tol=0.02)
    even = partition.weighted_pick(df.withColumn("w", F.lit(0.0)), "w", 500, "i").groupBy("i").count().collect()
    assert len(even) == 5 and partition.weighted_pick(df.limit(0), "w", 10, "i").count() == 0
