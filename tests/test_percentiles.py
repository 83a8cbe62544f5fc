"""Percentiles of groups by ranges of their values."""

import random

from pyspark.sql import functions as F

from strataframe.operators import label_reports as R
from strataframe.operators import stats


def test_percentiles_equal_the_buffered_ones(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice([None, -0.5, rng.gauss(0, 9), float(rng.randrange(9))])) for k in ("a", "b", None) for _ in range(200)] + [("one", 3.5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    at = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    want = {r.k: r.e for r in df.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(q) for q in at])).alias("e")).collect() if r.e}
    assert {r.k: r.e__ for r in stats.exact_percentiles(df, ["k"], "v", at).collect()} == want
    low = {r.k: (r.low, r.high) for r in R.robust_range(df, ["k"], "v", 1.0, 99.0).collect()}
    assert low["none"] == (None, None) and low["one"] == (3.5, 3.5) and low["a"] == (want["a"][1], want["a"][4])


def test_clip_score_holds_no_group_in_a_buffer(spark, capsys):
    df = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", None), (None, 2.0)], "k string, v double")
    found = R.clip_score(df, ["k"], "v")
    found.explain()
    assert "percentile" not in capsys.readouterr().out
    assert sorted((r.k, r.v) for r in found.where("v is not null").collect()) == [("a", -1.0), ("a", 1.0)] and found.where("k = 'b'").count() == 1
