"""Small cases with known answers."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.core.storage import with_row_index
from strataframe.functions import text as T
from strataframe.operators import arrays, boxes, graph, intensity, metrics, partition, segments, stats, tables, windows
from strataframe.plans.config import Config
from strataframe.plans.pipeline import Pipeline, on_columns, one_of, sometimes
from strataframe.sources import array_files, datalist, reports
from strataframe.streaming import aggregates, chunks


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_row_index_follows_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert sorted(values(with_row_index(df, "k"), "k", "row_index")) == [(i, i) for i in range(1000)]


def test_partitioning(spark):
    five = spark.createDataFrame([(i,) for i in range(1, 6)], "v int")
    parts = sorted(values(partition.round_robin(five, 2, "v"), "part", "v"))
    assert parts == [(0, 1), (0, 3), (0, 5), (1, 2), (1, 4)]
    assert partition.ratio_cuts(5, [2, 1]) == [3, 5] and partition.ratio_cuts(10, [1, 1, 1]) == [3, 6, 9]
    assert sorted(values(partition.even_padded(five, 2, "v"), "part", "v")) == [(0, 1), (0, 3), (0, 5), (1, 1), (1, 2), (1, 4)]
    some = spark.createDataFrame([(i, c) for i, c in enumerate([0, 0, 1, 1, 1, None])], "v int, c int")
    counts = values(partition.stratified(some, "c", 2, "v").groupBy("c", "part").count(), "c", "part", "count")
    assert sorted(counts, key=str) == sorted([(0, 0, 1), (0, 1, 1), (1, 0, 2), (1, 1, 1), (None, 0, 1)], key=str)
    assert sorted(values(partition.resample(five, 1.4, "v"), "v", "copy")) == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (4, 0), (5, 0)]
    picked = partition.weighted_pick(spark.createDataFrame([(1, -2.0), (2, 0.0), (3, 0.0)], "k int, w double"), "w", 50, "k")
    assert {k for (k,) in values(picked, "k")} == {2, 3} and picked.count() == 50
    assert partition.weighted_pick(spark.createDataFrame([(1, 0.0), (2, 0.0)], "k int, w double"), "w", 30, "k").count() == 30


def test_tables(spark):
    a = spark.createDataFrame([("s0", 1), ("s1", 2)], "id string, x int")
    b = spark.createDataFrame([("s0", float("nan")), ("s2", 5.0)], "id string, y double")
    full = tables.with_defaults(tables.join_tables([a, b], how="full"), {"x": 0, "y": 1.5}, {"y": "int"})
    assert sorted(values(full, "id", "x", "y")) == [("s0", 1, 1), ("s1", 2, 1), ("s2", 0, 5)]
    nested = a.select(F.struct("id", "x").alias("s"), "x")
    assert tables.flatten_struct(nested, "s", "m").columns == ["x", "m_id", "m_x"]
    with pytest.raises(ValueError):
        tables.flatten_struct(nested, "s")
    with pytest.raises(Exception, match="no override"):
        tables.override_column(a, "id", "x", b, "y").collect()


def test_statistics(spark):
    df = spark.createDataFrame([(0, float(v)) for v in [1, 2, 3, 4]] + [(0, float("nan"))], "g int, v double")
    (r,) = stats.sample_stats(df, ["g"], "v").collect()
    assert (r["max"], r["mean"], r["median"], r["min"]) == (4.0, 2.5, 2.5, 1.0) and abs(r["stdev"] - np.std([1, 2, 3, 4])) < 1e-12
    counts = stats.histogram(df.where("not isnan(v)"), [], "v", 3, 1.0, 4.0)
    assert [n for _, n in sorted(values(counts, "bin", "n"))] == np.histogram([1, 2, 3, 4], 3, (1, 4))[0].tolist()
    with pytest.raises(Exception, match="edges differ"):
        stats.merge_histograms(counts.union(counts.withColumn("edge", F.col("edge") + 1))).collect()


def test_scaling(spark):
    df = spark.createDataFrame([(0, 5.0), (0, 5.0), (1, 0.0), (1, 10.0)], "g int, v double")
    assert sorted(values(intensity.scale_min_max(df, ["g"], "v", 0.0, 1.0), "g", "scaled")) == [(0, 0.0), (0, 0.0), (1, 0.0), (1, 1.0)]
    assert sorted(values(intensity.normalize(df, ["g"], "v", nonzero=True), "g", "normalized")) == [(0, 0.0), (0, 0.0), (1, 0.0), (1, 0.0)]
    (r,) = spark.range(1).select(intensity.scale_range(F.lit(9.0), 3.0, 3.0, 1.0, 2.0, True).alias("a"), intensity.relabel(F.lit(3), {3: 0, 0: 1}).alias("b")).collect()
    assert (r.a, r.b) == (7.0, 0)


def test_ranking_metrics(spark):
    rows = [(0.1, 0), (0.9, 0), (0.3, 1), (0.9, 1), (0.2, 0)]
    df = spark.createDataFrame(rows, "s double, t int")
    pos, neg = [s for s, t in rows if t], [s for s, t in rows if not t]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert abs(metrics.roc_auc(df, [], "s", "t").first().auc - auc) < 1e-12
    assert metrics.roc_auc(df.where("t = 1"), [], "s", "t").first().auc is None
    assert abs(metrics.average_precision(df, [], "s", "t").first().ap - (0.5 * 0.5 + 0.5 * (2 / 3))) < 1e-12


def test_overlap_policies(spark):
    df = spark.createDataFrame([(0, True, True), (0, True, False), (1, False, False), (2, True, False)], "g int, p boolean, t boolean")
    keep = dict(values(metrics.overlaps(df, ["g"], F.col("p"), F.col("t"), ignore_empty=False), "g", "dice"))
    assert keep == {0: 2 / 3, 1: 1.0, 2: 0.0}
    assert dict(values(metrics.overlaps(df, ["g"], F.col("p"), F.col("t")), "g", "iou")) == {0: 0.5, 1: None, 2: None}
    reduced = metrics.reduce_metric(spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (1, 0, None), (1, 1, None)], "s int, c int, v double"), "s", "c", "v").first()
    assert reduced["mean"] == 1.0 and reduced["not_nans"] == 1


def test_windows(spark):
    assert values(spark.range(1).select(windows.window_starts(F.lit(10), 4, 0.5).alias("a"), windows.window_starts(F.lit(3), 4, 0.5).alias("b")), "a", "b") == [([0, 2, 4, 6], [0])]
    df = spark.createDataFrame([(0, i, float(i)) for i in range(10)], "k int, i long, v double")
    merged = dict(values(windows.sliding_merge(df, ["k"], "i", "v", 4, 0.5, F.avg("v"), center_weight=False), "i", "merged"))
    assert merged[0] == 1.5 and merged[2] == 2.5 and len(merged) == 10
    assert values(windows.early_stop(spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, 3.0, 2.0, 2.5, 3.0])], "k int, i int, v double"), ["k"], ["i"], "v", 2), "stop_place") == [(4,)]


def test_boxes(spark):
    rows = [(1, 0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (2, 0, 0, 0.8, 1.0, 1.0, 11.0, 11.0), (3, 0, 0, 0.7, 40.0, 40.0, 50.0, 50.0)]
    df = spark.createDataFrame(rows, "box int, image int, label int, score double, xmin double, ymin double, xmax double, ymax double")
    assert sorted(values(boxes.suppress(df, ["image", "label"], "score", "box", 0.5), "box")) == [(1,), (3,)]
    pairs = boxes.overlap_join(df, df, "image", 7.0).where("a_box < b_box").collect()
    assert len(pairs) == 1 and abs(pairs[0].iou - 81 / 119) < 1e-12
    made = spark.createDataFrame([(0, 1, 7, 0.9, 0.8), (0, 1, 8, 0.9, 0.9), (0, 2, 8, 0.5, 0.95)], "image int, pred int, truth int, score double, iou double")
    assert values(boxes.greedy_match(made, "image", "pred", "truth", "score", 0.5), "pred", "truth") == [(1, 8)]


def test_segments(spark):
    df = spark.createDataFrame([(0, "b"), (0, "a"), (1, "c"), (1, "c"), (1, "a")], "s int, l string")
    assert sorted(values(segments.majority(df, ["s"], "l"), "s", "label", "votes")) == [(0, "a", 1), (1, "c", 2)]
    assert dict(values(segments.majority_without_ties(df, ["s"], "l", "?"), "s", "label")) == {0: "?", 1: "c"}


def test_label_propagation_on_a_small_graph(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0), (1, 0.1, -1), (2, 5.0, 1)], "node long, x double, label int").withColumn("v", F.array("x")).withColumn("g", F.lit(0))
    edges = graph.affinity(graph.knn(nodes, "node", "v", "g", 2))
    assert dict(values(graph.propagate(nodes.select("node", "label"), edges, 0.99, 10), "node", "label")) == {0: 0, 1: 0, 2: 1}


def test_arrays(spark):
    v = F.array(*map(F.lit, [1.0, 2.0, 3.0]))
    (r,) = spark.range(1).select(arrays.pad_to(v, 6).alias("a"), arrays.center_crop(v, 1).alias("b"), arrays.argmax(v).alias("c"), arrays.softmax(v).alias("d"), arrays.flip(v).alias("e"), arrays.cumulative_sum(v).alias("f")).collect()
    assert r.a == [0, 1, 2, 3, 0, 0] and r.b == [2] and r.c == 2 and abs(sum(r.d) - 1) < 1e-12 and r.e == [3, 2, 1] and r.f == [1, 3, 6]


def test_text(spark):
    df = spark.createDataFrame([("ca", "abc"), ("abcd", "abdc"), (None, "x")], "a string, b string")
    assert values(df.select(T.edit_distance_with_swaps("a", "b").alias("n")), "n") == [(3,), (1,), (None,)]
    (r,) = spark.range(1).select(T.output_name(F.lit("/x/y/img.nii.gz"), "seg", ".nii", "out").alias("p"), T.str_to_bool(F.lit(" Yes ")).alias("b")).collect()
    assert (r.p, r.b) == ("out/img/img_seg.nii", True)


def test_pipeline_and_config(spark):
    df = spark.range(400).select("id", F.lit(1.0).alias("x"))
    plan = Pipeline(on_columns(["x"], lambda c: c * 2), Pipeline(sometimes(["x"], lambda c: c + 10, 0.5, 3, "id")))
    found = [x for (x,) in values(plan(df), "x")]
    assert len(plan) == 2 and set(found) == {2.0, 12.0} and 140 < found.count(12.0) < 260 and found == [x for (x,) in values(plan(df), "x")]
    assert {x for (x,) in values(one_of(["x"], [lambda c: c, lambda c: c + 1, lambda c: c + 2], [1, 1, 2], 1, "id")(df), "x")} == {1.0, 2.0, 3.0}
    with pytest.raises(KeyError):
        on_columns(["y"], lambda c: c)(df)
    assert on_columns(["y"], lambda c: c, allow_missing=True)(df).columns == ["id", "x"]
    config = Config({"k": 2, "step": {"_target_": "scale", "by": "@k"}, "off": {"_target_": "nope", "_disabled_": True}, "all": ["@step", {"a": "@k"}]}, {"scale": lambda by: ("scaled", by)})
    assert config.resolve("all") == [("scaled", 2), {"a": 2}] and "off" not in config.resolve()
    config.set("k", 5)
    assert config.resolve("step") == ("scaled", 5)
    with pytest.raises(ValueError):
        Config({"a": "@b", "b": "@a"}).resolve("a")


def test_sources(spark, tmp_path):
    volume = np.arange(24, dtype=float).reshape(2, 3, 4)
    np.save(tmp_path / "a.npy", volume)
    np.savez(tmp_path / "b.npz", one=volume[0], two=volume[1])
    (tmp_path / "c.nii").write_bytes(array_files.write_nifti(volume, [1.0, 2.0, 3.0]))
    (tmp_path / "d.npy").write_bytes(b"broken")
    rows = {(r.path.rsplit("/", 1)[-1], r.name): r for r in array_files.read_arrays(spark, str(tmp_path)).collect()}
    assert rows["a.npy", "array"]["values"] == volume.ravel().tolist() and rows["b.npz", "two"].shape == [3, 4]
    assert rows["c.nii", "image"]["values"] == volume.ravel().tolist() and rows["c.nii", "image"].spacing == [1.0, 2.0, 3.0]
    assert rows["d.npy", None].error
    (tmp_path / "list.json").write_text(json.dumps({"training": [{"image": "i1", "label": "/l1", "fold": 0}, {"image": "i2", "label": "l2", "fold": 1}], "test": ["t1"]}))
    items = datalist.read_datalist(spark, str(tmp_path / "list.json"), base_dir="/data")
    assert sorted(values(items, "image", "label")) == [("/data/i1", "/l1"), ("/data/i2", "/data/l2")]
    train, val = datalist.split_fold(items, 1)
    assert (train.count(), val.count()) == (1, 1)
    assert values(datalist.read_datalist(spark, str(tmp_path / "list.json"), "test", "/d"), "image") == [("/d/t1",)]
    saved = spark.createDataFrame([("f1", 1, 0.5), ("f1", 2, 0.7), ("f2", 1, 0.1)], "file string, n int, v double")
    reports.write_csv(saved, str(tmp_path / "csv"), "file", "n")
    assert sorted(values(spark.read.option("header", True).csv(str(tmp_path / "csv")), "file", "v")) == [("f1", "0.7"), ("f2", "0.1")]
    reports.write_metric_report(saved, str(tmp_path / "rep"), "m", ["v"])
    assert spark.read.option("header", True).csv(str(tmp_path / "rep/m_summary")).count() == 2


def test_streams(spark, tmp_path):
    data = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", float(i), i % 2) for i in range(40)], "id int, t string, v double, k int").withColumn("t", F.to_timestamp("t"))
    data.repartition(4).write.parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        ended = q.awaitTermination(90)
        q.stop()
        assert ended
        return spark.table(name)

    stream = lambda: chunks.file_chunks(spark, str(tmp_path / "in"), data.schema, "parquet")
    assert dict(values(run(aggregates.running_average(stream(), ["k"], "v"), "complete", "avg1"), "k", "average")) == {0: 19.0, 1: 20.0}
    assert sum(n for (n,) in values(run(aggregates.tumbling(stream(), "t", ["k"], "v", "10 minutes", "1 hour"), "update", "win1").groupBy("start", "k").agg(F.max("n").alias("n")), "n")) == 40
    out = [i for (i,) in values(run(chunks.shuffled(stream(), 5, 1), "append", "shuf1"), "id")]
    assert sorted(out) == list(range(40)) and out != [i for (i,) in values(run(stream(), "append", "plain1"), "id")]


def test_report_of_confusion_metrics(spark):
    df = spark.createDataFrame([(3, 1, 5, 2)], "tp int, fp int, tn int, fn int")
    (r,) = df.select(*[c.alias(n) for n, c in metrics.confusion_metrics().items()]).collect()
    assert len(r) == 17 and math.isclose(r.f1, 6 / 9) and math.isclose(r.mcc, (15 - 2) / math.sqrt(4 * 5 * 6 * 7))


def test_analyzer(spark):
    from strataframe.operators import analyzer

    rows = [("a", [2, 2], [1.0, 2.0], [0.0, 1.0, 2.0, 3.0], [0, 0, 1, 1]), ("b", [2, 2], [1.0, 1.0], [5.0, 5.0, 5.0, 9.0], [0, 0, 0, 2]), ("c", [1, 2], [1.0, 1.0], [1.0, 2.0], [0, 0])]
    cases = spark.createDataFrame(rows, "case string, shape array<int>, spacing array<double>, image array<double>, label array<int>")
    found = {r.case: r for r in analyzer.by_case(cases).collect()}
    assert found["a"].image_stats["mean"] == 1.5 and found["a"].foreground_stats["median"] == 2.5 and found["a"].size_mm == [2.0, 4.0]
    assert found["c"].foreground_stats is None and [(x.label, x.share) for x in found["b"].label_stats] == [(0, 0.75), (2, 0.25)]
    whole = analyzer.summary(analyzer.by_case(cases)).first()
    assert whole.image_stats["max"] == 9.0 and whole.image_stats["n_cases"] == 3 and whole.foreground_stats["n_cases"] == 2
    assert [x.label for x in whole.label_stats] == [0, 1, 2]
    one, every = analyzer.histogram_report(cases, 4, 0.0, 8.0)
    assert one.count() == 12 and sum(r.n for r in every.collect()) == 9


def test_softmax_query_takes_the_place_of_its_sql(spark, tmp_path):
    """A number greater by less than a millionth a place is passed over; the last place is hot also where it ties."""
    near, tie = [0.5] * 64, [0.1] * 64
    near[10], tie[0], tie[63] = 0.5000005, 0.9, 0.9
    spark.createDataFrame([(1, near), (2, tie)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    from strataframe.queries import QUERIES

    got = {r.vec_id: (r.place, r.last_hot) for r in QUERIES["softmax_argmax_onehot"](spark, str(tmp_path)).collect()}
    assert got == {1: (0, 0), 2: (0, 1)}
