"""NRRD files as a data source, the row cache, and buffers across micro-batches."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.plans.cache import NamedStep, RowCache
from strataframe.sources.nrrd import parse_header, read_nrrd, write_nrrd
from strataframe.streaming.buffers import shuffle_buffer
from strataframe.streaming.cumulative import CumulativeSums, counts_of_agreement


def test_nrrd_planes(spark, tmp_path):
    rng = np.random.default_rng(3)
    big, packed, flat = rng.integers(-9, 9, (40, 6, 5)).astype("i2"), rng.normal(size=(7, 3, 4)), np.arange(12, dtype="u1")
    for name, data in (("big", write_nrrd(big, [2.0, 1.5, 1.0])), ("packed", write_nrrd(packed, packed=True)), ("flat", write_nrrd(flat))):
        (tmp_path / f"{name}.nrrd").write_bytes(data)
    (tmp_path / "note.txt").write_text("no image")
    df = read_nrrd(spark, str(tmp_path), split=3 * 6 * 5 * 2)
    rows = {(r.path.rsplit("/", 1)[1], r.plane): r for r in df.collect()}
    assert len(rows) == 40 + 7 + 12
    for i in range(40):
        r = rows["big.nrrd", i]
        assert (r.shape, r.spacing, r.n_planes) == ([6, 5], [2.0, 1.5, 1.0], 40) and np.array_equal(np.reshape(r["values"], r.shape), big[i])
    assert all(np.array_equal(np.reshape(rows["packed.nrrd", i]["values"], (3, 4)), packed[i]) for i in range(7))
    assert [rows["flat.nrrd", i]["values"] for i in range(12)] == [[float(i)] for i in range(12)]
    one = read_nrrd(spark, str(tmp_path / "big.nrrd"), split=3 * 6 * 5 * 2)
    assert one.rdd.getNumPartitions() == 14
    assert sorted(r.plane for r in one.where("plane >= 30 and plane < 33").collect()) == [30, 31, 32]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = read_nrrd(spark, str(tmp_path / "big.nrrd"), split=3 * 6 * 5 * 2).where("plane >= 30 and plane < 33")
        assert sorted(r.plane for r in some.collect()) == [30, 31, 32] and some.rdd.getNumPartitions() == 1
        assert read_nrrd(spark, str(tmp_path)).where("plane = 99").count() == 0
        assert read_nrrd(spark, str(tmp_path)).where(f"path = '{tmp_path}/packed.nrrd' and plane > 4").count() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_nrrd_headers():
    head = b"NRRD0005\n# made by hand\ntype: short\ndimension: 3\nsizes: 4 3 2\nspace directions: (0,0,2) (3,4,0) none\nencoding: raw\nendian: big\nkey:=value\n\n"
    h = parse_header(head + b"x" * 48)
    assert (h.start, h.kind.str, h.sizes, h.spacing, h.planes, h.plane_bytes) == (len(head), ">i2", (4, 3, 2), (2.0, 5.0, 1.0), 2, 24)
    for bad in (b"PNG", head[:-1], head.replace(b"raw", b"hex"), head.replace(b"sizes: 4 3 2", b"sizes: 4 3"), head.replace(b"encoding", b"data file: a\nencoding")):
        with pytest.raises(ValueError):
            parse_header(bad)


def test_a_short_nrrd_file_is_an_error(spark, tmp_path):
    (tmp_path / "cut.nrrd").write_bytes(write_nrrd(np.zeros((4, 5)))[:-3])
    with pytest.raises(Exception, match="ends within plane 3"):
        read_nrrd(spark, str(tmp_path)).count()


@pytest.fixture
def counted(spark):
    """A step that counts the rows it's run on."""
    seen = spark.sparkContext.accumulator(0)

    def scale(df, by):
        def run(frames):
            for frame in frames:
                seen.add(len(frame))
                yield frame.assign(v=frame["v"] * by)

        return df.mapInPandas(run, df.schema)

    return seen, scale


def test_cache_computes_each_item_once(spark, tmp_path, counted):
    seen, scale = counted
    steps = [NamedStep("scale", scale, {"by": 3})]
    items = spark.createDataFrame([(i % 50, i % 50) for i in range(120)], "k long, v long")
    cache = RowCache(spark, str(tmp_path), steps)
    assert sorted(r.v for r in cache.fetch(items.where("k < 20")).collect()) == sorted(3 * (i % 50) for i in range(120) if i % 50 < 20)
    assert cache.computed == 20 and seen.value == 20
    assert sorted(r.v for r in cache.fetch(items).collect()) == sorted(3 * (i % 50) for i in range(120))
    assert cache.computed == 30 and seen.value == 50
    again = RowCache(spark, str(tmp_path), steps)  # as another session would
    assert again.fetch(items).count() == 120 and again.computed == 0 and seen.value == 50
    changed = RowCache(spark, str(tmp_path), [NamedStep("scale", scale, {"by": 4})])
    assert changed.fetch(items.where("k = 1")).first().v == 4 and changed.computed == 1
    more = RowCache(spark, str(tmp_path), [*steps, NamedStep("one more", lambda df: df.withColumn("v", F.col("v") + 1))])
    assert more.fetch(items.where("k = 2")).first().v == 7 and more.computed == 1


def test_a_killed_run_leaves_nothing_behind(spark, tmp_path, counted):
    seen, scale = counted
    cache = RowCache(spark, str(tmp_path), [NamedStep("scale", scale, {"by": 2})])
    items = spark.createDataFrame([(1, 1), (2, 2)], "k long, v long")

    def stops(df, **_):
        return df.withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("v")))

    broken = RowCache(spark, str(tmp_path), [NamedStep("scale", stops, {"by": 2})])
    assert broken.fingerprint == cache.fingerprint
    with pytest.raises(Exception, match="killed"):
        broken.fetch(items)
    spark.createDataFrame([(9, 9, "zz")], "k long, v long, item_hash string").write.parquet(f"{cache.folder}/batch-half")  # written, never committed
    assert cache.stored() is None
    assert sorted(r.v for r in cache.fetch(items).collect()) == [2, 4] and cache.computed == 2
    assert cache.fetch(items.limit(0)).count() == 0


def test_random_steps_are_not_cached(spark, tmp_path, counted):
    seen, scale = counted
    after = spark.sparkContext.accumulator(0)

    def noisy(df):
        def run(frames):
            for frame in frames:
                after.add(len(frame))
                yield frame

        return df.mapInPandas(run, df.schema)

    steps = [NamedStep("scale", scale, {"by": 2}), NamedStep("noise", noisy, random=True), NamedStep("last", lambda df: df.withColumn("v", -F.col("v")))]
    cache, items = RowCache(spark, str(tmp_path), steps), spark.createDataFrame([(1, 1), (2, 2)], "k long, v long")
    for _ in range(2):
        assert sorted(r.v for r in cache.fetch(items).collect()) == [-4, -2]
    assert seen.value == 2 and after.value == 4
    assert len(RowCache(spark, str(tmp_path), steps, count=0).steps) == 0
    with pytest.raises(ValueError, match="dropped"):
        RowCache(spark, str(tmp_path), [NamedStep("drop", lambda df: df.drop("item_hash"))]).fetch(items)


def test_shuffle_buffer_outlives_batches_and_restarts(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        spark.range(0, 90).selectExpr("id", "cast(id as string) as name").repartition(3).write.parquet(f"{tmp_path}/in")
        out = f"{tmp_path}/out"
        rows = lambda: [r.id for r in spark.read.schema("id long, name string").parquet(out).collect()]
        for last in (False, True):
            stream = spark.readStream.schema("id long, name string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            q = shuffle_buffer(stream, 10, lanes=2, wait_ms=1500 if last else 3_600_000).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/at").start(out)
            ends = time.time() + 90
            while q.isActive and time.time() < ends:
                if (len(rows()) == 100) if last else (q.lastProgress is not None and q.lastProgress.batchId >= 2 and len(rows()) == 70):
                    break
                time.sleep(0.5)
            q.stop()
            if not last:
                held = len(rows())
                assert held == 70  # two lanes hold ten rows each
                spark.range(90, 100).selectExpr("id", "cast(id as string) as name").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
                ids = rows()
                assert ids != sorted(ids)
        ends = time.time() + 60
        while len(rows()) < 100 and time.time() < ends:
            stream = spark.readStream.schema("id long, name string").parquet(f"{tmp_path}/in")
            q = shuffle_buffer(stream, 10, lanes=2, wait_ms=200).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/at").start(out)
            time.sleep(10)
            q.stop()
        assert sorted(rows()) == list(range(100))
    finally:
        spark.conf.unset(key)


def test_cumulative_sums(spark, tmp_path):
    rows = [(k, p, t) for k in ("a", "b") for p, t in ((True, True), (True, False), (False, True), (False, False), (None, True), (True, True))]
    batch = spark.createDataFrame(rows, "k string, p boolean, t boolean")
    made = lambda source: CumulativeSums(spark, str(tmp_path / "sums"), ["k"], counts_of_agreement(F.col("p"), F.col("t")), source)
    sums = made("one")
    assert sums.current() is None
    for number in (0, 1, 1):  # the second comes again after a failure
        sums.add(batch, number)
    assert {r.k: (r.tp, r.fp, r.fn, r.tn) for r in sums.current().collect()} == dict.fromkeys("ab", (4, 2, 2, 2))
    made("two").add(batch.where("k = 'a'"), 0)
    assert {r.k: r.tp for r in sums.current().collect()} == {"a": 6, "b": 4}
    sums.reset()
    assert sums.current() is None and sums.current(0).count() == 2
    batch.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restarted query adds nothing twice
        q = sums.attach(spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "at"), availableNow=True)
        q.awaitTermination(90)
    assert {r.k: (r.tp, r.fp, r.fn, r.tn) for r in sums.current().collect()} == dict.fromkeys("ab", (2, 1, 1, 1))
