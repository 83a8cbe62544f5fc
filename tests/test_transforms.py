"""Box transforms, complex arrays, label reports, mixing and traced steps on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from strataframe.operators import box_transforms as T
from strataframe.operators import complex_arrays as Z
from strataframe.operators import label_reports as R
from strataframe.operators import mixers as M
from strataframe.plans import trace

A = "q array<double>"


def one(df, column):
    return df.select(column.alias("x")).first().x


def test_boxes_follow_their_image(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0, 6.0],)], A)
    q, size = F.col("q"), (10, 20)
    assert one(df, T.flip_box(q, size)) == [6.0, 14.0, 9.0, 18.0]
    assert one(df, T.flip_box(q, size, [-1])) == [1.0, 14.0, 4.0, 18.0]
    assert one(df, T.rotate_box(q, size, 4)) == one(df, q)
    assert one(df, T.rotate_box(T.rotate_box(q, size), (20, 10), -1)) == one(df, q)
    assert one(df, T.rotate_box(q, size, 2)) == one(df, T.flip_box(q, size))
    assert one(df, T.rotate_box(q, size, 1, (1, 0))) == one(df, T.rotate_box(q, size, 3))
    assert one(df, T.zoom_box(q, (0.5, -1.0))) == [0.5, -6.0, 2.0, -2.0]
    with pytest.raises(ValueError):
        T.rotate_box(q, size, 1, (0, -2))
    deep = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 7.0],)], A)
    assert one(deep, T.points_box(T.box_points(q, 3), 3)) == [1.0, 2.0, 3.0, 4.0, 5.0, 7.0]
    assert len(one(deep, T.box_points(q, 3))) == 8
    assert one(deep, T.swap_box_axes(q, 3, 0, 2)) == [3.0, 2.0, 1.0, 7.0, 5.0, 4.0]
    none = spark.createDataFrame([(None,)], A)
    for made in (T.flip_box(q, size), T.box_points(q, 2), T.zoom_box(q, (1, 1)), T.box_mask(q, F.lit(1), (2, 2)), T.encode_box(q, q, (1, 1, 1, 1)), T.decode_box(q, q, (1, 1, 1, 1))):
        assert one(none, made) is None


def test_masks_and_codes(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0],)], A)
    q = F.col("q")
    mask = T.box_mask(q, F.lit(5), (3, 3))
    assert one(df, mask) == [-1, 5, 5, -1, 5, 5, -1, -1, -1]
    assert one(df, T.mask_box(mask, (3, 3))).asDict() == {"box": [0.0, 1.0, 2.0, 3.0], "label": 5}
    assert one(df, T.mask_box(F.array(*[F.lit(-1)] * 9), (3, 3))) is None
    flat = F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(2.0))
    assert one(df, T.encode_box(q, flat, (1, 1, 1, 1))) is None
    far = T.decode_box(F.array(*[F.lit(x) for x in (0.0, 0.0, 99.0, 0.0)]), q, (1, 1, 1, 1))
    low, _, high, _ = one(df, far)
    assert high - low == pytest.approx(2 * 1000 / 16)


def test_anchors_and_choice(spark):
    assert T.anchor_shapes([32], [1.0]) == [[-16.0, -16.0, 16.0, 16.0]]
    (w, h, d) = T.anchor_shapes([30], [(1.0, 1.0)])[0][3:]
    assert w == h == d == 15.0
    assert T.anchor_grid(spark, (8, 8), [(2, 2)], [T.anchor_shapes([4], [1.0, 2.0])]).count() == 8
    pairs = spark.createDataFrame([(0, 1, 10, 0.6), (0, 1, 11, 0.6), (0, 2, 10, 0.3), (0, 3, 12, 0.1), (0, 4, 10, 0.05)], "image int, anchor int, truth int, iou double")
    found = {r.anchor: r.matched for r in T.match_anchors(pairs, "image", "anchor", "truth", 0.2, 0.5).collect()}
    assert found == {1: 10, 2: -2, 3: 12, 4: -1}
    strict = {r.anchor: r.matched for r in T.match_anchors(pairs, "image", "anchor", "truth", 0.2, 0.5, weak=False).collect()}
    assert strict == {1: 10, 2: -2, 3: -1, 4: -1}
    rows = [(0, i, 1 if i < 3 else 0 if i < 99 else None, i / 100) for i in range(100)]
    samples = spark.createDataFrame(rows, "image int, sample int, label int, score double")
    picked = T.hard_negatives(samples, "image", "sample", "label", "score", 8, 0.25, pool=1.0).collect()
    assert sorted(r.sample for r in picked if not r.positive) == [93, 94, 95, 96, 97, 98]
    assert sum(r.positive for r in picked) == 2
    alone = T.hard_negatives(samples.where("label = 0"), "image", "sample", "label", "score", 8, 0.25, pool=1.0)
    assert alone.count() == 3


def test_complex_arrays(spark):
    df = spark.createDataFrame([([3.0, 4.0, 0.0, -1.0],), ([],), (None,)], A)
    z = Z.from_pairs(F.col("q"))
    sizes = [r.x for r in df.select(Z.magnitude(z).alias("x")).collect()]
    assert sizes == [[5.0, 1.0], [], None]
    assert [r.x for r in df.select(Z.to_pairs(z).alias("x")).collect()] == [[3.0, 4.0, 0.0, -1.0], [], None]
    assert df.select(Z.to_pairs(Z.multiply(z, Z.conjugate(z))).alias("x")).first().x == [25.0, 0.0, 1.0, 0.0]
    assert df.select(Z.complex_distance(z, Z.conjugate(z)).alias("x")).first().x == 8.0
    rows = spark.createDataFrame([("a", (1.0, 2.0)), ("a", (3.0, 2.0))], "k string, v struct<re: double, im: double>")
    assert sorted(r.v.re for r in Z.normalize(rows, ["k"], "v").collect()) == [-1.0, 1.0]
    assert {r.v.im for r in Z.normalize(rows, ["k"], "v").collect()} == {None}
    columns = spark.range(40)
    full = columns.where(Z.even_mask(F.col("id"), 40, 0.5, 4.0)).count()
    assert full == 20  # the centre alone is more than a quarter
    assert 6 <= columns.where(Z.even_mask(F.col("id"), 40, 0.1, 4.0)).count() <= 13


def test_label_reports(spark):
    cells = spark.createDataFrame(
        [(1, 0, 0), (1, 1, 0), (1, 1, 1), (2, 2, 2), (2, None, 2), (2, 0, 6), (3, 1, 6), (3, 1, None)], "segment int, pred int, truth int"
    )
    matrix = R.confusion_matrix(cells, [], "pred", "truth", 6)
    scores = {r["class"]: (r.dice, r.iou) for r in R.class_scores(matrix, [], range(4)).collect()}
    assert scores[0] == (pytest.approx(2 / 3), 0.5)
    assert scores[2] == (pytest.approx(2 / 3), 0.5)
    assert scores[3] == (1.0, 1.0)
    purity = {r.segment: r for r in R.segment_purity(cells, ["segment"], "pred", "truth", 3, 6).collect()}
    assert set(purity) == {1, 2}
    assert purity[1].purity == pytest.approx(2 / 3) and purity[1].mismatch == pytest.approx(1 / 3)
    assert purity[1].entropy == pytest.approx((math.log(3) - 2 / 3 * math.log(2)) / math.log(3))
    assert purity[2].entropy == 0 and purity[2].mismatch == 0.5
    voted = {r.segment: r.voted for r in R.vote_segments(cells, ["segment"], "truth", ignore=6, fallback=-1).collect()}
    assert voted == {1: 0, 2: 2, 3: -1}
    empty = cells.where("false")
    assert R.segment_purity(empty, ["segment"], "pred", "truth", 3).count() == 0
    assert [r.wrong for r in R.error_cells(cells.orderBy("segment", "truth", "pred"), "pred", "truth", 6).where("segment = 3").collect()] == [None, None]


def test_seeds_values_and_weights(spark):
    assert R.weight_table(" 1:0.5, 2 : 1 ") == {1: 0.5, 2: 1.0}
    assert R.weight_table(None) == {}
    for bad in ("1", "1:2,1:3"):
        with pytest.raises(ValueError):
            R.weight_table(bad)
    flat = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", None)], "k string, v double")
    assert [(r.k, r.v) for r in R.clip_score(flat, ["k"], "v").orderBy("k").collect()] == [("a", 0.0), ("a", 0.0), ("b", None)]
    shares = {r.segment: r.descriptor for r in R.histogram_descriptor(spark.createDataFrame([(1, -9.0), (1, 9.0), (1, 0.0), (1, None)], "segment int, v double"), ["segment"], "v", 2).collect()}
    assert shares[1] == [pytest.approx(1 / 3), pytest.approx(2 / 3)]
    weights = spark.createDataFrame([(1, 255), (1, 1), (1, 1), (2, 1), (2, 7)], "k int, n int")
    made = sorted((r.k, r.n, r.weight) for r in R.balanced_weight(weights, ["k"], "n", {1: 0.5}, fallback={1: 0.2}).collect())
    assert made == [(1, 1, 0.25), (1, 1, 0.25), (1, 255, 1.0), (2, 1, 0.2), (2, 7, 0.0)]
    rows = spark.range(300).select((F.col("id") % 3).alias("c"), F.col("id").alias("p"), (F.col("id") % 50).alias("l"))
    kept = R.random_seeds(rows, "c", "p", 0.0, 1, "l")
    assert kept.count() == kept.select("c", "l").distinct().count() == rows.select("c", "l").distinct().count()


def test_mixing(spark):
    df = spark.range(50).select("id", F.array_repeat(F.col("id").cast("double"), 6).alias("a"))
    both = M.paired(df, "id", 1)
    assert sorted(r.id_other for r in both.collect()) == list(range(50))
    a, b = F.col("a"), F.col("a_other")
    cut = both.select("id", "id_other", M.cut_mix(a, b, (2, 3), F.lit(0.0), 3, "id").alias("x"), M.kept_share((2, 3), F.lit(0.0), 3, "id").alias("w")).collect()
    for r in cut:
        own = sum(v == r.id for v in r.x) / 6
        assert r.id == r.id_other or own == pytest.approx(r.w)
    assert one(df, M.cut_out(a, (2, 3), 0.0, 1, "id")) == one(df, a)


def test_traced_steps(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "id int, v double")
    steps = [trace.Traced("a", ["v"], lambda c: c + 1, lambda c: c - 1), trace.Traced("b", ["v"], lambda c: c * 3, lambda c: c / 3)]
    made = steps[1](steps[0](df))
    assert [(r.v, r.applied) for r in made.collect()] == [(9.0, ["a", "b"]), (None, ["a", "b"])]
    assert [(r.v, r.applied) for r in trace.undo(made, steps).collect()] == [(2.0, []), (None, [])]
    assert [r.applied for r in trace.undo(made, steps[1:]).collect()] == [["a"], ["a"]]
    with pytest.raises(Exception, match="last step"):
        trace.undo(made, steps[:1]).collect()
    with pytest.raises(KeyError):
        trace.undo(df, steps)
    some = trace.some_of([lambda c: c + 1, lambda c: c * 2], ["v"], 1, "id", least=0, most=1)
    assert {r.v for r in some(spark.range(60).select("id", F.lit(5.0).alias("v"))).collect()} == {5.0, 6.0, 10.0}
    every = trace.some_of([lambda c: c + 1, lambda c: c * 2], ["v"], 1, "id")
    assert {r.v for r in every(spark.range(60).select("id", F.lit(5.0).alias("v"))).collect()} == {12.0, 11.0}


def test_masks_are_looked_at_together(spark, monkeypatch):
    """Boxes beyond the image, upside down, without a side or a label; masks with nulls; and more of them than one part."""
    monkeypatch.setattr(T, "TOGETHER", 3)
    rows = [(0, [1.0, 0.0, 9.0, 2.0], 7), (1, [-3.0, -1.0, 1.0, 1.0], 0), (2, [2.0, 2.0, 1.0, 3.0], 4), (3, [0.0, None, 2.0, 2.0], 4), (4, [0.0, 0.0, 2.0, 1.0], None), (5, [2.0, 2.0, 3.0, 3.0], 2)]
    df = spark.createDataFrame(rows, "k int, q array<double>, label int")
    made = df.select("k", T.box_mask(F.col("q"), F.col("label"), (3, 3)).alias("m"))
    found = {r.k: (r.m, r.f and (r.f.box, r.f.label)) for r in made.select("*", T.mask_box(F.col("m"), (3, 3)).alias("f")).collect()}
    blank, b = [-1] * 9, -1
    assert found[0] == ([b, b, b, 7, 7, b, 7, 7, b], ([1.0, 0.0, 3.0, 2.0], 7))
    assert found[1] == ([0] + [b] * 8, ([0.0, 0.0, 1.0, 1.0], 0))
    assert found[2] == (blank, None) and found[3] == (blank, None)
    assert found[4] == ([None, b, b, None] + [b] * 5, None) and found[5] == (blank[:8] + [2], ([2.0, 2.0, 3.0, 3.0], 2))
