"""Array kernels against plain loops and known answers."""

import numpy as np
import pytest

from strataframe.operators import detection as T
from strataframe.operators import graph as G
from strataframe.operators import random_volumes as R
from strataframe.operators import volumes as V

RNG = np.random.default_rng(1)
X = RNG.standard_normal((6, 5))


def test_shapes():
    assert V.spatial_pad((9, 5))(X).shape == (9, 5) and (V.spatial_pad((9, 5))(X)[1:7] == X).all()
    assert V.divisible_pad(4)(X).shape == (8, 8)
    assert (V.center_crop((2, 3))(X) == X[2:4, 1:4]).all()
    y = np.zeros((6, 5))
    y[2, 3] = y[4, 1] = 1
    assert V.foreground_crop()(y).shape == (3, 3) and V.foreground_crop(margin=9)(y).shape == (6, 5) and V.foreground_crop(5.0)(y).size == 0


def test_resampling():
    assert np.allclose(V.resize(X.shape)(X), X) and np.allclose(V.affine(np.eye(3))(X), X)
    ramp = np.arange(8.0)[:, None] * np.ones((1, 4))
    assert np.allclose(V.resize((4, 4))(ramp)[:, 0], [0.5, 2.5, 4.5, 6.5])
    assert V.zoom(1.7)(X).shape == X.shape and V.zoom(0.5)(X).shape == X.shape
    square = RNG.standard_normal((5, 5))
    assert np.allclose(V.affine(V.rotation(np.pi / 2))(square), np.rot90(square, -1)) or np.allclose(V.affine(V.rotation(np.pi / 2))(square), np.rot90(square))


def test_filters():
    r, padded = 1, np.pad(X, 1, "edge")
    plain = np.array([[np.median(padded[i : i + 3, j : j + 3]) for j in range(5)] for i in range(6)])
    assert np.allclose(V.median_filter(r)(X), plain)
    assert np.allclose(V.gaussian_smooth(1.0)(np.ones((7, 7))), 1)
    line = np.arange(12.0) ** 2
    assert np.allclose(V.savitzky_golay(5, 2)(line)[2:-2], line[2:-2])
    assert np.allclose(V.gibbs_noise(0.0)(X), X) and V.gibbs_noise(0.6)(X).std() < X.std()
    assert V.sobel(0)(np.arange(5.0)[:, None] * np.ones((1, 5)))[2, 2] != 0


def flood(mask, full):
    out, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if out[start]:
            continue
        n += 1
        todo = [start]
        out[start] = n
        while todo:
            p = todo.pop()
            for o in V._offsets(mask.ndim, full):
                q = tuple(a + b for a, b in zip(p, o, strict=True))
                if all(0 <= a < s for a, s in zip(q, mask.shape, strict=True)) and mask[q] and not out[q]:
                    out[q] = n
                    todo.append(q)
    return out


@pytest.mark.parametrize("full", [False, True])
@pytest.mark.parametrize("shape", [(9, 11), (5, 6, 4)])
def test_components_equal_flood_fill(full, shape):
    for p in (0.3, 0.5, 0.8):
        mask = RNG.random(shape) < p
        assert (V.components(mask, full) == flood(mask, full)).all()


def test_labels():
    y = np.zeros((7, 7))
    y[1:6, 1:6] = 1
    y[3, 3] = 0
    assert V.fill_holes()(y)[3, 3] == 1 and V.fill_holes()(y)[0, 0] == 0
    assert V.contour()(y)[2, 2] == 1 and V.contour()(np.pad(np.ones((5, 5)), 1))[3, 3] == 0
    y[0, 0] = 1
    assert V.keep_largest()(y)[0, 0] == 0 and V.remove_small(2)(y)[0, 0] == 0 and V.remove_small(1)(y)[0, 0] == 1
    mask = np.pad(np.ones((4, 5)), 1)
    plain = [[min((np.hypot(i - a, j - b) for a, b in np.argwhere(mask == 0))) if mask[i, j] else 0 for j in range(7)] for i in range(6)]
    assert np.allclose(V.distance_transform()(mask), plain)


def test_pair_metrics():
    a, b = np.zeros((9, 9)), np.zeros((9, 9))
    a[2:5, 2:5], b[2:5, 4:7] = 1, 1
    assert V.hausdorff()(a, b) == 2 and V.surface_distance()(a, a) == 0 and np.isnan(V.hausdorff()(a, b * 0))
    assert V.surface_dice(0.5)(a, a) == 1 and V.surface_dice(0.5)(a, b * 0) == 0 and 0 < V.surface_dice(1.0)(a, b) < 1
    assert V.ssim()(X, X) == pytest.approx(1) and V.ssim(window=3)(X, X[::-1]) < 1  # negating both mean and slope would cancel


def test_rows(spark):
    df = spark.createDataFrame([(1, [2, 3], [float(i) for i in range(6)]), (2, None, None)], "id int, shape array<int>, values array<double>")
    rows = {r.id: r for r in V.apply(df, V.transpose((1, 0))).collect()}
    assert rows[1].shape == [3, 2] and rows[1]["values"] == [0, 3, 1, 4, 2, 5] and rows[2].shape is None
    pairs = df.selectExpr("id", "shape", "values as pred", "values as truth")
    assert {r.id: r.metric for r in V.measure(pairs, V.surface_distance()).collect()} == {1: 0.0, 2: None}


def test_random_kernels_repeat_and_keep_shape(spark):
    from strataframe.operators import random_volumes as R

    kernels = [
        R.gaussian_noise(), R.rician_noise(), R.shift_intensity(-1, 1), R.std_shift(-1, 1, True), R.scale_intensity(-0.5, 0.5), R.scale_fixed_mean(-0.5, 0.5), R.contrast(0.5, 2), R.bias_field(),
        R.histogram_shift(), R.gaussian_smooth(0.5, 1), R.gaussian_sharpen(), R.gibbs_noise(0.2, 0.8), R.low_resolution(0.4, 0.8), R.coarse_dropout(2, (2, 2)), R.coarse_shuffle(2, (3, 3)), R.flip(), R.rotate(0.4), R.zoom(0.8, 1.2),
        R.affine(0.1, 0.1, 1, 0.1), R.elastic(1, 2), R.smooth_deform(3, 1), R.grid_distortion(3, 0.3), R.smooth_intensity(3, 0.5, 1.5), R.smooth_contrast(3, 0.5, 2), R.signal_shift(), R.signal_shift(0.5, 0.0), R.signal_drop(),
        R.add_sine((0, 1), (1, 3)), R.add_square_pulse((0, 1), (1, 3), True),
    ]
    for i, k in enumerate(kernels):
        a, b = k(X, R.generator(1, "k", i)), k(X, R.generator(1, "k", i))
        assert a.shape == X.shape and (a == b).all() and np.isfinite(a).all(), i
    assert R.spatial_crop((2, 3))(X, R.generator(0, "c")).shape == (2, 3)
    shuffled = R.coarse_shuffle(1, (3, 3))(X, R.generator(0, "s"))
    assert np.allclose(np.sort(shuffled.ravel()), np.sort(X.ravel()))
    t = np.arange(200) / 200
    wave = np.sin(2 * np.pi * 10 * t) + np.sin(2 * np.pi * 30 * t)
    assert np.allclose(R.remove_frequency(30, 200, 10)(wave), np.sin(2 * np.pi * 10 * t), atol=1e-9)
    assert np.allclose(R.envelope()(np.cos(2 * np.pi * 20 * t)), 1) and R.wavelet([2, 4])(wave).shape == (2, 200) and R.fill_empty(3.0)(np.array([np.nan])) == 3
    df = spark.createDataFrame([(i, [2, 2], [1.0, 2.0, 3.0, 4.0]) for i in range(40)], "id int, shape array<int>, values array<double>")
    out = lambda d: {r.id: r["values"] for r in R.apply_random(d, R.chosen([R.shift_intensity(1, 2), R.flip()]), ["id"], 5, 0.5, "n").collect()}
    assert out(df) == out(df.repartition(5)) and 8 < sum(v == [1.0, 2.0, 3.0, 4.0] for v in out(df).values()) < 32


def test_patches(spark):
    from strataframe.operators import patches as P

    assert P.window_starts(10, 4, 0.5) == [0, 2, 4, 6] and P.window_starts(11, 4, 0.5) == [0, 2, 4, 6, 7] and P.window_starts(3, 4, 0.5) == [0]
    assert P.starts(10, 4, 0.5) == [0, 2, 4, 6] and P.starts(10, 4, 1) == [0, 3, 6]
    df = spark.createDataFrame([(1, [5, 4], [float(i) for i in range(20)]), (2, [3, 3], [1.0] * 9), (3, None, None)], "id int, shape array<int>, values array<double>")
    cut = P.explode_patches(df, [2, 3], 0.5)
    for gaussian in (False, True):
        back = {r.id: r["values"] for r in P.merge_patches(cut, ["id"], df, gaussian).collect()}
        assert np.allclose(back[1], np.arange(20)) and np.allclose(back[2], 1) and set(back) == {1, 2}
    assert [c.tolist() for c in P.grid_split((2, 1))(np.arange(4).reshape(2, 2))] == [[[0, 1]], [[2, 3]]]
    assert P.coordinate_channels()(np.zeros((1, 3, 3)))[1, 0, 0] == -0.5 and P.one_hot(3)(np.array([0, 2]))[2].tolist() == [0, 1]
    assert P.probability_peaks(0.5, 3)(np.array([[0.9, 0.8, 0.1, 0.7]])) == [(0.9, 0, 0), (0.7, 0, 3)]
    assert [p.tolist() for p in P.class_places(np.array([0, 1, 1, 0, 1]), 2, 2)] == [[0, 3], [1, 4]]
    m = np.array([[2.0, 0, 1], [0, 1, 0], [0, 0, 1]])
    pts = RNG.standard_normal((4, 2))
    assert np.allclose(P.interpolation_points(P.interpolation_points(pts, m), m, True), pts)


def test_sparse_labels(spark):
    from pyspark.sql import functions as F

    from strataframe.operators import sparse_labels as S

    mask = np.zeros((9, 9), bool)
    mask[2:7, 2:7] = True
    assert S.surface_weight(mask) == 16 and S.interior(mask).sum() == 9 and S.bounding_box(mask, 1) == [(1, 8), (1, 8)]
    assert (S.shell(mask, 1.0, False) == S.boundary(mask)).all() and not (S.shell(mask, 1.0, True) & mask).any()
    assert S.farthest_points(np.array([[0.0], [1.0], [10.0], [6.0]]), 3) == [0, 2, 3]
    assert S.budget_split(10, [1, 1, 1]) == [4, 3, 3] and sum(S.budget_split(7, [0.2, 0.5])) == 7
    cells = spark.createDataFrame([(0, i, j, {(0, 0): 0, (0, 5): 1}.get((i, j), -1)) for i in range(1) for j in range(6)], "c int, y int, x int, l int")
    got = {r.x: r.label for r in S.diffuse(cells, "c", ["y", "x"], "l", 0.95, 8).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
    assert S.grid_neighbours(cells, "c", ["y", "x"]).count() == 10
    assert S.stratified_seeds(cells, "c", "l", "x", 2, 3).groupBy("l").count().agg(F.max("count")).first()[0] == 2
    a, b = RNG.standard_normal((300, 3)), RNG.standard_normal((300, 3)) + 2
    frame = lambda x: spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    mean, cov = S.gaussian_fit(frame(a), "v")
    assert np.allclose(mean, a.mean(0)) and np.allclose(cov, np.cov(a.T))
    assert abs(S.fid(frame(a), frame(a), "v")) < 1e-9 and 8 < S.fid(frame(a), frame(b), "v") < 16
    v = F.array(F.lit(1.0), F.lit(0.0))
    w = F.array(F.lit(0.0), F.lit(1.0))
    (r,) = spark.range(1).select(S.chi2_distance(v, w).alias("a"), S.cosine_distance(v, v).alias("b"), S.distance_bucket(F.lit(0), F.lit(2.0), 3.0).alias("c")).collect()
    assert abs(r.a - 1) < 1e-6 and abs(r.b) < 1e-9 and r.c == "boundary"


def test_spacing_and_orientation():
    ramp = np.arange(7.0)[:, None] * np.ones((1, 4))
    assert np.allclose(V.spacing([1, 1], [2, 1])(ramp)[:, 0], [0, 2, 4, 6]) and V.spacing([1, 1], [0.5, 3])(ramp).shape == (13, 2)
    assert (V.spacing([1, 1], [1, 1])(X) == X).all() and V.spacing([1, 1], [9, 9])(X).shape == (2, 1)
    flat = np.array([[0.0, -2.0, 5.0], [3.0, 0.0, 7.0], [0.0, 0.0, 1.0]])
    assert V.axis_codes(flat) == "AL" and V.axis_codes(np.eye(4)) == "RAS" and V.axis_codes(np.diag([-1, -1, 2, 1])) == "LPS"
    y = RNG.standard_normal((3, 4, 5))
    skew = np.eye(4)
    skew[:3, :3] = [[0.1, 0.2, -2.0], [-1.0, 0.1, 0.0], [0.0, 3.0, 0.3]]
    for affine, x in ((flat, X), (skew, y)):
        for codes in ("RA", "LP", "AR") if x.ndim == 2 else ("RAS", "SPL", "IRA"):
            out, moved = V.reorient(affine, codes)(x), V.reoriented_affine(affine, x.shape, codes)
            assert V.axis_codes(moved) == codes
            for at in np.ndindex(out.shape):  # each value keeps its place in the world
                world = moved @ [*at, 1]
                old = np.rint(np.linalg.solve(affine, world)[:-1]).astype(int)
                assert out[at] == x[tuple(old)]
    for bad in ("RR", "RAS", "R", "XY"):
        with pytest.raises(ValueError):
            V.reorient(flat, bad)


def test_keys_change_together(spark):
    rows = [(1, ([2, 3], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), ([2, 3], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), "a"), (2, None, ([0], []), None), (3, (None, [1.0]), ([1, 1], None), "c")]
    kind = "struct<shape:array<int>,values:array<double>>"
    df = spark.createDataFrame(rows, f"id int, image {kind}, label {kind}, shape string")
    out = {r.id: r for r in V.apply_keys(df, {"image": lambda x: x.T, "label": lambda x: -x, "none": abs}, ["image", "label", "none"], allow_missing=True).collect()}
    assert (out[1].image.shape, out[1].image.values) == ([3, 2], [1, 4, 2, 5, 3, 6]) and out[1].label.values == [-1, -2, -3, -4, -5, -6] and out[1].shape == "a"
    assert out[2].image is None and (out[2].label.shape, out[2].label.values) == ([0], []) and out[3].image is None and out[3].label is None
    with pytest.raises(KeyError):
        V.apply_keys(df, abs, ["image", "none"])
    many = spark.createDataFrame([(i, ([4, 4], [float(x) for x in range(16)]), ([4, 4], [float(x) for x in range(16)])) for i in range(40)], f"id int, image {kind}, label {kind}")
    turned = R.apply_random_keys(many, R.rotate90(), ["image", "label"], ["id"], seed=3, prob=0.5).collect()
    assert all(r.image == r.label for r in turned) and 5 < sum(r.image.values != [float(x) for x in range(16)] for r in turned) < 35
    again = R.apply_random_keys(many.repartition(7), R.rotate90(), ["image", "label"], ["id"], seed=3, prob=0.5).collect()
    assert sorted(turned) == sorted(again)
    assert V.apply_keys(df.limit(0), abs, ["image"]).count() == 0


def test_free_response_by_hand(spark):
    points = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.8), (1, 1, 0.3), (1, 0, 0.2), (2, 2, 0.95), (2, None, 0.5), (2, 1, None)], "image int, label int, score double")
    targets = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (2, 0), (1, 1)], "image int, label int")
    found = T.hits_and_misses(points, targets, "image", "label", "score", exclude=[2])
    assert sorted(map(tuple, found.collect())) == [(0.0, 0, 0), (0.0, 1, 0), (0.2, 0, 1), (0.8, 1, 0), (0.9, 0, 1)]
    curve = T.froc_points(found, 2)
    assert sorted((r.fps_per_image, r.sensitivity) for r in curve.collect()) == [(0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (1.0, 0.5)]
    # At 0.25 between (0, 0) and (0.5, 0); from 0.5 on the upper of equal points.
    assert T.froc_score(curve, (0.25, 0.5, 4)).first()[0] == pytest.approx((0 + 0.5 + 0.5) / 3)
    assert [tuple(r) for r in T.froc_points(found.limit(0), 2).collect()] == [(None, 0.0, 0.0)]
    assert T.froc_score(T.froc_points(found.limit(0), 2)).first()[0] == 0


def test_average_precision_by_hand(spark):
    kind = "image int, label int, box int, xmin double, ymin double, xmax double, ymax double"
    box = lambda x, w=10.0: (x, 0.0, x + w, 10.0)
    truths = spark.createDataFrame([(1, 0, 1, *box(0.0)), (1, 0, 2, *box(50.0)), (2, 0, 3, *box(0.0)), (1, 7, 4, *box(0.0)), (None, 0, 9, *box(0.0))], kind)
    preds = [(1, 0, 1, *box(0.0), 0.9), (1, 0, 2, *box(1.0), 0.8), (2, 0, 3, *box(4.0), 0.7), (1, 0, 4, *box(50.0), 0.6), (1, 5, 5, *box(0.0), 0.9), (2, 0, 6, *box(0.0), None)]
    preds = spark.createDataFrame(preds, f"{kind}, score double")
    got = {(r.label, r.at): (r.ap, r.recall) for r in T.box_precision(preds, truths, "image", "label", "box", "score", [0.3, 0.5]).collect()}
    # At 0.3: hit, miss (its truth is taken), hit, hit; precision 1 up to recall 1/3, then 3/4.
    assert got[0, 0.3] == (pytest.approx((34 + 67 * 0.75) / 101), 1.0)
    # At 0.5 the third is a miss: precision 1, then 2/4 up to recall 2/3.
    assert got[0, 0.5] == (pytest.approx((34 + 33 * 0.5) / 101), pytest.approx(2 / 3))
    assert got[7, 0.3] == got[7, 0.5] == (0.0, 0.0) and len(got) == 4
    top = T.box_precision(preds, truths, "image", "label", "box", "score", [0.3], most=1)
    assert {r.label: r.recall for r in top.collect()} == {0: pytest.approx(2 / 3), 7: 0.0}
    assert T.box_precision(preds, truths.limit(0), "image", "label", "box", "score", [0.5]).count() == 0
    assert T.box_precision(preds.limit(0), truths, "image", "label", "box", "score", [0.5]).count() == 2


def test_nearest_in_blocks(spark):
    x = np.round(RNG.standard_normal((120, 3)), 1)
    x[100:] = x[7]  # copies: ties go to the lesser node
    rows = [(i, i % 2, v.tolist()) for i, v in enumerate(x)] + [(500, 1, None), (501, None, [1.0, 2.0, 3.0]), (502, 1, [1.0, 2.0]), (503, 0, [1.0, None, 2.0])]
    df = spark.createDataFrame(rows, "id int, g int, v array<double>")
    want = set()
    for i in range(120):
        others = [(np.sqrt(((x[j] - x[i]) ** 2).sum()), j) for j in range(i % 2, 120, 2) if j != i]
        want |= {(i, j, p + 1) for p, (_, j) in enumerate(sorted(others)[:4])}
    for block in (7, 2048):
        assert {(r.src, r.dst, r.place) for r in G.knn(df, "id", "v", "g", 4, block).collect()} == want
    assert G.knn(df.limit(0), "id", "v", "g", 4).count() == 0
