"""Objects, surfaces, crops, pads and patches of long tables against numpy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import crops, grids

AXES = ["x", "y"]


def table(spark, arrays, low=(0, 0)):
    rows = [(case, i + low[0], j + low[1], int(v)) for case, a in arrays.items() for (i, j), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "case string, x long, y long, v int").repartition(3)


def arrays(df):
    """Each case as an array; coordinates start at zero."""
    by = {}
    for r in df.collect():
        assert (r.x, r.y) not in by.setdefault(r.case, {})
        by[r.case][r.x, r.y] = r.v
    out = {}
    for case, cells in by.items():
        shape = tuple(max(c[k] for c in cells) + 1 for k in (0, 1))
        assert len(cells) == shape[0] * shape[1]
        out[case] = np.array([[-9 if cells[i, j] is None else cells[i, j] for j in range(shape[1])] for i in range(shape[0])])
    return out


@pytest.fixture(scope="module")
def given():
    rng = np.random.default_rng(3)
    return {"a": rng.integers(0, 50, (7, 9)), "b": rng.integers(0, 50, (4, 5)), "c": rng.integers(0, 50, (1, 6))}


def same(got, want):
    assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k]) for k in want)


def test_crops(spark, given):
    df = table(spark, given, (5, -3))  # cases need not begin at zero
    same(arrays(crops.spatial_crop(df, "case", AXES, (-2, 1), (3, 4))), {k: a[:3, 1:4] for k, a in given.items()})
    assert crops.spatial_crop(df, "case", AXES, (3, 1), (2, 4)).count() == 0

    def center(a, s, t):
        s, t = min(s if s > 0 else a.shape[0], a.shape[0]), min(t if t > 0 else a.shape[1], a.shape[1])
        i, j = max(a.shape[0] // 2 - s // 2, 0), max(a.shape[1] // 2 - t // 2, 0)
        return a[i : i + s, j : j + t]

    for size in ((3, 4), (4, 3), (99, 2), (0, -1)):
        same(arrays(crops.center_crop(df, "case", AXES, size)), {k: center(a, *size) for k, a in given.items()})
    same(arrays(crops.center_crop(df, "case", AXES, scale=(0.5, 0.6))), {k: center(a, math.ceil(a.shape[0] * 0.5), math.ceil(a.shape[1] * 0.6)) for k, a in given.items()})


def test_crop_foreground(spark):
    a = np.zeros((8, 9), int)
    a[2, 3], a[4, 6] = 1, 2
    edge = np.zeros((5, 5), int)
    edge[0, 4] = 3
    df = table(spark, {"a": a, "edge": edge, "none": np.zeros((3, 3), int)}, (10, 10))
    same(arrays(crops.crop_foreground(df, "case", AXES, F.col("v") > 0)), {"a": a[2:5, 3:7], "edge": edge[:1, 4:]})
    same(arrays(crops.crop_foreground(df, "case", AXES, F.col("v") > 0, 2)), {"a": a[0:7, 1:9], "edge": edge[:3, 2:]})
    assert crops.crop_foreground(df.limit(0), "case", AXES, F.col("v") > 0).count() == 0


@pytest.mark.parametrize("mode", ["edge", "reflect", "symmetric", "wrap", "constant"])
def test_pad(spark, given, mode):
    df = table(spark, given, (2, 2))
    kind = {"constant_values": -1} if mode == "constant" else {}
    for before, after in (((2, 3), (1, 0)), ((0, 11), (9, 13)), ((0, 0), (0, 0))):
        got = arrays(crops.pad(df, "case", AXES, before, after, mode, {"v": -1}))
        same(got, {k: np.pad(a, list(zip(before, after, strict=True)), mode=mode, **kind) for k, a in given.items()})
    if mode == "constant":
        assert (arrays(crops.pad(df, "case", AXES, (1, 0), (0, 0)))["a"][0] == -9).all()
        with pytest.raises(ValueError):
            crops.pad(df, "case", AXES, (1, 0), (0, 0), "mean")


def test_flips_and_turns(spark, given):
    df = table(spark, given, (3, 4))
    same(arrays(crops.flip(df, "case", AXES, ["y"])), {k: a[:, ::-1] for k, a in given.items()})
    for turns in range(-1, 5):
        same(arrays(crops.rotate90(df, "case", AXES, turns, ("x", "y"))), {k: np.rot90(a, turns, (0, 1)) for k, a in given.items()})
        same(arrays(crops.rotate90(df, "case", AXES, turns, ("y", "x"))), {k: np.rot90(a, turns, (1, 0)) for k, a in given.items()})


def test_centers_are_drawn_by_kind_and_weight(spark):
    a = np.zeros((40, 50), int)
    a[5:8, 5:10] = 1
    df = table(spark, {"a": a, "only": np.ones((6, 6), int), "none": np.full((3, 3), 7)})
    found = crops.crop_centers(df, "case", AXES, F.col("v"), {1: 3.0, 0: 1.0}, 400, (4, 7), seed=1)
    rows = found.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, crops.crop_centers(df.repartition(7), "case", AXES, F.col("v"), {1: 3.0, 0: 1.0}, 400, (4, 7), seed=1).collect()))
    by = {c: [r for r in rows if r.case == c] for c in ("a", "only", "none")}
    assert len(by["a"]) == 400 and len(by["only"]) == 400 and not by["none"]
    assert {r.kind for r in by["only"]} == {1} and abs(sum(r.kind for r in by["a"]) - 300) < 45
    assert all(2 <= r.x <= 38 and 3 <= r.y <= 46 for r in by["a"]) and {(r.x, r.y) for r in by["only"]} <= {(i, 3) for i in range(2, 5)}
    spots = {(r.x, r.y) for r in by["a"] if r.kind == 1}
    assert spots == set(itertools.product(range(5, 8), range(5, 10)))  # 300 draws meet all fifteen
    heavy = crops.crop_centers(df, "case", AXES, F.col("v"), {1: 1.0}, 300, (1, 1), seed=2, weight=F.when(F.col("x") == 5, 8).when(F.col("x") == 6, 1)).where("case = 'a'").collect()
    assert {r.x for r in heavy} == {5, 6} and abs(sum(r.x == 6 for r in heavy) - 300 / 9) < 25


def test_patches(spark, given):
    df = table(spark, given, (1, 1))
    centers = spark.createDataFrame([("a", 0, 3, 4), ("a", 1, 1, 1), ("b", 0, 2, 2), ("c", 5, 0, 3)], "case string, sample int, x long, y long")
    got = {}
    for r in crops.patches_at(df, "case", AXES, centers, (3, 2)).collect():
        got[r.case, r.sample, r.x, r.y] = r.v
    want = {}
    for case, sample, i, j in (("a", 0, 3, 4), ("a", 1, 1, 1), ("b", 0, 2, 2), ("c", 5, 0, 3)):
        for x, y in itertools.product(range(3), range(2)):
            at = (i - 1 + x, j - 1 + y)
            if all(0 <= p < n for p, n in zip(at, given[case].shape, strict=True)):
                want[case, sample, x, y] = given[case][at]
    assert got == want


def test_small_objects_and_holes(spark):
    a = np.array([[1, 1, 0, 2, 0], [1, 0, 0, 2, 0], [0, 0, 1, 0, 0], [2, 2, 2, 2, 2]])
    df = table(spark, {"a": a})
    small = {(r.x, r.y) for r in grids.small_objects(df, "case", AXES, "v", 3).where("small").collect()}
    assert small == {(0, 3), (1, 3), (2, 2)}
    ring = np.zeros((9, 9), int)
    ring[1:6, 1:6] = 1
    ring[2:5, 2:5] = 0
    ring[3, 3] = 1
    ring[7, 7:] = ring[7:, 7] = 1  # closed by the border only
    found = grids.holes(table(spark, {"a": ring, "b": 1 - ring * 0}), "case", AXES, F.col("v") == 1, side=4).where("hole").collect()
    assert {(r.case, r.x, r.y) for r in found} == {("a", i, j) for i in range(2, 5) for j in range(2, 5)} - {("a", 3, 3)}


def edges(mask):
    wide = np.pad(mask, 1)
    alone = ~(wide[2:, 1:-1] & wide[:-2, 1:-1] & wide[1:-1, 2:] & wide[1:-1, :-2])
    return np.argwhere(mask & alone)


def test_surface_metrics(spark):
    rng = np.random.default_rng(4)
    made = {}
    for k in range(4):
        p, t = np.zeros((12, 14), bool), np.zeros((12, 14), bool)
        p[2 + k : 8 + k, 3:9], t[3:9, 2 + k : 9 + k] = True, True
        p[rng.integers(0, 12), rng.integers(0, 14)] = True
        made[f"case {k}"] = (p, t)
    nothing = np.zeros((12, 14), bool)
    made |= {"no truth": (made["case 0"][0], nothing), "no pred": (nothing, made["case 0"][1]), "nothing": (nothing, nothing), "same": (made["case 1"][0],) * 2}
    df = table(spark, {k: p + 2 * t for k, (p, t) in made.items()})
    got = {r.case: r for r in grids.surface_metrics(df, "case", AXES, F.col("v").bitwiseAND(1) == 1, F.col("v") >= 2, (1.0, 0.5)).collect()}
    scale = np.array([1.0, 0.5])
    for case, (p, t) in made.items():
        a, b, r = edges(p) * scale, edges(t) * scale, got[case]
        assert (r.n_pred, r.n_truth) == (len(a), len(b))
        far = lambda x, y: np.sqrt(((x[:, None] - y) ** 2).sum(2)).min(1) if len(y) else np.full(len(x), np.inf)
        one, two = far(a, b), far(b, a)
        if not len(a) + len(b):
            assert r.average is r.average_both is r.hausdorff is r.surface_dice is None
            continue
        assert (r.average is None) if not len(a) else r.average == pytest.approx(one.mean())
        both = np.concatenate([one, two])
        assert r.average_both == pytest.approx(both.mean()) and r.hausdorff == pytest.approx(both.max()) and r.surface_dice == pytest.approx((both <= 1).mean())
        if len(a) and len(b):
            assert r.hausdorff_percent == pytest.approx(max(np.percentile(one, 95), np.percentile(two, 95)))
    assert got["same"].hausdorff == 0 and got["same"].surface_dice == 1


def test_instances(spark):
    a = np.array([[1, 1, 0, 1], [1, 0, 0, 1], [0, 0, 0, 0], [1, 0, 1, 1]])
    kinds = np.array([[0, 3, 9, 2], [3, 9, 9, 1], [9, 9, 9, 9], [0, 9, 0, 5]])
    df = table(spark, {"a": a * 100 + kinds}).withColumn("label", F.when(F.col("v") >= 100, 1))
    found = grids.grid_components(df, "case", AXES, "label")
    rows = {r.component: r for r in grids.instance_table(found, "case", AXES, F.col("v") % 100).collect()}
    assert {k: (r.n_cells, r.kind, r.x_low, r.x_high, r.y_low, r.y_high) for k, r in rows.items()} == {0: (3, 3, 0, 1, 0, 1), 3: (2, 1, 0, 1, 3, 3), 12: (1, 0, 3, 3, 0, 0), 14: (2, 5, 3, 3, 2, 3)}
    assert rows[0].x_mean == pytest.approx(1 / 3) and rows[0].kind_share == pytest.approx(2 / 3)
    assert {(r.label, r.x, r.n_cells) for r in grids.slices_with(df, "case", "x", "label").where("label = 1").collect()} == {(1, 0, 3), (1, 1, 2), (1, 3, 3)}
