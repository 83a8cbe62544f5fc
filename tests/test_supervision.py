"""Sparse supervision of long tables against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import supervision as S

AXES = ["x", "y"]


def table(spark, arrays, low=(0, 0)):
    rows = [(case, i + low[0], j + low[1], int(v)) for case, a in arrays.items() for (i, j), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "case string, x long, y long, v int").repartition(3)


def test_center_fit(spark):
    given = {"a": np.arange(28).reshape(4, 7), "b": np.arange(15).reshape(5, 3), "c": np.arange(6).reshape(1, 6)}
    for size in ((3, 5), (6, 4), (8, 8), (5, 3)):
        got = {}
        for r in S.center_fit(table(spark, given, (4, -2)), "case", AXES, size, {"v": -1}).collect():
            assert (r.case, r.x, r.y) not in got
            got[r.case, r.x, r.y] = r.v
        want = {}
        for case, a in given.items():
            for axis, s in enumerate(size):
                n = a.shape[axis]
                a = a.take(range((n - s) // 2, (n - s) // 2 + s), axis) if n > s else a
            a = np.pad(a, [((max(s - n, 0)) // 2, max(s - n, 0) - max(s - n, 0) // 2) for s, n in zip(size, a.shape, strict=True)], constant_values=-1)
            want |= {(case, i, j): v for (i, j), v in np.ndenumerate(a)}
        assert got == want


def test_class_scores(spark):
    rows = [("a", 1, 1), ("a", 1, 2), ("a", 2, 2), ("a", None, 2), ("a", 0, 6), ("a", 1, None), ("b", 0, 0)]
    df = spark.createDataFrame(rows, "case string, pred int, truth int")
    got = {(r.case, r["class"]): (r.n_pred, r.n_truth, r.n_both, r.dice, r.iou, r.recall) for r in S.class_scores(df, "case", "pred", "truth", [0, 1, 2, 3], ignore=6).collect()}
    assert got["a", 1] == (2, 1, 1, pytest.approx(2 / 3), 0.5, 1.0) and got["a", 2] == (1, 3, 1, 0.5, pytest.approx(1 / 3), pytest.approx(1 / 3))
    assert got["a", 3] == got["b", 1] == (0, 0, 0, 1.0, 1.0, None) and got["b", 0] == (1, 1, 1, 1.0, 1.0, 1.0)
    over = {r.case: r for r in S.propagated_scores(df, "case", "pred", "truth", [0, 1]).collect()}
    assert over["a"].accuracy == pytest.approx(2 / 6) and over["a"].coverage == pytest.approx(5 / 6) and over["b"].dice_foreground == 1.0


def test_segment_votes(spark):
    rows = [("a", 1, 2, True), ("a", 1, 1, True), ("a", 1, 3, False), ("a", 2, 6, True), ("a", 2, 4, True), ("a", 2, 6, True), ("a", 3, 5, False), ("a", None, 7, True), ("b", 1, None, True)]
    df = spark.createDataFrame(rows, "case string, seg int, label int, seed boolean")
    votes = S.segment_votes(df, "case", "seg", "label", F.col("seed"), ignore=6)
    assert {(r.case, r.seg): (r.label, r.votes, r.share) for r in votes.collect()} == {("a", 1): (1, 1, 0.5), ("a", 2): (4, 1, 1.0), ("a", None): (7, 1, 1.0)}
    filled = S.fill_segments(df, "case", "seg", votes, "label", "full").collect()
    assert len(filled) == len(rows) and {(r.case, r.seg): r.full for r in filled} == {("a", 1): 1, ("a", 2): 4, ("a", 3): 0, ("a", None): 7, ("b", 1): 0}


def test_supervised_slices(spark):
    a = np.zeros((4, 5), int)
    a[1, :3], a[2, 2:], a[3, 0] = 1, 1, 1
    hit = {(r.x, r.y) for r in S.supervised_by_slices(table(spark, {"a": a}), "case", ["x"], F.col("v") == 1, count=1).where("supervised").collect()}
    assert hit == {(1, j) for j in range(5)}  # three cells in two slices: the lower one
    both = {(r.x, r.y) for r in S.supervised_by_slices(table(spark, {"a": a}), "case", AXES, F.col("v") == 1, ratio=0.3).where("supervised").collect()}
    assert both == {(x, y) for x, y in itertools.product(range(4), range(5)) if x in (1, 2) or y in (0, 2)}


def test_select_slices_equals_one_after_another(spark):
    rng = random.Random(5)
    rows = [(c, a, p, rng.randint(0, 9) / 10) for c in "abc" for a in ("x", "y") for p in range({"a": 30, "b": 8, "c": 1}[c])]
    df = spark.createDataFrame(rows, "case string, axis string, place long, score double").repartition(4)
    for share, gap, most in ((0.3, 2, None), (0.5, 0, 5), (1.0, 3, 4), (0.001, 1, 1), (0.4, 1, 7)):
        chosen = []
        for c, a, p, s in sorted(rows, key=lambda r: (-r[3], r[0], r[1], r[2])):
            if len(chosen) >= max(1, round(len(rows) * share)):
                break
            near = gap > 0 and any((c, a) == o[:2] and abs(p - o[2]) <= gap for o in chosen)
            if not near and (most is None or sum(o[0] == c for o in chosen) < most):
                chosen.append((c, a, p))
        got = sorted((r["rank"], r.case, r.axis, r.place) for r in S.select_slices(df, "case", share, gap, most).collect())
        assert [g[1:] for g in got] == chosen and [g[0] for g in got] == list(range(len(chosen)))


def test_seeds(spark):
    a = np.zeros((20, 20), int)
    a[:5], a[5:7], a[7, 0] = 1, 2, 3
    df = table(spark, {"a": a, "plain": np.zeros((4, 4), int)})
    budgets = S.seed_budgets(df, "case", "v", [1, 2, 3], 21, 0.3)
    got = {(r.case, r.v): r.budget for r in budgets.collect()}
    assert got == {("a", 0): 6, ("a", 1): 11, ("a", 2): 4, ("a", 3): 0, ("plain", 0): 21, ("plain", 1): 0, ("plain", 2): 0, ("plain", 3): 0}
    even = {(r.case, r.v): r.budget for r in S.seed_budgets(df, "case", "v", [1, 2, 3], 20, 0.0, uniform=True).collect()}
    assert [even["a", c] for c in range(4)] == [0, 7, 7, 6]
    seeds = S.point_seeds(df, "case", AXES, "v", budgets, seed=2)
    rows = seeds.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, S.point_seeds(df.repartition(2), "case", AXES, "v", budgets, seed=2).collect()))
    counts = {}
    for r in rows:
        counts[r.case, r.v] = counts.get((r.case, r.v), 0) + 1
    assert counts == {("a", 0): 6, ("a", 1): 11, ("a", 2): 4, ("plain", 0): 16}
    hit = {(r.case, r.x, r.y) for r in S.dilated(df, seeds, "case", AXES, 1).where("supervised").collect()}
    assert hit == {(r.case, x, y) for r in rows for x, y in itertools.product(range(r.x - 1, r.x + 2), range(r.y - 1, r.y + 2)) if 0 <= x < (20 if r.case == "a" else 4) and 0 <= y < (20 if r.case == "a" else 4)}


def test_slice_scores(spark):
    a = np.zeros((3, 4), int)
    a[0, :3], a[1, 0] = 1, 2
    got = {(r.axis, r.place): r for r in S.slice_scores(table(spark, {"a": a}), "case", AXES, "v", [1, 2, 3], None, (1.0, 10.0, 100.0)).collect()}
    assert len(got) == 7
    one, two = math.sqrt(4 / 3), math.sqrt(4)
    assert (got["x", 0].foreground, got["x", 0].boundary) == (0.75, 0.5) and got["x", 0].rarity == pytest.approx(one / (one + two))
    assert (got["y", 0].foreground, got["y", 0].boundary) == (pytest.approx(2 / 3), pytest.approx(2 / 3)) and got["y", 0].rarity == pytest.approx(1.0) and got["x", 2].score == 0


def test_losses(spark):
    rng = np.random.default_rng(6)
    z, t, w = rng.normal(size=(60, 3)) * 3, rng.integers(0, 4, 60), rng.random(60)
    rows = [("a" if i < 40 else "b", z[i].tolist(), int(t[i]) if i % 9 else None, float(w[i])) for i in range(60)] + [("zero", [1.0, 2.0, 3.0], 1, 0.0)]
    got = {r.batch: r for r in S.masked_losses(spark.createDataFrame(rows, "batch string, z array<double>, t int, w double"), "batch", "z", "t", F.col("w"), 3, ignore=3).collect()}
    for batch, part in (("a", range(40)), ("b", range(40, 60))):
        ok = [i for i in part if i % 9 and t[i] < 3]
        p = np.exp(z[ok]) / np.exp(z[ok]).sum(1, keepdims=True)
        hot, weight = np.eye(3)[t[ok]], w[ok][:, None]
        dice = (2 * (weight * p * hot).sum(0) + 1e-6) / ((weight * (p + hot)).sum(0) + 1e-6)
        assert got[batch].dice_loss == pytest.approx(1 - dice.mean())
        assert got[batch].cross_entropy == pytest.approx(-(w[ok] * np.log((p * hot).sum(1))).sum() / w[ok].sum())
    assert got["zero"].cross_entropy == 0.0 and got["zero"].dice_loss == pytest.approx(0.0)


def test_source_ratio_and_folds(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 0, True), ("a", 0, True), ("a", 0, False), ("b", 1, True), ("c", None, None)], "batch string, src int, ok boolean")
    assert {r.batch: r.ratio for r in S.source_ratio(df, "batch", F.col("src") > 0, F.col("ok"), 7.0).collect()} == {"a": 0.5, "b": 7.0, "c": 7.0}
    found = S.cross_validation(spark.range(10), 3, [0, 1], [2, 1], "id").collect()
    assert sorted(r.id for r in found if r.split == "training") == [0, 1, 3, 4, 6, 7, 9] and sorted(r.id for r in found if r.split == "validation") == [1, 2, 4, 5, 7, 8]
