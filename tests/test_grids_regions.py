"""Grids and regions as long tables against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.core.components import components
from strataframe.operators import grids, regions, seeds
from strataframe.operators.sparse_labels import farthest_points


def roots(edges, nodes=()):
    up = {n: n for n in nodes}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in up}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 180)] + [(rng.randint(200, 280), rng.randint(200, 280)) for _ in range(60)] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None), edges[0]], "a long, b long")
    want = {x: r for x, r in roots([e for e in edges if e[0] != e[1]]).items()}
    assert {r.node: r.component for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


def cells_of(spark, arrays):
    """Rows (case, axes..., label) of arrays; -1 is null."""
    axes = [f"x{i}" for i in range(next(iter(arrays.values())).ndim)]
    rows = [(case, *map(int, at), None if v < 0 else int(v)) for case, a in arrays.items() for at, v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, ", ".join(["case string", *[f"{a} long" for a in axes], "label int"])), axes


@pytest.mark.parametrize(("shape", "full", "side"), [((40, 30), False, 8), ((40, 30), True, 7), ((12, 9, 10), False, 4), ((12, 9, 10), True, 32), ((90,), False, 16)])
def test_grid_components(spark, shape, full, side):
    rng = np.random.default_rng(5)
    arrays = {"a": rng.integers(-1, 2, shape), "b": np.ones(shape, int), "c": np.full(shape, -1)}
    snake = np.full(shape, -1)
    if len(shape) == 2:  # one long path over many blocks
        snake[::2] = 1
        snake[1::4, -1] = snake[3::4, 0] = 1
        arrays["snake"] = snake
    df, axes = cells_of(spark, arrays)
    found = grids.grid_components(df.repartition(5), "case", axes, "label", full, side).collect()
    number = {at: i for i, at in enumerate(np.ndindex(shape))}
    want = {}
    for case, a in arrays.items():
        edges = []
        for at in np.ndindex(shape):
            for step in grids.steps(len(shape), full):
                to = tuple(x + s for x, s in zip(at, step, strict=True))
                if to in number and a[at] >= 0 and a[at] == a[to]:
                    edges.append((number[at], number[to]))
        up = roots(edges, [number[at] for at in np.ndindex(shape) if a[at] >= 0])
        want |= {(case, *at): up.get(number[at]) for at in np.ndindex(shape)}
    assert {(r.case, *[r[a] for a in axes]): r.component for r in found} == want and len(found) == len(want)


def test_component_shapes_and_largest(spark):
    a = np.full((6, 9), -1)
    a[0, :4], a[2:5, 6], a[5, 0:2] = 3, 3, 2
    df, axes = cells_of(spark, {"a": a})
    found = grids.grid_components(df, "case", axes, "label", side=4)
    shapes = {(r.label, r.n_cells, r.x0_length, r.x1_length) for r in grids.component_shapes(found, "case", axes, "label").collect()}
    assert shapes == {(3, 4, 1, 4), (3, 3, 3, 1), (2, 2, 1, 2)}
    assert sorted((r.label, r.x0, r.x1) for r in grids.largest_components(found, "case", "label").collect()) == [(2, 5, 0), (2, 5, 1), *[(3, 0, i) for i in range(4)]]
    far = spark.createDataFrame([("a", -5, 10**6, 1), ("a", -5, 10**6 + 1, 1), ("a", 3, 10**9, None)], "case string, x0 long, x1 long, label int")
    got = grids.grid_components(far, "case", axes, "label").collect()
    assert {r.component for r in got if r.label} == {0} and [r.component for r in got if not r.label] == [None]
    assert grids.grid_components(df.limit(0), "case", axes, "label").count() == 0


@pytest.mark.parametrize(("shape", "spacing"), [((17, 23), None), ((6, 7, 8), (1.0, 2.5, 0.5)), ((40,), (3.0,))])
def test_distance_transform(spark, shape, spacing):
    rng = np.random.default_rng(6)
    arrays = {"some": (rng.random(shape) < 0.03).astype(int), "none": np.zeros(shape, int), "all": np.ones(shape, int), "corner": np.zeros(shape, int)}
    arrays["corner"][(0,) * len(shape)] = 1
    df, axes = cells_of(spark, arrays)
    far = grids.distance_transform(df.repartition(7), "case", axes, F.col("label") == 1, spacing).collect()
    scale = np.array(spacing or [1.0] * len(shape))
    assert len(far) == sum(a.size for a in arrays.values())
    for r in far:
        there = np.argwhere(arrays[r.case] == 1)
        want = ((((there - [r[a] for a in axes]) * scale) ** 2).sum(1)).min() if len(there) else math.inf
        assert r.d2 == pytest.approx(want, abs=1e-9), r


def test_distance_transform_wants_dense_boxes(spark):
    df, axes = cells_of(spark, {"a": np.zeros((3, 4), int)})
    for bad in (df.where("x0 + x1 <> 3"), df.union(df.where("x0 = 0 and x1 = 0"))):
        with pytest.raises(ValueError, match="dense"):
            grids.distance_transform(bad, "case", axes, F.col("label") == 1)
    assert grids.distance_transform(df.limit(0), "case", axes, F.col("label") == 1).count() == 0


def test_lower_envelope_equals_all_pairs():
    rng = np.random.default_rng(7)
    for _ in range(200):
        at = np.sort(rng.choice(60, rng.integers(1, 40), replace=False)).astype(float)
        height = np.where(rng.random(len(at)) < 0.3, np.inf, rng.integers(0, 50, len(at)).astype(float))
        weight = float(rng.choice([0.25, 1.0, 4.0]))
        want = (weight * (at[:, None] - at) ** 2 + height).min(1)
        assert np.allclose(grids.lower_envelope(at, height, weight), want)


def test_lines_cut_by_batches(spark):
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        a = np.zeros((5, 20), int)
        a[2, 3] = a[4, 19] = 1
        df, axes = cells_of(spark, {"a": a, "b": a[::-1].copy()})
        got = {(r.case, r.x0, r.x1): r.d2 for r in grids.distance_transform(df, "case", axes, F.col("label") == 1).collect()}
        assert len(got) == 200 and all(d == min((x - i) ** 2 + (y - j) ** 2 for i, j in (((2, 3), (4, 19)) if c == "a" else ((2, 3), (0, 19)))) for (c, x, y), d in got.items())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_bands_and_outer_background(spark):
    a = np.zeros((9, 9), int)
    a[3:6, 3:6] = 1
    df, axes = cells_of(spark, {"a": a, "none": np.zeros((9, 9), int)})
    inside = F.col("label") == 1
    edge = {(r.x0, r.x1) for r in grids.boundary_cells(df, "case", axes, inside).where("boundary and case = 'a'").collect()}
    assert edge == {(i, j) for i in range(3, 6) for j in range(3, 6)} - {(4, 4)}
    band = {(r.x0, r.x1) for r in grids.boundary_band(df, "case", axes, inside, 1).where("band").collect()}
    assert band == {(i, j) for i in range(9) for j in range(9) if any((i - x) ** 2 + (j - y) ** 2 <= 1 for x, y in edge)}
    outer = grids.outer_background(df, "case", axes, inside, F.col("label") == 0, 3.0).where("outer")
    assert outer.where("case = 'none'").count() == 81
    assert {(r.x0, r.x1) for r in outer.where("case = 'a'").collect()} == {(i, j) for i in range(9) for j in range(9) if all((i - x) ** 2 + (j - y) ** 2 >= 9 for x in range(3, 6) for y in range(3, 6))}


def fused(values, edges, target):
    """The same rounds of merges, one after another: node -> region."""
    groups = {n: (1, v) for n, v in values.items()}
    name = {n: n for n in values}
    edges = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    cost = lambda a, b: groups[a][0] * groups[b][0] / (groups[a][0] + groups[b][0]) * sum((x / groups[a][0] - y / groups[b][0]) ** 2 for x, y in zip(groups[a][1], groups[b][1], strict=True))
    while len(groups) > target and edges:
        ranked = {(cost(a, b), a, b) for a, b in edges}
        pick = {g: min(e for e in ranked if g in e[1:]) for g in groups if any(g in e[1:] for e in ranked)}
        pairs = {e for e in ranked if pick[e[1]] == e == pick[e[2]]}
        root = {end: e[1] for e in pairs for end in e[1:]}
        merges = [(e, e[2], e[1]) for e in pairs]
        for g, e in pick.items():
            other = e[2] if e[1] == g else e[1]
            if g not in root and other in root:
                merges.append((e, g, root[other]))
        to = {gone: into for _, gone, into in sorted(merges)[: len(groups) - target]}
        new = {}
        for g, (n, v) in groups.items():
            m, w = new.get(to.get(g, g), (0, [0] * len(v)))
            new[to.get(g, g)] = (m + n, [x + y for x, y in zip(v, w, strict=True)])
        groups, name = new, {n: to.get(g, g) for n, g in name.items()}
        edges = {tuple(sorted((to.get(a, a), to.get(b, b)))) for a, b in edges}
        edges = {e for e in edges if e[0] != e[1]}
    return name


def test_fusion_equals_one_after_another(spark):
    rng = random.Random(11)
    nodes, edges, want = [], [], {}
    for case, (h, w), target in (("a", (7, 8), 6), ("b", (1, 20), 3), ("c", (4, 4), 1), ("d", (3, 3), 9)):
        at = {(i, j): i * w + j for i in range(h) for j in range(w)}
        values = {n: [rng.randint(0, 30), rng.randint(0, 3)] for n in at.values()}
        near = [(n, at[q]) for (i, j), n in at.items() for q in ((i + 1, j), (i, j + 1)) if q in at]
        nodes += [(case, n, float(v[0]), float(v[1]), target) for n, v in values.items()]
        edges += [(case, *e) for e in near]
        want |= {(case, n): g for n, g in fused(values, near, target).items()}
    nodes += [("lone", 1, 5.0, 1.0, 1), ("lone", 2, 5.0, 1.0, 1), ("lone", None, 1.0, 1.0, 1)]
    want |= {("lone", 1): 1, ("lone", 2): 2}
    df = spark.createDataFrame(nodes, "case string, node long, f double, g double, target int")
    target = F.when(F.col("case") == "a", 6).when(F.col("case") == "b", 3).when(F.col("case") == "d", 9).otherwise(1)
    found = regions.fuse_regions(df, spark.createDataFrame([*edges, edges[0], ("a", 3, 3), ("a", 1, 999)], "case string, a long, b long"), ["f", "g"], target).collect()
    assert {(r.case, r.node): r.region for r in found} == want and len(found) == len(want)
    assert len({r.region for r in found if r.case == "a"}) == 6 and len({r.region for r in found if r.case == "c"}) == 1
    assert regions.fuse_regions(df.limit(0), spark.createDataFrame([], "case string, a long, b long"), ["f", "g"], F.lit(1)).count() == 0


def test_exchange_moves_to_the_nearer_mean(spark):
    values = [0, 1, 9, 0, 10, 10, 1, 11]  # two regions of four in a row
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "case string, node long, f double")
    members = spark.createDataFrame([("a", i, i // 4) for i in range(8)], "case string, node long, region long")
    edges = spark.createDataFrame([("a", i, i + 1) for i in range(7)], "case string, a long, b long")
    got = {r.node: r.region for r in regions.exchange_members(df, members, edges, ["f"]).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 0, 4: 1, 5: 1, 6: 0, 7: 1}
    apart = {r.node: r.region for r in regions.exchange_members(df, members, edges.where("a <> 3"), ["f"]).collect()}
    assert apart == {i: i // 4 for i in range(8)}  # no neighbours, no moves


def flooded(height, marker, edges):
    """Edges in order of their passes, each joining two basins unless both have a marker."""
    up = {n: n for n in height}
    has = dict(marker)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for _, a, b in sorted((max(height[a], height[b]), min(a, b), max(a, b)) for a, b in edges):
        ra, rb = root(a), root(b)
        if ra != rb and not (ra in has and rb in has):
            up[ra] = rb
            if ra in has:
                has[rb] = has.pop(ra)
    return {n: has.get(root(n)) for n in height}


def test_watershed_equals_ordered_flooding(spark):
    rng = random.Random(12)
    nodes, edges, want = [], [], {}
    for case, (h, w), most in (("a", (9, 10), 5), ("b", (1, 30), 50), ("c", (6, 6), 1)):
        at = {(i, j): i * w + j for i in range(h) for j in range(w)}
        height = {n: rng.randint(0, most) for n in at.values()}
        marker = {n: n % 4 for n in rng.sample(sorted(height), 5)}
        near = [(n, at[q]) for (i, j), n in at.items() for q in ((i + 1, j), (i, j + 1)) if q in at]
        nodes += [(case, n, v, marker.get(n)) for n, v in height.items()]
        edges += [(case, *e) for e in near]
        want |= {(case, n): m for n, m in flooded(height, marker, near).items()}
    nodes += [("dry", 1, 0, None), ("dry", 2, 1, None), ("dry", 3, None, 1)]
    edges += [("dry", 1, 2), ("dry", 2, 3)]
    want |= {("dry", 1): None, ("dry", 2): None}
    df = spark.createDataFrame(nodes, "case string, node long, height int, marker int")
    found = regions.watershed(df, spark.createDataFrame(edges, "case string, a long, b long")).collect()
    assert {(r.case, r.node): r.marker for r in found} == want and len(found) == len(want)


def test_cover_points(spark):
    rng = np.random.default_rng(13)
    points = [("a", "x", i, *map(float, rng.integers(0, 100, 2))) for i in range(900)] + [("a", "y", i, float(i), 0.0) for i in range(5)] + [("b", "x", 1, 1.0, 1.0), ("b", "x", None, 0.0, 0.0)]
    df = spark.createDataFrame(points, "case string, bucket string, point long, u double, v double")
    budgets = spark.createDataFrame([("a", "x", 12), ("a", "y", 9), ("b", "x", 3), ("b", "z", 3)], "case string, bucket string, budget long")
    cloud = np.array([p[3:] for p in points[:900]])
    plain = farthest_points(cloud, 12)
    radius = lambda chosen: math.sqrt((((cloud[:, None] - cloud[chosen]) ** 2).sum(2)).min(1).max())
    whole = seeds.cover_points(df, budgets, ["u", "v"])
    assert [r.point for r in whole.where("case = 'a' and bucket = 'x'").orderBy("place").collect()] == plain
    assert sorted(r.point for r in whole.where("bucket = 'y'").collect()) == list(range(5)) and whole.where("case = 'b'").count() == 1
    cut = seeds.cover_points(df, budgets, ["u", "v"], block=60)
    chosen = [r.point for r in cut.where("case = 'a' and bucket = 'x'").collect()]
    # A plain choice is within twice the best radius, one of core-sets within four times.
    assert len(set(chosen)) == 12 and radius(chosen) <= 4 * radius(plain)
    near = {(r.case, r.bucket): r.radius for r in seeds.cover_radius(df.where("point is not null"), cut, ["u", "v"]).collect()}
    assert near["a", "x"] == pytest.approx(radius(chosen)) and near["a", "y"] == near["b", "x"] == 0


def test_share_budgets(spark):
    sizes = spark.createDataFrame([("a", "x", 100), ("a", "y", 100), ("a", "z", 2), ("b", "y", 50), ("c", "w", 9)], "case string, bucket string, n long")
    got = {(r.case, r.bucket): r.budget for r in seeds.share_budgets(sizes, 10, {"x": 1.0, "y": 1.0, "z": 1.0}).collect()}
    assert got == {("a", "x"): 4, ("a", "y"): 3, ("a", "z"): 2, ("b", "y"): 10}


def test_distances_read_no_line_anew_for_each_cell(spark, capsys):
    """A frame to the end of a line costs the square of its length; long lines and short ones give the same sums."""
    cells = spark.createDataFrame([(0, x, y, (x * 7 + y * 5) % 23 == 0) for x in range(90) for y in range(70)], "c int, x int, y int, on boolean")
    found = grids.distance_transform(cells, "c", ["x", "y"], F.col("on"))
    found.explain()
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()
    sources = [(r.x, r.y) for r in cells.where("on").collect()]
    assert all(r.d2 == min((r.x - a) ** 2 + (r.y - b) ** 2 for a, b in sources) for r in found.where("x % 9 = 0").collect())


def test_long_written_tables_are_not_broadcast(spark, capsys):
    from strataframe.core.storage import saved

    long, short = saved(spark.range(200_000)), saved(spark.range(10))
    long.join(long.withColumn("b", F.col("id") + 1), "id").explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out
    long.join(short, "id").count()
    assert long.join(F.broadcast(short), "id").count() == 10


def test_farthest_cover_is_one_sequence_over_a_group(spark):
    """Groups longer than a block of ``cover_points``, a group with fewer points than its budget, and none."""
    rows = [(g, "b", i, float(i * 37 % 211), float(i * 53 % 97)) for g in (0, 1) for i in range(9000 if g else 3)]
    points = spark.createDataFrame(rows, "case int, bucket string, point int, x double, y double")
    budgets = spark.createDataFrame([(0, "b", 5), (1, "b", 6), (2, "b", 4)], "case int, bucket string, budget int")
    got = {(r.case, r.place): r.point for r in seeds.farthest_cover(points, budgets, ["x", "y"]).collect()}
    for g, n in ((0, 3), (1, 6)):
        at = np.array([r[3:] for r in rows if r[0] == g])
        assert [got.pop((g, k)) for k in range(n)] == farthest_points(at, n)
    assert not got
    assert seeds.farthest_cover(points.limit(0), budgets, ["x", "y"]).count() == 0


def test_blocks_of_a_batch_are_solved_together(spark, monkeypatch):
    """Blocks cut by batches and parts: components are those of one block for each case."""
    a = np.random.default_rng(8).integers(-1, 2, (13, 11))
    df, axes = cells_of(spark, {"a": a, "b": a.T.copy()})
    want = {tuple(r) for r in grids.grid_components(df, "case", axes, "label", side=16).collect()}
    monkeypatch.setattr(grids, "TOGETHER", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert {tuple(r) for r in grids.grid_components(df, "case", axes, "label", side=4).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
