"""Matching, suppression, propagation and draws by weight against plain Python."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import boxes, detection, graph, matching, partition


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)


def scattered(rng, n, wide=200):
    out = []
    for _ in range(n):
        x, y, w, h = rng.randint(0, wide), rng.randint(0, wide), rng.randint(5, 60), rng.randint(5, 60)
        out.append((float(x), float(y), float(x + w), float(y + h)))
    return out


def plain_atss(truths, anchors, candidates, inside=True):
    centre = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    best = {}
    for t, box in sorted(truths.items()):
        near = []
        for level in sorted({lv for lv, _ in anchors.values()}):
            at = sorted(((centre(b)[0] - centre(box)[0]) ** 2 + (centre(b)[1] - centre(box)[1]) ** 2, a) for a, (lv, b) in anchors.items() if lv == level)
            near += [a for _, a in at[:candidates]]
        overlaps = [iou(anchors[a][1], box) for a in near]
        bar = np.mean(overlaps) + (np.std(overlaps, ddof=1) if len(near) > 1 else 0)
        for a, o in zip(near, overlaps, strict=True):
            x, y = centre(anchors[a][1])
            within = min(x - box[0], box[2] - x, y - box[1], box[3] - y) > 0.01
            if len(near) == 1 or (o >= bar - 1e-9 and (within or not inside)):
                best[a] = max(best.get(a, (-1.0, 0)), (o, -t))
    return {a: -best[a][1] if a in best else None for a in anchors}


@pytest.mark.parametrize("inside", [True, False])
def test_atss(spark, inside):
    rng, truths, anchors, want = random.Random(4), [], [], {}
    for image in range(5):
        boxes_ = dict(enumerate(scattered(rng, [6, 1, 12, 0, 3][image], 150 if image != 4 else 3000)))
        grid = {}
        for level in range(1 if image == 1 else 3):
            size = 16 * 2**level
            for i, j in itertools.product(range(160 // size if image != 1 else 1), repeat=2):
                x, y = (i + 0.5) * size, (j + 0.5) * size
                grid[len(grid)] = (level, (x - size, y - size, x + size, y + size))
        truths += [(image, t, *b) for t, b in boxes_.items()]
        anchors += [(image, lv, a, *b) for a, (lv, b) in grid.items()]
        want |= {(image, a): t for a, t in plain_atss(boxes_, grid, 4, inside).items()}
    sides = "xmin double, ymin double, xmax double, ymax double"
    found = matching.atss_match(spark.createDataFrame(truths, f"image int, truth long, {sides}"), spark.createDataFrame(anchors, f"image int, level int, anchor long, {sides}"), center_inside=inside).collect()
    assert {(r.image, r.anchor): r.truth for r in found} == want and len(found) == len(anchors)
    none = spark.createDataFrame([], f"image int, truth long, {sides}")
    assert matching.atss_match(none, spark.createDataFrame(anchors[:3], f"image int, level int, anchor long, {sides}")).where("truth is null").count() == 3


def test_nearest_anchors_in_odd_places(spark):
    """Anchors on one spot, in one line, and truths far from all of them."""
    sides = "xmin double, ymin double, xmax double, ymax double"
    spot = [("spot", 0, i, 4.0, 4.0, 6.0, 6.0) for i in range(30)]
    line = [("line", 0, i, 0.0, float(i), 2.0, i + 2.0) for i in range(200)]
    truths = [("spot", 1, 0.0, 0.0, 2.0, 2.0), ("line", 1, -9000.0, 100.0, -8998.0, 103.0), ("line", 2, 0.0, 5e6, 1.0, 5e6 + 2)]
    found = matching.nearest_anchors(spark.createDataFrame(truths, f"image string, truth long, {sides}"), spark.createDataFrame(spot + line, f"image string, level int, anchor long, {sides}"), 5).collect()
    by = {}
    for r in found:
        by.setdefault((r.image, r.truth), []).append(r.anchor)
    assert {k: sorted(v) for k, v in by.items()} == {("spot", 1): [0, 1, 2, 3, 4], ("line", 1): [98, 99, 100, 101, 102], ("line", 2): [195, 196, 197, 198, 199]}


def test_best_assignment_equals_enumeration():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n, m = map(int, rng.integers(1, 5, 2))
        values = np.where(rng.random((n, m)) < 0.4, 0.0, rng.integers(1, 9, (n, m)) / 8)
        chosen = matching.best_assignment(values)
        assert len({c for c in chosen if c >= 0}) == sum(chosen >= 0)
        got = sum(values[i, c] for i, c in enumerate(chosen) if c >= 0)
        padded = np.hstack([values, np.zeros((n, n))])
        assert got == pytest.approx(max(sum(padded[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m + n), n)))


def test_optimal_match(spark):
    rng, rows, best = random.Random(6), [], {}
    for image in range(12):
        table = {(t, p): rng.randint(1, 50) / 64 for t in range(5) for p in range(5) if rng.random() < 0.5}
        rows += [(image, t, p, v) for (t, p), v in table.items()]
        best[image] = max(sum(table.get((t, p), 0) for t, p in enumerate(way)) for way in itertools.permutations(range(5)))
    rows += [(99, i, i, 0.5) for i in range(300)] + [(99, i, i + 1, 0.75) for i in range(0, 299, 3)] + [(98, None, 1, 0.5), (98, 1, 1, 0.0), rows[0]]
    df = spark.createDataFrame(rows, "image int, truth int, pred int, iou double")
    found = matching.optimal_match(df, "image", "truth", "pred", "iou").collect()
    total = Counter()
    for r in found:
        total[r.image] += r.iou
    assert {i: total[i] for i in best} == pytest.approx(best) and 98 not in total
    assert len({(r.image, r.truth) for r in found}) == len({(r.image, r.pred) for r in found}) == len(found)
    assert matching.optimal_match(df, "image", "truth", "pred", "iou", 0.7).where("iou <= 0.7").count() == 0
    assert matching.optimal_match(df.limit(0), "image", "truth", "pred", "iou").count() == 0


def test_suppression_equals_one_after_another(spark):
    rng, rows, want = random.Random(7), [], set()
    for image in (1, 2, None):
        own = [(f"{image}-{i}", rng.choice([0.1, 0.5, 0.5, 0.9, rng.random()]), *b) for i, b in enumerate(scattered(rng, 90 if image == 1 else 25, 120))]
        rows += [(image, *r) for r in own]
        left, kept = sorted(own, key=lambda r: (-r[1], r[0])), []
        while left:
            kept.append(left[0])
            left = [r for r in left[1:] if iou(r[2:], kept[-1][2:]) <= 0.3]
        want |= {r[0] for r in kept}
    rows += [(3, "null score", None, 0.0, 0.0, 9.0, 9.0), (3, "scored", 0.1, 0.0, 0.0, 9.0, 9.0), (4, "flat", 0.2, 1.0, 1.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "image int, box string, score double, xmin double, ymin double, xmax double, ymax double")
    found = boxes.suppress(df, ["image"], "score", "box", 0.3)
    assert found.columns == df.columns and {r.box for r in found.collect()} == want | {"scored", "flat"}


def test_greedy_matching_by_rounds(spark):
    rng = random.Random(8)
    pairs = [(image, p, t, scores, rng.randint(1, 5) / 5) for image in range(3) for p in range(30) for scores in [rng.choice([0.2, 0.4, 0.6])] for t in range(30) if rng.random() < 0.2]
    used, want = set(), set()
    for image, p, t, s, o in sorted((r for r in pairs if r[4] >= 0.4), key=lambda r: (r[0], -r[3], r[1], -r[4], r[2])):
        if (image, "p", p) not in used and (image, "t", t) not in used:
            used |= {(image, "p", p), (image, "t", t)}
            want.add((image, p, t, o))
    df = spark.createDataFrame([*pairs, pairs[0], (1, None, 3, 0.9, 1.0)], "image int, pred int, truth int, score double, iou double")
    assert {tuple(r) for r in boxes.greedy_match(df, "image", "pred", "truth", "score", 0.4).collect()} == want


def test_coco_metrics_by_hand(spark):
    sides = "xmin double, ymin double, xmax double, ymax double"
    box = lambda x: (x, 0.0, x + 10, 10.0)
    truths = spark.createDataFrame([(1, 0, 1, *box(0.0), False), (1, 0, 2, *box(50.0), False), (2, 0, 3, *box(0.0), True)], f"image int, label long, box long, {sides}, out boolean")
    preds = spark.createDataFrame([(1, 0, 1, 0.9, *box(0.0)), (1, 0, 2, 0.8, *box(100.0)), (1, 0, 3, 0.7, *box(50.0)), (2, 0, 4, 0.95, *box(0.0))], f"image int, label long, box long, score double, {sides}")
    found = {(r.measure, r.label, r["at"], r.most): r.value for r in detection.coco_metrics(preds, truths, [0, 1], (0.5,), (0.5, 0.5, 0.05), (1, 2, 3), "out").collect()}
    # Ranked: hit, miss, hit, as the best one took a truth to be ignored: precision 1 up to recall 0.5, then 2/3.
    area = (51 + 50 * 2 / 3) / 101
    assert found["AP", 0, 0.5, 3] == pytest.approx(area) and found["AP", 1, 0.5, 3] == -1 and found["AP", None, None, 3] == pytest.approx((area - 1) / 2)
    assert [found["AR", 0, None, m] for m in (1, 2, 3)] == [0.5, 0.5, 1.0] and found["AR", 1, None, 1] == -1 and found["AR", None, None, 3] == 1.0
    assert ("AR", 0, 0.5, 1) not in found and found["AR", 0, 0.5, 3] == 1.0
    nothing = {(r.measure, r.label, r.value) for r in detection.coco_metrics(preds.limit(0), truths, [0], (0.5,), (0.5, 0.5, 0.05), (3,)).collect()}
    assert nothing == {("AP", 0, 0.0), ("AP", None, 0.0), ("AR", 0, 0.0), ("AR", None, 0.0)}


def test_propagation_equals_the_closed_form(spark):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(40, 3))
    far = np.sqrt(((points[:, None] - points) ** 2).sum(2))
    edges = [(i, int(j), float(far[i, j])) for i in range(40) for j in np.argsort(far[i])[1:5]] + [(50, 51, 1.0)]
    norm = graph.affinity(spark.createDataFrame(edges, "src long, dst long, distance double"), 1.0)
    nodes = spark.createDataFrame([(i, i % 3 if i < 9 else -1) for i in [*range(40), 50, 51, 60]], "node long, label int")
    s, y = np.zeros((62, 62)), np.zeros((62, 3))
    for r in norm.collect():
        s[r.src, r.dst] = r.norm
    for i in range(9):
        y[i, i % 3] = 1
    for alpha in (0.5, 0.99):
        want = np.linalg.solve(np.eye(62) - alpha * s, (1 - alpha) * y)
        done = graph.propagate_fully(nodes, norm, alpha, 1e-10)
        got = {(r.node, r.label): r.score for r in done.scores.collect()}
        assert done.residual <= 1e-10 and done.rounds < 60
        assert all(got.get((i, c), 0.0) == pytest.approx(want[i, c], abs=1e-9) for i in range(62) for c in range(3))
        best = {r.node: r.label for r in graph.best_labels(nodes, done.scores).collect()}
        assert best[50] is best[51] is best[60] is None and all(best[i] == int(want[i].argmax()) for i in range(40) if want[i].max() > 1e-6)
    none = graph.propagate_fully(nodes.where("label = -1"), norm, 0.5)
    assert none.scores.count() == 0 and none.rounds == 0
    with pytest.raises(ValueError):
        graph.propagate_fully(nodes, norm, 1.0)


def test_weighted_sample(spark):
    rows = [(i, [1.0, 2.0, 6.0][i % 3]) for i in range(6000)] + [(6001, 0.0), (6002, None), (6003, -1.0)]
    df = spark.createDataFrame(rows, "k long, w double").repartition(5)
    drawn = partition.weighted_sample(df, "w", 900, "k", seed=3).collect()
    assert len(drawn) == len({r.k for r in drawn}) == 900 and max(r.k for r in drawn) < 6000
    assert {r.k for r in drawn} == {r.k for r in partition.weighted_sample(df.repartition(2), "w", 900, "k", seed=3).collect()}
    assert {r.k for r in drawn} != {r.k for r in partition.weighted_sample(df, "w", 900, "k", seed=4).collect()}
    keys = sorted((r.sample_key, r.k) for r in partition.weighted_sample(df, "w", 9999, "k", seed=3).collect())
    assert len(keys) == 6000 and {k for _, k in keys[:900]} == {r.k for r in drawn}
    # Drawing by weight without replacement until 900 of 6,000 are taken: chances 1 - exp(-w t), with t from their sum.
    low, high = 0.0, 1.0
    for _ in range(60):
        t = (low + high) / 2
        low, high = (t, high) if sum(2000 * (1 - math.exp(-w * t)) for w in (1, 2, 6)) < 900 else (low, t)
    share = Counter(r.w for r in drawn)
    for w in (1.0, 2.0, 6.0):
        p = 1 - math.exp(-w * low)
        assert abs(share[w] - 2000 * p) < 4 * math.sqrt(2000 * p * (1 - p))
    assert partition.weighted_sample(df, "w", 0, "k").count() == 0 and partition.weighted_sample(df.limit(0), "w", 5, "k").count() == 0


def test_weighted_sample_when_the_bracket_misses(spark, monkeypatch):
    monkeypatch.setattr(F, "percentile_approx", lambda *_: F.array(F.max("sample_key") + 1, F.max("sample_key") + 2))
    df = spark.createDataFrame([(i, 1.0 + i % 5) for i in range(500)], "k long, w double")
    keys = sorted((r.sample_key, r.k) for r in partition.weighted_sample(df, "w", 500, "k").collect())
    assert {r.k for r in partition.weighted_sample(df, "w", 77, "k").collect()} == {k for _, k in keys[:77]}


def test_suppression_of_copies_compares_each_shape_once(spark, monkeypatch):
    """Two thousand copies of two boxes: the rows that meet are shapes, and boxes without an area all stay."""
    met = []
    join = boxes.overlap_join
    monkeypatch.setattr(boxes, "overlap_join", lambda left, *a, **k: (met.append(left.count()), join(left, *a, **k))[1])
    rows = [(i, 0, float(i % 7), 0.0 + i % 2, 0.0, 10.0 + i % 2, 10.0) for i in range(2000)] + [(5000 + i, 0, 1.0, 3.0, 3.0, 3.0, 3.0) for i in range(3)]
    df = spark.createDataFrame(rows, "id int, g int, score double, xmin double, ymin double, xmax double, ymax double")
    kept = sorted(r.id for r in boxes.suppress(df, ["g"], "score", "id", 0.5).collect())
    assert kept == [6, 5000, 5001, 5002] and met == [2]


def test_overlaps_of_copies_are_all_pairs(spark):
    rows = [(i, i % 2, float(i % 3), 0.0, 4.0 + i % 3, 4.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, image int, xmin double, ymin double, xmax double, ymax double")
    got = {(r.a_id, r.b_id): r.iou for r in boxes.overlap_join(df, df, "image", 3.0).collect()}
    gap = lambda a, b: abs(a[2] - b[2])
    want = {(a[0], b[0]): (16 - 4 * gap(a, b)) / (16 + 4 * gap(a, b)) for a in rows for b in rows if a[1] == b[1]}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("small", [0, 512])
def test_optimal_match_in_batches(spark, monkeypatch, small):
    """Small images need no components; both ways give the same matching, whatever batch a group is cut by."""
    monkeypatch.setattr(matching, "SMALL", small)
    asked, components = [], matching.components
    monkeypatch.setattr(matching, "components", lambda edges: (asked.append(1), components(edges))[1])
    rows = [(i, t, p, 1.0 + (i * 7 + t * 5 + p * 3) % 11 / 16 + t * p / 64) for i in range(30) for t in range(4) for p in range(4) if (t < 2) == (p < 2)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "image int, truth int, pred int, iou double")
        found = {(r.image, r.truth, r.pred) for r in matching.optimal_match(df, "image", "truth", "pred", "iou").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    value, want = {r[:3]: r[3] for r in rows}, set()
    for i in range(30):
        for low in (0, 2):
            ways = [[(i, low, low + x), (i, low + 1, low + 1 - x)] for x in (0, 1)]
            want.update(max(ways, key=lambda w: sum(value[k] for k in w)))
    assert sum(value[k] for k in found) == pytest.approx(sum(value[k] for k in want)) and len(found) == 120
    assert bool(asked) == (small == 0)


def test_pairs_of_copies_are_shuffled_once_and_whole(spark, capsys, monkeypatch):
    """Copies in several gatherings and slices give all pairs; the expansion keeps the tasks that its rows are dealt to."""
    monkeypatch.setattr(boxes, "BLOCK", 16)
    monkeypatch.setattr(boxes, "SLICE", 3)
    rows = [(i, i % 2, float(i % 3), 0.0, 4.0 + i % 3, 4.0) for i in range(120)] + [(None, 0, 0.0, 0.0, 4.0, 4.0), (500, 1, -0.0, 0.0, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "id int, image int, xmin double, ymin double, xmax double, ymax double")
    found = boxes.overlap_pairs(df, df, "image", "id", 3.0, 4)
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("hashpartitioning(b_at") == 2 == plan.count("REPARTITION_BY_NUM")
    want = sorted((r.a_id, r.b_id, round(r.inter, 4), round(r.iou, 4), round(r.giou, 4)) for r in boxes.overlap_join(df.dropna(), df.dropna(), "image", 3.0).collect())
    assert sorted(map(tuple, found.collect())) == want and len(want) > 7000
