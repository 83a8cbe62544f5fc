"""Evaluation of detections: free-response curves and scores, and average precision of boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.core.storage import saved, with_running_sums
from strataframe.operators.boxes import first_copies, mutual_best, overlap_join, usual_cell


def point_places(*coordinates: Column, level: int = 0) -> list[Column]:
    """Places on a mask made at a resolution level, from places at level 0."""
    return [(c / F.lit(float(2**level))).cast("long") for c in coordinates]


def hits_and_misses(detections: DataFrame, targets: DataFrame, image: str, label: str, score: str, exclude: Sequence[int] = ()) -> DataFrame:
    """``(score, hits, false_alarms)``, a row for each false alarm and each target.

    ``detections(image, label, score)`` holds the target that the point lies in, 0 for none;
    ``targets(image, label)`` lists all.  A target counts by its best detection, one without any by
    score 0.  An excluded target counts neither way but keeps its score of 0 in the list; detections
    of it, and those without a label or score, are left out."""
    known = detections.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    alarms = known.where(F.col(label) == 0).select(F.col(score).cast("double").alias("score"), F.lit(0).alias("hits"), F.lit(1).alias("false_alarms"))
    best = known.where(F.col(label) > 0).groupBy(image, label).agg(F.max(score).cast("double").alias("best__"))
    out = F.col(label).isin(list(exclude)) if exclude else F.lit(False)
    listed = targets.select(image, label).where(F.col(label) > 0).distinct().join(best, [image, label], "left")
    return alarms.union(listed.select(F.when(out, 0.0).otherwise(F.coalesce("best__", F.lit(0.0))), F.when(out, 0).otherwise(1), F.lit(0)))


def froc_points(found: DataFrame, images: int) -> DataFrame:
    """``found(score, hits, false_alarms)`` -> threshold, fps_per_image and sensitivity.

    One row for every score but the least, and the point without any detection (null threshold).
    The running sums are taken over ranges of scores, so no task sees all of them."""
    groups = found.groupBy("score").agg(F.sum("hits").alias("hits"), F.sum("false_alarms").alias("false_alarms"))
    total = groups.agg(F.sum("hits").alias("all__"), F.min("score").alias("least__"))
    sums = with_running_sums(groups, F.desc("score"), {"tp__": "hits", "fp__": "false_alarms"}).crossJoin(F.broadcast(total))
    points = sums.where("score > least__").select(
        F.col("score").alias("threshold"), (F.col("fp__") / images).alias("fps_per_image"), F.when(F.col("all__") > 0, F.col("tp__") / F.col("all__")).alias("sensitivity")
    )
    return points.union(found.sparkSession.range(1).select(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0)))


def froc_score(points: DataFrame, rates: Sequence[float] = (0.25, 0.5, 1, 2, 4, 8)) -> DataFrame:
    """Mean sensitivity at the given false positives per image, drawn straight between points.

    One pass: for each rate, the last point at or below it and the first one beyond."""
    spot = F.struct("fps_per_image", "sensitivity")
    ends = [F.max(F.when(F.col("fps_per_image") <= r, spot)).alias(f"low{i}") for i, r in enumerate(rates)]
    ends += [F.min(F.when(F.col("fps_per_image") > r, spot)).alias(f"high{i}") for i, r in enumerate(rates)]
    at = []
    for i, r in enumerate(rates):
        low, high = F.col(f"low{i}"), F.col(f"high{i}")
        slope = (high["sensitivity"] - low["sensitivity"]) / (high["fps_per_image"] - low["fps_per_image"])
        at.append(F.coalesce(low["sensitivity"] + slope * (F.lit(float(r)) - low["fps_per_image"]), low["sensitivity"]))
    total = F.lit(0.0)
    for value in at:
        total = total + value
    return points.agg(*ends).select((total / len(rates)).alias("froc_score"))


def matches_at(pairs: DataFrame, keys: Sequence[str], pred: str, truth: str, score: str, overlaps: Sequence[float], ignore: str | None = None) -> DataFrame:
    """``(*keys, pred, at, ignored)``: the predictions that get a truth of their own at each least overlap.

    By falling score (ties: the lesser ``pred``), a prediction takes the free truth that it overlaps
    most (ties: the lesser); one to be ignored, as boolean ``ignore`` says, only if no other is free.  All
    overlaps are matched at once, by rounds of mutual best over pairs, so no image is one task."""
    out = F.lit(False) if ignore is None else F.coalesce(F.col(ignore), F.lit(False))
    levels = F.explode(F.array(*[F.lit(float(o)) for o in overlaps])).alias("at")
    rows = pairs.select(*keys, pred, truth, score, "iou", out.alias("ignored"), levels).where(F.col("iou") >= F.col("at"))
    order = F.struct(-F.col(score), F.col(pred), "ignored", -F.col("iou"), F.col(truth), *keys, "at")
    return mutual_best(rows, [*keys, "at", pred], [*keys, "at", truth], order).select(*keys, pred, "at", "ignored")


def box_precision(
    preds: DataFrame, truths: DataFrame, image: str, label: str, box: str, score: str, overlaps: Sequence[float], most: int = 100, cell: float = 64.0
) -> DataFrame:
    """``(label, at, ap, recall)`` of each label with a truth, at each least overlap.

    ``preds`` and ``truths`` hold image, label, box (an id unique in its table), xmin, ymin, xmax and
    ymax, ``preds`` a score too.  The ``most`` best predictions of an image and label count.  They are
    matched with the truths, then ranked by score over all images (ties by image and box); ``ap`` is
    the mean, over the recalls 0, 0.01 ... 1, of the best precision at that recall or more; ``recall``
    is that of all predictions.  Rows with a null image, label, score or side are left out; a label
    without truths has no row, one without predictions gets zeros.

    The ranking is summed over ranges of one global order, so a label of any size is no task's load."""
    sides = ["xmin", "ymin", "xmax", "ymax"]
    corners = lambda df, *more: df.select(image, label, box, *more, *sides).dropna()
    best = Window.partitionBy(image, label).orderBy(F.desc(score), box)
    found = corners(preds, score).withColumn("rank__", F.row_number().over(best)).where(F.col("rank__") <= most).drop("rank__")
    grouped = lambda df: df.select(F.struct(image, label).alias("image__"), *[c for c in df.columns if c not in (image, label)])
    # No prediction of an image and label gets farther than the first ``most`` of equal truths.
    met = overlap_join(grouped(found), grouped(first_copies(corners(truths), [image, label], box, most)), "image__", cell)
    pairs = met.select(f"a_image.{image}", f"a_image.{label}", F.col(f"a_{box}").alias(box), F.col(f"b_{box}").alias("truth__"), F.col(f"a_{score}").alias(score), "iou")
    hits = matches_at(pairs, [image, label], box, "truth__", score, overlaps).select(image, label, box, "at", F.lit(1).alias("hit__"))
    levels = F.explode(F.array(*[F.lit(float(o)) for o in overlaps])).alias("at")
    ranked = found.select(image, label, box, score, levels).join(hits, [image, label, box, "at"], "left")
    ranked = ranked.select(label, "at", F.coalesce("hit__", F.lit(0)).alias("hit__"), F.lit(1).alias("one__"), F.struct(label, "at", -F.col(score), image, box).alias("order__"))
    sums = with_running_sums(ranked, F.col("order__"), {"tp__": "hit__", "all__": "one__"})
    # Sums run on from label to label; what stood before a label's first row is taken off again.
    starts = sums.groupBy(label, "at").agg(F.min(F.col("tp__") - F.col("hit__")).alias("tp0__"), F.min(F.col("all__") - 1).alias("all0__"))
    wanted = corners(truths).groupBy(label).agg(F.count(F.lit(1)).alias("n__"))
    points = sums.join(starts, [label, "at"]).join(wanted, label)
    hit, seen = F.col("tp__") - F.col("tp0__"), F.col("all__") - F.col("all0__")
    points = points.select(label, "at", "n__", hit.alias("h__"), (hit / seen).alias("precision__"), F.floor(100 * hit / F.col("n__")).cast("int").alias("percent__"))
    steps = points.groupBy(label, "at", "percent__").agg(F.max("precision__").alias("p__"), F.max(F.col("h__") / F.col("n__")).alias("r__"))
    # At most 101 steps a label and overlap: each fills the recalls from the step before up to its own.
    down = Window.partitionBy(label, "at").orderBy(F.desc("percent__"))
    before = Window.partitionBy(label, "at").orderBy("percent__")
    width = F.col("percent__") - F.coalesce(F.lag("percent__").over(before), F.lit(-1))
    filled = steps.select(label, "at", "r__", (width * F.max("p__").over(down.rowsBetween(Window.unboundedPreceding, 0))).alias("area__"))
    made = filled.groupBy(label, "at").agg((F.sum("area__") / 101).alias("ap"), F.max("r__").alias("recall"))
    every = wanted.select(label, levels)
    return every.join(made, [label, "at"], "left").select(label, "at", F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce("recall", F.lit(0.0)).alias("recall"))


def _precision_area(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, ap)`` from ``ranked(*keys, n, percent, precision)``: the mean of the best precision at each of 101 recalls."""
    steps = ranked.groupBy(*keys, "percent").agg(F.max("precision").alias("p"))
    down = Window.partitionBy(*keys).orderBy(F.desc("percent")).rowsBetween(Window.unboundedPreceding, 0)
    width = F.col("percent") - F.coalesce(F.lag("percent").over(Window.partitionBy(*keys).orderBy("percent")), F.lit(-1))
    return steps.select(*keys, (width * F.max("p").over(down)).alias("area")).groupBy(*keys).agg((F.sum("area") / 101).alias("ap"))


def coco_metrics(
    preds: DataFrame,
    truths: DataFrame,
    classes: Sequence[int],
    overlaps: Sequence[float] = (0.1, 0.5, 0.75),
    overlap_range: tuple[float, float, float] = (0.1, 0.5, 0.05),
    most: Sequence[int] = (1, 5, 100),
    ignore: str | None = None,
) -> DataFrame:
    """``(measure, label, at, most, value)``: average precision (AP) and recall (AR) of boxes, one row a figure.

    ``preds(image, label, box, score, corners)``, ``truths(image, label, box, corners)``; ``label`` null is the mean
    over ``classes``, ``at`` null the mean over ``overlap_range`` (first, last, step).  AP is given at the last of
    ``most``, the numbers of best predictions of an image and label that count; AR of the range at each of them, of
    single overlaps at the last.  Predictions that take a truth to be ignored (boolean column ``ignore``) count
    neither way, and such truths aren't wanted.  A class without a wanted truth has -1: means of AP hold it,
    means of AR leave it out and are -1 without any other.  Rows with nulls in the needed columns are left out.

    Matches are found once, with the last of ``most``, as lesser predictions can't change those of better ones.
    Rankings are running sums over ranges of one order, so a class of any size is no task's load."""
    first, last, step = overlap_range
    n_steps = round((last - first) / step)
    in_range = [round(first + i * (last - first) / max(n_steps, 1), 9) for i in range(n_steps + 1)]
    every = sorted({*in_range, *(round(o, 9) for o in overlaps)})
    sides = ["xmin", "ymin", "xmax", "ymax"]
    wanted_class = F.col("label").isin(list(classes))
    out = F.lit(False) if ignore is None else F.coalesce(F.col(ignore), F.lit(False))
    best = Window.partitionBy("image", "label").orderBy(F.desc("score"), "box")
    found = preds.where(wanted_class).select("image", "label", "box", "score", *sides).dropna()
    found = saved(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(most)))
    real = saved(truths.where(wanted_class).select("image", "label", "box", *sides, out.alias("out")).dropna())
    keyed = lambda df, *more: df.select(F.struct("image", "label").alias("at__"), "box", *more, *sides)
    # No prediction of an image and label gets farther than the first max(most) of equal truths.
    near = first_copies(real, ["image", "label", "out"], "box", max(most))
    met = overlap_join(keyed(found, "score"), keyed(near, "out"), "at__", usual_cell(real))
    pairs = met.select("a_image.image", "a_image.label", F.col("a_box").alias("box"), F.col("b_box").alias("truth"), F.col("a_score").alias("score"), F.col("b_out").alias("out"), "iou")
    hits = saved(matches_at(pairs, ["image", "label"], "box", "truth", "score", every, "out"))
    levels = F.explode(F.array(*[F.lit(o) for o in every])).alias("at")
    wanted = saved(real.where("not out").groupBy("label").agg(F.count(F.lit(1)).alias("n")))

    seen = found.select("image", "label", "box", "score", "rank", levels).join(hits, ["image", "label", "box", "at"], "left").where("ignored is null or not ignored")
    seen = saved(seen.select("image", "label", "box", "score", "rank", "at", F.col("ignored").isNotNull().cast("int").alias("hit")))
    recall = seen.where("hit = 1").withColumn("most", F.explode(F.array(*map(F.lit, most)))).where("rank <= most").groupBy("label", "at", "most").agg(F.count(F.lit(1)).alias("h"))
    order = F.struct("label", "at", -F.col("score"), "image", "box")
    sums = with_running_sums(seen.select("label", "at", "hit", F.lit(1).alias("one"), order.alias("order")), F.col("order"), {"tp": "hit", "all": "one"})
    starts = sums.groupBy("label", "at").agg(F.min(F.col("tp") - F.col("hit")).alias("tp0"), F.min(F.col("all") - 1).alias("all0"))
    points = sums.join(starts, ["label", "at"]).join(wanted, "label")
    h = F.col("tp") - F.col("tp0")
    area = _precision_area(points.select("label", "at", F.floor(100 * h / F.col("n")).cast("int").alias("percent"), (h / (F.col("all") - F.col("all0"))).alias("precision")), ["label", "at"])

    spark = preds.sparkSession
    frame = spark.createDataFrame([(c,) for c in classes], "label long").select("label", levels).join(wanted, "label", "left")
    value = lambda given: F.when(F.col("n").isNull(), -1.0).otherwise(F.coalesce(given, F.lit(0.0)))
    ap = frame.join(area, ["label", "at"], "left").select(F.lit("AP").alias("measure"), "label", "at", F.lit(most[-1]).alias("most"), value(F.col("ap")).alias("value"))
    ar = frame.withColumn("most", F.explode(F.array(*map(F.lit, most)))).join(recall, ["label", "at", "most"], "left")
    ar = ar.select(F.lit("AR").alias("measure"), "label", "at", "most", value(F.col("h") / F.col("n")).alias("value"))
    cells = saved(ap.unionByName(ar))

    def mean(rows: DataFrame, *keys: str) -> DataFrame:
        some = F.avg(F.when((F.col("measure") == "AP") | (F.col("value") > -1), F.col("value")))
        made = rows.groupBy("measure", "most", *keys).agg(F.coalesce(some, F.lit(-1.0)).alias("value"))
        null = {"label": F.lit(None).cast("long"), "at": F.lit(None).cast("double")}
        return made.select("measure", *[F.col(c) if c in keys else null[c].alias(c) for c in ("label", "at")], "most", "value")

    ranged = cells.where(F.col("at").isin(in_range))
    single = cells.where(F.col("at").isin([round(o, 9) for o in overlaps]) & (F.col("most") == most[-1]))
    return mean(ranged).unionByName(mean(ranged, "label")).unionByName(mean(single, "at")).unionByName(single.select("measure", "label", "at", "most", "value"))
