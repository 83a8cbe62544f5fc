"""Evaluation metrics from prediction rows: confusion family, ranking, overlap, regression, detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.core.storage import with_running_sums


def ratio(a: Column, b: Column) -> Column:
    """a / b in double, null where b is 0."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def confusion(df: DataFrame, keys: list[str], pred: Column, truth: Column) -> DataFrame:
    """tp, fp, tn, fn of boolean columns by group."""
    count = lambda c: F.sum(c.cast("long"))
    return df.groupBy(*keys).agg(
        count(pred & truth).alias("tp"), count(pred & ~truth).alias("fp"), count(~pred & ~truth).alias("tn"), count(~pred & truth).alias("fn")
    )


def confusion_metrics() -> dict[str, Column]:
    """17 metrics of the columns tp, fp, tn, fn; a zero denominator gives null."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    p, n = tp + fn, fp + tn
    tpr, tnr, ppv, npv = ratio(tp, p), ratio(tn, n), ratio(tp, tp + fp), ratio(tn, tn + fn)
    fpr, fnr = ratio(fp, n), ratio(fn, p)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "tpr": tpr,
        "tnr": tnr,
        "ppv": ppv,
        "npv": npv,
        "fnr": fnr,
        "fpr": fpr,
        "fdr": ratio(fp, fp + tp),
        "for_": ratio(fn, fn + tn),
        "pt": ratio(F.sqrt(tpr * fpr) - fpr, tpr - fpr),
        "ts": ratio(tp, tp + fn + fp),
        "acc": ratio(tp + tn, p + n),
        "ba": (tpr + tnr) / 2,
        "f1": ratio(tp * 2.0, tp * 2.0 + fn + fp),
        "mcc": ratio(tp * tn - fp * fn, root),
        "fm": F.sqrt(ppv * tpr),
        "bm": tpr + tnr - 1.0,
        "mk": ppv + npv - 1.0,
    }


def f_beta(beta: float) -> Column:
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    b = beta * beta
    return ratio((1 + b) * tp, (1 + b) * tp + b * fn + fp)


def _score_groups(df: DataFrame, keys: list[str], score: str, truth: str) -> DataFrame:
    """Positives and rows of each distinct score: what ranking metrics need, aggregated before any window."""
    return df.groupBy(*keys, score).agg(F.sum(F.col(truth).cast("long")).alias("pos__"), F.count(F.lit(1)).alias("n__"))


def roc_auc(df: DataFrame, keys: list[str], score: str, truth: str) -> DataFrame:
    """Area under the ROC curve; ties get half credit; null if only one label is there."""
    groups = _score_groups(df, keys, score, truth).withColumn("neg__", F.col("n__") - F.col("pos__"))
    groups = with_running_sums(groups, F.col(score).asc(), {"upto__": "neg__"}, tuple(keys))
    under = F.col("upto__") - F.col("neg__")
    wins = groups.withColumn("wins__", F.col("pos__") * (under + F.col("neg__") / 2.0))
    return wins.groupBy(*keys).agg(
        F.sum("pos__").alias("n_pos"), F.sum("neg__").alias("n_neg"), ratio(F.sum("wins__"), F.sum("pos__") * F.sum("neg__")).alias("auc")
    )


def average_precision(df: DataFrame, keys: list[str], score: str, truth: str) -> DataFrame:
    """Sum over distinct scores of precision times the recall gained; null without a positive."""
    groups = with_running_sums(_score_groups(df, keys, score, truth), F.desc(score), {"tp__": "pos__", "all__": "n__"}, tuple(keys))
    cut = groups.withColumn("gain__", F.col("tp__") / F.col("all__") * F.col("pos__"))
    return cut.groupBy(*keys).agg(F.sum("pos__").alias("n_pos"), ratio(F.sum("gain__"), F.sum("pos__")).alias("ap"))


def averaged(metric: DataFrame, value: str, support: str) -> DataFrame:
    """Macro (plain) and weighted (by support) means of a metric over classes."""
    return metric.agg(F.avg(value).alias("macro"), ratio(F.sum(F.col(value) * F.col(support)), F.sum(F.when(F.col(value).isNotNull(), F.col(support)))).alias("weighted"))


def overlaps(df: DataFrame, keys: list[str], pred: Column, truth: Column, ignore_empty: bool = True) -> DataFrame:
    """Dice and IoU of each group; an empty truth gives null, or 1 / 0 by whether the prediction is empty."""
    p, t = pred.cast("long"), truth.cast("long")
    sums = df.groupBy(*keys).agg(F.sum(p * t).alias("inter"), F.sum(p).alias("n_pred"), F.sum(t).alias("n_true"))
    both = F.col("n_pred") + F.col("n_true")
    empty = F.lit(None).cast("double") if ignore_empty else F.when(F.col("n_pred") == 0, 1.0).otherwise(0.0)
    return sums.withColumns(
        {
            "dice": F.when(F.col("n_true") == 0, empty).otherwise(ratio(2.0 * F.col("inter"), both)),
            "iou": F.when(F.col("n_true") == 0, empty).otherwise(ratio(F.col("inter"), both - F.col("inter"))),
        }
    )


def generalized_dice(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Overlap with each class weighted by the inverse square of its size; absent classes take the largest weight."""
    raw = F.try_divide(F.lit(1.0), F.nullif(F.col("n_true").cast("double") * F.col("n_true"), F.lit(0.0)))
    most = F.coalesce(F.max(raw).over(Window.partitionBy(*keys)), F.lit(0.0))
    weighted = sums.withColumn("w__", F.coalesce(raw, most))
    return weighted.groupBy(*keys).agg(
        ratio(F.sum(2.0 * F.col("inter") * F.col("w__")), F.sum((F.col("n_pred") + F.col("n_true")) * F.col("w__"))).alias("gds")
    )


def reduce_metric(df: DataFrame, sample: str, channel: str, value: str) -> DataFrame:
    """All reductions of a sample x class table of values, nulls left out and an empty mean being 0."""
    by_sample = df.groupBy(sample).agg(F.avg(value).alias("mean__"), F.sum(value).alias("sum__"), F.count(value).alias("n__"))
    by_class = df.groupBy(channel).agg(F.avg(value).alias("mean__"), F.sum(value).alias("sum__"))
    a = by_sample.agg(
        F.coalesce(F.avg("mean__"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.sum("sum__"), F.lit(0.0)).alias("sum"),
        F.coalesce(F.avg(F.coalesce("sum__", F.lit(0.0))), F.lit(0.0)).alias("mean_batch_of_sums"),
        F.sum("n__").alias("not_nans"),
    )
    b = by_class.agg(F.coalesce(F.avg(F.coalesce("mean__", F.lit(0.0))), F.lit(0.0)).alias("mean_of_class_means"), F.max("sum__").alias("largest_class_sum"))
    return a.crossJoin(b)


def regression(df: DataFrame, keys: list[str], pred: Column, truth: Column, peak: float) -> DataFrame:
    """MSE, MAE, RMSE and PSNR of each group."""
    e = pred - truth
    mse = F.avg(e * e)
    return df.groupBy(*keys).agg(
        mse.alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(mse).alias("rmse"), (20.0 * F.log10(F.lit(peak)) - 10.0 * F.log10(F.nullif(mse, F.lit(0.0)))).alias("psnr")
    )


def cumulative_average(df: DataFrame, keys: list[str], value: str, count: str) -> DataFrame:
    """Weighted mean of finite values."""
    v, n = F.col(value), F.col(count)
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return df.where(ok).groupBy(*keys).agg(ratio(F.sum(v * n), F.sum(n)).alias("average"), F.sum(n).alias("weight"))


def froc_curve(df: DataFrame, score: str, truth: str, images: int) -> DataFrame:
    """False positives per image and sensitivity for all thresholds but the least score, and the zero point."""
    groups = _score_groups(df, [], score, truth).withColumn("neg__", F.col("n__") - F.col("pos__"))
    total = groups.agg(F.sum("pos__").alias("all__"), F.min(score).alias("least__"))
    curve = with_running_sums(groups, F.desc(score), {"tp": "pos__", "fp": "neg__"}).crossJoin(F.broadcast(total))
    points = curve.where(F.col(score) > F.col("least__")).select(
        F.col(score).cast("double").alias("threshold"), (F.col("fp") / images).alias("fps_per_image"), ratio(F.col("tp"), F.col("all__")).alias("sensitivity")
    )
    return points.union(df.sparkSession.range(1).select(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0)))


def panoptic_quality(df: DataFrame, image: str, pred: str, truth: str, least: float = 0.5) -> DataFrame:
    """PQ of each image from pixel rows with instance ids, 0 being background.

    At IoU above one half at most one prediction fits an instance, so matching is a filter."""
    if least < 0.5:
        raise ValueError("below one half a match isn't unique")
    pairs = df.where((F.col(pred) > 0) & (F.col(truth) > 0)).groupBy(image, pred, truth).agg(F.count(F.lit(1)).alias("inter"))
    sizes_p = df.where(F.col(pred) > 0).groupBy(image, pred).agg(F.count(F.lit(1)).alias("size_p"))
    sizes_t = df.where(F.col(truth) > 0).groupBy(image, truth).agg(F.count(F.lit(1)).alias("size_t"))
    iou = pairs.join(sizes_p, [image, pred]).join(sizes_t, [image, truth]).withColumn("iou", F.col("inter") / (F.col("size_p") + F.col("size_t") - F.col("inter")))
    hits = iou.where(F.col("iou") > least).groupBy(image).agg(F.count(F.lit(1)).alias("tp"), F.sum("iou").alias("sum_iou"))
    n_p, n_t = sizes_p.groupBy(image).agg(F.count(F.lit(1)).alias("n_p")), sizes_t.groupBy(image).agg(F.count(F.lit(1)).alias("n_t"))
    every = df.select(image).distinct().join(hits, image, "left").join(n_p, image, "left").join(n_t, image, "left").na.fill(0)
    tp, fp, fn = F.col("tp"), F.col("n_p") - F.col("tp"), F.col("n_t") - F.col("tp")
    half = tp + fp * 0.5 + fn * 0.5
    return every.select(image, tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.coalesce(ratio(F.col("sum_iou"), half), F.lit(0.0)).alias("pq"))


def precision_envelope(df: DataFrame, keys: list[str], score: str, truth: str, recalls: int = 11) -> DataFrame:
    """Precision at evenly spaced recalls under the envelope (the best precision at that recall or beyond)."""
    down = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(0, Window.unboundedFollowing)
    groups = _score_groups(df, keys, score, truth)
    total = F.sum("pos__").over(Window.partitionBy(*keys))
    cut = groups.withColumns({"tp": F.sum("pos__").over(down), "n": F.sum("n__").over(down), "total": total})
    cut = cut.withColumns({"recall": ratio(F.col("tp"), F.col("total")), "precision": F.col("tp") / F.col("n")})
    shown = cut.withColumn("best", F.max("precision").over(on)).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(recalls - 1))))
    met = shown.where(F.col("recall") >= F.col("step") / (recalls - 1))
    every = df.select(*keys).distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(recalls - 1))))
    best = met.groupBy(*keys, "step").agg(F.max("best").alias("precision"))
    return every.join(best, [*keys, "step"], "left").na.fill(0.0, ["precision"])


def report(df: DataFrame, names: list[str]) -> DataFrame:
    """mean, median, max, min, 90percentile and population std of each metric column, and of the row means."""
    row_mean = F.try_divide(sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names), F.lit(0.0)), F.nullif(sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0)), F.lit(0)))
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("class"), F.col(n).cast("double").alias("v")) for n in names], F.struct(F.lit("mean").alias("class"), row_mean.cast("double").alias("v")))).alias("x"))
    return stacked.select("x.*").groupBy("class").agg(
        F.avg("v").alias("mean"), F.median("v").alias("median"), F.max("v").alias("max"), F.min("v").alias("min"), F.percentile("v", 0.9).alias("90percentile"), F.stddev_pop("v").alias("std"), F.count("v").alias("notnans")
    )
