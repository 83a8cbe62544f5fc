"""Dataset statistics of image and label arrays: by case, and over all cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.operators import stats
from strataframe.operators.stats import STATS


def voxels(cases: DataFrame, case: str = "case", image: str = "image", label: str = "label") -> DataFrame:
    """One row for each place of each case: case, value, label."""
    both = F.explode(F.arrays_zip(F.col(image).alias("value"), F.col(label).alias("label")))
    return cases.select(F.col(case).alias("case"), both.alias("v")).select("case", "v.value", "v.label")


def _named(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.select(*keys, F.struct(*STATS).alias(name))


def by_case(cases: DataFrame, case: str = "case", image: str = "image", label: str = "label") -> DataFrame:
    """Intensity statistics of each case, of its foreground, and of each of its labels with its share.

    ``cases`` has case, shape, spacing, image and label arrays.  A case without foreground has null
    foreground statistics."""
    rows = voxels(cases, case, image, label)
    whole = _named(stats.sample_stats(rows, ["case"], "value"), ["case"], "image_stats")
    front = _named(stats.sample_stats(rows.where("label > 0"), ["case"], "value"), ["case"], "foreground_stats")
    shares = stats.label_share(rows, ["case"], "label").select("case", "label", "n", "share")
    own = _named(stats.sample_stats(rows, ["case", "label"], "value"), ["case", "label"], "intensity")
    labels = shares.join(own, ["case", "label"]).groupBy("case").agg(F.sort_array(F.collect_list(F.struct("label", "n", "share", "intensity"))).alias("label_stats"))
    facts = cases.select(F.col(case).alias("case"), "shape", "spacing", F.zip_with("shape", "spacing", lambda n, s: n * s).alias("size_mm"))
    return facts.join(whole, "case", "left").join(front, "case", "left").join(labels, "case", "left")


def summary(reports: DataFrame) -> DataFrame:
    """Statistics of statistics over cases: one row with image, foreground and label parts."""
    def part(name: str) -> DataFrame:
        rows = reports.where(F.col(name).isNotNull()).select(f"{name}.*")
        return stats.summarise(rows, []).select(F.struct("n_cases", *STATS).alias(name))

    labels = reports.select(F.explode("label_stats").alias("l")).select("l.label", "l.share", "l.intensity.*")
    each = labels.groupBy("label").agg(F.avg("share").alias("share"), F.count(F.lit(1)).alias("n_cases"), *[(F.max(s) if s == "max" else F.min(s) if s == "min" else F.avg(s)).alias(s) for s in STATS])
    listed = each.agg(F.sort_array(F.collect_list(F.struct("label", "n_cases", "share", *STATS))).alias("label_stats"))
    return part("image_stats").crossJoin(part("foreground_stats")).crossJoin(listed)


def histogram_report(cases: DataFrame, bins: int = 100, low: float = -500.0, high: float = 500.0, case: str = "case", image: str = "image", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Histograms of each case, and their sum."""
    counts = stats.histogram(voxels(cases, case, image, label), ["case"], "value", bins, low, high)
    return counts, stats.merge_histograms(counts)
