"""Reports on labelled cells: scores of classes, purity of segments, seeds and their correction, weights of label sources.

Cells are rows ``(case, segment, predicted, true)``.  Everything is counted by label first (map-side), so
what is joined or ranked afterwards is a few rows for each segment, however many cells it has."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.core.storage import saved
from strataframe.operators.partition import hash_order, hash_unit
from strataframe.operators.segments import majority
from strataframe.operators.stats import exact_percentiles


def confusion_matrix(df: DataFrame, keys: Sequence[str], pred: str, truth: str, ignore: int | None = None) -> DataFrame:
    """Cells of each pair of true and predicted class; those whose truth is ``ignore`` or null don't count."""
    cells = df.where(F.col(truth).isNotNull() if ignore is None else F.col(truth) != ignore)
    return cells.groupBy(*keys, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("cells"))


def class_scores(matrix: DataFrame, keys: Sequence[str], classes: Sequence[int], empty: float = 1.0) -> DataFrame:
    """Dice and iou of each class from a confusion matrix; ``empty`` where neither side holds the class."""
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("cells"))), F.lit(0))
    sums = []
    for c in classes:
        t, p = F.col("truth") == c, F.coalesce(F.col("pred") == c, F.lit(False))
        sums.append(F.struct(F.lit(c).alias("class"), total(t & p).alias("hits"), total(t).alias("in_truth"), total(p).alias("in_pred")))
    rows = matrix.groupBy(*keys).agg(F.array(*sums).alias("c__")).select(*keys, F.explode("c__").alias("c__")).select(*keys, "c__.*")
    size = F.col("in_truth") + F.col("in_pred")
    score = lambda value: F.when(size == 0, F.lit(empty)).otherwise(value)
    return rows.withColumns({"dice": score(2.0 * F.col("hits") / F.greatest(size, F.lit(1))), "iou": score(F.col("hits") / F.greatest(size - F.col("hits"), F.lit(1)))})


def score_summary(scores: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Number of rows, and mean, population deviation, least and greatest of each score."""
    made = [f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *made)


def segment_purity(df: DataFrame, segment: Sequence[str], pred: str, truth: str, classes: int, ignore: int | None = None) -> DataFrame:
    """For each segment: cells, share of the commonest true class, entropy over that of ``classes`` equal classes,
    and share of cells whose predicted class is another."""
    counts = confusion_matrix(df, segment, pred, truth, ignore)
    by_truth = counts.groupBy(*segment, "truth").agg(F.sum("cells").alias("k"), F.sum(F.when(F.col("pred").eqNullSafe(F.col("truth")), 0).otherwise(F.col("cells"))).alias("off"))
    sums = by_truth.groupBy(*segment).agg(F.sum("k").alias("cells"), F.max("k").alias("top"), F.sum("off").alias("off"), F.sum(F.col("k") * F.ln("k")).alias("klogk"))
    entropy = (F.ln("cells") - F.col("klogk") / F.col("cells")) / math.log(classes)
    return sums.select(*segment, "cells", (F.col("top") / F.col("cells")).alias("purity"), F.greatest(entropy, F.lit(0.0)).alias("entropy"), (F.col("off") / F.col("cells")).alias("mismatch"))


def purity_report(segments: DataFrame, keys: Sequence[str], limits: Sequence[float] = (0.3, 0.5)) -> DataFrame:
    """One row a group: means by segment and by cell, correlation of entropy and mismatch, shares of high entropy."""
    w, over = F.col("cells"), {str(x).replace(".", "_"): F.col("entropy") >= x for x in limits}
    weighted = lambda c: F.sum(w * F.col(c)) / F.sum(w)
    return segments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("segments"), F.sum(w).alias("cells"), F.avg("purity").alias("purity"), F.avg("entropy").alias("entropy"),
        weighted("purity").alias("cell_purity"), weighted("entropy").alias("cell_entropy"), F.corr("entropy", "mismatch").alias("corr"),
        *[F.avg(test.cast("double")).alias(f"segments_over_{n}") for n, test in over.items()],
        *[(F.sum(F.when(test, w).otherwise(0)) / F.sum(w)).alias(f"cells_over_{n}") for n, test in over.items()],
    )


def vote_segments(df: DataFrame, segment: Sequence[str], truth: str, name: str = "voted", ignore: int | None = None, fallback: int | None = None) -> DataFrame:
    """Every cell with its segment's commonest true class; ``fallback`` in segments where all cells are ignored."""
    cells = df if ignore is None else df.where(F.col(truth) != ignore)
    votes = majority(cells.where(F.col(truth).isNotNull()), list(segment), truth).select(*segment, F.col("label").alias("v__"))
    return df.join(votes, list(segment), "left").withColumn(name, F.coalesce(F.col("v__"), F.lit(fallback))).drop("v__")


def correct_seeds(df: DataFrame, segment: Sequence[str], place: str, seed: str, truth: str) -> DataFrame:
    """Segments that hold a seed (a label of 0 or more): the first seed's label, the commonest true class, and
    whether they differ."""
    seeds = df.where(F.col(seed) >= 0).groupBy(*segment).agg(F.min(F.struct(place, seed))[seed].alias("seeded"), F.count(F.lit(1)).alias("seeds"))
    votes = majority(df.where(F.col(truth).isNotNull()), list(segment), truth).select(*segment, F.col("label").alias("common"))
    return seeds.join(votes, list(segment), "left").withColumn("corrected", ~F.col("seeded").eqNullSafe(F.col("common")))


def seed_labels(is_seed: Column, label: Column, ignore: Sequence[int] = ()) -> Column:
    """The label where there is a seed, else -1; labels in ``ignore`` and null ones are -1 too."""
    kept = is_seed & label.isNotNull() & ~(label.isin(list(ignore)) if ignore else F.lit(False))
    return F.when(kept, label).otherwise(F.lit(-1))


def random_seeds(df: DataFrame, case: str, place: str, share: float, seed: int, classes: str | None = None) -> DataFrame:
    """About ``share`` of the cells of each case, by a hash of case and place; one cell of each class at least if
    ``classes`` names its column.  No cell is sorted or moved for the share."""
    chosen = hash_unit(seed, case, place) < share
    if classes is None:
        return df.where(chosen)
    key, label, at = F.col(case).alias("c__"), F.col(classes).alias("l__"), F.struct(hash_order(seed, case, place).alias("h"), F.col(place).alias("p"))
    first = df.groupBy(key, label).agg(F.min(at)["p"].alias("p__"))
    both = df.join(first, F.col(case).eqNullSafe(F.col("c__")) & F.col(classes).eqNullSafe(F.col("l__")))
    return both.where(chosen | (F.col(place) == F.col("p__"))).drop("c__", "l__", "p__")


def segment_centers(df: DataFrame, segment: Sequence[str], axes: Sequence[str]) -> DataFrame:
    return df.groupBy(*segment).agg(F.count(F.lit(1)).alias("cells"), *[F.avg(a).alias(a) for a in axes])


def histogram_descriptor(df: DataFrame, segment: Sequence[str], value: str, bins: int = 32, low: float = -3.0, high: float = 3.0) -> DataFrame:
    """Shares of a segment's values in equal bins, as an array; values beyond the range count in the end bins."""
    scaled = F.floor((F.least(F.greatest(F.col(value), F.lit(low)), F.lit(high)) - low) * (bins / (high - low)))
    at = F.least(scaled, F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).isNotNull()).groupBy(*segment, at.alias("b")).agg(F.count(F.lit(1)).alias("k"))
    held = counts.groupBy(*segment).agg(F.map_from_entries(F.collect_list(F.struct("b", "k"))).alias("m"), F.sum("k").alias("n"))
    shares = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("n"))
    return held.select(*segment, shares.alias("descriptor"))


def clip_score(df: DataFrame, keys: Sequence[str], value: str, lower: float = 1.0, upper: float = 99.0) -> DataFrame:
    """Values cut to two percentiles of their group, less the mean of what is cut, over its deviation.

    Groups whose cut values are all equal get 0.  Null values stay null and count nowhere; rows of a null group are
    left out.  No group is gathered in a task, and cells aren't shuffled while groups are few."""
    ends = exact_percentiles(df, list(keys), value, [lower / 100, upper / 100])
    cut = df.dropna(subset=list(keys)).join(ends, list(keys), "left").withColumn(value, F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), F.get("e__", F.lit(0))), F.get("e__", F.lit(1)))))
    stats = saved(cut.groupBy(*keys).agg(F.avg(value).alias("m__"), F.stddev_pop(value).alias("s__")))
    score = F.when(F.col("s__") > 0, (F.col(value) - F.col("m__")) / F.col("s__")).when(F.col(value).isNotNull(), F.lit(0.0))
    return cut.join(stats, list(keys)).withColumn(value, score).drop("e__", "m__", "s__")


def robust_range(df: DataFrame, keys: Sequence[str], value: str, lower: float = 1.0, upper: float = 99.0) -> DataFrame:
    """Two percentiles of each group, or its least and greatest value where those are equal."""
    ends = exact_percentiles(df, list(keys), value, [lower / 100, upper / 100]).select(*[F.col(k).alias(f"{k}__") for k in keys], F.col("e__").alias("e"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}__"))
    found = df.groupBy(*keys).agg(F.min(value).alias("a"), F.max(value).alias("b")).join(ends, on, "left")
    flat = F.get("e", F.lit(1)) <= F.get("e", F.lit(0))
    return found.select(*keys, F.when(flat, F.col("a")).otherwise(F.get("e", F.lit(0))).alias("low"), F.when(flat, F.col("b")).otherwise(F.get("e", F.lit(1))).alias("high"))


def weight_table(text: str | None) -> dict[int, float]:
    """``"1:0.5, 2:0.8"`` as a table; a key given twice is an error, empty text an empty table."""
    table: dict[int, float] = {}
    for part in filter(None, (p.strip() for p in (text or "").split(","))):
        key, colon, value = part.partition(":")
        if not colon:
            raise ValueError(f"{part!r} isn't of the form number:weight")
        if int(key) in table:
            raise ValueError(f"{int(key)} is given twice")
        table[int(key)] = float(value)
    return table


def agreement_weight(count: Column, table: dict[int, float], sure: int = 255, sure_weight: float = 1.0) -> Column:
    """Weight of a cell by how many sources agree on its label: the table's, ``sure_weight`` for the mark of a
    known label, else 0."""
    weight = F.when(count == sure, F.lit(float(sure_weight)))
    for k, v in table.items():
        weight = weight.when(count == k, F.lit(float(v)))
    return weight.otherwise(F.lit(0.0))


def balanced_weight(df: DataFrame, keys: Sequence[str], count: str, shares: dict[int, float], sure: int = 255, sure_weight: float = 1.0, fallback: dict[int, float] | None = None, name: str = "weight") -> DataFrame:
    """Weights by which all cells of a count together weigh ``shares[count]`` times those of known labels.

    Where a group holds none of either, ``fallback`` says the weight (0 if it doesn't)."""
    n = lambda k: F.sum((F.col(count) == k).cast("long")).alias(f"n{k}__")
    sums = df.groupBy(*keys).agg(n(sure), *[n(k) for k in shares])
    weight = F.when(F.col(count) == sure, F.lit(float(sure_weight)))
    for k, share in shares.items():
        balanced = F.lit(sure_weight * share) * F.col(f"n{sure}__") / F.nullif(F.col(f"n{k}__"), F.lit(0))
        weight = weight.when(F.col(count) == k, F.when(F.col(f"n{sure}__") > 0, balanced).otherwise(F.lit(float((fallback or {}).get(k, 0.0)))))
    return df.join(sums, list(keys)).withColumn(name, weight.otherwise(F.lit(0.0))).drop(f"n{sure}__", *[f"n{k}__" for k in shares])


def source_shares(df: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """Cells of each label source (or count of agreement) and their share of the group's cells."""
    counts = df.groupBy(*keys, source).agg(F.count(F.lit(1)).alias("cells"))
    if not keys:
        total = counts.agg(F.sum("cells").alias("all__"))
        both = counts.crossJoin(total)  # one row
    else:
        both = counts.join(counts.groupBy(*keys).agg(F.sum("cells").alias("all__")), list(keys))
    return both.withColumn("share", F.col("cells") / F.col("all__")).drop("all__")


def error_cells(df: DataFrame, pred: str, truth: str, ignore: int | None = None, name: str = "wrong") -> DataFrame:
    """Whether a cell's predicted class is another than the true one; null where the truth is ``ignore`` or null."""
    counted = F.col(truth).isNotNull() if ignore is None else F.col(truth) != ignore
    return df.withColumn(name, F.when(counted, ~F.col(pred).eqNullSafe(F.col(truth))))
