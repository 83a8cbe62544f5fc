"""Sparse supervision of labelled grids kept as long tables: what to label, how far it reaches, how good it is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.core.storage import saved, with_row_index
from strataframe.operators.crops import _placed, extents
from strataframe.operators.grids import boundary_cells
from strataframe.operators.partition import hash_order, round_robin


def center_fit(cells: DataFrame, case: str, axes: Sequence[str], size: Sequence[int], fill: dict[str, object] | None = None) -> DataFrame:
    """Every case brought to ``size`` about its middle: what is too long is cut, (n - s) // 2 cells in front, what is too
    short is filled, (s - n) // 2 cells in front, with ``fill`` of each column or null."""
    axes, fill = list(axes), dict(fill or {})
    lead = {a: (F.greatest(F.floor((F.lit(s) - F.col(f"n_{a}")) / 2), F.lit(0)) - F.greatest(F.floor((F.col(f"n_{a}") - s) / 2), F.lit(0))).cast("long") for a, s in zip(axes, size, strict=True)}
    placed = _placed(cells, case, axes)
    inside = F.lit(True)
    for a, s in zip(axes, size, strict=True):
        inside = inside & (F.col(a) + lead[a]).between(0, s - 1)
    kept = placed.where(inside).select(*[(F.col(c) + lead[c]).alias(c) if c in axes else F.col(c) for c in cells.columns])
    box = extents(cells, case, axes)
    held = F.lit(True)
    for a, s in zip(axes, size, strict=True):
        box = box.withColumn(f"at_{a}", F.explode(F.sequence(F.lit(0), F.lit(s - 1)).cast("array<long>")))
        held = held & (F.col(f"at_{a}") - lead[a]).between(F.lit(0), F.col(f"n_{a}") - 1)
    values = {c: F.lit(fill.get(c)).cast(cells.schema[c].dataType) for c in cells.columns} | {case: F.col("case__")} | {a: F.col(f"at_{a}") for a in axes}
    return kept.unionByName(box.where(~held).select(*[values[c].alias(c) for c in cells.columns]))


def class_scores(cells: DataFrame, case: str, pred: str, truth: str, classes: Sequence[int], ignore: int | None = None) -> DataFrame:
    """(case, class, n_pred, n_truth, n_both, dice, iou, recall): agreement of two labels, one row a case and class.

    Cells whose truth is null or ``ignore`` don't count.  A class that stands in neither has dice and iou 1 and no
    recall.  One pass with a few sums a class, made where cells are read."""
    known = cells.where(F.col(truth).isNotNull() if ignore is None else F.col(truth) != ignore)
    sums = []
    for c in classes:
        p, t = F.coalesce(F.col(pred) == c, F.lit(False)), F.col(truth) == c
        sums.append(F.struct(F.lit(c).alias("class"), F.count_if(p).alias("n_pred"), F.count_if(t).alias("n_truth"), F.count_if(p & t).alias("n_both")))
    each = known.groupBy(case).agg(F.array(*sums).alias("all")).select(case, F.explode("all").alias("s")).select(case, "s.*")
    either = F.col("n_pred") + F.col("n_truth")
    dice = F.when(either > 0, 2 * F.col("n_both") / either).otherwise(1.0)
    iou = F.when(either > 0, F.col("n_both") / (either - F.col("n_both"))).otherwise(1.0)
    return each.withColumns({"dice": dice, "iou": iou, "recall": F.when(F.col("n_truth") > 0, F.col("n_both") / F.col("n_truth"))})


def propagated_scores(cells: DataFrame, case: str, pred: str, truth: str, classes: Sequence[int], background: int = 0) -> DataFrame:
    """(case, accuracy, coverage, dice_foreground, dice_all): overall scores of labels that were spread.

    ``coverage`` is the share of cells with a label that isn't negative or null, ``accuracy`` of those that agree."""
    overall = cells.groupBy(F.col(case).alias("case__")).agg(F.avg(F.coalesce(F.col(pred) == F.col(truth), F.lit(False)).cast("double")).alias("accuracy"), F.avg(F.coalesce(F.col(pred) >= 0, F.lit(False)).cast("double")).alias("coverage"))
    dice = class_scores(cells, case, pred, truth, classes).groupBy(case).agg(F.avg(F.when(F.col("class") != background, F.col("dice"))).alias("dice_foreground"), F.avg("dice").alias("dice_all"))
    return dice.join(overall, F.col(case).eqNullSafe(F.col("case__"))).select(case, "accuracy", "coverage", "dice_foreground", "dice_all")


def segment_votes(cells: DataFrame, case: str, segment: str, label: str, voters: Column | None = None, ignore: int | None = None) -> DataFrame:
    """(case, segment, label, votes, share): the most frequent label among a segment's voters, the lesser of equal ones.

    Voters are all cells, or those where ``voters`` holds (seeds); null and ``ignore`` don't vote; a segment
    without votes has no row."""
    able = F.col(label).isNotNull() & (F.lit(True) if voters is None else F.coalesce(voters, F.lit(False)))
    if ignore is not None:
        able = able & (F.col(label) != ignore)
    counts = cells.where(able).groupBy(case, segment, label).agg(F.count(F.lit(1)).alias("v"))
    best = counts.groupBy(case, segment).agg(F.min(F.struct((-F.col("v")).alias("v"), F.col(label).alias("l"))).alias("b"), F.sum("v").alias("all"))
    return best.select(case, segment, F.col("b.l").alias(label), (-F.col("b.v")).alias("votes"), (-F.col("b.v") / F.col("all")).alias("share"))


def fill_segments(cells: DataFrame, case: str, segment: str, votes: DataFrame, label: str, name: str, empty: int = 0) -> DataFrame:
    """``cells`` and ``name``: the label that its segment was voted, ``empty`` without one: flags of segments made dense."""
    won = votes.select(F.col(case).alias("c__"), F.col(segment).alias("s__"), F.col(label).alias("l__"))
    on = F.col(case).eqNullSafe(F.col("c__")) & F.col(segment).eqNullSafe(F.col("s__"))
    return cells.join(won, on, "left").withColumn(name, F.coalesce("l__", F.lit(empty))).drop("c__", "s__", "l__")


def supervised_by_slices(cells: DataFrame, case: str, axes: Sequence[str], foreground: Column, ratio: float | None = None, count: int | None = None) -> DataFrame:
    """``cells`` and boolean ``supervised``: within one of the best slices along any of ``axes``.

    Along each axis the ``count`` slices with most foreground are taken, or ceil(ratio * length) of them, one at least;
    equal ones fall to the lower.  Slices are counted first, so what is ranked is one row a slice."""
    marked = cells.withColumn("supervised", F.lit(False))
    for a in axes:
        sums = cells.groupBy(F.col(case).alias("c__"), F.col(a).alias("a__")).agg(F.count_if(F.coalesce(foreground, F.lit(False))).alias("n__"))
        own = Window.partitionBy("c__")
        wanted = F.lit(count) if count else F.greatest(F.ceil(F.lit(ratio) * F.count(F.lit(1)).over(own)), F.lit(1))
        best = sums.withColumn("w__", wanted).withColumn("p__", F.row_number().over(own.orderBy(F.desc("n__"), "a__"))).where("p__ <= w__").select("c__", "a__", F.lit(True).alias("hit__"))
        on = F.col(case).eqNullSafe(F.col("c__")) & (F.col(a) == F.col("a__"))
        marked = marked.join(best, on, "left").withColumn("supervised", F.col("supervised") | F.coalesce("hit__", F.lit(False))).drop("c__", "a__", "hit__")
    return marked


def slice_scores(cells: DataFrame, case: str, axes: Sequence[str], label: str, classes: Sequence[int], ignore: int | None, weights: tuple[float, float, float]) -> DataFrame:
    """(case, axis, place, foreground, boundary, rarity, score): one row a slice along any axis.

    ``foreground`` is the share of its cells in ``classes``, ``boundary`` of those with a neighbour within the slice that
    isn't or lies beyond it, ``rarity`` the sum over its classes of 1 / sqrt(share of that class in all foreground), as
    a part of the sum over all classes.  The score adds them by ``weights`` (boundary, foreground, rarity)."""
    axes = list(axes)
    inside = F.col(label).isin(list(classes))
    base = cells.select(case, *axes, label).withColumn("in__", F.coalesce(inside, F.lit(False)))
    total = base.agg(*[F.count_if(F.col(label) == c).alias(f"k{c}") for c in classes]).first()
    counts = {c: total[f"k{c}"] for c in classes}
    rare = {c: (sum(counts.values()) / n) ** 0.5 if n else 0.0 for c, n in counts.items()}
    most = sum(rare.values())
    parts = []
    for a in axes:
        others = [x for x in axes if x != a]
        # Within a slice the grid has one axis less; the slice's own place joins the case in the key.
        sliced = base.withColumn("key__", F.struct(case, a))
        edged = boundary_cells(sliced, "key__", others, F.col("in__"))
        seen = F.lit(0.0)
        for c in classes:
            seen = seen + F.when(F.count_if(F.col(label) == c) > 0, rare[c]).otherwise(0.0)
        n = F.count(F.lit(1))
        rarity = seen / most if most else F.lit(0.0)
        parts.append(edged.groupBy(case, F.lit(a).alias("axis"), F.col(a).alias("place")).agg((F.count_if("in__") / n).alias("foreground"), (F.count_if("boundary") / n).alias("boundary"), rarity.alias("rarity")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    w_boundary, w_foreground, w_rarity = weights
    return every.withColumn("score", w_boundary * F.col("boundary") + w_foreground * F.col("foreground") + w_rarity * F.col("rarity"))


def select_slices(scores: DataFrame, case: str, share: float, gap: int = 0, most_each: int | None = None) -> DataFrame:
    """The best slices of ``scores(case, axis, place, score)``, ``share`` of all of them, one at least, with their ``rank``.

    By falling score (ties by case, axis and place) a slice is taken unless one within ``gap`` places along the same
    axis of its case was, or its case already has ``most_each``.  Slices so close come from an equality join on
    buckets of places; they're thinned in rounds that give the sequential result; ranks come from ranges."""
    rows = saved(scores.select(case, "axis", "place", "score"))
    wanted = max(1, round(rows.count() * share))
    order = F.struct((-F.col("score")).alias("s"), F.col(case).alias("c"), "axis", "place")
    open_, taken = rows.withColumn("order__", order), None
    if gap > 0:
        wide = open_.select(F.col(case).alias("c__"), F.col("axis").alias("x__"), F.col("place").alias("p__"), F.col("order__").alias("o__")).withColumn("b__", F.explode(F.array(*[F.floor(F.col("p__") / gap) + i for i in (-1, 0, 1)])))
        near = open_.withColumn("q__", F.floor(F.col("place") / gap)).join(wide, F.col(case).eqNullSafe(F.col("c__")) & (F.col("axis") == F.col("x__")) & (F.col("q__") == F.col("b__")))
        pairs = saved(near.where((F.abs(F.col("place") - F.col("p__")) <= gap) & (F.col("order__") < F.col("o__"))).select(F.col("order__").alias("good"), F.col("o__").alias("bad")).distinct())
        while not pairs.isEmpty():
            stay = pairs.select("good").distinct().join(pairs.select(F.col("bad").alias("good")), "good", "left_anti")
            gone = saved(pairs.join(stay, "good", "left_semi").select(F.col("bad").alias("order__")).distinct())
            open_ = open_.join(gone, "order__", "left_anti")
            pairs = pairs.join(stay, "good", "left_anti")
            for end in ("good", "bad"):
                pairs = pairs.join(gone.select(F.col("order__").alias(end)), end, "left_anti")
            pairs = saved(pairs)
    taken = open_
    if most_each is not None:
        taken = taken.withColumn("r__", F.row_number().over(Window.partitionBy(case).orderBy("order__"))).where(F.col("r__") <= most_each).drop("r__")
    return with_row_index(taken, "order__", name="rank").where(F.col("rank") < wanted).drop("order__")


def seed_budgets(cells: DataFrame, case: str, label: str, classes: Sequence[int], total: int, background_share: float, uniform: bool = False, background: int = 0) -> DataFrame:
    """(case, label, budget): seeds of each class: floor(total * share) of the background, the rest by class.

    ``uniform``: as many of each class, one more for the first ones; else in proportion to their cells, what is left
    by falling size, ties by class.  All go to the background in a case without foreground."""
    n_back = int(total * min(max(background_share, 0.0), 0.9))
    rest, k = total - n_back, len(classes)
    sums = cells.groupBy(case).agg(*[F.count_if(F.col(label) == c).alias(f"n{c}") for c in classes])
    whole = F.lit(0)
    for c in classes:
        whole = whole + F.col(f"n{c}")
    if uniform:
        each = [F.lit(rest // k + (i < rest % k)) for i in range(k)]
    else:
        floors = {c: F.floor(F.lit(float(rest)) * (F.col(f"n{c}") / whole)).cast("int") for c in classes}
        spare = F.lit(rest)
        for c in classes:
            spare = spare - floors[c]
        each = []
        for i, c in enumerate(classes):
            before = F.lit(0)
            for j, o in enumerate(classes):
                ahead = (F.col(f"n{o}") >= F.col(f"n{c}")) if j < i else (F.col(f"n{o}") > F.col(f"n{c}"))
                before = before + ahead.cast("int")
            each.append(floors[c] + F.when(before < spare, 1).otherwise(0))
        each = [F.when(whole > 0, e).otherwise(0) for e in each]
    back = F.lit(n_back) if uniform else F.when(whole > 0, n_back).otherwise(total)
    rows = F.array(F.struct(F.lit(background).alias(label), back.alias("budget")), *[F.struct(F.lit(c).alias(label), e.alias("budget")) for c, e in zip(classes, each, strict=True)])
    return sums.select(case, F.explode(rows).alias("r")).select(case, F.col(f"r.{label}").alias(label), F.col("r.budget").cast("long").alias("budget"))


def point_seeds(cells: DataFrame, case: str, axes: Sequence[str], label: str, budgets: DataFrame, seed: int = 0) -> DataFrame:
    """The ``cells`` chosen as seeds: of each case and label as many as ``budgets(case, label, budget)`` says, by hash order.

    Places in that order come from ranges over the whole table, so no class of a case is one task's load."""
    have = cells.where(F.col(label).isNotNull()).join(budgets.where("budget > 0"), [case, label])
    ordered = with_row_index(have.withColumn("h__", hash_order(seed, case, *axes)), case, label, "h__", name="r__")
    first = ordered.groupBy(case, label).agg(F.min("r__").alias("f__"))
    return ordered.join(first, [case, label]).where(F.col("r__") - F.col("f__") < F.col("budget")).select(*[F.col(c) for c in cells.columns])


def dilated(cells: DataFrame, seeds: DataFrame, case: str, axes: Sequence[str], radius: int) -> DataFrame:
    """``cells`` and boolean ``supervised``: within ``radius`` cells of a seed along every axis, by shifted equality joins."""
    grown = seeds.select(F.col(case).alias("c__"), *axes)
    for a in axes:
        grown = grown.withColumn(a, F.explode(F.sequence(F.col(a) - radius, F.col(a) + radius)))
    grown = grown.distinct().select("c__", *[F.col(a).alias(f"{a}__") for a in axes], F.lit(True).alias("supervised"))
    on = F.col(case).eqNullSafe(F.col("c__"))
    for a in axes:
        on = on & (F.col(a) == F.col(f"{a}__"))
    return cells.join(grown, on, "left").select(*[F.col(c) for c in cells.columns], F.coalesce("supervised", F.lit(False)).alias("supervised"))


def masked_losses(rows: DataFrame, batch: str, logits: str, target: str, weight: Column, n_classes: int, ignore: int | None = None, eps: float = 1e-6) -> DataFrame:
    """(batch, dice_loss, cross_entropy) of scores ``logits`` (arrays) against ``target``, each row by its ``weight``.

    The soft dice of a class is (2 sum(w p t) + eps) / (sum(w p) + sum(w t) + eps), p being the softmax; the loss is one
    less the mean over classes.  Cross entropy is the weighted mean, 0 without any weight.  Rows with the target null
    or ``ignore``, or a null weight, don't count."""
    known = rows.where(F.col(target).isNotNull() if ignore is None else F.col(target) != ignore).withColumn("w__", weight.cast("double")).where("w__ is not null")
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))
    soft = known.withColumns({"z__": top.cast("double"), "e__": total})
    p = [F.exp(F.get(logits, F.lit(c)).cast("double") - F.col("z__")) / F.col("e__") for c in range(n_classes)]
    own = F.get(logits, F.col(target).cast("int")).cast("double")
    sums = [F.sum(F.col("w__") * (F.col("z__") + F.log("e__") - own)).alias("ce"), F.sum("w__").alias("w")]
    for c in range(n_classes):
        hit = (F.col(target) == c).cast("double")
        sums += [F.sum(F.col("w__") * p[c] * hit).alias(f"i{c}"), F.sum(F.col("w__") * (p[c] + hit)).alias(f"d{c}")]
    mean = F.lit(0.0)
    for c in range(n_classes):
        mean = mean + (2 * F.col(f"i{c}") + eps) / (F.col(f"d{c}") + eps)
    return soft.groupBy(batch).agg(*sums).select(batch, (1 - mean / n_classes).alias("dice_loss"), F.when(F.col("w") > 0, F.col("ce") / F.col("w")).otherwise(0.0).alias("cross_entropy"))


def source_ratio(rows: DataFrame, batch: str, source: Column, valid: Column | None = None, fallback: float = 1.0) -> DataFrame:
    """(batch, ratio): valid rows from the trusted source to the others; ``fallback`` where either has none."""
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    yes, no = F.count_if(ok & F.coalesce(source, F.lit(False))), F.count_if(ok & ~F.coalesce(source, F.lit(False)))
    return rows.groupBy(batch).agg(F.when((yes > 0) & (no > 0), yes / no).otherwise(fallback).alias("ratio"))


def cross_validation(df: DataFrame, k: int, train: Sequence[int], validation: Sequence[int], *order: str | Column) -> DataFrame:
    """Rows of the chosen ones of k folds, dealt in turn in the given order, with their ``fold`` and ``split``.

    A fold in both lists gives its rows twice, as two lists would."""
    part = F.when(F.col("part").isin(list(train)), F.array(F.lit("training"))).otherwise(F.expr("cast(array() as array<string>)"))
    more = F.when(F.col("part").isin(list(validation)), F.array(F.lit("validation"))).otherwise(F.expr("cast(array() as array<string>)"))
    dealt = round_robin(df, k, *order)
    return dealt.withColumn("split", F.explode(F.concat(part, more))).select(*df.columns, F.col("part").alias("fold"), "split")
