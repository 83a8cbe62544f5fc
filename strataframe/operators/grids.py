"""Grids kept as long tables, one row a cell: components, exact distances and bands.

``cells`` have a case and whole coordinates, one column an axis.  Units of work are blocks and lines of a
grid, never a case."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from strataframe.core.components import components
from strataframe.core.storage import saved, whole_groups


#: Lines of at most this many cells are swept together, each cell against each of its line.
SHORT = 64
#: Places of blocks that a task solves together.
TOGETHER = 1 << 21


def steps(n_axes: int, full: bool) -> list[tuple[int, ...]]:
    """Half of the steps to neighbouring cells: the other half are their opposites."""
    every = np.stack(np.meshgrid(*[[-1, 0, 1]] * n_axes, indexing="ij"), -1).reshape(-1, n_axes)
    return [tuple(map(int, s)) for s in every if tuple(s) > (0,) * n_axes and (full or abs(s).sum() == 1)]


def _block_components(side: int, axes: Sequence[str], full: bool, key: list[str]):
    """A function from the cells of whole blocks to their local components, named by their least cell's number.

    Blocks of one frame are solved together, side by side in one array."""

    def solve(frame: pd.DataFrame, block: np.ndarray) -> pd.DataFrame:
        at = frame[list(axes)].to_numpy() % side
        where = np.full((block[-1] - block[0] + 1,) + (side,) * len(axes), -1)
        block = block - block[0]
        where[(block, *at.T)] = np.arange(len(frame))
        value = pd.factorize(frame["label__"])[0]
        one, other = [], []
        for step in steps(len(axes), full):
            moved = at + np.array(step)
            inside = ((moved >= 0) & (moved < side)).all(1)
            there = where[(block[inside], *moved[inside].T)]
            here = np.flatnonzero(inside)[there >= 0]
            there = there[there >= 0]
            alike = value[here] == value[there]
            one.append(here[alike])
            other.append(there[alike])
        a, b = np.concatenate(one), np.concatenate(other)
        up = np.arange(len(frame))
        while True:
            low = np.minimum(up[a], up[b])
            new = up.copy()
            np.minimum.at(new, up[a], low)
            np.minimum.at(new, up[b], low)
            new = new[new]
            if (new == up).all():
                break
            up = new
        number = frame["number__"].to_numpy()
        least = np.full(len(frame), np.iinfo(np.int64).max)
        np.minimum.at(least, up, number)
        return frame.assign(local__=least[up])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = max(1, TOGETHER // side ** len(axes))
        for frame in whole_groups(frames, key):
            # Cells are sorted by block, so blocks are numbered in order.
            block = frame.groupby(key, sort=False, dropna=False).ngroup().to_numpy()
            for first in range(0, block[-1] + 1, most):
                a, b = np.searchsorted(block, (first, first + most))
                yield solve(frame.iloc[a:b], block[a:b]).drop(columns=key[1:])

    return run


def grid_components(cells: DataFrame, case: str, axes: Sequence[str], label: str, full: bool = False, side: int = 32) -> DataFrame:
    """``cells`` and ``component``: the number of the least cell that each is connected with by cells of its label.

    Neighbours share a face (``full``: or an edge or corner).  Cells are numbered in axis order within the
    extent of the whole table.  Blocks of ``side`` cells an axis are solved whole, many in a task; then only cells at
    block borders meet their neighbours across, and the components of those pairs are joined back.  Cells
    with a null label belong to no component; repeated cells aren't allowed.  An empty table gives no rows."""
    axes = list(axes)
    extent = cells.agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("low", F.min), ("high", F.max))]).first()
    low = {a: extent[f"low_{a}"] or 0 for a in axes}
    size = {a: (extent[f"high_{a}"] or 0) - low[a] + 1 for a in axes}
    if np.prod([float(s) for s in size.values()]) >= 2**62:
        raise ValueError("the grid's extent has no 62-bit numbers")
    number = F.lit(0).cast("long")
    for a in axes:
        number = number * F.lit(size[a]) + (F.col(a) - F.lit(low[a]))
    known = cells.where(F.col(label).isNotNull()).select(F.col(case).alias("case__"), *[F.col(a).cast("long").alias(a) for a in axes], F.col(label).alias("label__"), number.cast("long").alias("number__"))
    block = [F.floor(F.col(a) / side).cast("long").alias(f"b{i}__") for i, a in enumerate(axes)]
    schema, key = StructType([*known.schema.fields, StructField("local__", LongType())]), ["case__", *[f"b{i}__" for i in range(len(axes))]]
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = known.select("*", *block).repartition(tasks, *key).sortWithinPartitions(*key)
    local = saved(blocks.mapInPandas(_block_components(side, axes, full, key), schema))

    at_border = F.lit(False)
    for a in axes:
        at_border = at_border | (F.pmod(F.col(a), F.lit(side)).isin(0, side - 1))
    border = local.where(at_border).select("case__", "label__", "local__", *axes)
    moved = border.withColumn("step", F.explode(F.array(*[F.array(*map(F.lit, s)) for s in steps(len(axes), full)])))
    moved = moved.select("case__", "label__", F.col("local__").alias("from__"), *[(F.col(a) + F.get("step", F.lit(i))).alias(a) for i, a in enumerate(axes)])
    met = moved.join(border, ["case__", "label__", *axes]).where("from__ <> local__").select("case__", "from__", "local__").distinct()
    end = lambda n: F.struct("case__", F.col(n).alias("n"))
    joined = components(met.select(end("from__").alias("a"), end("local__").alias("b")))
    roots = joined.select(F.col("node.case__").alias("case__"), F.col("node.n").alias("local__"), F.col("component.n").alias("least__"))
    found = local.join(roots, ["case__", "local__"], "left").select("case__", *axes, F.coalesce("least__", "local__").alias("component"))
    key = [F.col(f"cells.{case}").eqNullSafe(F.col("found.case__")), *[F.col(f"cells.{a}") == F.col(f"found.{a}") for a in axes]]
    on = key[0]
    for k in key[1:]:
        on = on & k
    return cells.alias("cells").join(found.alias("found"), on, "left").select("cells.*", "found.component")


def component_shapes(found: DataFrame, case: str, axes: Sequence[str], label: str) -> DataFrame:
    """One row a component of ``grid_components``: number of cells, and length of its bounding box along each axis."""
    lengths = [(F.max(a) - F.min(a) + 1).alias(f"{a}_length") for a in axes]
    return found.where("component is not null").groupBy(case, label, "component").agg(F.count(F.lit(1)).alias("n_cells"), *lengths)


def largest_components(found: DataFrame, case: str, label: str, count: int = 1) -> DataFrame:
    """Cells of the ``count`` largest components of each case and label; equal sizes fall to the lesser number.

    Sizes are counted first, so what is ranked is one row a component."""
    sizes = found.where("component is not null").groupBy(case, label, "component").agg(F.count(F.lit(1)).alias("n__"))
    place = F.row_number().over(Window.partitionBy(case, label).orderBy(F.desc("n__"), "component"))
    best = sizes.withColumn("place__", place).where(F.col("place__") <= count)
    same = F.col("f.component") == F.col("b.component")
    for c in (case, label):
        same = same & F.col(f"f.{c}").eqNullSafe(F.col(f"b.{c}"))
    return found.alias("f").join(best.alias("b"), same, "left_semi")


def lower_envelope(at: np.ndarray, height: np.ndarray, weight: float) -> np.ndarray:
    """min over j of weight * (at[i] - at[j])**2 + height[j], for sorted ``at``; infinite heights count for nothing."""
    some = np.flatnonzero(np.isfinite(height))
    if not len(some):
        return np.full(len(at), np.inf)
    xs, fs = (weight**0.5 * at[some]).tolist(), height[some].tolist()
    kept, border = [0], [-np.inf]
    for j in range(1, len(xs)):
        while True:
            i = kept[-1]
            meet = ((fs[j] + xs[j] * xs[j]) - (fs[i] + xs[i] * xs[i])) / (2 * (xs[j] - xs[i]))
            if meet > border[-1]:
                break
            kept.pop()
            border.pop()
        kept.append(j)
        border.append(meet)
    own = some[np.array(kept)[np.searchsorted(border, weight**0.5 * at, side="right") - 1]]
    return weight * (at - at[own]) ** 2 + height[own]


def _lines(frames: Iterator[pd.DataFrame], key: list[str], axis: str, weight: float) -> Iterator[pd.DataFrame]:
    """Whole lines out of sorted batches; a line that a batch cuts waits for the next one."""
    held: list[pd.DataFrame] = []

    def swept(frame: pd.DataFrame) -> pd.DataFrame:
        at, d2 = frame[axis].to_numpy(float), frame["d2"].to_numpy(float)
        new = (frame[key] != frame[key].shift()).any(axis=1).to_numpy()
        ends = np.append(np.flatnonzero(new), len(frame))
        lengths, out = np.diff(ends), np.empty(len(frame))
        for n in np.unique(lengths):
            begins = ends[:-1][lengths == n]
            if n > SHORT:
                for a in begins:
                    out[a : a + n] = lower_envelope(at[a : a + n], d2[a : a + n], weight)
                continue
            rows = begins[:, None] + np.arange(n)
            x, height, best = at[rows], d2[rows], np.full(rows.shape, np.inf)
            for j in range(n):
                best = np.minimum(best, weight * (x - x[:, j : j + 1]) ** 2 + height[:, j : j + 1])
            out[rows] = best
        return frame.assign(d2=out)

    for frame in frames:
        if not len(frame):
            continue
        last = (frame[key] == frame[key].iloc[-1]).all(axis=1).to_numpy()
        if held and not (held[-1][key].iloc[-1] == frame[key].iloc[0]).all():
            yield swept(pd.concat(held))
            held = []
        if last.all():
            held.append(frame)
            continue
        yield swept(pd.concat([*held, frame[~last]]))
        held = [frame[last]]
    if held:
        yield swept(pd.concat(held))


def distance_transform(cells: DataFrame, case: str, axes: Sequence[str], source: Column, spacing: Sequence[float] | None = None) -> DataFrame:
    """``cells`` and ``d2``: the exact squared distance of each cell to the nearest cell where ``source`` holds.

    Cases are dense boxes of cells without holes or repeats, which is checked by counts.  Along the first axis
    the nearest source before and behind is found by windows over lines; each further axis takes the lower
    envelope of parabolas over the lines along it.  A line, keyed by the case and the other coordinates, is
    the unit of work, and each axis costs one exchange of the table.  ``spacing`` is a cell's size along each
    axis.  In a case without a source d2 is infinite; a null source is none."""
    axes, spacing = list(axes), list(spacing or [1.0] * len(axes))
    whole = cells.groupBy(case).agg(F.count(F.lit(1)).alias("n"), *[(F.max(a) - F.min(a) + 1).alias(f"n_{a}") for a in axes])
    volume = F.lit(1)
    for a in axes:
        volume = volume * F.col(f"n_{a}")
    if not whole.where(F.col("n") != volume).isEmpty():
        raise ValueError("distance_transform needs dense boxes of cells: some are missing or repeated")
    first, weight = axes[0], spacing[0] * spacing[0]
    line = Window.partitionBy(case, *axes[1:]).orderBy(first)
    place = F.when(F.coalesce(source, F.lit(False)), F.col(first))
    back = Window.partitionBy(case, *axes[1:]).orderBy(F.desc(first))
    before = F.last(place, True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    # Read from the end: a frame up to the end of a line would be gone through anew for each of its rows.
    behind = F.last(place, True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    nearest = F.least(F.col(first) - before, behind - F.col(first)).cast("double")
    now = cells.withColumn("d2", F.coalesce(nearest * nearest * weight, F.lit(float("inf"))))
    for axis, size in zip(axes[1:], spacing[1:], strict=True):
        key = [case, *[a for a in axes if a != axis]]
        schema = StructType([StructField(f.name, DoubleType() if f.name == "d2" else f.dataType) for f in now.schema.fields])
        dealt = now.repartition(*key).sortWithinPartitions(*key, axis)
        now = dealt.mapInPandas(lambda frames, key=key, axis=axis, size=size: _lines(frames, key, axis, size * size), schema)
    return now


def face_neighbours(cells: DataFrame, case: str, axes: Sequence[str], value: str) -> DataFrame:
    """Each cell with ``n_alike``, the number of face neighbours where boolean ``value`` holds too; neighbours outside count as unlike."""
    axes = list(axes)
    total = F.lit(0)
    for a in axes:
        line = Window.partitionBy(case, *[x for x in axes if x != a]).orderBy(a)
        for shift in (F.lag, F.lead):
            near = F.abs(shift(a).over(line) - F.col(a)) == 1
            total = total + F.when(near & shift(value).over(line), 1).otherwise(0)
    return cells.withColumn("n_alike", total)


def boundary_cells(cells: DataFrame, case: str, axes: Sequence[str], inside: Column) -> DataFrame:
    """``cells`` and boolean ``boundary``: inside, with a face neighbour that is outside or beyond the grid."""
    marked = face_neighbours(cells.withColumn("inside__", F.coalesce(inside, F.lit(False))), case, axes, "inside__")
    return marked.withColumn("boundary", F.col("inside__") & (F.col("n_alike") < 2 * len(list(axes)))).drop("inside__", "n_alike")


def boundary_band(cells: DataFrame, case: str, axes: Sequence[str], inside: Column, radius: float) -> DataFrame:
    """``cells`` with d2, the squared distance to the boundary, and ``band``: whether that's at most ``radius`` squared.

    Without anything inside a case has no band."""
    far = distance_transform(boundary_cells(cells, case, axes, inside), case, axes, F.col("boundary"))
    return far.withColumn("band", F.col("d2") <= radius * radius)


def outer_background(cells: DataFrame, case: str, axes: Sequence[str], inside: Column, background: Column, least: float) -> DataFrame:
    """``cells`` with d2, the squared distance to what is inside, and ``outer``: background at a distance of at least ``least``.

    In a case with nothing inside all background is outer."""
    far = distance_transform(cells, case, axes, inside)
    return far.withColumn("outer", F.coalesce(background, F.lit(False)) & (F.col("d2") >= least * least))


def _kept_by_component(cells: DataFrame, found: DataFrame, case: str, keep: Column, groups: list[Column], name: str) -> DataFrame:
    """``found`` and ``name``: whether its component passes ``keep``, a column over the aggregates ``groups``."""
    each = found.where("component is not null").groupBy(F.col(case).alias("case__"), "label__", F.col("component").alias("component__")).agg(*groups).where(keep)
    on = F.col(case).eqNullSafe(F.col("case__")) & (F.col("label__") == F.col("l__")) & (F.col("component") == F.col("component__"))
    chosen = each.select("case__", F.col("label__").alias("l__"), "component__", F.lit(True).alias(name))
    return found.join(chosen, on, "left").select(*cells.columns, F.coalesce(name, F.lit(False)).alias(name))


def small_objects(cells: DataFrame, case: str, axes: Sequence[str], label: str, least: int, full: bool = False, side: int = 32) -> DataFrame:
    """``cells`` and boolean ``small``: whether a cell's component of its label has fewer than ``least`` cells.

    Labels of zero and null are background, which is never small."""
    mine = cells.withColumn("label__", F.when(F.col(label) != 0, F.col(label)))
    found = grid_components(mine, case, axes, "label__", full, side)
    return _kept_by_component(cells, found, case, F.col("n__") < least, [F.count(F.lit(1)).alias("n__")], "small")


def holes(cells: DataFrame, case: str, axes: Sequence[str], inside: Column, side: int = 32) -> DataFrame:
    """``cells`` and boolean ``hole``: outside, in a component of outside cells that doesn't reach its case's extent.

    Outside cells are connected over faces.  Each case is a box; cells that are missing count as walls."""
    axes = list(axes)
    mine = cells.withColumn("label__", F.when(~F.coalesce(inside, F.lit(False)), 0))
    found = grid_components(mine, case, axes, "label__", False, side)
    extent = cells.groupBy(F.col(case).alias("e__")).agg(*[f(a).alias(f"{n}_{a}__") for a in axes for n, f in (("low", F.min), ("high", F.max))])
    ends = F.lit(False)
    for a in axes:
        ends = ends | (F.col(a) == F.col(f"low_{a}__")) | (F.col(a) == F.col(f"high_{a}__"))
    marked = found.join(extent, F.col(case).eqNullSafe(F.col("e__"))).withColumn("end__", ends)
    return _kept_by_component(cells, marked, case, ~F.col("ends__"), [F.bool_or("end__").alias("ends__")], "hole")


def surface_metrics(cells: DataFrame, case: str, axes: Sequence[str], pred: Column, truth: Column, spacing: Sequence[float] | None = None, tolerance: float = 1.0, percent: float = 95.0) -> DataFrame:
    """Distances between the surfaces of two masks: one row a case of dense ``cells``.

    ``n_pred`` and ``n_truth`` are cells of the surfaces (inside, with a face neighbour outside or beyond the grid).
    ``average`` is the mean distance from the predicted surface to the true one, ``average_both`` that of both
    directions together, ``hausdorff`` the greatest of either direction, ``hausdorff_percent`` the greater of their
    percentiles, ``surface_dice`` the part of both surfaces that lies within ``tolerance`` of the other.  Without
    a predicted surface averages are null, without any surface all are; against an empty one distances
    are infinite.  Distances come from two exact transforms, line by line; a case is only ever aggregated."""
    axes = list(axes)
    now = boundary_cells(cells.withColumns({"p__": F.coalesce(pred, F.lit(False)), "t__": F.coalesce(truth, F.lit(False))}).select(case, *axes, "p__", "t__"), case, axes, F.col("p__")).withColumnRenamed("boundary", "pe__")
    now = boundary_cells(now, case, axes, F.col("t__")).withColumnRenamed("boundary", "te__").drop("p__", "t__")
    now = distance_transform(now, case, axes, F.col("te__"), spacing).withColumnRenamed("d2", "to_t__")
    now = distance_transform(now, case, axes, F.col("pe__"), spacing).withColumnRenamed("d2", "to_p__")
    far_p, far_t = F.when(F.col("pe__"), F.sqrt("to_t__")), F.when(F.col("te__"), F.sqrt("to_p__"))
    at = F.lit(percent / 100)
    sums = now.groupBy(case).agg(
        F.count_if("pe__").alias("n_pred"), F.count_if("te__").alias("n_truth"), F.sum(far_p).alias("sp"), F.sum(far_t).alias("st"), F.max(far_p).alias("mp"), F.max(far_t).alias("mt"),
        F.percentile(far_p, at).alias("qp"), F.percentile(far_t, at).alias("qt"), F.count_if(far_p <= tolerance).alias("np"), F.count_if(far_t <= tolerance).alias("nt"),
    )
    both = F.col("n_pred") + F.col("n_truth")
    return sums.select(
        case, "n_pred", "n_truth", F.when(F.col("n_pred") > 0, F.col("sp") / F.col("n_pred")).alias("average"),
        F.when(both > 0, (F.coalesce("sp", F.lit(0.0)) + F.coalesce("st", F.lit(0.0))) / both).alias("average_both"), F.greatest("mp", "mt").alias("hausdorff"),
        F.greatest("qp", "qt").alias("hausdorff_percent"), F.when(both > 0, (F.col("np") + F.col("nt")) / both).alias("surface_dice"),
    )


def instance_table(found: DataFrame, case: str, axes: Sequence[str], kind: Column) -> DataFrame:
    """One row an instance of ``grid_components`` (case, component): its cells, the mean of each coordinate, its bounding
    box, and its kind: the most frequent ``kind`` but 0 and null (0 only if there's no other), the lesser of equal ones,
    with its share of the instance's cells."""
    axes = list(axes)
    rows = found.where("component is not null").withColumn("kind__", kind)
    own = rows.groupBy(case, "component").agg(F.count(F.lit(1)).alias("n_cells"), *[c for a in axes for c in (F.avg(a).alias(f"{a}_mean"), F.min(a).alias(f"{a}_low"), F.max(a).alias(f"{a}_high"))])
    votes = rows.groupBy(case, "component", "kind__").agg(F.count(F.lit(1)).alias("v__"))
    rank = F.struct(F.coalesce(F.col("kind__") != 0, F.lit(False)).cast("int").alias("real"), F.when(F.col("kind__").isNull(), 0).otherwise(1).alias("known"), F.col("v__").alias("v"), (-F.col("kind__")).alias("k"))
    won = votes.groupBy(case, "component").agg(F.max(F.struct(rank.alias("rank"), F.col("kind__").alias("kind"), F.col("v__").alias("v"))).alias("won"))
    on = F.col("o.component").eqNullSafe(F.col("w.component")) & F.col(f"o.{case}").eqNullSafe(F.col(f"w.{case}"))
    return own.alias("o").join(won.alias("w"), on).select("o.*", F.col("won.kind").alias("kind"), (F.col("won.v") / F.col("n_cells")).alias("kind_share"))


def slices_with(cells: DataFrame, case: str, axis: str, label: str) -> DataFrame:
    """(case, label, axis): the slices along an axis that hold each label but 0, with its number of cells there."""
    some = cells.where(F.col(label) != 0)
    return some.groupBy(case, label, axis).agg(F.count(F.lit(1)).alias("n_cells"))
