"""Crops, pads, flips and patches of grids kept as long tables: filters and arithmetic on coordinates.

``cells`` have a case and whole coordinates, one column an axis; each case is a box.  Coordinates of what is given
start at zero.  Extents are one row a case; nothing here holds a case."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.operators.partition import hash_unit


def extents(cells: DataFrame, case: str, axes: Sequence[str]) -> DataFrame:
    """(case__, low_a, n_a for each axis): where each case begins and how long it is."""
    return cells.groupBy(F.col(case).alias("case__")).agg(*[c for a in axes for c in (F.min(a).alias(f"low_{a}"), (F.max(a) - F.min(a) + 1).alias(f"n_{a}"))])


def _placed(cells: DataFrame, case: str, axes: Sequence[str]) -> DataFrame:
    """Cells with coordinates from zero and their case's lengths ``n_a``."""
    both = cells.join(extents(cells, case, axes), F.col(case).eqNullSafe(F.col("case__")))
    return both.withColumns({a: F.col(a) - F.col(f"low_{a}") for a in axes}).drop("case__", *[f"low_{a}" for a in axes])


def _cut(placed: DataFrame, columns: Sequence[str], axes: Sequence[str], start: Mapping[str, Column], size: Mapping[str, Column]) -> DataFrame:
    inside = F.lit(True)
    for a in axes:
        inside = inside & (F.col(a) >= start[a]) & (F.col(a) < start[a] + size[a])
    cut = placed.where(inside)
    return cut.select(*[(F.col(c) - start[c]).cast("long").alias(c) if c in axes else F.col(c) for c in columns])


def spatial_crop(cells: DataFrame, case: str, axes: Sequence[str], start: Sequence[int], end: Sequence[int]) -> DataFrame:
    """What lies in start <= coordinate < end; a start below zero is zero, an end before its start cuts all off."""
    at = {a: F.lit(max(s, 0)) for a, s in zip(axes, start, strict=True)}
    size = {a: F.lit(max(e - max(s, 0), 0)) for a, s, e in zip(axes, start, end, strict=True)}
    return _cut(_placed(cells, case, axes), cells.columns, axes, at, size)


def center_crop(cells: DataFrame, case: str, axes: Sequence[str], size: Sequence[int] | None = None, scale: Sequence[float] | None = None) -> DataFrame:
    """The middle of each case: of ``size`` cells, or of ``scale`` times its length rounded up, no more than it has.

    A crop of s of n cells begins at n // 2 - s // 2.  A size of zero or less keeps the axis."""
    placed = _placed(cells, case, axes)
    wanted = {}
    for i, a in enumerate(axes):
        n = F.col(f"n_{a}")
        one = F.ceil(n * scale[i]) if scale is not None else (F.lit(size[i]) if size[i] > 0 else n)
        wanted[a] = F.least(one, n).cast("long")
    start = {a: F.greatest(F.floor(F.col(f"n_{a}") / 2) - F.floor(wanted[a] / 2), F.lit(0)) for a in axes}
    return _cut(placed, cells.columns, axes, start, wanted)


def crop_foreground(cells: DataFrame, case: str, axes: Sequence[str], select: Column, margin: int = 0) -> DataFrame:
    """The smallest box of each case that holds all cells where ``select``, widened by ``margin`` but not beyond the case.

    A case without such a cell has no rows."""
    placed = _placed(cells, case, axes)
    lengths = [F.first(f"n_{a}").alias(f"n_{a}") for a in axes]
    boxes = placed.where(select).groupBy(F.col(case).alias("case__")).agg(*lengths, *[c for a in axes for c in (F.min(a).alias(f"from_{a}"), F.max(a).alias(f"to_{a}"))])
    start = {a: F.greatest(F.col(f"from_{a}") - margin, F.lit(0)) for a in axes}
    ends = {a: F.least(F.col(f"to_{a}") + margin, F.col(f"n_{a}") - 1) for a in axes}
    boxes = boxes.select("case__", *[start[a].alias(f"start_{a}") for a in axes], *[(ends[a] - start[a] + 1).alias(f"size_{a}") for a in axes])
    both = placed.join(boxes, F.col(case).eqNullSafe(F.col("case__")))
    return _cut(both, cells.columns, axes, {a: F.col(f"start_{a}") for a in axes}, {a: F.col(f"size_{a}") for a in axes})


def pad(cells: DataFrame, case: str, axes: Sequence[str], before: Sequence[int], after: Sequence[int], mode: str = "constant", fill: Mapping[str, object] | None = None) -> DataFrame:
    """Each case with ``before`` and ``after`` more cells along its axes; coordinates start at zero again.

    ``constant``: new cells hold ``fill`` of each column, null by default.  ``edge``, ``reflect`` (the border isn't
    repeated), ``symmetric`` (it is) and ``wrap`` copy the cell that the new place stands for, by an equality join on
    its coordinates.  New places are made from each case's lengths, without a pass over its cells."""
    if mode not in ("constant", "edge", "reflect", "symmetric", "wrap"):
        raise ValueError(f"unknown mode {mode!r}")
    axes, fill = list(axes), dict(fill or {})
    placed = _placed(cells, case, axes)
    shift = dict(zip(axes, before, strict=True))
    old = placed.select(*[(F.col(c) + shift[c]).cast("long").alias(c) if c in shift else F.col(c) for c in cells.columns])
    box = extents(cells, case, axes)
    for a, b, e in zip(axes, before, after, strict=True):
        box = box.withColumn(f"at_{a}", F.explode(F.sequence(F.lit(-b), F.col(f"n_{a}") - 1 + e)))
    inside = F.lit(True)
    for a in axes:
        inside = inside & F.col(f"at_{a}").between(F.lit(0), F.col(f"n_{a}") - 1)
    new = box.where(~inside)
    if mode == "constant":
        values = {c: F.lit(fill.get(c)).cast(cells.schema[c].dataType) for c in cells.columns}
        values |= {case: F.col("case__")} | {a: (F.col(f"at_{a}") + shift[a]).cast("long") for a in axes}
        return old.unionByName(new.select(*[values[c].alias(c) for c in cells.columns]))
    on = F.col(case).eqNullSafe(F.col("case__"))
    for a in axes:
        x, n = F.col(f"at_{a}"), F.col(f"n_{a}").cast("long")
        if mode == "edge":
            to = F.least(F.greatest(x, F.lit(0)), n - 1)
        elif mode == "wrap":
            to = F.pmod(x, n)
        elif mode == "symmetric":
            to = F.least(F.pmod(x, 2 * n), 2 * n - 1 - F.pmod(x, 2 * n))
        else:
            turn = F.greatest(2 * n - 2, F.lit(1))
            to = F.least(F.pmod(x, turn), turn - F.pmod(x, turn))
        new = new.withColumn(f"to_{a}", to.cast("long"))
        on = on & (F.col(a) == F.col(f"to_{a}"))
    there = placed.drop(*[f"n_{a}" for a in axes])
    made = new.join(there, on).select(*[(F.col(f"at_{c}") + shift[c]).cast("long").alias(c) if c in shift else F.col(c) for c in cells.columns])
    return old.unionByName(made)


def flip(cells: DataFrame, case: str, axes: Sequence[str], along: Sequence[str]) -> DataFrame:
    """Each case mirrored along some of its axes."""
    placed = _placed(cells, case, axes)
    return placed.select(*[(F.col(f"n_{c}") - 1 - F.col(c)).cast("long").alias(c) if c in along else F.col(c) for c in cells.columns])


def rotate90(cells: DataFrame, case: str, axes: Sequence[str], turns: int, plane: tuple[str, str]) -> DataFrame:
    """Each case turned by quarters in the plane of two axes, from the first towards the second."""
    placed, (a, b) = _placed(cells, case, axes), plane
    back = lambda c: F.col(f"n_{c}") - 1 - F.col(c)
    # A quarter turn takes what stood at (i, j) to (last of j - j, i).
    new = {0: (F.col(a), F.col(b)), 1: (back(b), F.col(a)), 2: (back(a), back(b)), 3: (F.col(b), back(a))}[turns % 4]
    moved = {a: new[0], b: new[1]}
    return placed.select(*[moved[c].cast("long").alias(c) if c in moved else F.col(c) for c in cells.columns])


def crop_centers(cells: DataFrame, case: str, axes: Sequence[str], kind: Column, chances: Mapping[object, float], count: int, size: Sequence[int], seed: int = 0, weight: Column | None = None) -> DataFrame:
    """(case, sample, kind, axes...): ``count`` centres of crops for each case, drawn by kind of cell.

    A sample first draws one of ``chances`` (kind -> weight) among the kinds that the case has, then one cell of
    that kind: all alike, or by ``weight`` if given.  The cell is the one of least -ln(u) / weight, u being its hash
    by seed, sample and place, found by a minimum that starts where cells are read.  Centres are then moved so
    far inwards that a crop of ``size`` lies within its case where it can.  A case without any such cell has no
    rows; null and negative weights are never drawn; reruns agree."""
    axes = list(axes)
    placed = _placed(cells, case, axes)
    names = list(chances)
    number = F.lit(None).cast("int")
    for i, name in enumerate(names):
        number = F.when(kind == F.lit(name), i).otherwise(number)
    heavy = F.lit(1.0) if weight is None else weight.cast("double")
    some = placed.withColumns({"kind__": number, "w__": heavy}).where("kind__ is not null and w__ > 0")
    each = some.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    unit = hash_unit(seed, F.col("sample"), F.coalesce(F.col(case).cast("string"), F.lit("null")), *axes) + 2.0**-53
    pick = F.struct((-F.log(unit) / F.col("w__")).alias("k"), *axes, *[f"n_{a}" for a in axes])
    best = each.groupBy(F.col(case).alias("case__"), "sample", "kind__").agg(F.min(pick).alias("pick"))
    chance = F.element_at(F.array(*[F.lit(float(chances[n])) for n in names]), F.col("kind__") + 1)
    lot = hash_unit(seed + 1, F.col("sample"), F.coalesce(F.col("case__").cast("string"), F.lit("null")), "kind__") + 2.0**-53
    drawn = best.where(chance > 0).groupBy("case__", "sample").agg(F.min(F.struct((-F.log(lot) / chance).alias("l"), "kind__", "pick")).alias("d"))
    told = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("d.kind__") + 1)
    inwards = []
    for a, s in zip(axes, size, strict=True):
        low, high = F.lit(s // 2), F.col(f"d.pick.n_{a}") - (s - s // 2)
        inwards.append(F.when(high < low, F.floor(F.col(f"d.pick.n_{a}") / 2)).otherwise(F.least(F.greatest(F.col(f"d.pick.{a}"), low), high)).cast("long").alias(a))
    return drawn.select(F.col("case__").alias(case), "sample", told.alias("kind"), *inwards)


def patches_at(cells: DataFrame, case: str, axes: Sequence[str], centers: DataFrame, size: Sequence[int]) -> DataFrame:
    """``cells`` of each crop of ``size`` around ``centers(case, sample, axes...)``, with ``sample``; coordinates start at zero.

    Crops and cells meet by the blocks of ``size`` that a crop touches, so a cell meets only crops near it."""
    axes = list(axes)
    placed = _placed(cells, case, axes)
    starts = centers.select(F.col(case).alias("case__"), "sample", *[(F.col(a) - s // 2).alias(f"start_{a}") for a, s in zip(axes, size, strict=True)])
    on = F.col(case).eqNullSafe(F.col("case__"))
    for a, s in zip(axes, size, strict=True):
        starts = starts.withColumn(f"b_{a}", F.explode(F.sequence(F.floor(F.col(f"start_{a}") / s), F.floor((F.col(f"start_{a}") + s - 1) / s))))
        placed = placed.withColumn(f"c_{a}", F.floor(F.col(a) / s))
        on = on & (F.col(f"b_{a}") == F.col(f"c_{a}"))
    met = placed.join(starts, on)
    size_of = {a: F.lit(s) for a, s in zip(axes, size, strict=True)}
    return _cut(met, [*cells.columns, "sample"], axes, {a: F.col(f"start_{a}") for a in axes}, size_of)
