"""Near-duplicate embeddings by sorted projection passes.

Each pass orders the vectors of a label lexicographically by a concatenation of random hash bits,
compares every vector with the neighbours in a bounded window, and keeps verified pairs; vectors
that agree on a pass's leading bits, but are more than a window holds, are then compared block by
block too.  The pairs of all passes are united into components.  Links are then counted exactly
within each component.  It goes the same way at every size."""

from __future__ import annotations

from math import acos, ceil, log, log2, pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import hinted, packed, saved, small_enough, unpacked
from strataframe.llm.components import connected_components

THRESHOLD = 0.93
#: Neighbours that a vector is compared with, to one side, in each pass.
WINDOW = 64
#: Chance that a pair just at the threshold is met in some pass.
RECALL = 0.9995
#: Hash bits of one pass, as many as a positive long has.
BITS = 63
#: Vectors of a component that one task compares with as many others.
BLOCK = 2048


def leading_bits(group: int, window: int = WINDOW) -> int:
    """Bits that tell ``group / window`` blocks apart."""
    return min(BITS, max(1, ceil(log2(max(2, group / window)))))


def passes_needed(group: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes for the largest group of vectors: a pair meets if it agrees on the leading bits, each
    with chance 1 - angle / pi."""
    met = (1 - acos(threshold) / pi) ** leading_bits(group, window)
    return max(2, ceil(log(1 - recall) / log(1 - met)))


def _planes(dim: int, turn: int) -> np.ndarray:
    return np.random.default_rng((dim, turn)).standard_normal((dim, BITS))


def _unit(column) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(passes: int):
    """The concatenated bits of every pass, a long each, beside the vector."""

    def run(batches):
        weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                x = _unit(part["emb"])
                keys = [(x @ _planes(int(dim), turn) > 0) @ weights for turn in range(passes)]
                yield part.assign(keys=list(np.stack(keys, axis=1)))

    return run


class _Sets:
    """Union-find; ``join`` says whether two sets became one."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _linked(frame: pd.DataFrame, window: int, threshold: float, fresh: int = 0):
    """Pairs within the window of a sorted frame that link, less those that others imply.

    ``fresh``: rows before it were compared with each other before."""
    sets = _Sets()
    for _, part in frame.groupby(["turn", "label", "dim"], sort=False):
        ids, x, n = part["rep"].to_numpy(), _unit(part["emb"]), len(part)
        old = part["fresh__"].to_numpy() < fresh
        for a in range(0, n, 512):
            b, c = min(n, a + 512), min(n, a + 512 + window)
            near = x[a:b] @ x[a:c].T
            i, j = np.nonzero(near >= threshold)
            ok = (j > i) & (j - i <= window)
            for p, q in zip((i[ok] + a).tolist(), (j[ok] + a).tolist(), strict=True):
                if not (old[p] and old[q]) and sets.join(int(ids[p]), int(ids[q])):
                    yield int(ids[p]), int(ids[q])


def _scan(window: int, threshold: float, kind: str):
    """Links within one sorted partition; its first and last rows go on, for the pairs across borders."""

    def run(batches):
        at, carry, first, seen = TaskContext.get().partitionId(), None, None, 0
        columns = ["turn", "label", "dim", "rep", "emb"]
        for batch in batches:
            frame = batch.to_pandas()[columns]
            if not len(frame):
                continue
            if first is None or len(first) < window:
                first = frame[:window] if first is None else pd.concat([first, frame])[:window]
            both = frame if carry is None else pd.concat([carry, frame], ignore_index=True)
            held = len(both) - len(frame)
            both = both.assign(fresh__=np.arange(len(both)))
            pairs = list(_linked(both, window, threshold, held))
            if pairs:
                yield _record(kind, links=pairs)
            carry = both[columns][-window:]
            seen += len(frame)
        if first is not None:
            yield _record(kind, border=first, at=at - 1, side=1)
            yield _record(kind, border=carry, at=at, side=0)

    return run


def _edge(kind: str) -> str:
    return f"a long, b long, at int, side int, place int, turn int, label long, dim int, rep long, emb array<{kind}>"


def _record(kind: str, links=None, border=None, at=0, side=0) -> pa.RecordBatch:
    n = len(links) if links is not None else len(border)
    none = lambda type_: pa.nulls(n, type_)
    numbers = pa.list_(pa.float64() if kind == "double" else pa.float32())
    if links is not None:
        data = [pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64()), *[none(pa.int32())] * 4, none(pa.int64()), none(pa.int32()), none(pa.int64()), none(numbers)]
    else:
        data = [none(pa.int64())] * 2 + [pa.array(np.full(n, v, np.int32)) for v in (at, side)] + [pa.array(np.arange(n, dtype=np.int32))]
        data += [pa.array(border[c].to_numpy(t)) for c, t in (("turn", np.int32), ("label", np.int64), ("dim", np.int32), ("rep", np.int64))]
        data.append(pa.array([np.asarray(v, np.float64 if kind == "double" else np.float32) for v in border["emb"]], numbers))
    return pa.RecordBatch.from_arrays(data, names=[c.split()[0] for c in _edge(kind).split(", ")])


def _bridge(window: int, threshold: float):
    """Links between the last rows of one partition and the first of the next."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "place"]).assign(fresh__=np.arange(len(frame)))
        return pd.DataFrame(list(_linked(frame, window, threshold)), columns=["a", "b"], dtype=np.int64)

    return run


def _counted(threshold: float):
    """Links of each vector of block ``i`` with block ``j`` of its component, copies counted."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in frame.groupby("component", sort=False):
            rep, x, times = part["rep"].to_numpy(), _unit(part["emb"]), part["times"].to_numpy()
            own, low, high = part["block"].to_numpy(), part["i"].iloc[0], part["j"].iloc[0]
            here, there = np.flatnonzero(own == low), np.flatnonzero(own == high)
            for a in range(0, len(here), 512):
                rows = here[a : a + 512]
                close = x[rows] @ x[there].T >= threshold
                close[rows[:, None] == there[None, :]] = False
                out.append(pd.DataFrame({"rep": rep[rows], "n": close @ times[there]}))
                if low != high:
                    out.append(pd.DataFrame({"rep": rep[there], "n": times[rows] @ close}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "n": []}, dtype=np.int64)

    return run


def _spanning(keys: list[str], threshold: float):
    """Links between block ``i`` and block ``j`` of each group of ``keys``, less those that others imply."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in frame.groupby(keys, sort=False):
            rep, x, own = part["rep"].to_numpy(), _unit(part["emb"]), part["block"].to_numpy()
            here, there = (np.flatnonzero(own == part[k].iloc[0]) for k in ("i", "j"))
            group = np.arange(len(part))
            for a in range(0, len(here), 512):
                rows = here[a : a + 512]
                close = x[rows] @ x[there].T >= threshold
                close[rows[:, None] == there[None, :]] = False
                for at in np.flatnonzero(close.any(axis=1)).tolist():
                    p, others = rows[at], there[close[at]]
                    names, first = np.unique(group[others], return_index=True)
                    fresh = names != group[p]
                    if fresh.any():
                        out += [(int(rep[p]), int(rep[q])) for q in others[first[fresh]]]
                        group[np.isin(group, names)] = group[p]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def _compared(rows: DataFrame, sizes: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Pairs (a, b) that connect what links within the groups ``sizes(*keys, n)``, all pairs compared."""
    sizes = sizes.select(*keys, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(hinted(sizes, small_enough(sizes.count(), 48)), keys)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    every = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(*keys), F.lit(1024))).otherwise(F.xxhash64(*keys))
    every = every.select(*keys, "rep", "emb", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), task.alias("task"))
    return every.groupBy("task", "i", "j").applyInPandas(_spanning(keys, threshold), "a long, b long")


def _links(classes: DataFrame, threshold: float, window: int, recall: float) -> DataFrame:
    """Verified pairs (a, b) of class representatives, enough to connect what links.

    All vectors go through all passes.  Beyond that, those that agree on the leading bits of a pass
    are all compared, so a pair is met with chance ``recall`` however crowded its neighbourhood is;
    where the crowds of a label, added up, are more work than all its pairs, its pairs are compared
    once instead of in every pass."""
    label, rows = ["label", "dim"], classes.select("label", "dim", "rep", "emb")
    kind = rows.schema["emb"].dataType.elementType.typeName()
    groups = saved(classes.groupBy(*label).agg(F.count(F.lit(1)).alias("n")))
    largest = groups.agg(F.max("n")).first()[0] or 0
    passes, crowd = passes_needed(largest, threshold, window, recall), [*label, "turn", "prefix"]
    # Bits are taken once; a vector is multiplied by the passes only on its way into the sort.
    keys = saved(rows.mapInPandas(_keys(passes), f"label long, dim int, rep long, emb array<{kind}>, keys array<long>"))
    keyed = keys.select(*label, "rep", "emb", F.posexplode("keys").alias("turn", "sortkey"))
    prefixed = keyed.withColumn("prefix", F.shiftright("sortkey", BITS - leading_bits(largest, window)))
    # Up to a window and one more, each vector of a crowd is within the window of all others.
    crowds = saved(prefixed.groupBy(*crowd).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > window + 1))
    work = crowds.groupBy(*label).agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("work"))
    dense = saved(groups.join(work, label).where(F.col("work") > F.col("n").cast("double") * F.col("n")).select(*label, "n"))
    crowds = crowds.join(hinted(dense.select(*label), small_enough(dense.count(), 16)), label, "left_anti").select(*crowd, "n")
    order = ["turn", "label", "dim", "sortkey", "rep"]
    found = saved(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_scan(window, threshold, kind), _edge(kind)))
    within = found.where("a is not null").select("a", "b")
    across = found.where("a is null").groupBy("at").applyInPandas(_bridge(window, threshold), "a long, b long")
    crowded = _compared(prefixed, crowds, crowd, threshold).union(_compared(rows, dense, label, threshold))
    return within.union(across).union(crowded).distinct()


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> DataFrame:
    """All columns of ``vectors(vec_id, embedding, label, ...)`` and n_links, component_id, kept.

    Vectors of equal label and length link if their cosine in double precision reaches
    ``threshold``; arrays of doubles are taken as they are, others as floats.  Labels are whole numbers; of
    others the 64-bit hash counts.  Copies of one vector are one class in the passes and count as links of each
    other.  What is null, zero, has a null or non-finite component, or a null label or vec_id links
    with nothing and is its own component.  Repeated rows count as copies, and rows of one
    id with different vectors as vectors of their own; an empty table gives none.

    A pair is met with chance ``recall`` or more on its own, however many vectors lie near it and
    whatever the label's size.  Links are counted over whole components, block by block, so none
    within a component is missed."""
    kinds = dict(vectors.dtypes)
    kind = "double" if kinds["embedding"] == "array<double>" else "float"
    whole = kinds["label"] in ("tinyint", "smallint", "int", "bigint")
    rows = packed(vectors).select(
        "row__",
        F.col("row__.vec_id").cast("long").alias("id"),
        (F.col("row__.label").cast("long") if whole else F.when(F.col("row__.label").isNotNull(), F.xxhash64("row__.label"))).alias("label"),
        F.col("row__.embedding").cast(f"array<{kind}>").alias("emb"),
    )
    finite = F.forall("emb", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("emb").isNotNull() & finite & F.exists("emb", lambda v: v != 0)
    # Two 64-bit hashes stand for the vector wherever only its identity matters.
    rows = rows.withColumns({"h1": F.xxhash64("emb"), "h2": F.xxhash64(F.lit("again"), F.reverse("emb")), "fit": F.coalesce(fit, F.lit(False))})
    good = rows.where("fit")
    # A class has a number of its own, as an id may stand in rows of different vectors.
    made = good.groupBy("label", "emb").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("times"), F.min("h1").alias("h1"), F.min("h2").alias("h2"))
    classes = saved(made.withColumns({"dim": F.size("emb"), "rep": F.monotonically_increasing_id()}))
    linked = saved(connected_components(_links(classes, threshold, window, recall)))
    sizes = linked.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = classes.select("rep", "emb", "times").join(linked.join(sizes, "component"), F.col("rep") == F.col("node"))
    members = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    every = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(1024))).otherwise(F.xxhash64("component"))
    every = every.select("component", "rep", "emb", "times", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), task.alias("task"))
    counts = every.groupBy("task", "i", "j").applyInPandas(_counted(threshold), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    named = linked.select(F.col("node").alias("rep"), "component")
    lowest = named.join(classes.select("rep", "low"), "rep").groupBy("component").agg(F.min("low").alias("lowest"))
    told = (
        named.join(lowest, "component")
        .join(counts, "rep", "left")
        .join(classes.select("rep", "label", "h1", "h2", "times", "low"), "rep", "right")
        .where("times > 1 or component is not null")
        .select(F.col("label").alias("l__"), F.col("h1").alias("x__"), F.col("h2").alias("y__"), F.coalesce("lowest", "low").alias("c__"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n__"))
    )
    both = rows.join(told, F.col("fit") & (F.col("label") == F.col("l__")) & (F.col("h1") == F.col("x__")) & (F.col("h2") == F.col("y__")), "left")
    component = F.coalesce("c__", "id")
    return unpacked(
        both,
        vectors.columns,
        n_links=F.coalesce("n__", F.lit(0)).cast("long"),
        component_id=component,
        kept=component.eqNullSafe(F.col("id")),
    )
