"""Sharding by histogram sort: exact byte counts below key boundaries, refined; then one exchange."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.llm.common import packed, saved, unpacked

#: Keys are 60 bits of an md5; each round of counting looks at 12 more of them.
KEY_BITS, ROUND_BITS = 60, 12
#: A splitter stays on the border of a group of equal texts if that's within this part of a shard.
TOLERANCE = 0.01


def _key(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def _counts(rows: DataFrame, key: str, parents: list[int] | None, depth: int) -> list:
    """Exact bytes and rows between the candidate boundaries inside the open intervals."""
    shift = KEY_BITS - depth * ROUND_BITS
    if parents is not None:
        rows = rows.where(F.shiftright(key, shift + ROUND_BITS).isin(parents))
    cell = F.shiftright(key, shift).alias("cell")
    return (
        rows.groupBy(cell)
        .agg(F.sum("size").alias("bytes"), F.min(key).alias("low"), F.max(key).alias("high"))
        .orderBy("cell")
        .collect()  # at most 4096 boundaries for each open splitter
    )


def _refine(rows: DataFrame, key: str, targets: dict[int, int], below: int = 0) -> dict[int, tuple[int, int, int]]:
    """For each target, the key that straddles it, the bytes below that key, and its own bytes."""
    found: dict[int, tuple[int, int, int]] = {}
    inside: dict[int, tuple[int | None, int]] = {i: (None, below) for i in targets}
    depth = 1
    while inside:
        parents = None if depth == 1 else sorted({p for p, _ in inside.values()})
        cells = _counts(rows, key, parents, depth)
        for i, (parent, under) in list(inside.items()):
            for c in cells:
                if parent is not None and c.cell >> ROUND_BITS != parent:
                    continue
                if under + c.bytes > targets[i]:
                    if c.low == c.high:
                        found[i] = (c.low, under, c.bytes)
                        del inside[i]
                    else:
                        inside[i] = (c.cell, under)
                    break
                under += c.bytes
        depth += 1
    return found


def find_splitters(rows: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """``rows(k1, k2, size)`` -> sorted keys (k1, k2) at which the next shard begins.

    Splitter i aims at i/n of all bytes.  It takes the nearer border of the group of equal texts that
    straddles its target if that lies within ``tolerance`` of a shard, else the nearest border of a
    row within the group.  Borders tie towards the lower one."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    targets = {i: i * total // n_shards for i in range(1, n_shards)}
    slack = int(total * tolerance / n_shards)
    cuts, deeper = {}, {}
    for i, (k1, under, size) in _refine(rows, "k1", targets).items():
        before, after = targets[i] - under, under + size - targets[i]
        if min(before, after) <= slack:
            cuts[i] = (k1, 0) if before <= after else (k1 + 1, 0)
        else:
            deeper.setdefault((k1, under), {})[i] = targets[i]
    for (k1, under), some in deeper.items():  # groups larger than the tolerance: at most one a splitter
        for i, (k2, low, size) in _refine(rows.where(F.col("k1") == k1), "k2", some, under).items():
            cuts[i] = (k1, k2) if targets[i] - low <= low + size - targets[i] else (k1, k2 + 1)
    return [cuts[i] for i in sorted(cuts)]


def _hot_groups(rows: DataFrame, shift: int, usual: float) -> DataFrame:
    """Per cell of the key space that holds far more rows than most: the texts that are the reason."""
    cells = rows.groupBy(F.shiftright("k1", shift).alias("c__")).count().where(F.col("count") > 2 * usual + 64)
    inside = rows.select(F.shiftright("k1", shift).alias("c__"), "k1").join(F.broadcast(cells.select("c__")), "c__", "left_semi")
    keys = inside.groupBy("c__", "k1").count().where(F.col("count") > usual + 32)
    return keys.groupBy("c__").agg(F.sort_array(F.collect_list("k1")).alias("hot__"))


def shard_documents(docs: DataFrame, n_shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """All columns of ``docs(doc_id, text, ...)`` and size, text_crc32, shard, slot.

    Law ``bytes``: shards are key ranges of near equal bytes, the key being (hash of text, hash of
    doc_id).  Equal texts stay together unless that moves a splitter by more than ``tolerance`` of a
    shard.  Slots number a shard's rows from 0 in key order.  To number them, the rows are exchanged
    once into fine ranges of the key (hot texts are split by the second key), whose counts give each
    range its first slot; the table of ranges is bounded by the number of ranges and is broadcast.

    A null text has the size, key and crc of an empty one; a null doc_id is an id of its own; rows
    equal in both fall side by side; an empty table gives no rows."""
    source = packed(docs).select("row__", F.coalesce("row__.text", F.lit("")).alias("t__"))
    keyed = source.select(
        "row__",
        (F.octet_length("t__") + 1).cast("long").alias("size"),
        F.crc32(F.col("t__").cast("binary")).alias("crc__"),
        _key(F.col("t__")).alias("k1"),
        _key(F.coalesce(F.col("row__.doc_id").cast("string"), F.lit("null"))).alias("k2"),
    )
    narrow = saved(keyed.select("k1", "k2", "size"))
    cuts = find_splitters(narrow, n_shards, tolerance)
    n_rows = narrow.count()
    bits = min(20, max(9, ceil(log2(max(n_rows, 1) / 20_000)) if n_rows > 20_000 else 9))
    shift, usual = KEY_BITS - bits, n_rows / (1 << bits)
    hot = saved(_hot_groups(narrow, shift, usual))

    borders = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in cuts])
    past = lambda s: (F.col("k1") > s["a"]) | ((F.col("k1") == s["a"]) & (F.col("k2") >= s["b"]))
    shard = F.size(F.filter(borders, past)).cast("int") if cuts else F.lit(0)

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("c__", F.shiftright("k1", shift)).join(F.broadcast(hot), "c__", "left")
        is_hot = F.coalesce(F.array_contains("hot__", F.col("k1")), F.lit(False))
        last = F.array_max(F.filter("hot__", lambda h: h < F.col("k1")))
        return rows.withColumns(
            {
                "s__": shard,
                "x1__": F.when(is_hot, F.col("k1")).otherwise(F.coalesce(last + 1, F.shiftleft("c__", shift))),
                "x2__": F.when(is_hot, F.shiftright("k2", KEY_BITS - 8)).otherwise(F.lit(-1)).cast("long"),
            }
        ).drop("c__", "hot__")

    ranges = placed(narrow).groupBy("s__", "x1__", "x2__").count()
    earlier = Window.partitionBy("s__").orderBy("x1__", "x2__")
    first = ranges.select("s__", "x1__", "x2__", (F.sum("count").over(earlier) - F.col("count")).alias("first__"))
    here = Window.partitionBy("s__", "x1__", "x2__").orderBy("k1", "k2", "row__.doc_id")
    dealt = placed(keyed).withColumn("n__", F.row_number().over(here)).join(F.broadcast(first), ["s__", "x1__", "x2__"])
    return unpacked(
        dealt,
        docs.columns,
        size=F.col("size"),
        text_crc32=F.col("crc__"),
        shard=F.col("s__"),
        slot=(F.col("first__") + F.col("n__") - 1).cast("long"),
    )
