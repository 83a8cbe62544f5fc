"""A Merkle manifest of a dataset, and proofs of its rows by coordinate lookup."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.llm.common import hinted, saved, small_enough

#: Consecutive nodes that are hashed together.
FANOUT = 16
#: Levels that one exchange builds and one lookup covers; nodes under one ancestor share the path above it.
STRIDE = 2
BLOCK = FANOUT**STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"


class Manifest(NamedTuple):
    """``leaves(tree, at, n, digest, row)`` of one tree a source, the ``nodes(tree, level, at, n, digest)`` of all
    levels (n: nodes of the tree at that level), and the same of the tree over the subroots."""

    leaves: DataFrame
    nodes: DataFrame
    top_leaves: DataFrame
    top_nodes: DataFrame
    most_leaves: int
    sources: int


def leaf_digest(fields: list[Column]) -> Column:
    """Each field as ``-`` if null, else its UTF-8 byte count, a colon and itself; hashed together."""
    values = [field.cast("string") for field in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` and their ``place`` in a total order, from 0: dealt into ranges, sorted there, with the sizes of
    earlier ranges added, so no task sees more than its range."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = saved(dealt.withColumn("mark", F.monotonically_increasing_id())).withColumn("part", F.shiftright("mark", 33))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    sizes = marked.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    starts = sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    place = (F.col("start") + F.col("mark").bitwiseAND((1 << 33) - 1)).alias("place")
    return marked.join(F.broadcast(starts), "part").select(*rows.columns, place)


def _over(at: Column | str, width: int) -> Column:
    return F.floor((F.col(at) if isinstance(at, str) else at) / F.lit(width)).cast("long")


def _nodes(leaves: DataFrame, most: int) -> DataFrame:
    """All nodes of all trees.  Two levels are made per exchange: nodes meet by (tree, block of 256), and runs
    of 16 are hashed there in order, twice.  A tree ends at the level where it has a single node."""
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]), ""), 256)
    fewer = F.ceil(F.col("n") / FANOUT).cast("long").alias("n")
    here = leaves.select("tree", F.lit(0).alias("level"), "at", "n", "digest")
    found, level = here, 0
    while FANOUT**level < most:
        rows = here.where("n > 1").withColumn("block", _over("at", BLOCK)).repartition("tree", "block")
        one = rows.groupBy("tree", "block", _over("at", FANOUT).alias("at"), fewer).agg(digest.alias("digest"))
        two = one.where("n > 1").groupBy("tree", F.col("block").alias("at"), fewer).agg(digest.alias("digest"))
        steps = [x.select("tree", F.lit(level + i).alias("level"), "at", "n", "digest") for i, x in ((1, one), (2, two))]
        made = saved(steps[0].unionByName(steps[1]))
        level += STRIDE
        found, here = found.unionByName(made), made.where(F.col("level") == level)
    return found


def build_manifest(docs: DataFrame, carry: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS) -> Manifest:
    """Leaves, nodes and the tree over all sources, for ``docs(doc_id, source, ...)``.

    A source's leaves ascend by doc_id, null first, ties by digest; every 16 consecutive nodes become one until
    one is left, the subroot; subroots, by source with null first and bytewise, likewise give the root.
    ``carry`` are columns of ``docs`` kept beside the leaves.  Documents are read once; what is written and
    shuffled are digests.  Places come from ranges of the order, so a source of any size is spread.  Rows equal
    in all fields take neighbouring places.  An empty table gives empty tables."""
    tree = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    kept = F.struct(*[value.alias(name) for name, value in (carry or {"doc_id": F.col("doc_id")}).items()])
    digest = leaf_digest([F.col(name) for name in fields])
    placed = _placed(docs.select(tree.alias("tree"), F.col("doc_id").alias("id"), digest.alias("digest"), kept.alias("row")), "tree", "id", "digest")
    sizes = saved(placed.groupBy("tree").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")))
    sources, most = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
    leaves = placed.join(hinted(sizes, small_enough(sources, 200)), "tree").select("tree", (F.col("place") - F.col("first")).alias("at"), "n", "digest", "row")
    nodes = _nodes(leaves, most or 0)
    subroots = _placed(nodes.where("n = 1").select("tree", "digest"), "tree")
    name = F.struct(F.col("tree").alias("source_tree"), F.col("digest").alias("subroot")).alias("row")
    top = subroots.select(F.lit("").alias("tree"), F.col("place").alias("at"), F.lit(sources).cast("long").alias("n"), "digest", name)
    return Manifest(leaves, nodes, top, _nodes(top, sources), most or 0, sources)


def _siblings(level: int, j: int) -> Column:
    """The coordinates (level, at) of the siblings, j levels up, of the node of ``level`` in columns ``at`` and ``n``."""
    own, count = _over("at", FANOUT**j), F.ceil(F.col("n") / FANOUT**j).cast("long")
    first = own - own % FANOUT
    others = F.filter(F.sequence(first, F.least(first + FANOUT - 1, count - 1)), lambda x: x != own)
    found = F.transform(others, lambda x: F.struct(F.lit(level + j).alias("level"), x.alias("at")))
    return F.when(count > 1, found).otherwise(F.expr("cast(array() as array<struct<level: int, at: bigint>>)"))


def _step(level: int, j: int) -> Column:
    """The path's part j levels up: digests of ``siblings`` before and after the node; nothing above the tree's root."""
    own = _over("at", FANOUT**j)
    here = F.filter("siblings", lambda x: x["level"] == level + j)
    side = [F.array_join(F.transform(F.filter(here, keep), lambda x: x["digest"]), "") for keep in (lambda x: x["at"] < own, lambda x: x["at"] > own)]
    step = F.array(F.struct(side[0].alias("left"), side[1].alias("right")))
    return F.when(F.ceil(F.col("n") / FANOUT**j) > 1, step).otherwise(F.expr(f"cast(array() as {PATH})"))


def _paths(leaves: DataFrame, nodes: DataFrame, tails: DataFrame, most: int) -> DataFrame:
    """(tree, at, row, path, roots) for every leaf; ``tails(tree, n_leaves, path, roots)`` is what lies above each tree.

    From the top, every node of an even level explodes the coordinates of its siblings up to the next even
    level, at most 30, from its place and the number of nodes there; they are joined with the node table,
    meet again by (tree, block), are put in order, and the path of the block's ancestor follows."""
    height = 0
    while FANOUT ** (height + STRIDE) < most:
        height += STRIDE
    above = None
    for level in range(height, -1, -STRIDE):
        # A tree that ends at or below this level enters lower down: its root asks for nothing here.
        here = leaves if level == 0 else nodes.where((F.col("level") == level) & (F.col("n") > 1)).withColumn("row", F.lit(None).cast("boolean"))
        here = here.select("tree", _over("at", BLOCK).alias("block"), "at", "n", "row")
        coordinates = F.concat(*[_siblings(level, j) for j in range(STRIDE)])
        asked = here.select("tree", "block", F.col("at").alias("asker"), F.explode(coordinates).alias("c"))
        asked = asked.select("tree", "block", "asker", F.col("c.level").alias("level"), F.col("c.at").alias("at"))
        met = asked.join(nodes.select("tree", "level", "at", "digest"), ["tree", "level", "at"])
        met = met.select("tree", "block", F.col("asker").alias("at"), F.struct("level", "at", "digest").alias("sibling"))
        entering = (F.col("n_leaves") <= FANOUT ** (level + STRIDE)) & (F.lit(level == 0) | (F.col("n_leaves") > FANOUT**level))
        tail = tails.where(entering).select("tree", F.lit(0).cast("long").alias("block"), F.struct("path", "roots").alias("tail"))
        tail = tail if above is None else tail.unionByName(above.select("tree", F.col("at").alias("block"), F.struct("path", "roots").alias("tail")))
        rows = met.unionByName(here, allowMissingColumns=True).unionByName(tail, allowMissingColumns=True).repartition("tree", "block")
        gathered = rows.groupBy("tree", "block", "at").agg(
            F.array_sort(F.collect_list("sibling")).alias("siblings"), F.max("n").alias("n"), F.first("row", True).alias("row"), F.first("tail", True).alias("tail")
        )
        gathered = gathered.withColumn("tail", F.first("tail", True).over(Window.partitionBy("tree", "block"))).where("at is not null")
        path = F.concat(*[_step(level, j) for j in range(STRIDE)], "tail.path")
        above = gathered.select("tree", "at", "row", path.alias("path"), F.col("tail.roots").alias("roots"))
        above = saved(above) if level else above
    return above


def prove(manifest: Manifest) -> DataFrame:
    """(row, leaf, subroot, root, path) for every leaf: ``row`` as carried, and the siblings' digests on the left and
    right of each level of the path, from the leaf's level to the root's."""
    root = manifest.top_nodes.where("n = 1").select(F.lit("").alias("tree"), F.lit(manifest.sources).alias("n_leaves"), F.expr(f"cast(array() as {PATH})").alias("path"), F.col("digest").alias("roots"))
    over = saved(_paths(manifest.top_leaves, manifest.top_nodes, root, manifest.sources))
    sizes = manifest.nodes.where((F.col("level") == 0) & (F.col("at") == 0)).select("tree", F.col("n").alias("n_leaves"))
    roots = F.struct(F.col("row.subroot").alias("subroot"), F.col("roots").alias("root")).alias("roots")
    tails = over.select(F.col("row.source_tree").alias("tree"), "path", roots).join(sizes, "tree")
    found = _paths(manifest.leaves.withColumn("row", F.struct("row", "digest")), manifest.nodes, tails, manifest.most_leaves)
    return found.select(F.col("row.row").alias("row"), F.col("row.digest").alias("leaf"), "roots.subroot", "roots.root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings' digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def verify_rows(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row a document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` is the leaf digest, as an expression over ``docs``, of the row as it's found today; null or none
    means that it's unchanged.  The proof's siblings are always those of the manifest.  A null field has its
    own encoding, so null and empty texts differ; a null doc_id comes first in its source; rows equal in all
    fields get equal leaves at neighbouring places; an empty table gives no rows; other columns are ignored."""
    now = F.lit(None).cast("string") if tampered is None else tampered
    found = prove(build_manifest(docs, {"doc_id": F.col("doc_id"), "now": now}))
    root = folded(F.coalesce("row.now", "leaf"), F.col("path"))
    out = found.select(F.col("row.doc_id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
