"""Exact copies: two passes over a blocked Bloom filter, so that only rows that may be repeated are shuffled."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import hinted, packed, saved, small_enough, unpacked

#: A block of the filter is one bitmap of Spark's bitmap functions: 32,768 bits in 4,096 bytes.
BLOCK_BITS, BLOCK_BYTES = 1 << 15, 1 << 12
#: Bits of the filter for each row, and bits that a hash sets.
BITS_PER_ROW, PROBES = 16, 2
#: A group of over one in so many rows is joined by broadcast, so at most that many groups are.
HOT_SHARE = 1000


def text_digest(text: Column) -> Column:
    """The 32 bytes of sha256 over the UTF-8 of the text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("sha__"), F.lit(blocks)).cast("int")


def _bits() -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(j), "sha__"), F.lit(BLOCK_BITS)).cast("int") for j in range(PROBES)]


def repeated_filter(digests: DataFrame, blocks: int) -> DataFrame:
    """First pass: (block__, bitmap__) of all bits that two rows or more of ``digests(sha__)`` set.

    Bits are counted where they are read and again after an exchange that carries (block, bit) only,
    so a digest of any frequency is one row a task.  A block's bits, at most 32,768, meet in one bitmap."""
    bits = digests.select(_block(blocks).alias("block__"), F.explode(F.array(*_bits())).alias("bit__"))
    twice = bits.groupBy("block__", "bit__").count().where(F.col("count") > 1)
    return twice.repartition("block__").groupBy("block__").agg(F.expr("bitmap_construct_agg(bit__)").alias("bitmap__"))


def _filter_of(digests: DataFrame) -> tuple[DataFrame, int, bool]:
    n_rows = digests.count()
    blocks = 1 << max(0, ceil(log2(max(1, n_rows * BITS_PER_ROW / BLOCK_BITS))))
    return saved(repeated_filter(digests, blocks)), blocks, small_enough(blocks, BLOCK_BYTES)


def _flagged(rows: DataFrame, found: tuple[DataFrame, int, bool]) -> DataFrame:
    """Second pass: ``maybe__`` is false where the digest stands once for certain."""
    filtered, blocks, broadcast = found
    looked_up = rows.withColumn("block__", _block(blocks)).join(hinted(filtered, broadcast), "block__", "left")
    bit = "getbit(cast(conv(hex(substring(bitmap__, {0} div 8 + 1, 1)), 16, 10) as int), {0} % 8) = 1"
    names = [f"bit{j}__" for j in range(PROBES)]
    flags = looked_up.withColumns(dict(zip(names, _bits(), strict=True)))
    maybe = F.coalesce(F.expr(" and ".join(bit.format(n) for n in names)), F.lit(False))
    return flags.withColumn("maybe__", maybe).drop("block__", "bitmap__", *names)


def exact_groups(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns of ``docs(doc_id, text, ...)`` and keep_id, group_size, kept, text_sha256: one row a document.

    Of equal texts the row with the largest doc_id stays; null ids are less than all others, and of rows
    equal in id and text exactly one stays.  A null text equals an empty one.  Texts are equal if their
    sha256 are.  Texts are read once, whole; a table of digests and carried columns is written, and all
    that follows reads that.  The filter has 16 bits a row, in blocks; up to 64 MB it's broadcast, beyond
    that digests are joined to it by block.  Rows that it clears are never shuffled; the others are
    aggregated before their exchange.  Groups found are looked up by broadcast where they're small by
    measure, else only those over a thousandth of all rows (at most a thousand) are, and the rest by a
    shuffled join.  An empty table gives no rows; new columns replace carried ones of the same name."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys((*carry, "doc_id"))]).alias("row__"), text_digest(F.col("text")).alias("sha__"))
    narrow = saved(rows.withColumn("mark__", F.monotonically_increasing_id()))
    flagged = _flagged(narrow, _filter_of(narrow.select("sha__")))
    alone, suspects = flagged.where(~F.col("maybe__")), flagged.where("maybe__")
    best = F.max(F.struct(F.col("row__.doc_id").alias("id"), F.col("mark__").alias("mark")))
    found = suspects.groupBy("sha__").agg(best.alias("best__"), F.count(F.lit(1)).alias("n__"))
    groups = saved(found.where(F.col("n__") > 1))
    if small_enough(groups.count(), 100):
        decided = suspects.join(F.broadcast(groups), "sha__", "left")
    else:
        is_hot = F.col("n__") * HOT_SHARE > narrow.count()
        hot = suspects.join(F.broadcast(groups.where(is_hot)), "sha__", "left")
        rest = hot.where(F.col("n__").isNull()).drop("best__", "n__").join(groups.where(~is_hot), "sha__", "left")
        decided = hot.where(F.col("n__").isNotNull()).unionByName(rest)
    both = decided.unionByName(alone, allowMissingColumns=True)
    in_group = F.col("n__").isNotNull()
    return unpacked(
        both,
        list(carry),
        keep_id=F.when(in_group, F.col("best__.id")).otherwise(F.col("row__.doc_id")),
        group_size=F.coalesce("n__", F.lit(1)).cast("long"),
        kept=~in_group | (F.col("best__.mark") == F.col("mark__")),
        text_sha256=F.lower(F.hex("sha__")),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept.  Rows that the filter clears go straight through;
    of the others the row of largest doc_id of each digest is kept by an aggregation that starts where they
    are read, so a group of any size is one row a task.  Edge cases are those of ``exact_groups``."""
    keyed = packed(docs).withColumn("sha__", text_digest(F.col("row__.text")))
    flagged = _flagged(keyed, _filter_of(saved(keyed.select("sha__"))))
    last = F.max_by("row__", F.struct("row__.doc_id")).alias("row__")
    stay = flagged.where("maybe__").groupBy("sha__").agg(last)
    return unpacked(flagged.where(~F.col("maybe__")).select("row__").unionByName(stay.select("row__")), docs.columns)
