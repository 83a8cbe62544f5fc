"""Mixing sources to target weights: repetition rates and hash-seeded Bernoulli copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.llm.common import hinted, packed, saved, small_enough, unpacked

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CEILING = 2.0
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_rates(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """``sizes(source, size)`` -> per source: source_size, target, rate.

    Sources in code point order, null last, take the weights in turn.  They share ``share`` of all
    words; a target stops at ``ceiling`` times its source's words and the rest is dealt again by
    weight.  Sorted by ceiling over weight, the sources that stop form a prefix, so one pass over the
    table of sources finds the level at which nobody is above."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", ceiling * F.col("source_size"))
    all_of = Window.partitionBy(F.lit(0))
    up_to = all_of.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        ranked.withColumn("total", F.lit(share) * F.sum("source_size").over(all_of))
        .withColumn("capped", F.sum("cap").over(up_to) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(all_of) - F.sum("weight").over(up_to) + F.col("weight"))
    )
    # The level if this source and all after it stay below their ceilings.  The first that does is right;
    # later ones give lower levels, as they count sources as stopped that aren't.
    level = (F.col("total") - F.col("capped")) / F.col("open")
    ranked = ranked.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    found = F.max("level").over(all_of)
    target = F.least(F.col("cap"), F.coalesce(found * F.col("weight"), F.col("cap")))
    return ranked.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the md5 of the seed and the id: alike on every run and engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def planned_copies(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """All columns of ``docs(doc_id, text, source, ...)`` and size, source_size, target, copies, taken.

    A document goes in floor(rate) times, and once more if its uniform number is below the
    fraction; so reruns agree and no document goes in more than ``ceiling`` times.  Null and empty
    texts have size 0, a source of such texts gets rate 0, null is a source of its own, and rows that
    share an id share the number."""
    rows = packed(docs).select("row__", F.col("row__.source").alias("s__"), word_count(F.col("row__.text")).alias("size__"))
    rates = saved(source_rates(rows.select(F.col("s__").alias("source"), F.col("size__").alias("size")), weights, share, ceiling))
    table = hinted(rates, small_enough(rates.count(), 256))
    both = rows.join(table, F.col("s__").eqNullSafe(F.col("source")), "left")
    extra = uniform(F.col("row__.doc_id"), seed) < F.col("rate") - F.floor("rate")
    copies = (F.floor("rate") + F.when(extra, 1).otherwise(0)).cast("long")
    return unpacked(
        both,
        docs.columns,
        size=F.col("size__"),
        source_size=F.col("source_size"),
        target=F.col("target"),
        copies=copies,
        taken=copies * F.col("size__"),
    )


def mix(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """The mixed corpus itself: each document as many times as planned, with the columns of ``docs``."""
    planned = planned_copies(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept__"), "doc_id", "text", "source"), seed, weights, share, ceiling)
    again = planned.where("copies > 0").select("kept__", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return again.select("kept__.*")
