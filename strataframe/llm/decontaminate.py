"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned for natively."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import BROADCAST_LIMIT, hinted, packed, saved, unpacked

#: What stands between words, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10


def normalised(text: Column) -> Column:
    """A-Z lower-cased, words joined by single spaces; null stays null."""
    ascii_only = F.length(text) == F.octet_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.trim(F.regexp_replace(lowered, GAP, " "))


def word_count(norm: Column) -> Column:
    spaces = F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit("")))
    return F.when(F.coalesce(norm, F.lit("")) == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: ``win`` string, ``w`` its words, ``items`` array of ids."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
        normalised(F.col("text")).alias("norm"),
    ).where("norm != ''")
    words = items.select("item", F.split("norm", " ").alias("words"))
    words = words.withColumn("w", F.least(F.size("words"), F.lit(window)))
    starts = words.select(
        "item", "words", "w", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("w"))).alias("at")
    )
    cut = F.array_join(F.slice("words", F.col("at") + 1, F.col("w")), " ").alias("win")
    return starts.select("item", "w", cut).groupBy("win", "w").agg(F.collect_set("item").alias("items"))


def _seeds(windows: DataFrame) -> DataFrame:
    """The aligned block that a scan meets first inside a window, for each alignment.

    A window of w words holds a whole aligned block of ``size = (w + 1) // 2`` words, whatever the
    word at which it starts; the first such block begins ``off`` < size words into the window."""
    sized = windows.withColumn("size", F.floor((F.col("w") + 1) / 2).cast("int"))
    each = sized.withColumn("off", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    block = F.array_join(F.slice(F.split("win", " "), F.col("off") + 1, F.col("size")), " ")
    return each.withColumn("seed", block)


def _scan(keyed: DataFrame, seeds: DataFrame, size: int, broadcast: bool) -> DataFrame:
    """Verified occurrences: key columns, ``p`` first word, ``e`` word after the last, ``items``."""
    pattern = "[^ ]++" if size == 1 else rf"(?:[^ ]++ ){{{size - 1}}}[^ ]++|[^ ]++(?: [^ ]++)*+"
    blocks = keyed.select("id__", "h__", F.regexp_extract_all("norm", F.lit(pattern), 0).alias("blocks"))
    k = F.col("k")
    around = F.when(k > 0, F.slice("blocks", F.greatest(k, F.lit(1)), F.lit(3))).otherwise(F.slice("blocks", 1, 2))
    tokens = blocks.select("id__", "h__", "blocks", F.posexplode("blocks").alias("k", "block"))
    tokens = tokens.select("id__", "h__", "k", "block", F.array_join(around, " ").alias("near"))
    met = tokens.join(hinted(seeds.where(F.col("size") == size).drop("size"), broadcast), F.col("block") == F.col("seed"))
    start = F.col("k") * size - F.col("off")
    first = F.greatest(start - F.when(k > 0, (k - 1) * size).otherwise(0) + 1, F.lit(1))
    same = F.array_join(F.slice(F.split("near", " "), first, F.col("w")), " ") == F.col("win")
    return met.where((start >= 0) & same).select(
        "id__", "h__", start.alias("p"), (start + F.col("w")).alias("e"), "items"
    )


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Per text that holds any window: ``id__``, ``h__``, ``spans`` of words, ``items`` met."""
    windows = saved(_seeds(benchmark_windows(benchmark, window)))
    facts = windows.agg(
        F.collect_set("size"), F.sum(F.length("win") + F.length("seed") + 40 * (F.size("items") + 2))
    ).first()
    keyed = docs.select("id__", "h__", normalised(F.col("text__")).alias("norm")).where("norm != ''")
    hits = None
    for size in sorted(facts[0]):
        found = _scan(keyed, windows, size, facts[1] <= limit)
        hits = found if hits is None else hits.union(found)
    if hits is None:  # no item has a word
        hits = keyed.where("false").select("id__", "h__", F.lit(0).alias("p"), F.lit(0).alias("e"), F.array().cast("array<string>").alias("items"))
    return hits.groupBy("id__", "h__").agg(
        F.sort_array(F.collect_set(F.struct("p", "e"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )


def covered(spans: Column) -> Column:
    """How many words lie in the union of sorted spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    def step(acc, x):
        new = F.greatest(x["e"] - F.greatest(acc["end"], x["p"]), F.lit(0))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["end"], x["e"]).alias("end"))
    return F.aggregate(spans, zero, step)["n"]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """All columns of ``docs(doc_id, text, ...)`` and n_words, n_hit, n_items, items_sha256,
    contaminated, hit_spans (sorted word ranges).

    A benchmark, and hits, up to ``limit`` measured bytes are broadcast; beyond it the same joins
    shuffle short word blocks, and the rows to which hits are attached.  Rows are matched by doc_id and a hash of the text, so repeated ids and
    rows keep their own results.  Null and wordless texts and items have no windows; an item_id that
    is null counts under the name "null"; an empty benchmark hits nothing."""
    text = F.col("row__.text")
    rows = packed(docs).select("row__", F.col("row__.doc_id").alias("id__"), F.xxhash64(text).alias("h__"), text.alias("text__"))
    found = saved(occurrences(rows, benchmark, window, limit).withColumnRenamed("id__", "i__").withColumnRenamed("h__", "g__"))
    size = found.agg(F.sum(48 + 16 * F.size("spans") + F.length(F.array_join("items", "________")))).first()[0]
    # Words are counted below the join, so that it carries no text that the caller doesn't ask for.
    counted = rows.select("row__", "id__", "h__", word_count(normalised(F.col("text__"))).alias("n__"))
    on = F.col("id__").eqNullSafe(F.col("i__")) & (F.col("h__") == F.col("g__"))
    both = counted.join(hinted(found, (size or 0) <= limit), on, "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    none = F.array().cast("array<struct<p:int,e:int>>")
    return unpacked(
        both,
        docs.columns,
        n_words=F.col("n__"),
        n_hit=F.coalesce(covered(F.col("spans")), F.lit(0).cast("long")),
        n_items=F.size(items).cast("long"),
        items_sha256=F.sha2(F.array_join(F.sort_array(items), ","), 256),
        contaminated=F.col("spans").isNotNull(),
        hit_spans=F.coalesce("spans", none),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without the words hit.

    A removed word goes with the gap before it; texts without hits stay as they are."""
    found = find_contamination(docs, benchmark, window)
    if remove == "documents":
        return found.where("not contaminated").select(*[f"`{c}`" for c in docs.columns])
    tokens = F.regexp_extract_all("text", F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), 0)
    inside = lambda i: F.exists("hit_spans", lambda s: (s["p"] <= i) & (i < s["e"]))
    tail = F.regexp_extract("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$", 0)
    left = F.concat(F.array_join(F.filter(tokens, lambda t, i: ~inside(i)), ""), tail)
    text = F.when(F.col("contaminated"), left).otherwise(F.col("text"))
    return found.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
