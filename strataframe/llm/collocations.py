"""Collocations: phrases whose words stand together more often than the counts of their parts let expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.llm.common import hinted, saved, small_enough

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What ends a piece; a fixed value.  Words are parted by spaces and tabs.
BREAKS = r"[.,;:!?\x0A-\x0D]+"
UNKNOWN = "und"
#: Words of a piece whose phrases are made together; those that begin here end in the next stretch's words.
STRETCH = 4096
#: Bits of a filter's block, and blocks of a filter at most: 64 MB.
BLOCK_BITS, MOST_BLOCKS = 1 << 15, 1 << 14
#: Slices in which a language's phrases are ranked, before the slices' best are ranked together.
SLICES = 64


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _words(docs: DataFrame, max_n: int) -> DataFrame:
    """(lang, words, i): every word's place within its stretch of a piece, compiled generators only but for the cut
    into stretches; a stretch holds the words in which its last runs end as well."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang")
    lowered = F.replace(lower_ascii(F.col("text")), F.lit("\t"), F.lit(" "))
    pieces = docs.select(lang, F.explode(F.split(lowered, BREAKS)).alias("piece"))
    words = pieces.select("lang", F.array_remove(F.split("piece", " "), "").alias("words")).where(F.size("words") > 0)
    begins = F.sequence(F.lit(1), F.size("words"), F.lit(STRETCH))
    stretches = words.select("lang", F.explode(F.transform(begins, lambda i: F.slice("words", i, STRETCH + max_n - 1))).alias("words"))
    return stretches.select("lang", "words", F.posexplode("words").alias("i", "word")).where(F.col("i") < STRETCH).drop("word")


def _key(n: int) -> Column:
    """Language and n words from the place on, parted by a line break, which no phrase holds; null beyond the end."""
    parts = ["lang", F.lit("\n"), F.get("words", F.col("i"))]
    for k in range(1, n):
        parts += [F.lit(" "), F.get("words", F.col("i") + k)]
    return F.concat(*parts)


def _spot(words: list[Column], blocks: int) -> dict[str, Column]:
    """A run's block of a filter and its bit there, from one hash of language and words."""
    h = F.xxhash64("lang", *words)
    return {"block": F.pmod(h, F.lit(blocks)).cast("int"), "bit": F.pmod(F.shiftright(h, 32), F.lit(BLOCK_BITS)).cast("int")}


def _frequent_filter(phrases: DataFrame, n_words: int) -> tuple[DataFrame, int]:
    """(block, bits): a Bloom filter of ``phrases(lang, phrase)``, 16 bits each in blocks of 32,768, at most 64 MB in all.

    Beyond that more phrases share a bit: fewer runs are held back, none is lost."""
    n, blocks = phrases.count(), 1
    while blocks * BLOCK_BITS < 16 * n and blocks < MOST_BLOCKS:
        blocks *= 2
    words = F.split("phrase", " ")
    spot = _spot([F.get(words, F.lit(k)) for k in range(n_words)], blocks)
    marks = phrases.select(*[c.alias(name) for name, c in spot.items()])
    longs = marks.groupBy("block", F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, bit % 64))").alias("v"))
    held = longs.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda at: F.coalesce(F.element_at("m", at), F.lit(0).cast("long")))
    return saved(held.select("block", every.alias("bits"))), blocks


def _passed(rows: DataFrame, words: list[Column], found: tuple[DataFrame, int]) -> DataFrame:
    """The rows whose run of ``words`` the filter may hold."""
    bits, blocks = found
    looked_up = rows.withColumns(_spot(words, blocks)).join(F.broadcast(bits), "block")
    return looked_up.where(F.expr("getbit(bits[bit div 64], bit % 64) = 1")).drop("block", "bit", "bits")


def phrase_counts(docs: DataFrame, max_n: int = 3, least: int = 10) -> DataFrame:
    """(lang, phrase, f): how often each run of 1..max_n words occurs within pieces, overlaps included.

    Runs are exploded into rows, counted where they are read and again after one exchange by language and
    phrase.  Words and pairs come first; a longer run is exploded only where both runs of one word less that it
    holds may be frequent, by a broadcast filter of bounded size that lets no frequent one out, as a run occurs
    no more often than its parts.  Of runs of two words or more only those that occur ``least`` times are given."""
    placed = _words(docs, max_n)

    def counted(keys: DataFrame) -> DataFrame:
        counts = keys.where(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("f"))
        phrase = F.substring_index("key", "\n", -1)
        parted = counts.select(F.expr("left(key, length(key) - length(substring_index(key, '\n', -1)) - 1)").alias("lang"), phrase.alias("phrase"), "f")
        return saved(parted.where((F.col("f") >= least) | ~F.contains("phrase", F.lit(" "))))

    found = now = counted(placed.select(F.explode(F.array(*[_key(n) for n in range(1, min(max_n, 2) + 1)])).alias("key")))
    for n in range(3, max_n + 1):
        shorter = now.where((F.col("f") >= least) & (F.size(F.split("phrase", " ")) == n - 1))
        known = _frequent_filter(shorter, n - 1)
        runs = placed.where(F.col("i") + n <= F.size("words"))
        for first in (0, 1):
            runs = _passed(runs, [F.get("words", F.col("i") + k) for k in range(first, first + n - 1)], known)
        now = counted(runs.select(_key(n).alias("key")))
        found = found.unionByName(now)
    return found


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, keep_percent: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language of ``docs(text, lang)``: lang, rank, phrase, a, l, r, n, score.

    Candidates are phrases of 2..max_n words that occur a >= ``least`` times.  Cut after its first k words, a phrase
    scores floor(10**6 a a / (l r)), l and r being the counts of both parts, in whole numbers of 38 digits;
    the lowest cut counts, the smallest k of equal ones.  A candidate goes if a longer one that contains it
    occurs ``keep_percent`` of its times or more: as counts only fall with length, longer ones by one word decide.
    Ties in score fall to the greater a, then to the phrase by UTF-8 bytes.  A null text has no words, a null
    language is ``und``; repeated rows count each time; texts of any length are taken in stretches of words;
    an empty table gives no rows; other columns are ignored."""
    return ranked_phrases(phrase_counts(docs, max_n, least), least, keep_percent, top)


def ranked_phrases(counts: DataFrame, least: int, keep_percent: int, top: int) -> DataFrame:
    """The phrases of ``collocations`` from the counts of ``phrase_counts``."""
    n_words = counts.where(~F.contains("phrase", F.lit(" "))).groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = counts.where(F.col("f") >= least)
    words = F.split("phrase", " ")
    candidates = frequent.where(F.contains("phrase", F.lit(" "))).select("lang", "phrase", F.col("f").alias("a"))

    longer = candidates.where(F.size(words) > 2)
    without_last = F.array_join(F.slice(words, 1, F.size(words) - 1), " ")
    without_first = F.array_join(F.slice(words, 2, F.size(words) - 1), " ")
    inside = longer.select("lang", F.explode(F.array(without_last, without_first)).alias("phrase"), F.col("a").alias("f"))
    extended = inside.groupBy("lang", "phrase").agg(F.max("f").alias("f")).alias("e")
    covered = (F.col("c.lang") == F.col("e.lang")) & (F.col("c.phrase") == F.col("e.phrase")) & (F.col("e.f") * 100 >= F.col("c.a") * keep_percent)
    left = candidates.alias("c").join(extended, covered, "left_anti")

    small = small_enough(frequent.count(), 150)
    parts = [hinted(frequent.select("lang", F.col("phrase").alias(part), F.col("f").alias(count)), small) for part, count in (("first", "l"), ("rest", "r"))]
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(words) - 1)))
    cuts = cuts.withColumns({"first": F.array_join(F.slice(words, 1, F.col("k")), " "), "rest": F.array_join(F.slice(words, F.col("k") + 1, F.size(words)), " ")})
    whole = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "l", "r")}
    scored = cuts.join(parts[0], ["lang", "first"]).join(parts[1], ["lang", "rest"]).withColumns({f"{c}_": v for c, v in whole.items()})
    scored = scored.withColumn("score", F.expr("(cast(1000000 as decimal(38,0)) * a_ * a_) div (l_ * r_)"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.*")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SLICES))).orderBy(*order)
    best = lowest.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(n_words) if small_enough(n_words.count(), 100) else n_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
