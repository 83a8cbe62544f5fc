"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.llm.common import packed, saved, unpacked
from strataframe.llm.shingles import slices

#: n-grams of 1 to 3 characters; the most frequent 300 of a text and of a language are ranked.
ORDERS, TOP = (1, 2, 3), 300
#: About this many labelled documents, chosen by hash, teach the profiles of each language.
SAMPLE = 4000
#: Texts whose n-grams a task holds at once.
TOGETHER = 64
UNKNOWN = "und"
#: Character codes take 21 bits each in an n-gram; this one stands for a run of other characters.
BITS, GAP = 21, 1


@cache
def _letters() -> np.ndarray:
    """For every code point its lower-case letter's code, or GAP."""
    table = np.full(0x110000, GAP, np.int64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            table[i] = ord(c.lower()[0])
    return table


def ngrams(text: str | None) -> np.ndarray:
    """All n-grams of a whole text as integers; empty if it has no letter."""
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _letters()[points]
    if codes.max(initial=GAP) == GAP:
        return np.empty(0, np.int64)
    codes = np.concatenate(([GAP], codes, [GAP]))
    codes = codes[np.append(True, (codes[1:] != GAP) | (codes[:-1] != GAP))]
    found, gram = [codes[codes != GAP]], codes
    for n in range(2, max(ORDERS) + 1):
        gram = (gram[:-1] << BITS) | codes[n - 1 :]
        found.append(gram)
    return np.concatenate(found)


def ranked(text: str | None) -> np.ndarray:
    """The most frequent n-grams of a text, first the most frequent, ties by code."""
    grams, counts = np.unique(ngrams(text), return_counts=True)
    if len(grams) > TOP:  # ties at the border need all that are as frequent
        least = np.partition(counts, len(counts) - TOP)[len(counts) - TOP]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.argsort(-counts, kind="stable")][:TOP]


def _count(batches):
    """Counts of n-grams by language, summed over a task's texts."""
    totals: dict[str, dict[int, int]] = {}
    for part in (part for batch in batches for part in slices(batch)):
        for lang, texts in part.to_pandas().groupby("lang")["text"]:
            own = totals.setdefault(lang, {})
            for first in range(0, len(texts), TOGETHER):
                held = [ngrams(t) for t in texts.iloc[first : first + TOGETHER]]
                grams, counts = np.unique(np.concatenate(held), return_counts=True)
                for g, n in zip(grams.tolist(), counts.tolist(), strict=True):
                    own[g] = own.get(g, 0) + n
    for lang, own in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], names=["lang", "gram", "n"])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn_profiles(docs: DataFrame, sample: int = SAMPLE) -> dict[str, list[int]]:
    """``docs(doc_id, text, lang)`` -> each language's ranked n-grams.

    Held-out documents and null languages teach nothing.  Of a language with more than ``sample``
    documents, a share of about that many is chosen by the hash of doc_id.  The profiles, 300 numbers
    a language, are all that comes to the driver."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("all"))
    part = F.pmod(F.xxhash64(F.lit("profile"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.join(F.broadcast(sizes), "lang").where(part < F.lit(sample) / F.col("all")).select("lang", "text")
    counts = chosen.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("place", place).where(F.col("place") <= TOP)
    rows = best.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "gram"))).alias("best")).collect()
    return {r.lang: [x.gram for x in r.best] for r in rows}


def classifier(profiles: dict[str, list[int]]):
    """text -> (language, score): the least out-of-place distance; ties go to the first by name."""
    langs = sorted(profiles)
    codes = np.unique(np.array([g for v in profiles.values() for g in v], np.int64))
    places = np.full((len(codes) + 1, max(1, len(langs))), -1, np.int64)  # the last row: in no profile
    for j, lang in enumerate(langs):
        places[np.searchsorted(codes, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def classify(text: str | None) -> tuple[str, float]:
        grams = ranked(text)
        if not len(grams) or not langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(codes, grams)
        at[at == len(codes)] = len(codes) - 1
        at = np.where(codes[at] == grams, at, len(codes))
        there = places[at]
        out = np.where(there < 0, TOP, np.abs(there - np.arange(len(grams))[:, None])).sum(0)
        best = int(out.argmin())
        return langs[best], 1.0 - float(out[best]) / (TOP * len(grams))

    return classify


def identify(docs: DataFrame, profiles: dict[str, list[int]] | None = None, sample: int = SAMPLE) -> DataFrame:
    """All columns of ``docs(doc_id, text, lang, ...)`` and held_out, lang_pred, score.

    Only the text decides, read whole.  ``score`` is 1 less the distance's share of its maximum.
    A text that is null or has no letter, or any text if nothing was learned, gets "und" and 0;
    a null doc_id counts as not held out; repeated rows get equal results."""
    if profiles is None:
        profiles = learn_profiles(docs.select("doc_id", "text", "lang"), sample)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    made: list = []

    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(classifier(shared.value))
        found = [made[0](t) for i in range(0, len(texts), TOGETHER) for t in texts.slice(i, TOGETHER).to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64()))], ["lang", "score"])

    # Were it deterministic to the planner, a filter on the result would judge each text again, in a second worker.
    rows = packed(docs).withColumn("p__", predict.asNondeterministic()(F.col("row__.text")))
    return unpacked(
        rows,
        docs.columns,
        held_out=held_out(F.col("row__.doc_id")),
        lang_pred=F.col("p__.lang"),
        score=F.col("p__.score"),
    )


def accuracy(found: DataFrame) -> DataFrame:
    """Held-out accuracy of ``found(lang, lang_pred, held_out)``: one row n, right, accuracy."""
    own = saved(found.where("held_out and lang is not null").select((F.col("lang") == F.col("lang_pred")).alias("ok")))
    return own.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("long")).alias("right"), F.avg(F.col("ok").cast("double")).alias("accuracy"))
