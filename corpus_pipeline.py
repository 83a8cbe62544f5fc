"""The corpus pipeline: stages that turn ``documents`` into a deduplicated, mixed and sharded corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm import decontaminate, language_id, mixing, near_dedup, sharding
from strataframe.llm.common import saved


#: A text of at least so many characters whose best score is below the second number is in no known language: it
#: lies farther from every profile than three quarters of the greatest distance.
JUDGED, LEAST_SCORE = 200, 0.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts, those without a letter, and those that fit no learned profile
    (see ``LEAST_SCORE``); shorter ones are too little to tell and stay.  A null ``lang`` becomes the predicted one.

    On a table without a label nothing is learned; then only texts without a letter go.  Texts of any length are
    judged whole, and repeated rows alike."""
    found = language_id.identify(docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text", "lang"))
    learned = F.col("lang_pred") != language_id.UNKNOWN
    foreign = learned & (F.length("text") >= JUDGED) & (F.col("score") < LEAST_SCORE)
    kept = found.where(F.col("text").rlike(r"\p{L}") & ~foreign)
    lang = F.coalesce("doc.lang", F.when(learned, F.col("lang_pred")))
    return kept.select(*[lang.alias(c) if c == "lang" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of least doc_id.

    Texts without a word and rows without an id stay; of rows equal in id and text one stays.  Texts of any
    length are compared whole."""
    return near_dedup.deduplicate(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.  Null texts, and all texts if the benchmark is empty, stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's rate says; a null source is one of its own.

    Copies have equal rows, and rows that share an id share its chance of one more copy."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes, rows numbered within each; null texts take one byte, equal rows
    follow each other."""
    return sharding.shard_documents(docs, 8)


STAGES = [
    ("language identification", identify_language),
    ("near-duplicate removal", remove_near_copies),
    ("benchmark decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
