"""The pipeline's stages on the small corpus: each judged on its own input."""

import random

import pytest

import corpus_pipeline
from strataframe.llm import language_id
from tests.llm.test_llm_operators import DOC, clashing, corpus, plain_words, words

BENCH = [(1, " ".join(words(random.Random(77), 30)))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = corpus(11, 40)
    rows.append((500, "before it " + BENCH[0][1] + " after it", "en", "s1", 0))
    rows += [(i, t, *rest) for i, t, *rest in rows[:3]]  # repeated rows
    spark.createDataFrame(rows, DOC).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, docs
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.saved(stage(spark, kept, folder))
        assert kept.columns == columns
        sizes.append(kept.count())
    judged = language_id.identify(docs).collect()
    lettered = [r for r in judged if r.text and any(c.isalpha() for c in r.text)]
    foreign = [r for r in lettered if len(r.text) >= corpus_pipeline.JUDGED and r.score < corpus_pipeline.LEAST_SCORE]
    assert sizes[1] == len(lettered) - len(foreign) and len(foreign) < 0.05 * len(lettered)
    assert sizes[2] < sizes[1] and sizes[3] == sizes[2] - 1 and sizes[4] != sizes[3]
    assert kept.where("doc_id = 500").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, kept, folder).collect()
    assert len(last) == sizes[4] and set(columns) <= set(last[0].asDict())
    for s in {r["shard"] for r in last}:
        slots = sorted(r.slot for r in last if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_language_decides(spark, folder):
    """A script that nothing taught goes, if there's enough of it; an unlabelled text gets its language."""
    rng = random.Random(4)
    plain = {"en": "an the er on re sh ti".split(), "fr": "ou be lo é ñi qua".split()}
    say = lambda lang, n: " ".join("".join(rng.choices(plain[lang], k=3)) for _ in range(n))
    rows = [(i, say(lang, 60), lang, None, None) for i, lang in enumerate(["en", "fr"] * 60)]
    rows += [(900, "Съешь ещё этих мягких французских булок " * 9, None, None, None), (901, "Привет", None, None, None), (902, say("fr", 60), None, "s", 1), (903, say("en", 60), "de", "s", 1), (904, say("en", 200_000), None, None, None)]
    kept = {r.doc_id: r for r in corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, DOC), folder).collect()}
    assert set(range(120)) | {901, 902, 903, 904} == set(kept)
    assert kept[902].lang == "fr" and kept[903].lang == "de" and kept[904].lang == "en" and kept[902].source == "s"
    unlabelled = spark.createDataFrame([(1, say("en", 80), None, None, None), (2, "12 34", None, None, None)], DOC)
    assert [(r.doc_id, r.lang) for r in corpus_pipeline.identify_language(spark, unlabelled, folder).collect()] == [(1, None)]


def test_run_and_empty_and_extra_columns(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clashing(docs).write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    for d in ("a", "b"):
        spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == corpus_pipeline.run(spark, f"{tmp_path}/a").count() > 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_no_benchmark_words_are_left(spark, folder):
    wins = set()
    w = plain_words(BENCH[0][1])
    wins.update(tuple(w[i : i + 10]) for i in range(len(w) - 9))
    for r in corpus_pipeline.run(spark, folder).collect():
        w = plain_words(r.text)
        assert not any(tuple(w[i : i + 10]) in wins for i in range(len(w) - 9))


def test_texts_are_judged_once(spark, folder, capsys):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    corpus_pipeline.identify_language(spark, docs, folder).explain()
    assert capsys.readouterr().out.count("ArrowEvalPython ") == 1
