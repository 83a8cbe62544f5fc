"""Merkle manifest, collocations and exact copies against plain Python, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataframe.llm import collocations, exact_dedup, merkle
from strataframe.llm.queries import op11_merkle_manifest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame(rows, DOC)


def clashing(df):
    names = ["keep_id", "kept", "sha__", "row__", "tree", "at", "n", "digest", "place", "level", "block", "phrase", "a", "f", "rank", "words", "mark"]
    return df.withColumns({n: F.lit("mine") for n in names})


# exact copies


def copies(seed=5):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("ab \né", k=rng.randint(0, 6))) for _ in range(400)] + ["hot"] * 700 + [None] * 5 + [""] * 5 + ["x" * 3_000_000] * 2 + [f"only {i}" for i in range(300)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, "hot", None, None, None), (None, "no id", None, None, None), (None, "no id", None, None, None), (3, texts[3], None, None, None)]
    rng.shuffle(rows)
    return rows


def groups_of(rows):
    by = {}
    for i, t, *_ in rows:
        by.setdefault(t or "", []).append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in by.items()}


@pytest.mark.parametrize("limit", [None, 0])
def test_exact_groups_equal_brute_force(spark, monkeypatch, limit):
    """Also without any broadcast of measured size: the filter joined by block, small groups by a shuffle."""
    if limit is not None:
        monkeypatch.setattr(exact_dedup, "small_enough", lambda *_: False)
    rows = copies()
    want = groups_of(rows)
    found = exact_dedup.exact_groups(clashing(frame(spark, rows)), carry=("doc_id", "text", "keep_id")).collect()
    assert len(found) == len(rows)
    stays = Counter()
    for r in found:
        keep, size = want[r.text or ""]
        assert (r.keep_id, r.group_size, r.text_sha256) == (keep, size, sha(r.text or ""))
        if r.kept:
            stays[r.text or ""] += 1
            assert r.doc_id == keep
    assert stays == dict.fromkeys(want, 1)


def test_deduplicate_keeps_one_row_of_each_text(spark):
    rows = copies()
    want = groups_of(rows)
    df = clashing(frame(spark, rows))
    left = exact_dedup.deduplicate(df)
    assert left.columns == df.columns
    got = [(r.text or "", r.doc_id) for r in left.collect()]
    assert sorted(got, key=repr) == sorted(((t, k) for t, (k, _) in want.items()), key=repr)
    empty = frame(spark, [])
    assert exact_dedup.exact_groups(empty).count() == exact_dedup.deduplicate(empty).count() == 0


def test_filter_clears_most_single_texts_and_no_copy(spark):
    rows = [(i, f"text {i if i % 10 else i // 20}", None, None, None) for i in range(20_000)]
    keyed = frame(spark, rows).select(exact_dedup.text_digest(F.col("text")).alias("sha__"), "text")
    flagged = exact_dedup._flagged(keyed, exact_dedup._filter_of(keyed.select("sha__"))).groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("maybe__").alias("m")).collect()
    assert all(r.m for r in flagged if r.n > 1)
    single = [r.m for r in flagged if r.n == 1]
    assert len(single) > 10_000 and sum(single) < 0.1 * len(single)


# Merkle manifest


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 16])) for i in range(0, len(now), 16)])
    return levels


def siblings(levels, at):
    for now in levels[:-1]:
        low = at // 16 * 16
        yield now[low:at], now[at + 1 : low + 16]
        at //= 16


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def ascii_lower(text):
    return None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)


def manifest(rows):
    trees = {}
    for i, text, lang, source, n in rows:
        trees.setdefault(source, []).append((i, leaf_of((i, source, lang, n, text)), text, lang, n))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        built[s] = climb([x[1] for x in trees[s]])
    top = climb([built[s][-1][0] for s in order])
    out = []
    for t, s in enumerate(order):
        for at, (i, leaf, text, lang, n) in enumerate(trees[s]):
            path = [*siblings(built[s], at), *siblings(top, t)]
            tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
            node = leaf_of((i, s, lang, n, ascii_lower(text))) if tampered else leaf
            for before, after in path:
                node = sha("".join([*before, node, *after]))
            proof = sha("".join("".join([*b, *a]) for b, a in path))
            out.append((i, leaf, built[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


@pytest.mark.parametrize("case", ["many", "one", "hot", "sources"])
def test_manifest_equals_brute_force(spark, case):
    rng = random.Random(4)
    text = lambda: rng.choice([None, "", "Aé", "abc", "ÉCOLE Zz\n", "long " * rng.randint(0, 50)])
    row = lambda i, s: (i, text(), rng.choice(["en", None]), s, rng.choice([None, 0, 12]))
    if case == "many":
        rows = [row(rng.randint(0, 300), rng.choice(["a", "b", "é", "", None, "src10", "src9"])) for _ in range(600)] + [row(None, "a") for _ in range(3)]
        rows += rows[:20] + [(7, "Q" * 2_000_000, "en", "b", None)]
    elif case == "one":
        rows = [row(3, None)]
    elif case == "hot":
        rows = [row(i, "hot") for i in range(4500)] + [row(i, f"s{i % 3}") for i in range(257)] + [row(i, "sixteen") for i in range(16)] + [row(i, "seventeen") for i in range(17)]
    else:
        rows = [row(i, f"s{i}") for i in range(300)]
    want = manifest(rows)
    got = [tuple(r) for r in op11_of(clashing(frame(spark, rows))).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(r[6] for r in want) == (case in ("one",)) or not all(r[6] for r in want)


def op11_of(df):
    changed = merkle.leaf_digest([F.col(c) if c != "text" else collocations.lower_ascii(F.col("text")) for c in merkle.FIELDS])
    return merkle.verify_rows(df, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, changed))


def test_manifest_has_one_path_above_each_block(spark, monkeypatch):
    """A tree of 17 to 256 leaves beside a larger one ends at level 2; it must not leave a second, null path there, of
    which the order of shuffled rows would take either."""
    seen = []

    def watched(df):
        out = merkle_saved(df)
        if "path" in out.columns:
            seen.append(out.where("path is null or roots is null").count())
        return out

    merkle_saved = merkle.saved
    monkeypatch.setattr(merkle, "saved", watched)
    rows = [(i, f"T{i}", "en", "big" if i < 300 else "mid" if i < 340 else "small", i) for i in range(345)]
    assert sorted(map(tuple, op11_of(frame(spark, rows)).collect()), key=repr) == sorted(manifest(rows), key=repr)
    assert len(seen) == 2 and not any(seen)


def test_manifest_of_an_empty_table(spark):
    assert op11_of(frame(spark, [])).count() == 0
    assert merkle.verify_rows(frame(spark, [(1, "a", None, None, None)])).first().verified
    assert op11_merkle_manifest is not None


# collocations


def phrases(rows, max_n=3, least=10, keep=50, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {}
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inside = lambda x, y: any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1))
    for (lang, p), a in candidates.items():
        if any(other == lang and len(q) > len(p) and 100 * b >= keep * a and inside(p, q) for (other, q), b in candidates.items()):
            continue
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, own in found.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1))


def told(rows=None, seed=8):
    rng = random.Random(seed)
    fixed = ["new york city", "New\tYork", "on the other hand", "É é E", "a a a a a", "of the", "the end of the"]
    rows = []
    for i in range(500):
        parts = rng.choices([*fixed, *"the of and x Y zz été".split()], k=rng.randint(0, 20))
        rows.append((i, rng.choice([" ", "  ", ", ", "\n"]).join(parts), rng.choice(["en", "fr", None]), None, None))
    return rows + [(1, None, "en", None, None), (1, "", None, None, None), (1, "...  \t", "de", None, None), rows[0], rows[0]]


@pytest.mark.parametrize(("max_n", "keep", "top"), [(3, 50, 2000), (4, 80, 7), (2, 50, 3)])
def test_collocations_equal_brute_force(spark, max_n, keep, top):
    rows = told()
    got = [tuple(r) for r in collocations.collocations(clashing(frame(spark, rows)), max_n=max_n, keep_percent=keep, top=top).collect()]
    want = phrases(rows, max_n=max_n, keep=keep, top=top)
    assert sorted(got) == want and len(want) >= 3


def test_collocations_of_long_pieces_and_none(spark, monkeypatch):
    monkeypatch.setattr(collocations, "STRETCH", 5)
    monkeypatch.setattr(collocations, "small_enough", lambda *_: False)
    rows = told(seed=9) + [(9, "in one breath " * 3000, "en", None, None)]
    got = sorted(tuple(r) for r in collocations.collocations(frame(spark, rows)).collect())
    assert got == phrases(rows)
    assert collocations.collocations(frame(spark, [])).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    """10**6 a a passes 64 bits here; doubles would round the quotient."""
    counts = spark.createDataFrame([("en", "x y", 6_000_000_007), ("en", "x", 6_000_000_011), ("en", "y", 6_000_000_013)], "lang string, phrase string, f long")
    found = collocations.ranked_phrases(counts, 10, 50, 2000).first()
    assert found.score == 10**6 * 6_000_000_007**2 // (6_000_000_011 * 6_000_000_013) and found.n == 12_000_000_024
