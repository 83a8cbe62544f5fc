"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms around them."""

from __future__ import annotations

import hashlib
import re
import string

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import hinted, packed, saved, small_enough, unpacked
from strataframe.llm.secret_scan import joined, masked

KINDS = ("email", "ip", "card", "phone", "term")
#: Fixed patterns of the contract.  Runs are possessive or begin at their border, so that very long
#: runs that fail cost linear time; neither changes what is found.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = string.ascii_letters + string.digits + "._%+-"
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
DIGITS = re.compile(r"[^0-9]")

#: Terms are runs of three letters or more within this many characters of an entity.
NEAR = 100
#: The pattern means the same to Spark, which counts terms over the corpus.
TERM = regex.compile(r"\p{L}{3,}")
#: A pair must be seen in this many different texts to be an estimate at all.
SUPPORT = 3
#: Part of an entity's information that a term may give away.
DISCLOSURE = 0.8


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the run of local characters before each @ that the domain pattern follows.

    @ is no local character, so each is looked at once, with what stands between it and the last."""
    found, done, i = [], 0, text.find("@")
    while i >= 0:
        left = text[done:i]
        start = done + len(left.rstrip(LOCAL))
        m = DOMAIN.match(text, i) if start < i else None
        if m:
            found.append((start, m.end()))
        done = m.end() if m else i + 1
        i = text.find("@", done)
    return found


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """Spans (start, number of the kind, end) of the four fixed kinds, sorted; null is empty."""
    if not text:
        return []
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        parts = m[0].split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = DIGITS.sub("", m[0]) if m.end() - m.start() <= 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def entity(text: str, span: tuple[int, int, int]) -> str:
    """The protected entity that a span names, alike however it is written."""
    a, kind, b = span
    value = text[a:b]
    return f"{KINDS[kind]}:{DIGITS.sub('', value) if kind >= 2 else value.lower()}"


def contexts(text: str, spans: list[tuple[int, int, int]]) -> tuple[list, list, list, list]:
    """Entities and the terms near them: parallel lists of entity, term, start, end.

    A term that any base span overlaps is left out; so is one that the border of the context cuts."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    for span in spans:
        low, high, name = max(0, span[0] - NEAR), min(len(text), span[2] + NEAR), entity(text, span)
        for m in TERM.finditer(text, low, high):
            a, b = m.span()
            if (a == low and a and text[a - 1].isalpha()) or (b == high and b < len(text) and text[b].isalpha()):
                continue
            if any(a < s[2] and s[0] < b for s in spans):
                continue
            for column, value in zip(out, (name, m[0].lower(), a, b), strict=True):
                column.append(value)
    return out


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, starts array<int>, kinds array<int>, ends array<int>, ents array<string>, near array<string>, terms array<string>, t_starts array<int>, t_ends array<int>"


def _examined(text: str | None) -> tuple:
    spans = base_spans(text)
    counts = [sum(s[1] == k for s in spans) for k in range(4)]
    sha = hashlib.sha256(joined(spans, KINDS).encode()).hexdigest()
    around = contexts(text, spans) if spans else ([], [], [], [])
    ents = sorted({entity(text, s) for s in spans})
    return (*counts, sha, [s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans], ents, *around)


def _examine(text: Column) -> Column:
    @F.pandas_udf(FOUND)
    def examine(texts: pd.Series) -> pd.DataFrame:
        names = [c.split()[0] for c in FOUND.split(", ")]
        return pd.DataFrame([_examined(t) for t in texts], columns=names)

    return examine(text)


def disclosing_terms(found: DataFrame, docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(entity, term) pairs in which the term gives away too much of the entity.

    With p taken over all different texts, a term t gives away PMI(c; t) = log p(c, t) / (p(c) p(t)) of the
    information IC(c) = -log p(c) of an entity c.  A pair counts if it stands in ``support`` different
    texts and PMI / IC reaches ``disclosure``.  Copies of one text are one observation in every p."""
    copies = saved(found.groupBy(F.col("h__").alias("k__")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    many, extra = copies.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))).first()
    n = found.count() - extra
    seen = saved(found.where("size(ents) > 0").select("h__", "ents", "near", "terms").dropDuplicates(["h__"]))
    pairs = seen.select("h__", F.explode(F.arrays_zip(F.col("near").alias("c"), F.col("terms").alias("t"))).alias("x")).select("h__", "x.c", "x.t").distinct()
    often = saved(pairs.groupBy("c", "t").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= support))
    ents = seen.select(F.explode("ents").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n_c"))
    # Each of k copies counts 1 / k, so that no text needs to move for it.  Words are counted before they
    # are joined, so the join has a row for each term, however many documents say it.
    texts = docs.join(hinted(copies, small_enough(many, 16)), F.col("h__") == F.col("k__"), "left").withColumn("part", 1 / F.coalesce("copies", F.lit(1)))
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("text__", F.lit("")), F.lit(TERM.pattern), F.lit(0)), lambda w: F.lower(w)))
    said = texts.select("part", F.explode(words).alias("t")).groupBy("t").agg(F.round(F.sum("part")).alias("n_t"))
    used = said.join(often.select("t").distinct(), "t")
    scored = often.join(used, "t").join(ents, "c")
    pmi = F.log(F.col("both") * float(n) / (F.col("n_c") * F.col("n_t")))
    info = F.log(float(n) / F.col("n_c"))
    return saved(scored.where((F.col("n_c") < n) & (pmi >= disclosure * info)).select("c", "t"))


def personal_data(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """One row for each of ``docs(doc_id, text)``: doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans, and the hash h__ of the text.

    A whole text is searched; offsets count code points, ends are exclusive.  Spans of kind ``term``
    are the method's: a disclosing term near the entity that it discloses.  Null and empty texts have
    no spans; rows equal in id and text share their terms; entities in every document disclose
    nothing; an empty table gives no rows."""
    rows = docs.select(F.col("doc_id").alias("id__"), F.col("text").alias("text__"), F.xxhash64("text").alias("h__"))
    found = saved(rows.select("id__", "h__", _examine(F.col("text__")).alias("f")).select("id__", "h__", "f.*"))
    pairs = disclosing_terms(found, rows, support, disclosure)
    zipped = F.arrays_zip(*[F.col(a).alias(b) for a, b in (("near", "c"), ("terms", "t"), ("t_starts", "a"), ("t_ends", "b"))])
    around = found.where("size(near) > 0").select("id__", "h__", F.explode(zipped).alias("x")).select("id__", "h__", "x.*")
    told = around.join(hinted(pairs, small_enough(pairs.count(), 256)), ["c", "t"])
    span = lambda a, k, b: F.struct(a.cast("int").alias("a"), k.cast("int").alias("k"), b.cast("int").alias("b"))
    own = told.groupBy(F.col("id__").alias("i__"), F.col("h__").alias("g__")).agg(F.collect_set(span(F.col("a"), F.lit(4), F.col("b"))).alias("more"))
    both = found.join(own, F.col("id__").eqNullSafe(F.col("i__")) & F.col("h__").eqNullSafe(F.col("g__")), "left")
    base = F.transform(F.arrays_zip("starts", "kinds", "ends"), lambda x: span(x["starts"], x["kinds"], x["ends"]))
    every = F.array_sort(F.concat(base, F.coalesce("more", F.array().cast("array<struct<a:int,k:int,b:int>>"))))
    kinds = F.array(*map(F.lit, KINDS))
    text = F.transform(every, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["a"].cast("string"), x["b"].cast("string")))
    return both.select(
        F.col("id__").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(text, ",").alias("spans"), "h__"
    )


def sanitise(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``docs`` with entities generalised to their kind, as in ``[email]``, and disclosing terms removed."""
    found = personal_data(docs.select("doc_id", "text"), support, disclosure).where("spans != ''")
    found = found.dropDuplicates(["doc_id", "h__"]).select(F.col("doc_id").alias("i__"), F.col("h__").alias("g__"), F.col("spans").alias("s__"))

    @F.pandas_udf("string")
    def clean(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, said):
            if not isinstance(said, str):
                return text
            parsed = sorted((int(a), KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in said.split(",")))
            return masked(text, parsed, lambda k: "" if k == 4 else f"[{KINDS[k]}]")

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    rows = packed(docs).withColumn("h__", F.xxhash64("row__.text"))
    both = rows.join(found, F.col("row__.doc_id").eqNullSafe(F.col("i__")) & (F.col("h__") == F.col("g__")), "left")
    out = unpacked(both, docs.columns, text=clean(F.col("row__.text"), F.col("s__")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
