"""Secret scans: fixed patterns, and a guess-cost dynamic program over values in credential context."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.llm import exact_dedup
from strataframe.llm.common import hinted, saved, small_enough, unpacked

#: Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more; shorter runs fail and touch no other
KINDS = ("assign", "access", "hex", "guess")

#: Credential context of the method: a name, a sign, and a value up to white space or a quote.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|(?:api|access|private|client)[_-]?(?:key|secret))["']?\x20*(?:[:=]|=>)\x20*(["']?)([^\s"'<>,;]+)""",
    re.I | re.A,
)
HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "key")

#: A value that takes 10**10 guesses or more counts as a secret.
LEAST_DIGITS = 10.0
#: Different texts in which a word of the learned dictionary stands at least.
LEAST_DOCUMENTS = 3
#: Letters of a dictionary word.
SHORTEST, LONGEST = 3, 20
LETTERS = re.compile(rf"[^\W\d_]{{{SHORTEST},}}")

#: Frequent words of passwords and of prose, most frequent first.
WORDS = (
    "password 123456 qwerty letmein admin welcome monkey dragon master login abc123 football baseball iloveyou "
    "sunshine princess shadow superman michael jordan charlie secret test guest root user default changeme "
    "example sample demo token key api your enter here value none null true false string placeholder required "
    "the and that have for not with you this but his from they say her she will one all would there their what "
    "out about who get which when make can like time just him know take people into year good some could them "
    "see other than then now look only come its over think also back after use two how our work first well way "
    "even new want because any these give day most love summer winter spring autumn monday friday home house "
    "hello world computer internet server database system service public private access account"
).split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
#: Rows of keyboards.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm", "azertyuiop", "abcdefghijklmnopqrstuvwxyz")
NEXT = {(a, b) for row in ROWS for a, b in [*zip(row, row[1:], strict=False), *zip(row[1:], row, strict=False)]}
DATES = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._](?:0[1-9]|1[0-2])[-/._](?:19|20)\d\d")
#: Lengths of a date.
DATE_SIZES = (4, 6, 7, 8, 9, 10)
LEET = str.maketrans("430157@$!", "aeoistasi")


def _alphabet(value: str) -> float:
    """Digits (log10) of guesses for one character by brute force, from the kinds of character there."""
    size = 0
    for test, n in ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10)):
        size += n * any(map(test, value))
    size += 33 * any(not c.isalnum() for c in value)
    return math.log10(max(size, 10))


class _Starts:
    """Starts of segments whose cost is cost[start] + log10(units) for growing units.

    A later start that is no better when it enters never is, and an earlier one that costs as much
    never again is; so few are held, however long the run."""

    def __init__(self):
        self.held: list[tuple[int, float]] = []

    def least(self, end: int, unit: int) -> float:
        return min((c + math.log10((end - s) / unit) for s, c in self.held), default=math.inf)

    def add(self, start: int, cost: float, end: int, unit: int) -> None:
        if cost + math.log10((end - start) / unit) < self.least(end, unit):
            self.held = [x for x in self.held if x[1] < cost] + [(start, cost)]


def guess_digits(value: str, ranks: dict[str, int] = RANK, enough: float = math.inf) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` takes.

    ``cost[i]`` is the least cost of the first i characters, over all last segments: a character by
    brute force; a word of ``ranks`` of up to LONGEST letters (also with capitals, or digits for
    letters); a date; one character said three times or more, or a longer unit said twice or more,
    the unit by brute force; a walk of three keys or more over the keyboard.  Each segment but brute
    force adds log10(2) for its place.  Any result of ``enough`` or more only says that the least
    cost is no less than ``enough``; a unit that costs as much on its own needn't be tried, and no
    more characters once all that may go on costs as much."""
    n, one, step = len(value), _alphabet(value), math.log10(2)
    most = n // 2 if enough == math.inf else min(n // 2, math.ceil(enough / one))
    low = value.lower() if len(value.lower()) == n else value
    plain, cost = low.translate(LEET), [0.0]
    walk, walks, streak = 0, _Starts(), [0] * (most + 1)
    units: list[dict[int, _Starts]] = [{} for _ in range(most + 1)]
    for end in range(1, n + 1):
        best = cost[end - 1] + one
        for size in range(SHORTEST, min(LONGEST, end) + 1):
            word = low[end - size : end]
            rank = ranks.get(word) or ranks.get(plain[end - size : end], 0) * 4
            if rank:
                capital = step if word != value[end - size : end] else 0.0
                best = min(best, cost[end - size] + math.log10(rank + 1) + capital + step)
        if value[end - 1].isdigit():
            for size in DATE_SIZES:
                if size <= end and DATES.fullmatch(value, end - size, end):
                    best = min(best, cost[end - size] + math.log10(365 * 119) + step)
        if end > 1 and (low[end - 2], low[end - 1]) not in NEXT:
            walk, walks = end - 1, _Starts()
        if end - 3 >= walk:
            walks.add(end - 3, cost[end - 3], end, 1)
            best = min(best, walks.least(end, 1) + math.log10(47) + step)
        for unit in range(1, most + 1):
            if end <= unit or value[end - 1] != value[end - 1 - unit]:
                if streak[unit]:
                    streak[unit], units[unit] = 0, {}
                continue
            streak[unit] += 1
            times = 3 if unit == 1 else 2
            if streak[unit] >= (times - 1) * unit:
                starts = units[unit].setdefault(end % unit, _Starts())
                starts.add(end - times * unit, cost[end - times * unit], end, unit)
                best = min(best, starts.least(end, unit) + unit * one + step)
        cost.append(best)
        if best >= enough and end > 2 * most + LONGEST and min(cost[-2 * most - LONGEST :]) >= enough:
            going = [walks, *(x for each in units for x in each.values())]
            if all(c >= enough for x in going for _, c in x.held):
                break
    return cost[-1]


def letter_words(value: str) -> set[str]:
    """All words a dictionary may hold that stand in a value: runs of 3 to 20 letters, also as digits for letters."""
    low = value.lower() if len(value.lower()) == len(value) else value
    found = set()
    for text in {low, low.translate(LEET)}:
        for run in LETTERS.finditer(text):
            a, b = run.span()
            found.update(text[s : s + n] for s in range(a, b - SHORTEST + 1) for n in range(SHORTEST, min(LONGEST, b - s) + 1))
    return found


def corpus_ranks(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(word, rank) of all words of 3 to 20 letters that stand in ``least`` different texts of ``docs(text)`` or more.

    Texts that are equal count once, and what stands in credential context doesn't count at all, or a secret
    that was copied would turn into a word.  A word's rank follows the fixed list's: one more than the words
    that stand in more texts.  All words are counted, and none leaves Spark."""
    texts = exact_dedup.deduplicate(docs.select(F.lit(0).alias("doc_id"), "text"))
    prose = F.regexp_replace("text", f"(?i){CONTEXT.pattern}", " ")
    words = F.array_distinct(F.split(F.lower(prose), r"[^\p{L}]+"))
    said = texts.select(F.explode(words).alias("word")).where(F.length("word").between(SHORTEST, LONGEST))
    often = saved(said.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & ~F.col("word").isin(list(RANK))))
    down = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)  # over one row a frequency
    classes = often.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    ranks = classes.select("n", (F.lit(len(RANK) + 1) + F.coalesce(F.sum("k").over(down), F.lit(0))).alias("rank"))
    return often.join(ranks, "n").select("word", "rank")


def _judged(values: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """(key) of the ``values(key, value)`` that take 10**least guesses or more, each with its own part of the dictionary.

    Words only make a value cheaper, so those that the fixed list alone makes cheap are settled first.  Of the
    rest all words that may stand in them are listed and looked up among the corpus's, so what a task gets is
    one value's own words."""

    @F.pandas_udf("boolean")
    def dear(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: guess_digits(t, RANK, least) >= least)

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, value in zip(frame["key"], frame["value"], strict=True):
                words = sorted(letter_words(value) - RANK.keys())
                for a in range(0, len(words), 50_000):
                    yield pd.DataFrame({"key": key, "word": words[a : a + 50_000]})

    @F.pandas_udf("boolean")
    def still_dear(texts: pd.Series, words: pd.Series, ranks: pd.Series) -> pd.Series:
        own = [RANK | dict(zip(w, map(int, r), strict=True)) for w, r in zip(words, ranks, strict=True)]
        return pd.Series([guess_digits(t, o, least) >= least for t, o in zip(texts, own, strict=True)], dtype=bool)

    open_ = saved(values.where(dear("value")))
    if open_.isEmpty():
        return open_.select("key")
    pieces = open_.mapInPandas(listed, "key string, word string")
    known = pieces.join(corpus_ranks(docs), "word").groupBy("key").agg(F.collect_list(F.struct("word", "rank")).alias("own"))
    both = open_.join(known, "key", "left").withColumn("own", F.coalesce("own", F.expr("cast(array() as array<struct<word: string, rank: bigint>>)")))
    return both.where(still_dear("value", "own.word", "own.rank")).select("key")


def examine(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str]]]:
    """Base spans (start, number of the kind, end) of a whole text, and (start, end, value) of its credential contexts."""
    if not text:
        return [], []
    low, found, values = text.lower(), [], []
    if any(h in low for h in ("password", "passwd", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(h in low for h in HINTS):
        values = [(m.start(2), m.end(2), m[2]) for m in CONTEXT.finditer(text) if len(m[2]) >= 6]
    return sorted(found), values


def scan(text: str | None, least: float = LEAST_DIGITS, ranks: dict[str, int] = RANK) -> list[tuple[int, int, int]]:
    """All spans (start, number of the kind, end) of a whole text by one dictionary, sorted; null is empty."""
    found, values = examine(text)
    return sorted(found + [(a, 3, b) for a, b, value in values if guess_digits(value, ranks, least) >= least])


def joined(spans: list[tuple[int, int, int]], kinds=KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def digest(spans: list[tuple[int, int, int]], n_base: int, kinds) -> tuple:
    """Counts of the base kinds, sha256 of the base spans, and all spans as text."""
    base = [x for x in spans if x[1] < n_base]
    counts = [sum(x[1] == k for x in base) for k in range(n_base)]
    return (*counts, hashlib.sha256(joined(base, kinds).encode()).hexdigest(), joined(spans, kinds))


def _examined(texts: pd.Series) -> pd.DataFrame:
    rows = [examine(t) for t in texts]
    return pd.DataFrame({"base": [[{"a": a, "k": k, "b": b} for a, k, b in r[0]] for r in rows], "contexts": [[{"a": a, "b": b, "value": v} for a, b, v in r[1]] for r in rows]})


def spans_of(docs: DataFrame, carry: Sequence[str], least_digits: float = LEAST_DIGITS, learn: bool = True) -> DataFrame:
    """(row__, spans__): the ``carry`` columns of ``docs(text, ...)``, and all spans as sorted (a, k, b).

    Texts are searched once; a table of carried columns, base spans and credential values is written.
    Every different value is judged once, by the fixed words and those that ``docs`` teach (only the fixed ones
    if not ``learn``).  Rows without a value aren't shuffled again; the others get back which of theirs are
    secrets, joined by the value's hash, broadcast if that's small by measure."""
    kept = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row__")
    find = F.pandas_udf(_examined, "base array<struct<a: long, k: int, b: long>>, contexts array<struct<a: long, b: long, value: string>>")
    rows = saved(docs.select(kept, find("text").alias("f__"), F.monotonically_increasing_id().alias("mark__")))
    none = F.size("f__.contexts") == 0
    held = rows.where(~none).select("mark__", F.explode("f__.contexts").alias("c")).select("mark__", "c.a", "c.b", "c.value", F.sha2("c.value", 256).alias("key"))
    values = saved(held.groupBy("key").agg(F.first("value").alias("value")))
    if learn:
        secrets = saved(_judged(values, docs.select("text"), least_digits))
    else:
        least = least_digits
        dear = F.pandas_udf(lambda texts: texts.map(lambda t: guess_digits(t, RANK, least) >= least), "boolean")
        secrets = saved(values.where(dear("value")).select("key"))
    small = small_enough(secrets.count(), 100)
    guessed = held.join(hinted(secrets, small), "key").groupBy("mark__").agg(F.collect_list(F.struct("a", F.lit(3).alias("k"), "b")).alias("g__"))
    with_values = rows.where(~none).join(guessed, "mark__", "left")
    every = F.array_sort(F.concat("f__.base", F.coalesce("g__", F.expr("cast(array() as array<struct<a: bigint, k: int, b: bigint>>)"))))
    return rows.where(none).select("row__", F.col("f__.base").alias("spans__")).unionByName(with_values.select("row__", every.alias("spans__")))


def find_secrets(docs: DataFrame, least_digits: float = LEAST_DIGITS, learn: bool = True, carry: Sequence[str] | None = None) -> DataFrame:
    """The ``carry`` columns (all if none are named) of ``docs(text, ...)`` and n_assign, n_access, n_hex, base_sha256, spans.

    Offsets count code points, ends are exclusive; the method's own spans have kind ``guess``.
    Whole texts of any length are searched, and values of any length judged.  Null and empty texts have no
    spans; repeated rows get equal results; an empty table gives no rows."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def told(spans: pd.Series) -> pd.DataFrame:
        rows = [digest([(s["a"], s["k"], s["b"]) for s in own], 3, KINDS) for own in spans]
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    columns = list(docs.columns if carry is None else carry)
    rows = spans_of(docs, columns, least_digits, learn).withColumn("d__", told("spans__"))
    names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    return unpacked(rows, columns, **{c: F.col(f"d__.{c}") for c in names})


def mask_secrets(docs: DataFrame, mark: str = "[secret]", least_digits: float = LEAST_DIGITS, learn: bool = True) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; overlapping spans merge."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series, spans: pd.Series) -> pd.Series:
        made = [t if t is None else masked(t, [(s["a"], s["k"], s["b"]) for s in own], lambda _: mark) for t, own in zip(texts, spans, strict=True)]
        return pd.Series(made, dtype=object)

    rows = spans_of(docs, docs.columns, least_digits, learn)
    text = mask(F.col("row__.text"), F.col("spans__"))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"row__.`{c}`").alias(c) for c in docs.columns])


def masked(text: str, spans: list[tuple[int, int, int]], mark) -> str:
    """``text`` with the union of the sorted spans replaced; ``mark`` gets the first kind of each."""
    parts, at = [], 0
    for a, kind, b in spans:
        if a >= at or not parts:
            parts += [text[at:a], mark(kind)]
        at = max(at, b)
    return "".join([*parts, text[at:]])
