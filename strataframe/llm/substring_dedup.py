"""Repeated byte strings by prefix-free parsing.

Rolling-hash triggers cut every text into phrases that overlap by one byte less than the length
sought, so each string of that length starts in exactly one phrase, and equal strings start at equal
distances from equal triggers.  The parse is then the list of phrases with their places, the
dictionary the list of different phrases.  Strings of a phrase that stands twice in the parse are
repeated.  For the others the dictionary's suffixes that begin at triggers are sorted, and so is what
stands before the triggers, read backwards; as a string never leaves its phrase, the second order
takes the part of the parse's.  The common prefixes of neighbours in both orders tell which strings
begin alike on either side of a trigger, byte by byte: that is their place in the corpus's order."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import hinted, packed, saved, small_enough, unpacked
from strataframe.llm.shingles import U, mixed, prefix_hashes, slices, span_hashes

LENGTH = 400
#: A trigger is the least rolling hash of GRAM bytes within the first ZONE bytes of a string; its key
#: is the hash of the KEY bytes from the trigger on, which the string holds too.
GRAM, KEY = 16, 128
ZONE = LENGTH - KEY
#: Phrases of one trigger that a task sorts at once; more are compared string by string, spread out.
MOST_PHRASES = 50_000
#: Phrases of several triggers that a task sorts at once; bytes of a text that are parsed at once.
BATCH, PIECE = 8192, 1 << 20
#: Bits of a place within the bytes parsed at once, which are fewer than 2 * PIECE.
PLACE_BITS = 28


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i : i + width] for each i, from running minima of blocks to both sides."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def parse(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Phrases of all texts: number of the text, first start ``lo``, trigger ``p``, last start ``hi``
    (places within the text), ``key`` of the trigger and fingerprint ``ctx`` of the whole phrase."""
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate([np.arange(b, b + n - LENGTH + 1) for b, n in zip(begins, sizes, strict=True) if n >= LENGTH] or [np.zeros(0, np.int64)])
    if not len(starts):
        return {c: np.zeros(0, np.int64) for c in ("text", "lo", "p", "hi", "key", "ctx")}
    prefix = prefix_hashes(data)
    place = np.arange(len(data) - GRAM + 1)
    # Of equal hashes the rightmost wins, so the place counts down below the hash.
    mask = U((1 << PLACE_BITS) - 1)
    ranked = (span_hashes(prefix, place, place + GRAM) & ~mask) | (mask - place.astype(U))
    trigger = (mask - (least_in_windows(ranked, ZONE - GRAM + 1)[starts] & mask)).astype(np.int64)
    new = np.append(True, (trigger[1:] != trigger[:-1]) | (starts[1:] != starts[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, p = starts[first], starts[last], trigger[first]
    text = np.searchsorted(begins, lo, side="right") - 1
    own = begins[text]
    return {
        "text": text,
        "lo": lo - own,
        "p": p - own,
        "hi": hi - own,
        "key": span_hashes(prefix, p, p + KEY).view(np.int64),
        "ctx": span_hashes(prefix, lo, hi + LENGTH).view(np.int64),
    }


PARSE = "id long, h int, lo int, p int, hi int, key long, ctx long"


def pieces(texts: list[str]):
    """Lists of (number of the text, place, bytes) of about PIECE bytes in all; a longer text is cut into
    pieces that overlap by one byte less than the length, so each string lies in one piece."""
    held, size = [], 0
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        for a in range(0, max(1, len(data) - LENGTH + 1), PIECE):
            part = data[a : a + PIECE + LENGTH - 1]
            if held and size + len(part) > PIECE:
                yield held
                held, size = [], 0
            held.append((i, a, part))
            size += len(part)
    if held:
        yield held


def _parsed(batches):
    for batch in (part for whole in batches for part in slices(whole)):
        ids, hashes = batch.column("id"), batch.column("h")
        for held in pieces(batch.column("text").to_pylist()):
            found = parse([x[2] for x in held])
            at = pa.array(np.array([x[0] for x in held], np.int64)[found["text"]])
            place = np.array([x[1] for x in held], np.int64)[found["text"]]
            yield pa.RecordBatch.from_arrays(
                [ids.take(at), hashes.take(at)]
                + [pa.array((found[c] + place).astype(np.int32)) for c in ("lo", "p", "hi")]
                + [pa.array(found[c]) for c in ("key", "ctx")],
                names=[c.split()[0] for c in PARSE.split(", ")],
            )


PHRASES = "id long, h int, lo int, p int, hi int, key long, many boolean, crowded boolean, phrase binary"


def _cut(batches):
    """The bytes of each phrase asked for, from the whole texts."""
    kinds = {"id": pa.int64(), "h": pa.int32(), "lo": pa.int32(), "p": pa.int32(), "hi": pa.int32(), "key": pa.int64(), "many": pa.bool_(), "crowded": pa.bool_(), "phrase": pa.binary()}
    out: dict[str, list] = {c: [] for c in kinds}

    def flushed():
        made = pa.RecordBatch.from_arrays([pa.array(out[c], kinds[c]) for c in out], names=list(out))
        for column in out.values():
            column.clear()
        return made

    for batch in (part for whole in batches for part in slices(whole)):
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            data = row["text"].encode("utf-8", "surrogatepass")
            for x in row["asked"]:
                for c in ("lo", "p", "hi", "key", "many", "crowded"):
                    out[c].append(x[c])
                out["id"].append(row["id"])
                out["h"].append(row["h"])
                out["phrase"].append(data[x["lo"] : x["hi"] + LENGTH])
                if len(out["id"]) >= BATCH:
                    yield flushed()
    yield flushed()


def _ordered(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of byte rows of equal width in order within their groups, and the length of the prefix that
    each shares with the one before it, -1 at the first of a group."""
    n, width = rows.shape
    rank = np.empty(n, np.int64)
    rank[np.argsort(rows.view(f"S{width}").ravel(), kind="stable")] = np.arange(n)
    order = np.lexsort((rank, group))
    here = rows[order]
    other = here[1:] != here[:-1]
    shared = np.where(other.any(axis=1), other.argmax(axis=1), width)
    shared[group[order][1:] != group[order][:-1]] = -1
    return order, np.append(-1, shared)


def repeated_distances(phrases: list[bytes], before: np.ndarray, after: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each phrase the least and the greatest distance from the trigger back to the start of a string
    that another phrase of its group holds too; -1 for none.

    ``before`` is the number of bytes before the trigger, the distance of the first start; ``after``
    the distance of the last.  Two phrases share the string at distance d if they agree in the d bytes
    before the trigger and in the LENGTH - d bytes from it on."""
    n, widest = len(phrases), max(1, int(before.max()))
    left, right = np.zeros((n, widest), np.uint8), np.zeros((n, LENGTH), np.uint8)
    for i, (phrase, d) in enumerate(zip(phrases, before.tolist(), strict=True)):
        data = np.frombuffer(phrase, np.uint8)
        left[i, :d] = data[:d][::-1]
        right[i, : len(data) - d] = data[d:]
    (by_left, same_left), (by_right, same_right) = _ordered(left, group), _ordered(right, group)
    least, most = np.full(n, -1), np.full(n, -1)
    one, two = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(after.min()), int(before.max()) + 1):
        there = np.flatnonzero((after <= d) & (d <= before))
        if len(there) < 2:
            continue
        one[by_left] = np.cumsum(same_left < d)
        two[by_right] = np.cumsum(same_right < LENGTH - d)
        both = one[there] * (n + 1) + two[there]
        order = np.argsort(both)
        equal = both[order][1:] == both[order][:-1]
        again = there[order[np.append(False, equal) | np.append(equal, False)]]
        least[again[least[again] < 0]] = d
        most[again] = d
    return least, most


def _repeated(held: list[dict]) -> pa.RecordBatch:
    """Bytes [a, b) that repeated strings cover, for phrases that occur once.

    The starts of a phrase span less than LENGTH, so what lies between the first and the last
    repeated string of a phrase is covered without a gap."""
    lo, p, hi, key = (np.array([x[c] for x in held], np.int64) for c in ("lo", "p", "hi", "key"))
    least, most = repeated_distances([x["phrase"] for x in held], p - lo, p - hi, np.unique(key, return_inverse=True)[1])
    at = np.flatnonzero((most >= 0) & ~np.array([x["many"] for x in held], bool))
    columns = [pa.array([held[i][c] for i in at], kind) for c, kind in (("id", pa.int64()), ("h", pa.int32()))]
    columns += [pa.array(x.astype(np.int32)) for x in ((p - most)[at], (p - least)[at] + LENGTH)]
    return pa.RecordBatch.from_arrays(columns, names=["id", "h", "a", "b"])


def _by_trigger(batches):
    """Streams a partition sorted by trigger; a trigger's phrases are sorted together, BATCH or a few more at once."""
    held: list[dict] = []
    for batch in (part for whole in batches for part in slices(whole)):
        for row in batch.to_pylist():
            if len(held) >= BATCH and held[-1]["key"] != row["key"]:
                yield _repeated(held)
                held = []
            held.append(row)
    if held:
        yield _repeated(held)


def suffixes(phrases: list[bytes], key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every start of every phrase: row of the phrase, place within it, two fingerprints of LENGTH bytes.

    One is of the whole string with its trigger, the other of its halves."""
    sizes = np.array([len(x) for x in phrases])
    begins = np.cumsum(sizes) - sizes
    prefix = prefix_hashes(np.frombuffer(b"".join(phrases), np.uint8))
    n = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(phrases)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at, half = begins[row] + place, LENGTH // 2
    whole = mixed(span_hashes(prefix, at, at + LENGTH) ^ key.view(U)[row])
    return row, place, whole, mixed(span_hashes(prefix, at, at + half) ^ mixed(span_hashes(prefix, at + half, at + LENGTH) + U(1)))


SPANS = "id long, h int, a int, b int"


STRINGS = "mark long, other long, id long, h int, s int, lo int, many boolean"


def _each_string(batches):
    """Every string of crowded triggers as a row of its own."""
    for batch in (part for whole in batches for part in slices(whole)):
        if batch.num_rows:
            row, place, mark, other = suffixes(batch.column("phrase").to_pylist(), batch.column("key").to_numpy())
            at = pa.array(row)
            lo = batch.column("lo").take(at)
            start = pa.array((lo.to_numpy() + place).astype(np.int32))
            columns = [pa.array(mark.view(np.int64)), pa.array(other.view(np.int64)), batch.column("id").take(at), batch.column("h").take(at), start, lo, batch.column("many").take(at)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in STRINGS.split(", ")])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``docs(id, text, h)`` -> ``(id, h, a, b)``: byte ranges that repeated strings cover; they overlap."""
    parts = saved(docs.where(F.octet_length("text") >= LENGTH).mapInArrow(_parsed, PARSE))
    keys = parts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    again = saved(parts.join(keys, "key", "left_semi"))
    name = ["key", "ctx", F.expr("p - lo").alias("dl"), F.expr("p - hi").alias("dh")]
    phrases = saved(again.groupBy(*name).agg(F.count(F.lit(1)).alias("times")))
    named = again.withColumns({"dl": F.expr("p - lo"), "dh": F.expr("p - hi")}).join(phrases, ["key", "ctx", "dl", "dh"])
    whole = named.where("times > 1").select("id", "h", F.col("lo").alias("a"), (F.col("hi") + LENGTH).alias("b"))
    unsure = phrases.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("times").alias("least")).where("n > 1 and least = 1")
    unsure = unsure.select("key", (F.col("n") > MOST_PHRASES).alias("crowded"))
    one_each = named.join(unsure, "key").withColumn("many", F.col("times") > 1)
    asked = one_each.where("not many").union(one_each.where("many").dropDuplicates(["key", "ctx", "dl", "dh"]))
    by_text = saved(asked.groupBy("id", "h").agg(F.collect_list(F.struct("lo", "p", "hi", "key", "many", "crowded")).alias("asked")))
    texts = docs.select(F.col("id").alias("i"), F.col("h").alias("g"), "text")
    # A text may stand in several rows of one id: its phrases are then asked of one of them.
    on = F.col("i").eqNullSafe(F.col("id")) & (F.col("g") == F.col("h"))
    there = texts.join(hinted(by_text, small_enough(asked_size(by_text), 40)), on).dropDuplicates(["i", "g"])
    cut = saved(there.select("id", "h", "text", "asked").mapInArrow(_cut, PHRASES))
    once = cut.where("not crowded").repartition("key").sortWithinPartitions("key").mapInArrow(_by_trigger, SPANS)
    strings = cut.where("crowded").mapInArrow(_each_string, STRINGS)
    twice = strings.groupBy("mark", "other").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark", "other")
    rest = strings.where("not many").join(twice, ["mark", "other"], "left_semi").groupBy("id", "h", "lo").agg(F.min("s").alias("a"), (F.max("s") + LENGTH).alias("b"))
    return whole.union(once).union(rest.select("id", "h", "a", "b"))


def asked_size(by_text: DataFrame) -> int:
    return by_text.agg(F.coalesce(F.sum(F.size("asked")), F.lit(0))).first()[0]


def _kept(text: str | None, starts, ends) -> tuple[bytes, int, int]:
    """Bytes that stay, number removed, number of maximal runs removed."""
    data, parts, at, runs = (text or "").encode("utf-8", "surrogatepass"), [], 0, 0
    for a, b in sorted(zip(starts, ends, strict=True)):
        if a > at or not runs:
            parts.append(data[at:a])
            runs += 1
        at = max(at, b)
    kept = b"".join([*parts, data[at:]])
    return kept, len(data) - len(kept), runs


def _with_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packed rows of texts without and with removed bytes, the latter with their spans."""
    rows = packed(docs).withColumns({"id": F.col("row__.doc_id").cast("long"), "text": F.col("row__.text"), "h": F.hash("row__.text")})
    spans = repeated_spans(rows.select("id", "text", "h"))
    marked = saved(spans.groupBy(F.col("id").alias("i"), F.col("h").alias("g")).agg(F.collect_set(F.struct("a", "b")).alias("x")).select("i", "g", "x.a", "x.b"))
    on = F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g"))
    names = marked.select("i", "g")
    clean = rows.join(hinted(names, small_enough(names.count(), 40)), on, "left_anti")
    return clean, rows.join(marked, on)


def find_repeats(docs: DataFrame) -> DataFrame:
    """One row for each of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a string of 400 bytes that covers it starts anywhere else too, in the same
    text or another; strings are judged on the input.  Null and empty texts have no bytes, texts
    under 400 bytes keep all; repeated rows and copies lose everything, as each string stands in the
    other row; an empty table gives no rows."""
    clean, touched = _with_spans(docs)

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string")
    def judged(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        out = [_kept(t, a, b) for t, a, b in zip(texts, starts, ends, strict=True)]
        return pd.DataFrame([(n, runs, hashlib.sha256(kept).hexdigest()) for kept, n, runs in out], columns=["n_removed", "n_spans", "kept_sha256"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    zero = F.lit(0).cast("long")
    left = clean.select("row__.doc_id", size, zero.alias("n_removed"), zero.alias("n_spans"), sha)
    right = touched.select("row__.doc_id", size, judged("text", "a", "b").alias("j")).select("doc_id", "n_bytes", "j.*")
    return left.union(right)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes gone from their texts; characters cut in half go too."""

    @F.pandas_udf("string")
    def rest(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = [_kept(t, a, b)[0].decode("utf-8", "ignore") for t, a, b in zip(texts, starts, ends, strict=True)]
        return pd.Series(out, dtype=object)

    clean, touched = _with_spans(docs)
    changed = unpacked(touched, docs.columns, text=rest("text", "a", "b"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return unpacked(clean, docs.columns).select(*columns).union(changed.select(*columns))
