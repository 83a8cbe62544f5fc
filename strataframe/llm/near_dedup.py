"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

Weights are times in the text x (1 + ln(documents / document frequency)), every frequency counted
over all documents.  Texts are dealt into slices; each slice sends its shingles to ranges of shingles,
where they are counted, and gets back those that more than one document holds.

A shingle of one document can't be shared, so a text is carried as its shared shingles and its whole
weight; sampling sees all its other shingles as one element of their summed weight, which leaves the
chance of equal samples, the weighted Jaccard similarity, as it is."""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import hinted, packed, saved, small_enough, unpacked
from strataframe.llm.components import connected_components
from strataframe.llm.shingles import SHINGLE_BITS, U, chunks, mixed, shingled, slices

SIMILARITY = 0.8
WORDS = 5
BANDS, ROWS = 9, 3
#: Bytes of text, and documents, of a slice; bytes of text whose shingles are one range on average.
SLICE_BYTES, SLICE_DOCUMENTS, RANGE_BYTES = 2 << 20, 4096, 8 << 20
#: About so many shingles of a range are counted at once; columns of a matrix, and pairs, that are compared at once.
COUNTED, WIDE, PAIRED = 1 << 17, 512, 1 << 19
#: Partners that one copy of a hub is compared with; members, and shared shingles, of a block of a bucket.
PARTNERS, BLOCK, BLOCK_SHINGLES = 256, 1024, 1 << 19
#: Members of a bucket beyond which it is split by further samples, and the bands and rows of these:
#: a pair just at 0.8 that shares the bucket shares one of its parts with chance 0.99985.
CROWD, DEEP_BANDS, DEEP_ROWS = 8192, 48, 8
#: Rounding of a similarity that may be least exactly.
ROUNDING = 1e-9


def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """65,536 quantiles of Gamma(2, 1), whose distribution is 1 - (1 + x) exp(-x), and their logarithms."""
    want = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.full(1 << 16, 1.0)
    low, high = np.zeros(1 << 16), np.full(1 << 16, 40.0)
    for _ in range(60):
        x = (low + high) / 2
        less = 1 - (1 + x) * np.exp(-x) < want
        low, high = np.where(less, x, low), np.where(less, high, x)
    return x.astype(np.float32), np.log(x).astype(np.float32)


GAMMA, LOG_GAMMA = _quantiles()


def samples(owner: np.ndarray, shingles: np.ndarray, weights: np.ndarray, n: int, first: int = 0, many: int = BANDS * ROWS) -> np.ndarray:
    """``many`` consistent weighted samples, from number ``first`` on, of each of n texts; owners ascend.

    For each shingle and sample, r and c from Gamma(2, 1) and b uniform come from 48 bits of a hash;
    t = floor(ln w / r + b), and the shingle with the least ln c - r (t - b + 1) is the sample,
    together with its t.  One integer holds both: the order's bits above, a hash of what was
    sampled below, so one minimum per text finds it."""
    out = np.zeros((n, many), U)
    if not len(owner):
        return out
    texts, begins = np.unique(owner, return_index=True)
    base, log_w = mixed(shingles.astype(U)), np.log(weights).astype(np.float32)
    for k in range(many):
        h = mixed(base + U((first + k + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        r = GAMMA[(h & U(0xFFFF)).astype(np.intp)]
        c = LOG_GAMMA[((h >> U(16)) & U(0xFFFF)).astype(np.intp)]
        b = ((h >> U(32)) & U(0xFFFF)).astype(np.float32) / np.float32(65536)
        t = np.floor(log_w / r + b)
        bits = (c - r * (t - b + 1)).view(np.uint32)
        order = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(U)
        what = (mixed(base ^ (t.astype(np.int64).view(U) * U(0x9FB21C651E98DF25))) >> U(32))
        out[texts, k] = np.minimum.reduceat((order << U(32)) | what, begins)
    return out & U(0xFFFFFFFF)


def band_keys(owner: np.ndarray, shared: np.ndarray, weights: np.ndarray, rest: np.ndarray, own: np.ndarray, first: int = 0, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Keys of the bands of texts: shared shingles by owner, and for each text the weight ``rest`` of its
    other ones, which are one element named by ``own``."""
    n = len(rest)
    alone = np.flatnonzero(rest > 0)
    owner, shared, weights = (np.concatenate(x) for x in ((owner, alone), (shared.view(U), own[alone]), (weights, rest[alone])))
    order = np.argsort(owner, kind="stable")
    sampled = samples(owner[order], shared[order], weights[order], n, first, bands * rows).reshape(n, bands, rows)
    key = np.zeros((n, bands), U) + (np.arange(bands, dtype=U) + U(1 + first)) * U(0xA0761D6478BD642F)
    for j in range(rows):
        key = mixed(key ^ sampled[:, :, j])
    return key


def _bytes(shingles: np.ndarray) -> bytes:
    """Sorted shingles with all first bytes first, so that they compress."""
    return shingles.astype("<i8").view(np.uint8).reshape(-1, 8).T[: SHINGLE_BITS // 8].tobytes()


def _of_bytes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(SHINGLE_BITS // 8, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : SHINGLE_BITS // 8] = planes.T
    return out.view("<i8")[:, 0].astype(np.int64)


SENT = "range long, slice long, s binary, n binary"
TOLD = "slice long, s binary, n binary"


def _sent(bits: int):
    """Distinct shingles of a slice with the number of its texts that hold them, by ranges of 2**-bits of all."""

    def run(table: pa.Table) -> pa.Table:
        found = [shingled(part, WORDS)[1] for _, part in chunks(table.column("text").to_pylist())]
        shingle, n = np.unique(np.concatenate(found), return_counts=True)
        place = shingle >> (SHINGLE_BITS - bits)
        at = np.flatnonzero(np.diff(place, prepend=-1))
        ends = np.append(at[1:], len(shingle))
        return pa.table(
            {
                "range": pa.array(place[at], pa.int64()),
                "slice": pa.array([table.column("slice")[0].as_py()] * len(at), pa.int64()),
                "s": pa.array([_bytes(shingle[i:j]) for i, j in zip(at, ends, strict=True)], pa.binary()),
                "n": pa.array([n[i:j].astype(np.uint32).tobytes() for i, j in zip(at, ends, strict=True)], pa.binary()),
            }
        )

    return run


def _told(table: pa.Table) -> pa.Table:
    """For each slice, those of its shingles in a range that several documents hold, with how many do.

    Shingles are counted a part of the range at a time, as all of a range at once are what a worker's memory would follow."""
    sent = [(_of_bytes(s), np.frombuffer(n, np.uint32)) for s, n in zip(table.column("s").to_pylist(), table.column("n").to_pylist(), strict=True)]
    low, high = min(int(s[0]) for s, _ in sent), max(int(s[-1]) for s, _ in sent) + 1
    step = max(1, -(-(high - low) * COUNTED // max(1, sum(len(s) for s, _ in sent))))  # shingles are hashes, so spread evenly
    held: list[list] = [[] for _ in sent]
    begin = [0] * len(sent)
    for edge in range(low + step, high + step, step):
        end = [int(np.searchsorted(s, edge)) for s, _ in sent]
        part = [(s[i:j], n[i:j]) for (s, n), i, j in zip(sent, begin, end, strict=True)]
        begin = end
        _, at = np.unique(np.concatenate([s for s, _ in part]), return_inverse=True)
        total, first = np.bincount(at, weights=np.concatenate([n for _, n in part]))[at].astype(np.uint32), 0
        for k, (s, _) in enumerate(part):
            n = total[first : first + len(s)]
            first += len(s)
            if (n > 1).any():
                held[k].append((s[n > 1], n[n > 1]))
    out = []
    for name, parts in zip(table.column("slice").to_pylist(), held, strict=True):
        if parts:
            out.append((name, _bytes(np.concatenate([s for s, _ in parts])), np.concatenate([n for _, n in parts]).tobytes()))
    return pa.table({c: pa.array([x[k] for x in out], t) for k, (c, t) in enumerate((("slice", pa.int64()), ("s", pa.binary()), ("n", pa.binary())))})


class Weights:
    """Shingle weights: the documents there are, and the frequencies of shingles that several hold."""

    def __init__(self, documents: int, frequent: dict[int, int]):
        self.documents = documents
        self.shingles = np.array(sorted(frequent), np.int64)
        self.n = np.array([frequent[s] for s in self.shingles.tolist()], np.int64)

    @classmethod
    def told(cls, documents: int, table: pa.Table) -> Weights:
        """Those of one slice, from what was told to it."""
        out = cls(documents, {})
        if table.num_rows:
            shingles = np.concatenate([_of_bytes(x) for x in table.column("s").to_pylist()])
            n = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("n").to_pylist()])
            order = np.argsort(shingles)
            out.shingles, out.n = shingles[order], n[order].astype(np.int64)
        return out

    def frequencies(self, shingles: np.ndarray) -> np.ndarray:
        n = np.ones(len(shingles), np.int64)
        if len(self.shingles):
            at = np.searchsorted(self.shingles, shingles)
            at[at == len(self.shingles)] = 0
            known = self.shingles[at] == shingles
            n[known] = self.n[at[known]]
        return n

    def of(self, shingles: np.ndarray, times: np.ndarray) -> np.ndarray:
        return weighted(self.documents, self.frequencies(shingles), times)


def weighted(documents: int, n: np.ndarray, times: np.ndarray) -> np.ndarray:
    return (1 + np.log(documents / n)) * times


SIGNED = "id long, h1 long, h2 long, bands array<long>, total double, s binary, n binary, t binary"


def _signed(documents: int):
    """A slice's texts: bands, whole weight, and shared shingles in order with their frequencies and times."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        weights, out = Weights.told(documents, told), []
        for batch in slices(table):
            rows: list[tuple] = []
            marks = mixed(batch.column("h1").to_numpy().view(U) ^ mixed(batch.column("h2").to_numpy().view(U)))
            for first, part in chunks(batch.column("text").to_pylist()):
                owner, shingle, times = shingled(part, WORDS)
                n = weights.frequencies(shingle)
                w = weighted(documents, n, times)
                total, held = np.bincount(owner, w, len(part)), n > 1
                rest = np.bincount(owner[~held], w[~held], len(part))
                owner, shingle, n, times, w = owner[held], shingle[held], n[held], times[held], w[held]
                key = band_keys(owner, shingle, w, rest, marks[first : first + len(part)]).view(np.int64)
                at = np.searchsorted(owner, np.arange(len(part) + 1))
                n, times = n.astype(np.uint32), times.astype(np.uint32)
                for i, (low, high) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    rows.append((key[i] if total[i] else None, total[i], _bytes(shingle[low:high]), n[low:high].tobytes(), times[low:high].tobytes()))
            columns = [batch.column(c).combine_chunks() for c in ("id", "h1", "h2")]
            kinds = (pa.list_(pa.int64()), pa.float64(), pa.binary(), pa.binary(), pa.binary())
            columns += [pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)]
            out.append(pa.table(columns, names=[c.split()[0] for c in SIGNED.split(", ")]))
        return pa.concat_tables(out) if out else _none(SIGNED)

    return run


def _none(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.table({c.split()[0]: pa.array([], kinds[c.split()[1]]) for c in schema.split(", ")})


def signatures(rows: DataFrame) -> tuple[int, DataFrame]:
    """How many ``rows(id, text, h1, h2)`` there are, and for each its bands, weight and shared shingles."""
    documents, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    many = max(1, ceil((size or 0) / SLICE_BYTES), ceil(documents / SLICE_DOCUMENTS))
    bits = ceil(log2(max(1, (size or 0) / RANGE_BYTES)))
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("id", "h1", "h2"), F.lit(many)))
    told = sliced.groupBy("slice").applyInArrow(_sent(bits), SENT).groupBy("range").applyInArrow(_told, TOLD)
    return documents, sliced.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(_signed(documents), SIGNED)


def weighted_jaccard(a: dict[int, float], b: dict[int, float]) -> float:
    """Sum of the lesser weights over sum of the greater ones; 0 if either has none."""
    both = sum(min(w, b[s]) for s, w in a.items() if s in b)
    every = sum(a.values()) + sum(b.values()) - both
    return both / every if a and b else 0.0


class _Vectors:
    """Shared shingles of texts as sorted (shingle, weight of one occurrence, times)."""

    def __init__(self, documents: int):
        self.documents = documents

    def of(self, s: bytes, n: bytes, t: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _of_bytes(s), weighted(self.documents, np.frombuffer(n, np.uint32), 1), np.frombuffer(t, np.uint32)


def _overlap(x: tuple, y: tuple) -> float:
    """Summed lesser weights of two vectors."""
    (s, w, m), (t, _, n) = x, y
    if not len(s) or not len(t):
        return 0.0
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    same = t[at] == s
    return float((w[same] * np.minimum(m[same], n[at[same]])).sum())


def _linked_partners(documents: int, least: float):
    """Links (a, b) from rows sorted by (a, part, side): a hub of side 0, then its partners b."""

    def run(batches):
        vectors, hub, whole = _Vectors(documents), None, 0.0
        for batch in (part for every in batches for part in slices(every)):
            links = []
            for a, b, side, total, *row in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "side", "total", "s", "n", "t")], strict=True):
                if side == 0:
                    hub, whole = vectors.of(*row), total
                elif min(whole, total) >= (least - ROUNDING) * max(whole, total):
                    both = _overlap(hub, vectors.of(*row))
                    if both >= (least - ROUNDING) * (whole + total - both):
                        links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, vectors: DataFrame, documents: int, least: float) -> DataFrame:
    """Those of the distinct pairs (a, b) that are similar enough; a hub is sent once to each PARTNERS of its own."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    held = [F.col(c) for c in ("total", "s", "n", "t")]
    hubs = dealt.select("a", "part").distinct().join(vectors, F.col("a") == F.col("node")).select("a", "part", F.lit(None).cast("long").alias("b"), F.lit(0).alias("side"), *held)
    others = dealt.join(vectors, F.col("b") == F.col("node")).select("a", "part", "b", F.lit(1).alias("side"), *held)
    rows = hubs.union(others).repartition("a", "part").sortWithinPartitions("a", "part", "side")
    return saved(rows.mapInArrow(_linked_partners(documents, least), "a long, b long"))


def _levels(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as (row, element, weight); a shingle that stands k times is k elements, so that the summed
    lesser weights of two vectors are the summed weights of the elements that both have."""
    size = [len(x[0]) for x in held]
    row = np.repeat(np.arange(len(held)), size)
    s, w, m = (np.concatenate([x[k] for x in held]) for k in range(3))
    again = np.repeat(np.arange(len(s)), m)
    level = np.arange(len(again)) - np.repeat(np.cumsum(m) - m, m)
    element = np.where(level > 0, mixed(s[again].view(U) + level.astype(U) * U(0xD1B54A32D192ED03)), s[again].view(U))
    return row[again], element, w[again]


def overlaps(left: list[tuple], right: list[tuple]) -> np.ndarray:
    """Summed lesser weights of each vector of ``left`` with each of ``right``.

    Elements that many hold are multiplied as matrices, some columns at a time; others are counted pair by pair."""
    (row, x, w), (col, y, _) = _levels(left), _levels(right)
    n, m = len(left), len(right)
    out = np.zeros(n * m)
    both = np.intersect1d(x, y)
    if not len(both):
        return out.reshape(n, m)

    def among(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, e), len(both) - 1)
        ok = np.flatnonzero(both[at] == e)
        ok = ok[np.argsort(at[ok], kind="stable")]
        return ok, at[ok]

    (i, u), (j, v) = among(x), among(y)
    row, w, col = row[i], w[i], col[j]
    here, there = np.bincount(u, minlength=len(both)), np.bincount(v, minlength=len(both))
    heavy = here * there > max(64, n * m // 100)
    number = np.cumsum(heavy) - 1
    dense = out.reshape(n, m)
    for a in range(0, int(heavy.sum()), WIDE):
        p, q = (heavy[k] & (number[k] >= a) & (number[k] < a + WIDE) for k in (u, v))
        one, two = np.zeros((n, WIDE)), np.zeros((m, WIDE))
        one[row[p], number[u[p]] - a] = w[p]
        two[col[q], number[v[q]] - a] = 1
        dense += one @ two.T
    begin = np.cumsum(there) - there
    light = np.flatnonzero(~heavy[u])
    ends = np.cumsum(there[u[light]])
    for a in range(0, int(ends[-1]) if len(ends) else 0, PAIRED):
        part = light[np.searchsorted(ends, a, "right") if a else 0 : np.searchsorted(ends, a + PAIRED, "right")]
        times = there[u[part]]
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin[u[part]], times)
        out += np.bincount(np.repeat(row[part], times) * m + col[at], np.repeat(w[part], times), n * m)
    return dense


def _between(rows: list[tuple], i: int, j: int, vectors: _Vectors, least: float) -> list[tuple[int, int]]:
    """Links between blocks i and j of a bucket, rows (block, node, component, total, s, n, t), enough to
    connect the components that link."""
    held = [vectors.of(*x[4:]) for x in rows]
    here, there = ([k for k, x in enumerate(rows) if x[0] == b] for b in (i, j))
    if not here or not there:
        return []
    left, right = ([held[k] for k in side] for side in (here, there))
    both = overlaps(left, right)
    total, group = np.array([x[3] for x in rows]), np.array([x[2] for x in rows])
    every = total[here][:, None] + total[there][None, :] - both
    close = (both >= (least - ROUNDING) * every) & (group[here][:, None] != group[there][None, :])
    links, up = [], {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in np.argwhere(close).tolist():
        p, q = rows[here[a]], rows[there[b]]
        g, h = root(p[2]), root(q[2])
        if g != h:
            up[max(g, h)] = min(g, h)
            links.append((p[1], q[1]))
    return links


def _linked_blocks(documents: int, least: float):
    """Links (a, b) from rows sorted by (key, i, j), all pairs of two blocks in different components compared."""

    def run(batches):
        vectors, name, held = _Vectors(documents), None, []
        for batch in (part for every in batches for part in slices(every)):
            links = []
            for key, i, j, *row in zip(*[batch.column(c).to_pylist() for c in ("key", "i", "j", "block", "node", "component", "total", "s", "n", "t")], strict=True):
                if name != (key, i, j):
                    links += _between(held, *name[1:], vectors, least) if name else []
                    name, held = (key, i, j), []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
        if name:
            links = _between(held, *name[1:], vectors, least)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _deeper(documents: int):
    """Members of crowded buckets once for each further band: (key, node, component)."""

    def run(batches):
        vectors = _Vectors(documents)
        for batch in (part for every in batches for part in slices(every)):
            held = [vectors.of(*x) for x in zip(*[batch.column(c).to_pylist() for c in ("s", "n", "t")], strict=True)]
            if not held:
                continue
            owner = np.repeat(np.arange(len(held)), [len(x[0]) for x in held])
            s, w, m = (np.concatenate([x[k] for x in held]) for k in range(3))
            node = batch.column("node").to_numpy()
            rest = batch.column("total").to_numpy() - np.bincount(owner, w * m, len(held))
            rest[rest < ROUNDING] = 0
            key = band_keys(owner, s, w * m, rest, mixed(node.view(U)), BANDS * ROWS, DEEP_BANDS, DEEP_ROWS)
            key = mixed(key ^ batch.column("key").to_numpy().view(U)[:, None]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel())] + [pa.array(np.repeat(batch.column(c).to_numpy(), DEEP_BANDS)) for c in ("node", "component")], names=["key", "node", "component"]
            )

    return run


def _open(buckets: DataFrame) -> DataFrame:
    """Rows (key, node, component) of the buckets that hold several components, with their number ``n``."""
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    return buckets.join(sizes.where("low != high").select("key", "n"), "key")


def find_links(signed: DataFrame, documents: int, least: float) -> DataFrame:
    """Edges (a, b) of similar texts, enough to connect all candidates of a bucket that are.

    Each bucket's least node is compared with the others; most buckets are one component then.  In
    the rest all pairs in different components are compared, a block of the bucket with another, and
    only links leave the task.  A bucket of more than CROWD members is first split by further samples."""
    worded = signed.where("bands is not null and id is not null")
    whole = worded.groupBy("h1", "h2").agg(F.min("id").alias("node")).groupBy("node").agg(F.min(F.struct("h1", "h2")).alias("h"))
    nodes = saved(whole.select("node", F.col("h.h1").alias("x"), F.col("h.h2").alias("y")))
    own = (F.col("id") == F.col("node")) & (F.col("h1") == F.col("x")) & (F.col("h2") == F.col("y"))
    keys = saved(worded.select("id", "h1", "h2", "bands").join(nodes, own).select("node", F.explode("bands").alias("key")).distinct())
    lead = keys.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = saved(keys.join(lead.select("key", "lead"), "key"))
    met = nodes.join(buckets.select("node").distinct(), "node")
    vectors = saved(worded.join(met, own).dropDuplicates(["node"]).select("node", "total", "s", "n", "t"))
    stars = buckets.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    edges = _verified(saved(stars), vectors, documents, least)
    found = saved(connected_components(edges))
    named = buckets.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    members = saved(_open(named))
    crowded = members.where(F.col("n") > CROWD)
    if crowded.limit(1).count():
        deep = crowded.join(vectors.withColumnRenamed("n", "df"), "node").select("key", "node", "component", "total", "s", F.col("df").alias("n"), "t")
        split = _open(deep.mapInArrow(_deeper(documents), "key long, node long, component long"))
        members = saved(members.where(F.col("n") <= CROWD).unionByName(split))
    sized = members.join(vectors.select("node", (F.octet_length("t") / 4).alias("shingles")), "node")
    blocks = sized.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("shingles") / BLOCK_SHINGLES), F.lit(1)).cast("int").alias("blocks"))
    placed = members.drop("n").join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("key", "node", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = each.join(vectors, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = rows.mapInArrow(_linked_blocks(documents, least), "a long, b long")
    return saved(found.where("node != component").select(F.col("component").alias("a"), F.col("node").alias("b")).union(more))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row for each of ``docs(doc_id, text)``: doc_id, component_id, kept.

    Documents link if the weighted Jaccard similarity of their shingles of five words reaches
    ``least``, or if their texts are equal; ``component_id`` is the least doc_id reachable by links,
    and ``kept`` says that it is the document's own.  Equal texts are one node of the search.

    Texts that are null or have no word link with nothing; a null doc_id has no component and is
    kept; rows that share an id are one document, of whose texts the one of least hash is compared;
    an empty table gives no rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.reverse("text"), F.lit(1))})
    documents, signed = signatures(rows)
    signed = saved(signed)
    links = find_links(signed, documents, least)
    worded = signed.where("bands is not null and id is not null")
    copies = worded.join(worded.groupBy("h1", "h2").agg(F.min("id").alias("a")), ["h1", "h2"]).where("id != a").select("a", F.col("id").alias("b"))
    found = connected_components(links.union(copies))
    both = signed.select("id").join(found, F.col("id") == F.col("node"), "left")
    component = F.coalesce("component", "id")
    return both.select(F.col("id").alias("doc_id"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def deduplicate(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group: the one of least doc_id; rows without an id stay.

    Rows equal in id and text are copies too, and one of them stays."""
    found = saved(near_duplicates(docs.select("doc_id", "text"), least))
    gone = found.where("not kept").select(F.col("doc_id").alias("gone__")).distinct()
    again = found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("again__")).count().where("count > 1").select("again__")
    gone, again = saved(gone), saved(again)
    rows = packed(docs).withColumn("id__", F.col("row__.doc_id").cast("long"))
    left = rows.join(hinted(gone, small_enough(gone.count(), 16)), F.col("id__") == F.col("gone__"), "left_anti")
    twice = hinted(again, small_enough(again.count(), 16))
    on = F.col("id__") == F.col("again__")
    once = left.join(twice, on, "left_anti").select("row__")
    first = left.join(twice, on, "left_semi").withColumn("text__", F.col("row__.text")).dropDuplicates(["id__", "text__"]).select("row__")
    return unpacked(once.union(first), docs.columns)
