"""What a worker of the near-duplicate search holds at once, beyond its input and its result."""

import tracemalloc

import numpy as np
import pyarrow as pa

from strataframe.llm import near_dedup, shingles


def peak(run) -> tuple[object, int]:
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_counting_a_range_takes_little_more_than_its_shingles():
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 40, 1 << 17)
    rows = [np.unique(np.concatenate([rng.integers(0, 1 << 40, 1 << 15), rng.choice(common, 1 << 15)])) for _ in range(16)]
    sent = [(near_dedup._bytes(s), np.ones(len(s), np.uint32).tobytes()) for s in rows]
    table = pa.table({"range": [0] * 16, "slice": list(range(16)), "s": pa.array([s for s, _ in sent], pa.binary()), "n": pa.array([n for _, n in sent], pa.binary())})
    told, most = peak(lambda: near_dedup._told(table))
    shingle, n = np.unique(np.concatenate(rows), return_counts=True)
    shared = dict(zip(shingle[n > 1].tolist(), n[n > 1].tolist(), strict=True))
    assert told.column("slice").to_pylist() == list(range(16))
    for own, s, times in zip(rows, told.column("s").to_pylist(), told.column("n").to_pylist(), strict=True):
        want = [x for x in own.tolist() if x in shared]
        assert near_dedup._of_bytes(s).tolist() == want and np.frombuffer(times, np.uint32).tolist() == [shared[x] for x in want]
    assert most < 48 * sum(len(s) for s in rows)


def test_hashing_many_texts_takes_few_megabytes_at_once():
    texts = [" ".join(f"w{i * 7919 % 997}x{j * 31 % 1009}" for j in range(200)) for i in range(2000)]
    shingles.powers(shingles.BASE, 2), shingles.powers(shingles.INVERSE, 2)  # kept by a worker anyway
    n, most = peak(lambda: sum(len(shingles.shingled(part)[1]) for _, part in shingles.chunks(texts)))
    assert n and most < 15e6
