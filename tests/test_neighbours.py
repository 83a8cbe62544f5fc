"""The step of nearest neighbours that compares two blocks."""

import numpy as np
import pandas as pd

from strataframe.operators import graph as G


def test_blocks_are_compared_many_rows_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (700, 4)).astype(np.float32)  # many ties and equal vectors
    frame = pd.DataFrame({"src": rng.permutation(700), "v__": list(x)})
    here, there = frame[:600], frame[300:]
    made, kind = [], pd.DataFrame
    monkeypatch.setattr(G.pd, "DataFrame", lambda *a, **b: made.append(1) or kind(*a, **b))
    found = G._nearest(here, there, 5)
    monkeypatch.undo()
    want = []
    for src, v in zip(here["src"], here["v__"], strict=True):
        far = [(float(np.sqrt(((w.astype(float) - v) ** 2).sum())), other) for other, w in zip(there["src"], there["v__"], strict=True) if other != src]
        want += [(src, other, d) for d, other in sorted(far)[:5]]
    assert list(zip(found["src"], found["dst"], found["distance"], strict=True)) == want
    assert len(made) <= 10
