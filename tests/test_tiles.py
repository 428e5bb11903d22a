"""The exact neighbour search moves tiles, not pairs of blocks."""

import numpy as np
import pytest

from seqlattice.operators import neighbors as N


@pytest.mark.parametrize("tile_bytes, pending", [(N.TILE_BYTES, N.PENDING), (4_000, 50)])
def test_a_vector_moves_once_for_each_tile(spark, monkeypatch, tile_bytes, pending):
    monkeypatch.setattr(N, "TILE_BYTES", tile_bytes)
    monkeypatch.setattr(N, "PENDING", pending)
    monkeypatch.setattr(N, "QUERY_ROWS", 16)
    monkeypatch.setattr(N, "DATA_ROWS", 50)
    meetings, sent = N._meetings, []
    monkeypatch.setattr(N, "_meetings", lambda some, pairs: sent.append(meetings(some, pairs)) or sent[-1])
    rng = np.random.default_rng(3)
    data = np.vstack([rng.normal(size=(380, 6)), np.ones((20, 6))])
    df = spark.createDataFrame([(f"c{i:03d}", [float(x) for x in v]) for i, v in enumerate(data)], "cell string, vector array<double>")
    found = {}
    for r in N.knn_cosine(df, 4, block_rows=5).collect():
        found.setdefault(r["cell"], {})[r["rank"]] = r["neighbor"]
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 10)
    for i in range(len(data)):
        best = sorted((-sims[i, j], j) for j in range(len(data)) if j != i)[:4]
        assert [found[f"c{i:03d}"][n] for n in range(1, 5)] == [f"c{j:03d}" for _, j in best]
    blocks = sent[-1].select("block").distinct().count()
    tiles = sent[-1].select("tile").distinct().count()
    # Block by block each of the blocks, 80 at least, would move to all others.
    assert blocks >= 80 and 5 <= tiles <= 8 and sent[-1].count() <= blocks * (tiles + 1)
