"""Near-duplicate vectors and nearest neighbours against all pairs."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from seqlattice.llm import graphsearch, nearpairs  # noqa: E402


def vectors(n=300, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(0, n, 5):
        source = x[rng.integers(0, n)]
        x[k] = source * rng.uniform(0.5, 2) + rng.normal(size=dim) * rng.choice([0, 0.05, 0.2, 0.33])
    return x.astype(np.float32)


ODD = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0]]


def table(spark, x, ids=None):
    rows = [(int(i), v.tolist(), "l") for i, v in zip(ids if ids is not None else range(len(x)), x)]
    rows += [(10_000 + k, v, None) for k, v in enumerate(ODD)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, kept string")


@pytest.mark.parametrize("tile,threshold", [(4096, 0.95), (40, 0.95), (16, 0.8)])
def test_near_duplicates(spark, tile, threshold):
    """Small tiles make many pivots, visits and units."""
    x = vectors()
    x[50:90] = x[7]  # equal vectors
    ids = np.random.default_rng(1).permutation(len(x)) + 5
    got = {r["vec_id"]: tuple(r)[1:] for r in nearpairs.near_duplicates(table(spark, x, ids), threshold, tile=tile).collect()}
    y = x.astype(np.float64)
    norm = np.linalg.norm(y, axis=1)
    link = (y @ y.T) / (norm[:, None] * norm[None, :]) >= threshold
    np.fill_diagonal(link, False)
    part = brute.components(ids.tolist(), [(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(link))])
    want = {int(i): (int(link[k].sum()), part[int(i)], part[int(i)] == i) for k, i in enumerate(ids)}
    want |= {10_000 + k: (0, 10_000 + k, True) for k in range(len(ODD))}
    assert got == want


def test_near_duplicates_of_odd_ids(spark):
    """Equal ids with equal and other vectors, and a null id."""
    a, b = [1.0, 0.0], [0.0, 1.0]
    df = spark.createDataFrame([(1, a), (1, a), (2, b), (1, b), (None, b), (None, None), (4, [2.0, 0.0])], "vec_id long, embedding array<double>")
    order = lambda r: str(r)
    got = sorted((tuple(r) for r in nearpairs.near_duplicates(df).collect()), key=order)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, False), (4, 2, 1, False)], key=order)
    assert nearpairs.near_duplicates(df.filter("vec_id > 99")).collect() == []
    assert [tuple(r) for r in nearpairs.near_duplicates(df.filter("embedding IS NULL")).collect()] == [(None, 0, None, False)]


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(4)
    for dim in (2, 16, 300):
        x = rng.normal(size=(80, dim)) * rng.uniform(0.1, 9, (80, 1))
        x[1] = x[0] * 3
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        q, scale, error = nearpairs.quantise(unit)
        back = q * scale[:, None]
        off = np.abs(unit @ unit.T - back @ back.T)
        e, f = error[:, None], error[None, :]
        assert (off <= e + f + 3 * e * f + 1e-12).all()


def test_dense_tiles_lose_no_link():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1, 24)) + rng.normal(size=(700, 24)) * 0.22
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T) >= 0.95
    seen = np.zeros_like(want)
    for i, j in nearpairs.tile_links(x, x, 0.95, True):
        seen[i, j] = True
    assert (seen == np.triu(want, 1)).all() and 0.02 < want.mean() < 0.98


def nearest(x, ids, q, k):
    score = x @ x[q]
    rest = np.flatnonzero(ids != ids[q])
    return [(int(ids[r]), float(score[r])) for r in rest[np.lexsort((ids[rest], -score[rest]))][:k]]


def test_nearest_of_few_are_all(spark):
    """A shard within the beam is searched whole: exact, with ties and copies."""
    x = vectors(90)
    x[10:60] = x[3]
    df = table(spark, x)
    found = graphsearch.search(graphsearch.build_index(df), df.filter("vec_id % 20 = 0"))
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    y, ids = x.astype(np.float64), np.arange(len(x))
    # The odd row of two components is a candidate only for its like, and has none.
    assert set(got) == set(range(0, 90, 20))
    for q, rows in got.items():
        want = nearest(y, ids, q, 20)
        assert [v for v, _ in rows] == [v for v, _ in want]
        assert np.allclose([s for _, s in rows], [s for _, s in want])


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_on_graphs(spark, scaled):
    x = vectors(3000, 24, seed=9)
    if scaled:
        x *= np.random.default_rng(1).uniform(0.2, 3, (len(x), 1)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = graphsearch.search(graphsearch.build_index(df, shard=800), df.filter("vec_id % 20 = 0"))
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    y, ids, hit = x.astype(np.float64), np.arange(len(x)), 0
    assert len(got) == 150
    for q, rows in got.items():
        assert sorted(rows) == list(range(1, 21))
        want = nearest(y, ids, q, 20)
        hit += len({v for v, _ in want} & {v for v, _ in rows.values()})
        assert all(abs(s - float(y[v] @ y[q])) < 1e-9 for v, s in rows.values())
    assert hit / (20 * len(got)) >= 0.9


@pytest.mark.parametrize("factor", [1e4, 1e6])
def test_recall_beside_long_vectors(spark, factor):
    """A few rows far longer than the rest are found, and leave the rest to be told apart."""
    x = vectors(2400, 24, seed=5)
    x[:6] *= np.float32(factor)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = graphsearch.search(graphsearch.build_index(df, shard=800), df.filter("vec_id % 20 = 7"))
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    y, ids, hit, long_hit, long_all = x.astype(np.float64), np.arange(len(x)), 0, 0, 0
    for q, rows in got.items():
        want = {v for v, _ in nearest(y, ids, q, 20)}
        hit += len(want & rows)
        long_all += sum(v < 6 for v in want)
        long_hit += sum(v < 6 for v in want & rows)
    assert len(got) == 120 and long_all > 120
    assert hit / (20 * len(got)) >= 0.9 and long_hit >= 0.9 * long_all


def test_nearest_of_odd_tables(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (20, [1.0, 0.0]), (None, [1.0, 0.0]), (40, None), (1, [3.0, 1.0])], "vec_id long, embedding array<double>")
    index = graphsearch.build_index(df)
    assert sorted(map(tuple, graphsearch.search(index, df).collect())) == [(1, 1, 20, 3.0), (20, 1, 1, 3.0)]
    none = df.filter("vec_id > 99")
    assert graphsearch.search(index, none).collect() == []
    assert graphsearch.search(graphsearch.build_index(none), df).collect() == []
    alone = df.filter("vec_id = 1")
    assert graphsearch.search(graphsearch.build_index(alone), alone).collect() == []


def test_queries_and_shards_are_not_broadcast(spark):
    """The copies of the queries, one for each part of the shards, once went to the driver in one table."""
    x = vectors(600, 8, seed=2)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = graphsearch.search(graphsearch.build_index(df, shard=50), df.filter("vec_id % 20 = 0"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


@pytest.mark.parametrize("units", [1, 5, 96])
def test_parts_of_several_shards(spark, monkeypatch, units):
    """Shards that a part holds together, and blocks of few queries, find what they find one by one."""
    x = vectors(600, 8, seed=2)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(graphsearch, "UNITS", units)
    monkeypatch.setattr(graphsearch, "QUERIES", 11)
    monkeypatch.setattr(graphsearch, "QUERY_ROOM", 8 * 13)
    found = graphsearch.search(graphsearch.build_index(df, shard=50), df.filter("vec_id % 20 = 0"))
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    # The list of each shard holds all of it, so the result is exact.
    y, ids = x.astype(np.float64), np.arange(len(x))
    assert got == {q: [v for v, _ in nearest(y, ids, q, 20)] for q in range(0, 600, 20)}


def test_groups_are_bounded_and_move_little():
    """Bytes that move: each shard for each block of queries, each query and what it finds for each part."""
    for shards, queries, dim, most_mb in ((1, 25, 64, 2), (13, 2564, 64, 150), (151, 30770, 64, 2000), (1503, 307_700, 64, 150_000), (151, 30770, 768, 70_000)):
        per, blocks = graphsearch.dealt(shards, queries, dim)
        parts = -(-shards // per)
        assert 1 <= per <= max(1, graphsearch.SHARD_ROOM // dim) and per <= shards and -(-queries // blocks) <= max(graphsearch.QUERIES, graphsearch.QUERY_ROOM // dim)
        one_shard, one_query = 4096 * (4 * dim + 4 * graphsearch.ROOM), 4 * dim + 20 * 24
        assert shards * blocks * one_shard + queries * parts * one_query <= most_mb * 1e6


def test_an_id_of_many_vectors_counts_once(spark):
    """Vectors of one id that fill a shard's first places leave the other places to other ids."""
    rows = [(7, [1.0, 0.001 * j]) for j in range(30)] + [(100 + j, [0.5, 0.01 * j]) for j in range(25)] + [(20, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = graphsearch.search(graphsearch.build_index(df), df.filter("vec_id = 20"))
    assert [r["vec_id"] for r in sorted(found.collect(), key=lambda r: r["rank"])] == [7, *range(100, 119)]


def test_pruned_edges_are_diverse():
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1], [0, 1.2], [-3, 0]], np.float32)
    kept = graphsearch.robust_prune(points, np.array([0]), np.array([[1, 2, 3, 4, 5, -1, 0, 1]]), 4, 1.2)
    assert kept[0].tolist() == [1, 3, 5, -1]
