import datetime as dt

import numpy as np
import pytest

from conftest import rows
from lattiq.llm import sampling

SCHEMA = "piece_id bigint, arrived_at timestamp, pids array<bigint>, doclens array<bigint>, embeddings array<array<float>>, leaf string, pos string"


def pieces(spark, data):
    t = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, t + dt.timedelta(minutes=i), p, d, e, "l", "p") for i, p, d, e in data], SCHEMA)


DATA = [
    (0, [1, 2], [1, 2], [[1.0], [2.0], [3.0]]),
    (0, [1, 2], [1, 2], [[1.0], [2.0], [3.0]]),
    (1, None, None, None),
    (2, [], [], []),
    (3, [3, None, 1, 4], [0, 1, 1, 2], [[4.0], [5.0], [6.0], [7.0]]),
]


def test_documents(spark):
    assert rows(sampling.documents_of(pieces(spark, DATA))) == [(1, 0, 0, 1), (2, 0, 1, 2), (3, 3, 0, 0), (4, 3, 3, 2)]


@pytest.mark.parametrize("k", [0, 1, 3, 4, 99])
def test_size(spark, k):
    got = rows(sampling.sample(pieces(spark, DATA), k, seed=1))
    assert len(got) == min(k, 4) == len({r[0] for r in got})
    assert got == rows(sampling.sample(pieces(spark, DATA), k, seed=1))


def test_vectors(spark):
    df = pieces(spark, DATA)
    got = {r.pid: r.vectors for r in sampling.with_vectors(sampling.sample(df, 9), df).collect()}
    assert got == {1: [[1.0]], 2: [[2.0], [3.0]], 3: [], 4: [[6.0], [7.0]]}


def test_empty(spark):
    assert rows(sampling.sample(pieces(spark, []), 5)) == []


def test_selection_is_uniform():
    rng = np.random.default_rng(0)
    hits = np.zeros(12)
    pairs = np.zeros((12, 12))
    for _ in range(12_000):
        p = sampling.select(12, 4, rng)
        assert len(set(p)) == 4 and (np.diff(p) > 0).all()
        hits[p] += 1
        pairs[p[0], p[1]] += 1
    assert np.abs(hits / 12_000 - 1 / 3).max() < 0.02
    assert abs(pairs[0, 1] / 12_000 - (4 * 3) / (12 * 11)) < 0.02  # both of the first two
    assert (sampling.select(1000, 1000, rng) == np.arange(1000)).all()
    long = np.concatenate([sampling.select(100_000, 3, rng) for _ in range(2000)])
    assert abs(long.mean() / 100_000 - 0.5) < 0.02


def test_split_is_hypergeometric():
    rng = np.random.default_rng(2)
    counts = np.array([10, 0, 30, 60])
    q = np.array([sampling.split(counts, 20, rng) for _ in range(4000)])
    assert (q.sum(1) == 20).all() and (q <= counts).all()
    assert np.abs(q.mean(0) - 20 * counts / 100).max() < 0.15
    assert sampling.split(counts, 500, rng).tolist() == counts.tolist()
    for good, bad, n in ((6 * 10**8, 6 * 10**8, 10_000), (10**12, 10**11, 500)):  # beyond the generator's range
        v = np.array([sampling._hypergeometric(rng, good, bad, n) for _ in range(3000)])
        p = good / (good + bad)
        var = n * p * (1 - p)
        assert abs(v.mean() - n * p) < 5 * (var / 3000) ** 0.5 and abs(v.var() / var - 1) < 0.15
    huge = sampling.split(np.array([3_000_000_000, 1_000_000_000]), 1000, rng)
    assert huge.sum() == 1000 and abs(huge[0] - 750) < 80


def test_leaves_share_the_sample(spark):
    df = pieces(spark, [(i, list(range(i * 50, i * 50 + 50)), [1] * 50, None) for i in range(40)])
    old, sampling.LEAF = sampling.LEAF, 100
    try:
        got = [r[0] for r in rows(sampling.sample(df, 700, seed=5))]
    finally:
        sampling.LEAF = old
    assert len(set(got)) == 700 and abs(np.mean(got) - 1000) < 80


def test_long_pieces_are_linear(spark):
    """One piece of 200,000 documents: elements travel alone, so the time does not grow with its square."""
    import time

    df = spark.range(1).selectExpr("id as piece_id", "timestamp'2025-01-01' as arrived_at", "sequence(0L, 199999L) as pids", "sequence(0L, 199999L) as doclens")
    began = time.time()
    assert sampling.documents_of(df).where("pid = doclen").count() == 200_000
    assert time.time() - began < 60


def test_unequal_lists(spark):
    df = pieces(spark, [(0, [1, 2, 3], [5], None), (1, [4], [1, 2, 3], None), (2, [6], None, None)])
    assert rows(sampling.documents_of(df)) == [(1, 0, 0, 5), (2, 0, 1, 0), (3, 0, 2, 0), (4, 1, 0, 1), (6, 2, 0, 0)]
