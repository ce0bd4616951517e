import numpy as np
import pandas as pd
import pytest

from conftest import rows
from lattiq.llm import topn

SCHEMA = "query_id bigint, shard int, passage_ids array<bigint>, scores array<float>, g string, item string, score string, code string"


def frame(spark, data):
    return spark.createDataFrame([(q, 0, p, s, "x", "y", "z", "w") for q, p, s in data], SCHEMA)


def top(df, n=10):
    return rows(topn.top_n(topn.entries(df), n).selectExpr("g", "item"))


def test_dirt_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (1, [5, 4, 3, 2, 1], [1.0, 1.0, 1.0, 1.0, 1.0]),
        (1, [5, 9], [2.0, nan]),
        (1, [7, None, 8], [None, 9.0]),
        (2, None, [1.0]),
        (2, [1], None),
        (2, [], []),
        (3, [1, 2, 3], [inf, -inf, 0.0]),
        (3, [4], [-0.0]),
        (None, [1], [1.0]),
    ]
    df = frame(spark, data)
    assert top(df, 3) == [(1, 1), (1, 2), (1, 5), (3, 1), (3, 3), (3, 4)]
    assert top(df, 10) == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (3, 1), (3, 2), (3, 3), (3, 4)]
    assert top(df, 1) == [(1, 5), (3, 1)]


def test_empty(spark):
    assert top(frame(spark, []), 5) == []


@pytest.mark.parametrize("seed", [0, 1])
def test_against_sorting(spark, seed):
    """Large ties, a group with most of the rows, negative scores and ids at the ends of their range."""
    rng = np.random.default_rng(seed)
    n = 30_000
    g = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 300, n))
    ids = rng.integers(0, 4000, n)
    ids[:4] = [2**63 - 1, -(2**63), 2**62, -1]
    s = np.where(rng.random(n) < 0.7, rng.integers(-3, 4, n), rng.normal(size=n) * 1e3).astype(np.float32)
    pdf = pd.DataFrame({"g": g, "item": ids, "score": s})
    got = rows(topn.top_n(spark.createDataFrame(pdf, "g bigint, item bigint, score float"), 10).selectExpr("g", "item"))
    best = pdf.groupby(["g", "item"]).score.max().reset_index().sort_values(["g", "score", "item"], ascending=[True, False, True])
    want = best.groupby("g").head(10)[["g", "item"]]
    assert got == sorted(map(tuple, want.values.tolist()), key=repr)


def test_hot_groups_are_salted(spark):
    df = spark.range(300_000).selectExpr("0L as g", "id as item", "cast(id % 7 as float) as score")
    assert rows(topn.top_n(df, 4).selectExpr("item")) == [(13,), (20,), (27,), (6,)]


def test_many_hot_groups_are_salted(spark, monkeypatch):
    """Salting goes by the size of a group, not by its share: here every group is salted."""
    df = spark.range(40_000).selectExpr("id % 20 as g", "id as item", "cast((id * 7919) % 1000 as float) as score")
    want = top_of(df, 5)
    monkeypatch.setattr(topn, "HOT_ROWS", 300)
    assert top_of(df, 5) == want and len(want) == 100
    monkeypatch.setattr(topn, "MOST_HOT", 10)
    assert top_of(df, 5) == want


def top_of(df, n):
    return rows(topn.top_n(df, n).selectExpr("g", "item"))


def test_rank(spark):
    df = topn.ranked(topn.top_n(topn.entries(frame(spark, [(1, [3, 2, 1], [1.0, 5.0, 1.0])])), 2))
    assert rows(df.selectExpr("item", "rank")) == [(1, 2), (2, 1)]
