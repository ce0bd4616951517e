import math

import pytest

from conftest import rows
from lattiq.operators import build, evaluate


@pytest.fixture(scope="module")
def frames(spark):
    run = spark.createDataFrame([("q1", "a", 3.0), ("q1", "b", 2.0), ("q1", "c", 1.0), ("q2", "z", 1.0), ("qx", "a", 9.0)], "qid string, doc_id string, score double")
    qrels = spark.createDataFrame([("q1", "b", 2), ("q1", "c", 1), ("q1", "n", 0), ("q2", "y", 1), ("q3", "y", 1)], "qid string, doc_id string, rel int")
    return run, qrels


def test_metrics(frames):
    run, qrels = frames
    got = evaluate.evaluate(run, qrels, ("ndcg@10", "recall@2", "hits@1", "hits@3", "map"))
    dcg = 2 / math.log2(3) + 1 / math.log2(4)
    ideal = 2 / math.log2(2) + 1 / math.log2(3)
    assert got["ndcg@10"] == pytest.approx(dcg / ideal / 3)
    assert got["recall@2"] == pytest.approx(0.5 / 3)
    assert (got["hits@1"], got["hits@3"]) == (0, pytest.approx(2 / 3))
    assert got["map"] == pytest.approx((1 / 2 + 2 / 3) / 2 / 3)
    assert set(evaluate.evaluate(run, qrels)) == {"ndcg@10", *(f"hits@{k}" for k in (1, 2, 3, 4, 5, 10))}


def test_duplicates_and_self(spark):
    queries = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "qid int, text string")
    run = spark.createDataFrame([(1, 7, 1.0), (2, 2, 1.0)], "qid int, doc_id int, score double")
    assert rows(evaluate.add_duplicates(run, queries).select("qid", "doc_id")) == [(1, 7), (2, 2), (3, 7)]
    assert rows(evaluate.without_self(run)) == [(1, 7, 1.0)]


def test_shards(spark):
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate([5, 0, 5, 10, 0])], "cid int, size bigint")
    assert rows(build.shard_of(sizes, [1.0])) == [(0, 0, 5)]
    assert rows(build.shard_of(sizes, [1, 1])) == [(0, 0, 3), (1, 3, 5)]
    assert rows(build.shard_of(sizes, [0.9, 0.05, 0.05])) == [(0, 0, 4), (1, 4, 4), (2, 4, 5)]


def test_sampling_is_repeatable(spark):
    docs = spark.range(100).withColumnRenamed("id", "pid")
    a, b = (rows(build.sample_documents(docs, 10)) for _ in range(2))
    assert a == b and len(a) == 10
    assert rows(build.sample_documents(docs, 10, seed=1)) != a
