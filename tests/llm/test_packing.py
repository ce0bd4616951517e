from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from lattiq.llm import packing


def check_plan(hist, plan, capacity):
    placed, fill = Counter(), Counter()
    ranks = {}
    for n, first, count, container in plan.run:
        placed[n] += count
        ranks.setdefault(n, []).append((first, first + count))
        for i in range(count):
            fill[container + i] += n
    assert placed == Counter({n: c for n, c in hist.items() if c})
    assert all(v <= capacity for v in fill.values())
    assert set(fill) == set(range(plan.containers))
    for spans in ranks.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


@given(st.dictionaries(st.integers(1, 100), st.integers(0, 40), max_size=20))
@settings(max_examples=60, deadline=None)
def test_any_histogram(hist):
    check_plan(hist, packing.make_plan(hist, 100, classes=16, rounds=40), 100)


def test_knapsack_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        units, limit, value = rng.integers(1, 12, 5), rng.integers(0, 4, 5), rng.random(5)
        take = packing.price(units, limit, value, 20)
        best = max(sum(v * k for v, k in zip(value, ks, strict=True)) for ks in np.ndindex(*(limit + 1)) if np.dot(ks, units) <= 20)
        assert (take <= limit).all() and take @ units <= 20 and take @ value == pytest.approx(best)


def test_little_is_wasted():
    rng = np.random.default_rng(1)
    sizes = np.clip(rng.lognormal(6.3, 1, 20_000).astype(int), 1, 4096)
    hist = {int(k): int(v) for k, v in Counter(sizes.tolist()).items()}
    plan = packing.make_plan(hist)
    least = -(-sum(k * v for k, v in hist.items()) // 4096)
    assert plan.containers <= 1.01 * least


def test_thirds_fit_exactly():
    plan = packing.make_plan({34: 300, 33: 600}, 100)
    assert plan.containers == 300


def test_pack(spark):
    data = [(i, 34) for i in range(50)] + [(100 + i, 66) for i in range(50)] + [(200, 100), (201, 250), (202, 300), (203, 0), (204, None), (205, 1), (205, 1)]
    out = packing.pack(spark.createDataFrame(data, "doc_id bigint, n_ids bigint"), 100).collect()
    fill, parts, total = Counter(), Counter(), Counter()
    for r in out:
        fill[r.container_id] += r.n_ids
        parts[r.doc_id] += 1
        total[r.doc_id] += r.n_ids
    assert max(fill.values()) <= 100 and len(fill) == 50 + 1 + 3 + 3
    assert parts[201] == 3 and parts[202] == 3 and parts[200] == 1 and parts[203] == parts[204] == 1
    assert total[201] == 250 and total[205] == 2 and sum(parts.values()) == len(out)
    assert sorted(r.part for r in out if r.doc_id == 201) == [0, 1, 2]


def test_pack_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, n_ids bigint")
    assert rows(packing.pack(none)) == []
    assert rows(packing.pack(spark.createDataFrame([(1, 0)], "doc_id bigint, n_ids bigint"))) == [(1, 0, 0, 0)]


def test_one_common_length(spark):
    df = spark.range(1000).selectExpr("id as doc_id", "if(id < 900, 40L, id) as n_ids")
    old, packing.RANK_BUCKET = packing.RANK_BUCKET, 100
    try:
        out = packing.pack(df, 100).toPandas()
    finally:
        packing.RANK_BUCKET = old
    assert out.groupby("container_id").n_ids.sum().max() <= 100
    assert out.groupby("doc_id").n_ids.sum().tolist() == [40] * 900 + list(range(900, 1000))


def test_program_places_most_items():
    """The linear program, not best fit, fills nearly all containers even where every length is rare."""
    rng = np.random.default_rng(2)
    for n in (900, 9000):
        hist = {int(k): int(v) for k, v in Counter(np.clip(rng.lognormal(6.3, 1, n).astype(int), 1, 4096).tolist()).items()}
        plan = packing.make_plan(hist)
        check_plan(hist, plan, 4096)
        inside = sum(c for _, _, c, k in plan.run if k < plan.by_program)
        assert plan.by_program > 0.9 * plan.containers and inside > 0.7 * n
        assert plan.containers <= 1.01 * -(-sum(k * v for k, v in hist.items()) // 4096) + 1


def test_check_sees_faults(spark):
    sized = spark.createDataFrame([(1, 60), (2, 50), (3, 250), (4, None)], "doc_id bigint, n_ids bigint")
    assert rows(packing.check(packing.pack(sized, 100), sized, 100)) == [(0, 4, 0, 0)]
    bad = spark.createDataFrame([(1, 0, 0, 60), (2, 0, 0, 50), (3, 0, 1, 100), (3, 1, 2, 100)], "doc_id bigint, part bigint, container_id bigint, n_ids bigint")
    assert rows(packing.check(bad, sized, 100)) == [(1, 3, 2, 50)]
