import numpy as np
import pytest

from conftest import rows
from lattiq.llm import clusters, neighbours
from lattiq.llm import vectors as V

SCHEMA = "vec_id bigint, pid bigint, embeddings array<float>, key string, v string"


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), 0, None if r is None else [None if k is None else float(k) for k in r], "k", "v") for i, r in zip(ids, x, strict=True)], SCHEMA)


def sample(n=900, seed=0):
    """Tight clusters, chains at the link threshold, near copies and noise."""
    rng = np.random.default_rng(seed)
    out = []
    for size in (200, 60, 12, 6, 5, 4, 3):
        c = rng.normal(size=64)
        c /= np.linalg.norm(c)
        out += [c + 0.035 * rng.normal(size=64) for _ in range(size)]
    for _ in range(3):  # chains
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        for _ in range(7):
            out.append(a)
            b = rng.normal(size=64)
            b -= b @ a * a
            b /= np.linalg.norm(b)
            a = 0.87 * a + np.sqrt(1 - 0.87**2) * b
    while len(out) < n:
        out.append(rng.normal(size=64))
    x = np.array(out)
    for i in range(0, 60, 3):
        x[-1 - i] = x[i] + 0.003 * rng.normal(size=64)
    return (x * rng.uniform(0.01, 300, (n, 1))).astype(np.float32)


def unit(x):
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_encoding_is_accurate():
    u = unit(sample())
    d = V.decode(V.encode(u).ravel())
    assert np.abs(u @ u.T - d @ d.T).max() < 3e-5


def test_usable_rows(spark):
    good = np.arange(1, 65)
    data = [None, [], [1.0] * 63, [1.0] * 65, [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, good, good * 1e30, good * 1e-30]
    got = V.usable(frame(spark, range(len(data)), data)).collect()
    assert sorted(r.vec_id for r in got) == [8, 9, 10]
    assert len({r.key for r in got}) == 1


@pytest.fixture(scope="module")
def table(spark):
    x = sample()
    return x, frame(spark, np.arange(len(x)) * 3 + 1, x)


def test_neighbours(table):
    x, df = table
    u = unit(x)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1, kind="stable")[:, :5]
    got = neighbours.nearest(df, per_list=120, per_group=300).toPandas()
    assert (got.groupby("vec_id").size() == 5).all() and got.vec_id.nunique() == len(x)
    pairs = set(zip(got.vec_id, got.neighbour_id, strict=True))
    hit = np.mean([(int(i) * 3 + 1, int(j) * 3 + 1) in pairs for i in range(len(x)) for j in want[i]])
    assert hit > 0.9
    close = {(min(i, j) * 3 + 1, max(i, j) * 3 + 1) for i in range(len(x)) for j in map(int, want[i]) if u[i] @ u[j] >= 0.985}
    assert set(rows(neighbours.near_pairs(df))) == close


def test_copies_do_not_multiply(spark):
    rng = np.random.default_rng(1)
    same = rng.normal(size=64)
    x = [same * (1 + i % 3) for i in range(300)] + list(rng.normal(size=(20, 64)))
    df = frame(spark, range(320), x)
    df = df.unionByName(df.limit(50))
    got = neighbours.nearest(df).toPandas()
    assert len(got) == 320 * 5
    by = got.sort_values("rank").groupby("vec_id").neighbour_id.apply(list)
    assert by[0] == [1, 2, 3, 4, 5] and by[3] == [0, 1, 2, 4, 5] and by[299] == [0, 1, 2, 3, 4]
    assert len(rows(neighbours.near_pairs(df))) == 5 + 4 + 3 + 2 + 1 + 5 * 294
    found = clusters.cluster(df).toPandas()
    assert len(found) == 300 and set(found.cluster_vec_id) == {0} and set(found["size"]) == {300}


def test_small_and_empty(spark):
    assert rows(neighbours.nearest(frame(spark, [], []))) == []
    assert rows(neighbours.near_pairs(frame(spark, [], []))) == []
    assert rows(clusters.cluster(frame(spark, [], []))) == []
    assert rows(neighbours.nearest(frame(spark, [7], [np.ones(64)]))) == []
    two = frame(spark, [7, 5], [np.ones(64), np.r_[np.ones(63), 2]])
    assert [(r[0], r[1], r[2]) for r in rows(neighbours.nearest(two))] == [(5, 7, 1), (7, 5, 1)]


def test_clusters(spark, table):
    x, df = table
    u = unit(x)
    a, b = np.nonzero(u @ u.T >= 0.85)
    label = clusters._labels(len(x), a, b)
    size = np.bincount(label)
    want = sorted((int(label[i]) * 3 + 1, i * 3 + 1) for i in range(len(x)) if size[label[i]] >= 5)
    for per_list, per_group in ((60, 300), (400, 8000)):
        found = clusters.cluster(df, per_list=per_list, per_group=per_group)
        assert sorted(map(tuple, found.select("cluster_vec_id", "vec_id").collect())) == want
    report = clusters.describe(found).toPandas()
    assert report.groupby("cluster_vec_id").ngroups == len({c for c, _ in want})
    assert (report.groupby("cluster_vec_id").size() <= 3).all() and (report.in_cell <= report["size"]).all()


def bundles():
    """A crowded bundle and a smaller one beside it: one cluster, though their vectors may share no cell."""
    rng = np.random.default_rng(11)
    c, d = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    d = 0.88 * c + np.sqrt(1 - 0.88**2) * d
    x = np.concatenate([c + 0.01 * rng.normal(size=(1500, 64)), d + 0.01 * rng.normal(size=(150, 64)), rng.normal(size=(50, 64))])
    return x.astype(np.float32)


@pytest.mark.parametrize("hosts", [100_000, 200])
def test_links_outside_shared_cells(spark, monkeypatch, hosts):
    x = bundles()
    u = unit(x)
    label = clusters._labels(len(x), *np.nonzero(u @ u.T >= 0.85))
    size = np.bincount(label)
    want = sorted((int(label[i]), i) for i in range(len(x)) if size[label[i]] >= 5)
    assert {c for c, _ in want} == {0} and len(want) == 1650
    monkeypatch.setattr(clusters, "HOSTS", hosts)
    found = clusters.cluster(frame(spark, range(len(x)), x), per_list=20, per_group=100)
    assert sorted(map(tuple, found.select("cluster_vec_id", "vec_id").collect())) == want


def test_labels_and_propagation(spark):
    from lattiq.functions.scratch import Scratch

    n = 200
    rng = np.random.default_rng(3)
    a, b = np.arange(n - 1), np.arange(1, n)
    cut = rng.random(n - 1) > 0.1
    a, b = a[cut], b[cut]
    perm = rng.permutation(n)
    label = clusters._labels(n, perm[a], perm[b])
    assert (label[perm[a]] == label[perm[b]]).all() and (label <= np.arange(n)).all()
    got = dict(rows(clusters.propagate(spark.createDataFrame([(int(i), int(j)) for i, j in zip(perm[a], perm[b], strict=True)], "a bigint, b bigint"), Scratch(spark, "t"))))
    assert all(label[k] == v for k, v in got.items())


def test_crowded_cells():
    rng = np.random.default_rng(5)
    c = rng.normal(size=64)
    c /= np.linalg.norm(c)
    x = np.concatenate([c + 0.03 * rng.normal(size=(700, 64)), rng.normal(size=(300, 64))])
    x = unit(x).astype(np.float32)
    i, j = clusters.cell_links(x, 0.85)
    a, b = np.nonzero(x @ x.T >= 0.85)
    assert (clusters._labels(1000, i, j) == clusters._labels(1000, a, b)).all()
    assert len(i) < 20_000


def test_layouts_agree(spark, table):
    """Heads that are broadcast and heads that travel to their cells give the same lists; many cells keep the recall.

    Lists are a tenth of the usual size here; sixteen are searched (with the default of twelve the recall is 0.89).
    """
    x, df = table
    u = unit(x)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1, kind="stable")[:, :5]
    got = [neighbours.nearest(df, per_list=40, per_group=300, searched=16, cell_lists=4, head_bytes=b).toPandas() for b in (None, 0)]
    pairs = [set(zip(g.vec_id, g.neighbour_id, strict=True)) for g in got]
    assert np.mean([(int(i) * 3 + 1, int(j) * 3 + 1) in pairs[1] for i in range(len(x)) for j in want[i]]) > 0.9
    assert pairs[0] == pairs[1]


def test_groups_share_partitions(spark, table, monkeypatch):
    x, df = table
    whole = sorted(map(tuple, neighbours.nearest(df, per_list=60, per_group=200).select("vec_id", "neighbour_id").collect()))
    monkeypatch.setattr(V, "TASKS", 2)
    assert sorted(map(tuple, neighbours.nearest(df, per_list=60, per_group=200).select("vec_id", "neighbour_id").collect())) == whole


def test_walk_finds_heads():
    rng = np.random.default_rng(2)
    heads = unit(rng.normal(size=(600, 64))).astype(np.float32)
    heads = heads[np.argsort((heads @ heads[:12].T).argmax(1), kind="stable")]
    starts = np.linspace(0, 600, 13).astype(int)
    coarse = np.stack([heads[a:b].mean(0) for a, b in zip(starts, starts[1:], strict=False)])
    coarse /= np.linalg.norm(coarse, axis=1, keepdims=True)
    lay = V.Layout(coarse, starts, heads, V.nearest_heads(heads, heads, np.arange(600)), np.zeros(600, int), np.zeros(600, int), np.arange(600))
    ids, cos = lay.search(heads, 5)
    assert (ids[:, 0] == np.arange(600)).mean() > 0.99 and (np.diff(cos, axis=1) <= 0).all()
    assert all(len(set(r)) == 5 for r in ids)


def test_hot_keys_are_attached_apart(spark, monkeypatch):
    from lattiq.functions.scratch import Scratch

    scratch = Scratch(spark, "t")
    df = scratch.write(spark.range(1000).selectExpr("if(id < 400, 0, id) as k", "id"), "rows")
    table = spark.range(0, 1000, 2).selectExpr("id as k", "id * 2 as v")
    want = rows(df.join(table, "k", "left"))
    monkeypatch.setattr(V, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(V, "HOT_ROWS", 100)
    got = V.attach(df, table, "k", scratch, "table", "left")
    assert rows(got) == want and len(want) == 1000
