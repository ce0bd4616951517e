import numpy as np
import pytest

from lattiq.sources import corpus, tokens


def _write(folder, name, lens, dim=8, seed=0):
    x = np.random.default_rng(seed).normal(size=(sum(lens), dim)).astype(np.float16)
    np.save(folder / f"{name}.npy", x)
    np.save(folder / f"{name}.doclens.npy", np.array(lens))
    return x


def test_file_order(tmp_path):
    for n in ("emb_10", "emb_2", "zeta", "alpha", "emb_2.doclens"):
        np.save(tmp_path / f"{n}.npy", np.zeros(1))
    assert [f.rsplit("/", 1)[1] for f in tokens.npy_files(tmp_path)] == ["emb_2.npy", "emb_10.npy", "alpha.npy", "zeta.npy"]


def test_npy_rows_and_pruned_read(spark, tmp_path):
    a, b = _write(tmp_path, "emb_0", [2, 0, 3]), _write(tmp_path, "emb_1", [1, 4], seed=1)
    got = tokens.from_npy(spark, tmp_path).orderBy("pid", "pos").collect()
    assert [(r.pid, r.pos) for r in got] == [(0, 0), (0, 1), (2, 0), (2, 1), (2, 2), (3, 0), (4, 0), (4, 1), (4, 2), (4, 3)]
    assert np.allclose([r.vec for r in got], np.concatenate([a, b]))
    keep = spark.createDataFrame([(4,)], "pid bigint")
    assert {r.pid for r in tokens.from_npy(spark, tmp_path, keep).collect()} == {4}


def test_npy_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tokens.npy_files(tmp_path)
    np.save(tmp_path / "x.npy", np.zeros((3, 8)))
    with pytest.raises(FileNotFoundError):
        tokens.from_npy(spark, tmp_path)
    np.save(tmp_path / "x.doclens.npy", np.array([1]))
    with pytest.raises(ValueError):
        tokens.from_npy(spark, tmp_path)


def test_queries_are_padded():
    q = tokens.pad_queries([np.ones((2, 4)), np.ones((3, 4))])
    assert q.shape == (2, 3, 4) and q[0, 2].sum() == 0
    assert tokens.pad_queries(np.ones((3, 4))).shape == (1, 3, 4)
    with pytest.raises(ValueError):
        tokens.pad_queries(np.ones(4))


def test_corpus(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": "T", "text": "x"}\n{"_id": "d2", "title": "", "text": "y"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "a"}\n{"_id": "q2", "text": "b"}\n')
    (tmp_path / "qrels").mkdir()
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td2\t0\n")
    docs, queries, qrels = corpus.load(spark, str(tmp_path))
    assert sorted(map(tuple, docs.collect())) == [("d1", "T x"), ("d2", "y")]
    assert [r.qid for r in queries.collect()] == ["q1"]
    assert [tuple(r) for r in qrels.collect()] == [("q1", "d1", 1)]
