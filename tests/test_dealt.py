"""Heavy keys and small files: small cases by hand, whole tables against DuckDB."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from lattiq.operators import compaction, salted

PARTIAL = "partial_id bigint, cid int, seg int, centroid_counts bigint, centroid_pids array<bigint>, extra string"


def test_salted_counts(spark):
    data = [
        (0, 1, 0, 3, [5, 5, 7, None, -1], "x"),
        (0, 1, 0, 3, [5, 5, 7, None, -1], "copy"),
        (1, 1, 0, 99, [7, 8], "x"),
        (1, 1, 1, None, None, "x"),
        (1, 1, 2, 0, [], "x"),
        (2, 2, 0, 1, [7], "x"),
        (None, 2, 0, 1, [7], "x"),
        (3, None, 0, 1, [7], "x"),
    ]
    df = spark.createDataFrame(data, PARTIAL)
    for per_salt in (1, 10**6):
        assert rows(salted.merged_postings(df, per_salt)) == [(1, 5, 2, False), (1, 7, 2, True), (1, 8, 1, False), (2, 7, 1, False)]
        assert rows(salted.centroid_totals(df, per_salt)) == [(1, 5, 3, 1), (2, 1, 1, 0)]
    assert rows(salted.posting_segments(df)) == [(1, 0, [5, 7, 8], [2, 2, 1]), (2, 0, [7], [1])]


def test_salted_empty(spark):
    df = spark.createDataFrame([], PARTIAL)
    assert rows(salted.merged_postings(df)) == [] and rows(salted.centroid_totals(df)) == []


def test_heavy_key_is_salted(spark):
    df = spark.range(20_000).selectExpr("0L as partial_id", "cast(if(id % 3 = 0, id % 50 + 1, 0) as int) as cid", "cast(id as int) as seg", "1L as centroid_counts", "array(id) as centroid_pids")
    assert rows(salted.heavy_keys(df.selectExpr("cid", "1 as n"), "cid", "n", 1000)) == [(0, 14)]
    parts = {r[0]: r[1] for r in rows(salted.salted_counts(df, 1000).groupBy("cid").agg(F.countDistinct("salt")))}
    assert parts[0] == 14 and parts[1] == 1
    sizes = {r[0]: r[1] for r in rows(salted.centroid_totals(df, 1000))}
    assert sizes[0] == 13333 and sum(sizes.values()) == 20_000


def test_passages_over_several_salts(spark):
    """Copies of a passage that fall under different salts are one passage after the merge."""
    df = spark.range(4000).selectExpr("id % 4 as partial_id", "1 as cid", "cast(id as int) as seg", "1L as centroid_counts", "array(id % 10, id % 7, null, -1L) as centroid_pids")
    stage1 = salted.salted_counts(df, 500)
    assert stage1.where("pid = 3").count() > 10
    got = rows(salted.merged_postings(df, 500))
    assert got == rows(salted.merged_postings(df, 10**9)) and sum(r[2] for r in got) == 8000
    longest = salted.posting_segments(df, 4, 500).selectExpr("max(size(pids)) as n").first().n
    assert longest <= 10
    old = salted.BROADCAST_ROWS, salted.HOT_ROWS
    salted.BROADCAST_ROWS, salted.HOT_ROWS = 0, 5
    try:
        apart = rows(salted.posting_segments(df, 4, 500).selectExpr("cid", "inline(arrays_zip(pids, counts))"))
    finally:
        salted.BROADCAST_ROWS, salted.HOT_ROWS = old
    assert sorted(r[1:] for r in apart) == sorted(r[1:3] for r in got)


@pytest.mark.parametrize(
    "path,want",
    [("a/b.npy", "a/b.npy"), ("./a//b.npy", "a/b.npy"), ("x/../a/./b.npy", "a/b.npy"), ("../a.npy", "../a.npy"), ("a/../../b", "../b"), ("A/b.npy", "A/b.npy"), ("", "")],
)
def test_paths(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").selectExpr(compaction.resolved_path("p") + " as r").first().r == want


def npy(n, lie=None):
    import io

    b = io.BytesIO()
    np.save(b, np.arange(n * 8).reshape(n, 8).astype(np.float16))
    return bytearray(b.getvalue()) if lie is None else bytearray(b.getvalue()[:lie])


def test_consolidation(spark, tmp_path):
    t = [dt.datetime(2025, 1, i + 1) for i in range(5)]
    files = [
        (1, "a.npy", 0, [1, 2], [10, 11], npy(3), t[0], "x"),
        (1, "d/../a.npy", 0, [1, 2], [10, 11], npy(3), t[0], "x"),
        (1, "b.npy", 0, [1, 1], [11, 12], npy(2), t[1], "x"),
        (1, "bad.npy", 0, [5], [13], npy(3), t[0], "x"),
        (1, "cut.npy", 0, [3], [14], npy(3, 150), t[0], "x"),
        (1, "none.npy", 0, None, None, npy(0), t[0], "x"),
        (1, "unlisted.npy", 0, [1], [15], npy(1), t[0], "x"),
        (2, "a.npy", 0, [2, 0], [10, None], npy(2), t[0], "x"),
        (2, "n.npy", 0, None, [16], npy(0), t[0], "x"),
        (None, "a.npy", 0, [1], [17], npy(1), t[0], "x"),
    ]
    f = spark.createDataFrame(files, "source_id bigint, file_path string, n_bytes bigint, doclens array<bigint>, passage_ids array<bigint>, payload binary, written_at timestamp, chunk_size string")
    s = spark.createDataFrame([(1, ["./a.npy", "b.npy", "b.npy", None, "bad.npy", "cut.npy", "none.npy", "gone.npy"], 2, 9, t[0]), (2, ["a.npy", "n.npy", "A.npy"], None, 1, t[0]), (3, None, 5, 0, t[0])], "source_id bigint, files array<string>, chunk_size bigint, num_docs bigint, listed_at timestamp")
    out = compaction.consolidate(s, f.drop("chunk_size"))
    got = {(r.source_id, r.passage_id): r for r in out.collect()}
    assert sorted(got) == [(1, 10), (1, 11), (1, 12), (2, 10), (2, 16)]
    assert got[1, 11].doclen == 1  # from the later file
    assert bytes(got[1, 10].vectors) == np.arange(8).astype(np.float16).tobytes()
    assert bytes(got[1, 12].vectors) == np.arange(8, 16).astype(np.float16).tobytes()
    assert bytes(got[2, 16].vectors) == b""
    written = compaction.write_consolidated(out, str(tmp_path / "out"))
    report = compaction.reconcile(s, f.drop("chunk_size"), written)
    assert rows(report.select("source_id", "expected", "ok")) == [(1, 3, True), (2, 2, True)]
    lost = compaction.reconcile(s, f.drop("chunk_size"), written.where("passage_id <> 11"))
    assert rows(lost.select("source_id", "expected", "ok")) == [(1, 3, False), (2, 2, True)]
    small = compaction.consolidate(s, f.drop("chunk_size"), piece_bytes=1)
    assert rows(small.groupBy("source_id").agg({"piece": "max"})) != rows(out.groupBy("source_id").agg({"piece": "max"}))


def test_consolidation_empty(spark):
    f = spark.createDataFrame([], "source_id bigint, file_path string, doclens array<bigint>, passage_ids array<bigint>, payload binary, written_at timestamp")
    s = spark.createDataFrame([], "source_id bigint, files array<string>, chunk_size bigint")
    assert rows(compaction.consolidate(s, f)) == []


@pytest.mark.parametrize("name", ["p2_found", "p2_salted", "p2_segments", "p2_totals", "p3_found", "p3_reconciled", "search_topk", "kernel_scores", "filter_lambda"])
def test_against_duckdb(spark, name):
    import duckdb

    from lattiq.operators import dealt
    from lattiq.plans import catalogue

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("partial_compacted", "disk_embedding_source", "embedding_files", "embeddings", "residual_codec", "documents"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    queries, oracle = {**dealt.QUERIES, **catalogue.QUERIES}, {**dealt.ORACLE, **catalogue.ORACLE}
    df = queries[name](spark, d)
    want = con.execute(f"select {', '.join(df.columns)} from ({oracle[name]})").fetchall()
    assert rows(df) == sorted(want, key=repr)
