"""Index build: document layout, codec statistics, postings and their offsets.

Token rows are ``(pid, pos, vec)``; assigned rows add ``cid, score, residual``; postings are ``(cid, pid, ...)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_DOCS = 25_000


def doc_lengths(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("pid").agg(F.count(F.lit(1)).alias("doclen"))


def chunk_of(docs: DataFrame, per_chunk: int = CHUNK_DOCS) -> DataFrame:
    """Chunk number of each document, counting documents in order of pid (dense ids)."""
    return docs.withColumn("chunk", F.expr(f"pid div {per_chunk}"))


def split_by_doclens(files: DataFrame) -> DataFrame:
    """``(file, doc, first_row, n_rows)`` from files with ``doclens``: prefix sums inside each file."""
    return files.selectExpr("file", "doclens", "posexplode(doclens) as (doc, n_rows)").selectExpr(
        "file", "doc", "aggregate(slice(doclens, 1, doc), 0L, (s, x) -> s + x) as first_row", "cast(n_rows as bigint) as n_rows"
    )


def sample_documents(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n documents in the order of a seeded hash: uniform, repeatable, and a bounded top-n for Spark."""
    return docs.select("pid").distinct().orderBy(F.xxhash64(F.col("pid"), F.lit(seed)), "pid").limit(n)


def histogram(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """``(cid, size)`` for every centroid, zeros kept."""
    counts = assigned.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
    return centroids.select("cid").join(counts, "cid", "left").selectExpr("cid", "coalesce(n, 0L) as size")


def offsets(sizes: DataFrame) -> DataFrame:
    """Exclusive running sum of sizes in order of cid; one row per centroid, so one partition suffices."""
    return sizes.withColumn("begin", F.expr("sum(size) over (order by cid) - size"))


def residual_norms(assigned: DataFrame) -> DataFrame:
    return assigned.withColumn("norm", F.expr("sqrt(aggregate(residual, 0D, (s, x) -> s + x * x))"))


def nearest_rank(norms: DataFrame, share: float = 0.75) -> DataFrame:
    """The threshold as a nearest-rank percentile (creation and compaction)."""
    return norms.agg(F.expr(f"percentile_disc({share}) within group (order by norm)").alias("threshold"))


def linear_rank(norms: DataFrame, share: float = 0.75) -> DataFrame:
    """The threshold as a linear percentile (additions)."""
    return norms.agg(F.expr(f"percentile(norm, {share})").alias("threshold"))


def mean_abs_residual(assigned: DataFrame) -> DataFrame:
    """``(dim, avg_abs)`` per dimension."""
    return assigned.select(F.posexplode("residual").alias("dim", "x")).groupBy("dim").agg(F.avg(F.abs("x")).alias("avg_abs"))


def bucket_quantiles(assigned: DataFrame, nbits: int) -> DataFrame:
    """One row ``(cutoffs, weights)``: linear quantiles at i / 2^b and (i + 1/2) / 2^b over all residual values.

    Exact; the engine calls it on the held-out sample, which is bounded.
    """
    n = 1 << nbits
    cut = ", ".join(f"{i / n}D" for i in range(1, n))
    mid = ", ".join(f"{(i + 0.5) / n}D" for i in range(n))
    values = assigned.select(F.explode("residual").alias("x"))
    return values.agg(F.expr(f"percentile(x, array({cut}))").alias("cutoffs"), F.expr(f"percentile(x, array({mid}))").alias("weights"))


def sorted_postings(postings: DataFrame, partitions: int) -> DataFrame:
    """Postings laid out by ranges of cid, ready for scans that ask for few cells."""
    return postings.repartitionByRange(partitions, "cid").sortWithinPartitions("cid", "pid")


def prune_empty(centroids: DataFrame, postings: DataFrame) -> DataFrame:
    """Used centroids with dense new numbers in the old order: ``(cid, new_cid)``."""
    return centroids.select("cid").join(postings.select("cid").distinct(), "cid", "left_semi").withColumn("new_cid", F.expr("cast(row_number() over (order by cid) - 1 as int)"))


def statistics(postings: DataFrame) -> DataFrame:
    """One row: embeddings, distinct passages and mean document length."""
    return postings.agg(F.count(F.lit(1)).alias("num_embeddings"), F.countDistinct("pid").alias("num_passages")).withColumn(
        "avg_doclen", F.expr("case when num_passages > 0 then num_embeddings / num_passages else 0D end")
    )


def shard_of(sizes: DataFrame, ratios: list[float]) -> DataFrame:
    """``(shard, first_cid, end_cid)``: contiguous cid ranges whose embeddings follow the ratios.

    A shard ends with the first centroid at which the running count reaches its running ratio; the last
    shard takes the rest.
    """
    total = sum(ratios)
    bounds, run = [], 0.0
    for r in ratios[:-1]:
        run += r / total
        bounds.append(run)
    run_sum = sizes.withColumn("cum", F.expr("sum(size) over (order by cid)")).withColumn("all", F.expr("sum(size) over ()"))
    aggs = [F.expr(f"coalesce(min(case when cum >= ceil({b}D * all) then cid end) + 1, count(1))").alias(f"e{i}") for i, b in enumerate(bounds)]
    row = run_sum.agg(F.count(F.lit(1)).alias("n"), *aggs)
    starts = ["0L"]
    for i in range(len(bounds)):
        starts.append(f"greatest({', '.join(['0L', *(f'cast(e{j} as bigint)' for j in range(i + 1))])})")
    ends = [*starts[1:], "n"]
    structs = ", ".join(f"struct({i} as shard, {s} as first_cid, {e} as end_cid)" for i, (s, e) in enumerate(zip(starts, ends, strict=True)))
    return row.selectExpr(f"inline(array({structs}))")
