"""Search: selection of cells, missing-token estimates, posting fetch, merging and top-k.

The score of a passage p for a query is the sum over the query's tokens of the best score over probed cells
that hold p, or the token's estimate m where no probed cell holds it, over passages in at least one probed
cell; ties go to the lower pid.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Parameters:
    """Cells probed per token, cells considered, least best score of a strong token, and embeddings to look past."""

    nprobe: int
    bound: int
    threshold: float
    t_prime: int

    def clamped(self, centroids: int) -> Parameters:
        nprobe = max(1, min(self.nprobe, centroids))
        return Parameters(nprobe, max(nprobe, min(self.bound or 128, centroids)), self.threshold, self.t_prime)


def live_tokens(queries: DataFrame) -> DataFrame:
    """Tokens with any value other than zero."""
    return queries.where("exists(vec, x -> x <> 0)")


def weak_tokens(scores: DataFrame, threshold: float) -> DataFrame:
    """Tokens whose best centroid score is below the threshold (an equal score is kept)."""
    return scores.groupBy("qid", "tok").agg(F.max("score").alias("best")).where(F.col("best") < threshold)


def selected(scores: DataFrame, sizes: DataFrame, p: Parameters) -> DataFrame:
    """The ``bound`` best cells of strong tokens with the running number of embeddings: adds size, cum."""
    best = scores.withColumn("best", F.expr("max(score) over (partition by qid, tok)"))
    kept = best.where((F.col("best") >= p.threshold) & (F.col("rn") <= p.bound)).drop("best")
    return kept.join(F.broadcast(sizes), "cid").withColumn(
        "cum", F.expr("sum(size) over (partition by qid, tok order by rn rows unbounded preceding)")
    )  # one row per centroid, like the codebook


def missing_estimates(picked: DataFrame, p: Parameters) -> DataFrame:
    """``(qid, tok, m)``: the score at the cell where the running number reaches t' (at most the last one)."""
    at = picked.withColumn("at", F.expr(f"least(sum(cast(cum < {p.t_prime} as int)) over (partition by qid, tok), {p.bound - 1}) + 1"))
    return at.where("rn = at").selectExpr("qid", "tok", "score as m")


def dummy_cell(sizes: DataFrame) -> DataFrame:
    """The smallest centroid, ties to the lowest cid: one row ``kd``."""
    return sizes.agg(F.min(F.struct("size", "cid")).alias("s")).selectExpr("s.cid as kd")


def probes(picked: DataFrame, queries: DataFrame, sizes: DataFrame, p: Parameters) -> DataFrame:
    """``(qid, tok, cid, score)``: the first cells of strong tokens, and the dummy cell for all others.

    A probed cell with a score of exactly zero also becomes the dummy cell; tokens that are all zero or weak
    probe only that one, with score 0.
    """
    kd = dummy_cell(sizes)
    strong = picked.where(F.col("rn") <= p.nprobe).crossJoin(F.broadcast(kd))  # one row
    strong = strong.selectExpr("qid", "tok", "case when score = 0 then kd else cid end as cid", "score")
    idle = queries.select("qid", "tok").join(picked.select("qid", "tok").distinct(), ["qid", "tok"], "left_anti").crossJoin(F.broadcast(kd))
    return strong.unionByName(idle.selectExpr("qid", "tok", "kd as cid", "0D as score"))


def fetch(cells: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings of the probed cells (an equi join on cid; the probes are the small side)."""
    return cells.join(postings, "cid")


def residual_scores(hits: DataFrame, queries: DataFrame, weights: str) -> DataFrame:
    """SQL form of the decompressed score; ``hits`` carry ``codes``, ``weights`` is an SQL array."""
    return hits.join(queries, ["qid", "tok"]).selectExpr(
        "qid", "tok", "cid", "pid", f"score + aggregate(zip_with(vec, codes, (a, c) -> a * {weights}[c]), 0D, (s, x) -> s + x) as score"
    )


def merge_max(scored: DataFrame) -> DataFrame:
    """Best score of a passage for a token over cells: ``(qid, tok, pid, score)``."""
    return scored.groupBy("qid", "tok", "pid").agg(F.max("score").alias("score"))


def merge_sum(best: DataFrame, estimates: DataFrame) -> DataFrame:
    """Total per passage; tokens without a probed cell for it count their estimate: ``(qid, pid, score)``."""
    base = estimates.groupBy("qid").agg(F.sum("m").alias("base"))
    over = best.join(estimates, ["qid", "tok"], "left").selectExpr("qid", "pid", "score - coalesce(m, 0D) as d")
    return over.groupBy("qid", "pid").agg(F.sum("d").alias("d")).join(base, "qid", "left").selectExpr("qid", "pid", "d + coalesce(base, 0D) as score")


def top_k(totals: DataFrame, k: int) -> DataFrame:
    """``(qid, rank, pid, score)``: Catalyst limits each group before and after the shuffle."""
    return totals.withColumn("rank", F.expr("row_number() over (partition by qid order by score desc, pid)")).where(F.col("rank") <= k).select("qid", "rank", "pid", "score")


def only(rows: DataFrame, subset: DataFrame) -> DataFrame:
    """Rows of a subset of passages, shared (pid) or per query (qid, pid)."""
    return rows.join(subset, [c for c in ("qid", "pid") if c in subset.columns], "left_semi")


def living(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    return rows.join(tombstones, "pid", "left_anti")


QUERY_TOKENS = 4_096
"""Query tokens that one pass of ``max_sim`` broadcasts."""
HOT_TOKENS = 1_000_000
"""Tokens of a passage that one task may take; a longer one is salted."""


def max_sim(queries: DataFrame, tokens: DataFrame) -> DataFrame:
    """Exact late interaction ``(qid, pid, score)``: best product per query token and passage, summed over tokens.

    Queries are a stated set, scored against all passage tokens in passes of about QUERY_TOKENS.  The tokens of a
    passage are brought together first, so that the kernel reduces them to one row per query and passage, also where
    a passage runs over several batches.  The parts of a passage of more than HOT_TOKENS tokens leave one row per query
    token, and their maxima are merged.
    """
    import numpy as np
    import pyarrow as pa

    from lattiq.functions.kernels import matrix, row_blocks

    spark = queries.sparkSession
    q = queries.select(F.col("qid").cast("bigint"), F.col("tok").cast("int"), "vec")
    per = q.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n")).first()
    passes = -(-(per.n or 0) // QUERY_TOKENS)
    t = tokens.select(F.col("pid").cast("bigint").alias("pid"), "vec")
    hot = F.broadcast(t.groupBy("pid").count().where(f"count > {HOT_TOKENS}").select("pid", F.ceil(F.col("count") / HOT_TOKENS).alias("salts")))  # one for so many tokens
    whole = t.join(hot, "pid", "left_anti").repartition("pid").sortWithinPartitions("pid")
    parts = t.join(hot, "pid").withColumn("salt", F.expr("pmod(xxhash64(vec), salts)")).repartition("pid", "salt").sortWithinPartitions("pid", "salt").select("pid", "vec")
    found, partial = [], []
    for turn in range(passes):
        t = q.where(f"pmod(xxhash64(qid), {passes}) = {turn}").orderBy("qid", "tok").toArrow().combine_chunks()  # about QUERY_TOKENS rows
        if not t.num_rows:
            continue
        shared = spark.sparkContext.broadcast((t.column(0).combine_chunks().to_numpy(), matrix(t.column(2).combine_chunks())))

        def run(batches, each, shared=shared):
            qid, v = shared.value
            names, first = np.unique(qid, return_index=True)

            def emit(pid, best):
                if each:
                    return pa.RecordBatch.from_arrays([pa.array(qid), pa.array(np.arange(len(qid), dtype=np.int32)), pa.array(np.full(len(qid), pid)), pa.array(best)], ["qid", "tok", "pid", "score"])
                return pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), pid)), pa.array(np.add.reduceat(best, first))], ["qid", "pid", "score"])

            open_, best = None, None  # a passage may run over several batches
            for b in batches:
                pid, x = b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1))
                edge = np.flatnonzero(np.diff(pid, prepend=pid[:1] - 1))
                for a, z in zip(edge, np.append(edge[1:], len(pid)), strict=True):
                    top = np.max([(x[a:z][rows] @ v.T).max(0) for rows in row_blocks(int(z - a), len(v))], axis=0)
                    if open_ is not None and pid[a] == open_:
                        best = np.maximum(best, top)
                        continue
                    if open_ is not None:
                        yield emit(open_, best)
                    open_, best = pid[a], top
            if open_ is not None:
                yield emit(open_, best)

        found.append(whole.mapInArrow(lambda b, run=run: run(b, False), "qid bigint, pid bigint, score double"))
        partial.append(parts.mapInArrow(lambda b, run=run: run(b, True), "qid bigint, tok int, pid bigint, score double"))
    if not found:
        return spark.createDataFrame([], "qid bigint, pid bigint, score double")
    merged = [merge_max(p).groupBy("qid", "pid").agg(F.sum("score").alias("score")) for p in partial]
    return reduce(DataFrame.unionByName, [*found, *merged])
