"""Retrieval quality: ``run(qid, doc_id, score)`` against ``qrels(qid, doc_id, rel)``.

Queries of the qrels without results count zero; results for queries outside the qrels are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranked(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Results of judged queries with ``rank`` and ``rel`` (0 where unjudged)."""
    judged = run.join(qrels.select("qid").distinct(), "qid", "left_semi")
    order = judged.withColumn("rank", F.expr("row_number() over (partition by qid order by score desc, doc_id)"))
    return order.join(qrels, ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def _per_query(run: DataFrame, qrels: DataFrame, value: str, ideal: DataFrame, formula: str) -> DataFrame:
    got = ranked(run, qrels).groupBy("qid").agg(F.expr(value).alias("got"))
    return ideal.join(got, "qid", "left").selectExpr("qid", f"cast({formula} as double) as value")


def ndcg(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    ideal = (
        qrels.withColumn("i", F.expr("row_number() over (partition by qid order by rel desc, doc_id)"))
        .groupBy("qid")
        .agg(F.expr(f"sum(case when i <= {k} then rel / log2(i + 1D) else 0D end)").alias("ideal"))
    )
    return _per_query(run, qrels, f"sum(case when rank <= {k} then rel / log2(rank + 1D) else 0D end)", ideal, "case when ideal > 0 then coalesce(got, 0D) / ideal else 0D end")


def _relevant(qrels: DataFrame) -> DataFrame:
    return qrels.groupBy("qid").agg(F.expr("sum(cast(rel > 0 as bigint))").alias("n"))


def recall(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    return _per_query(run, qrels, f"sum(cast(rel > 0 and rank <= {k} as bigint))", _relevant(qrels), "case when n > 0 then coalesce(got, 0) / n else 0D end")


def hits(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Number of relevant documents among the first k."""
    return _per_query(run, qrels, f"sum(cast(rel > 0 and rank <= {k} as bigint))", _relevant(qrels), "coalesce(got, 0)")


def average_precision(run: DataFrame, qrels: DataFrame) -> DataFrame:
    hit = ranked(run, qrels).where("rel > 0").withColumn("nth", F.expr("row_number() over (partition by qid order by rank)"))
    got = hit.groupBy("qid").agg(F.expr("sum(nth / rank)").alias("got"))
    return _relevant(qrels).join(got, "qid", "left").selectExpr("qid", "cast(case when n > 0 then coalesce(got, 0D) / n else 0D end as double) as value")


def evaluate(run: DataFrame, qrels: DataFrame, metrics: tuple[str, ...] = ("ndcg@10", "hits@1", "hits@2", "hits@3", "hits@4", "hits@5", "hits@10")) -> dict[str, float]:
    """Means over the queries of the qrels, computed in one job."""
    parts = []
    for m in metrics:
        name, _, k = m.partition("@")
        k = int(k) if k else 1_000_000_000
        frame = {"ndcg": lambda k=k: ndcg(run, qrels, k), "recall": lambda k=k: recall(run, qrels, k), "hits": lambda k=k: hits(run, qrels, k), "map": lambda: average_precision(run, qrels)}[name]()
        parts.append(frame.agg(F.avg("value").alias("v")).selectExpr(f"'{m}' as metric", "v"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return {r.metric: r.v or 0.0 for r in whole.collect()}


def first_occurrence(queries: DataFrame) -> DataFrame:
    """``(qid, text, first_qid)``: repeated query texts point to their first occurrence."""
    return queries.withColumn("first_qid", F.expr("min(qid) over (partition by text)"))


def add_duplicates(run: DataFrame, queries: DataFrame) -> DataFrame:
    """Results of first occurrences handed to every repetition."""
    return first_occurrence(queries).select("qid", "first_qid").join(run.withColumnRenamed("qid", "first_qid"), "first_qid").drop("first_qid")


def without_self(run: DataFrame) -> DataFrame:
    """Drops the result whose document is the query itself."""
    return run.where("doc_id <> qid")


def latency(samples: DataFrame) -> DataFrame:
    """p50, p95, p99, mean, min and max of ``seconds``."""
    return samples.selectExpr(
        "percentile(seconds, 0.5) as p50", "percentile(seconds, 0.95) as p95", "percentile(seconds, 0.99) as p99", "avg(seconds) as mean", "min(seconds) as min", "max(seconds) as max"
    )
