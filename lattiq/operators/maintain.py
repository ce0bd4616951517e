"""Mutation and maintenance on immutable tables.

Every posting carries the generation of its document (``gen``).  ``docs(pid, gen, deleted)`` says which
generation of a document is live; adding, replacing and deleting write new rows or new ``docs``, never in place.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """Postings of the live generation; tombstoned documents are still counted until compaction."""
    return postings.join(docs.select("pid", "gen"), ["pid", "gen"], "left_semi")


def delete(docs: DataFrame, pids: DataFrame) -> DataFrame:
    """Marks documents as deleted; unknown ids and repeated calls change nothing."""
    return docs.join(pids.select("pid").distinct().withColumn("hit", F.lit(True)), "pid", "left").withColumn("deleted", F.expr("deleted or coalesce(hit, false)")).drop("hit")


def compacted(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """Live postings of documents that are not deleted."""
    return postings.join(docs.where("not deleted").select("pid", "gen"), ["pid", "gen"], "left_semi")


def added(postings: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows and new rows; the order inside a cell is settled when they are written."""
    return postings.unionByName(new)


def replaced(postings: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the replaced documents give way to their new rows."""
    return postings.join(new.select("pid").distinct(), "pid", "left_anti").unionByName(new)


def renumbered(postings: DataFrame, mapping: DataFrame) -> DataFrame:
    """Postings under the dense numbers of ``build.prune_empty`` (one row per centroid: broadcast)."""
    return postings.join(F.broadcast(mapping), "cid").withColumn("cid", F.col("new_cid")).drop("new_cid")


def outliers(norms: DataFrame, threshold: float) -> DataFrame:
    return norms.where(F.col("norm") > threshold)


def growth(n_outliers: int, n_centroids: int, min_outliers: int = 50, max_growth_rate: float = 0.1, per_centroid: int = 256) -> int:
    """Centroids to add for the outliers of an addition; 0 below the minimum, a power of two otherwise."""
    if n_outliers < min_outliers:
        return 0
    wanted = min(math.ceil(n_outliers / per_centroid), max(1, int(n_centroids * max_growth_rate)))
    return 1 << (max(1, min(wanted, n_outliers)).bit_length() - 1)


def blended(old: float, old_count: int, new: float, new_count: int) -> float:
    """Thresholds weighted by the number of embeddings behind them."""
    total = old_count + new_count
    return (old * old_count + new * new_count) / total if total else new


def memory_estimate(n_embeddings: int, n_centroids: int, dim: int, nbits: int) -> dict[str, int]:
    """Bytes by component of a loaded index, and their total."""
    parts = {
        "centroids": n_centroids * dim * 4,
        "bucket_weights": (1 << nbits) * 4,
        "pids": n_embeddings * 8,
        "residuals": n_embeddings * dim * nbits // 8,
        "sizes_and_offsets": n_centroids * 8 + (n_centroids + 1) * 8,
    }
    return parts | {"total": sum(parts.values())}
